"""Helpers shared by the operators: Arrow batches in bounded chunks, words, hashes, folds."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import cut_lineage, ensure_checkpoint_dir

#: ASCII white space, space and \t \n \v \f \r: what ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
CHUNK_BYTES = 4 << 20


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of the text column each; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def joined_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and where each text starts (one entry more than texts)."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bundled(blocks: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """``block, bundle``: the rows of each block in compressed pieces of about ``most`` bytes of text, for a shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", most):
            block = chunk.column("block").to_numpy()
            for b in np.unique(block).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, chunk.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(chunk.filter(pa.array(block == b)))
                yield record(arrow_schema("block long, bundle binary"), block=[b], bundle=[sink.getvalue().to_pybytes()])

    return blocks.mapInArrow(pack, "block long, bundle binary")


def unbundled(table: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for bundle in table.column("bundle"):
        yield from pa.ipc.open_stream(bundle.as_buffer())


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def arrow_schema(fields: str) -> pa.Schema:
    """"name type, ..." with Spark's names of simple types, as an Arrow schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (part.strip().split(" ") for part in fields.split(","))])


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder, so what follows neither repeats it nor depends on one executor."""
    return cut_lineage(df)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables that several jobs read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Written as Parquet to the shared checkpoint folder and read again, and the folder: smaller than a checkpoint."""
    path = shared_folder(df.sparkSession, name)
    # room for a dictionary of the different values of a row group, as of hashed words
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored_by(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Written once to the shared checkpoint folder, in buckets of the key, so that grouping by it moves nothing.

    Tasks write their own rows: where they hold whole keys, there are no more files than keys. The files stay like those
    of a checkpoint; the name goes at once, as the plan knows the folder.
    """
    spark = df.sparkSession
    name, path = f"stored_{uuid.uuid4().hex}", shared_folder(spark, "stored")
    df.write.format("parquet").option("path", path).option("compression", "none").bucketBy(buckets, key).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_folder`` has named, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
