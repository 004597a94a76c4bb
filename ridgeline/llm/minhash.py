"""MinHash near-duplicates: links at an exact Jaccard similarity of word shingles, and their components.

1. One pass over the whole texts leaves for each document the size and a 128-bit fingerprint of its shingle set, and a
   64-bit key for each band of minima of universal hashes. Documents with equal sets are one class from here on.
2. Classes that share a band key are candidates. Candidates that reach each other form a cluster (components by
   alternating stars); it is cut by set size, and large parts by hash, into blocks that fit a task.
3. Every pair of blocks of neighbouring sizes meets in one task, where pairs that share a band are verified on their
   full sets. Only links come out, at most a spanning forest for each pair of blocks, so large groups stay linear.
4. Components of the links, again by alternating large-star and small-star.

The number of bands is chosen so that a pair exactly at the threshold is missed with a chance below 1 in 100,000.

Odd cases: null or empty texts and texts without words have the empty set and link with nothing; fewer words than a
shingle make one shingle of all of them; rows that repeat an id count as one document; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, chunks, kept, mix64, record, text_bytes
from ridgeline.llm.graph import components, lookup

ROWS = 6
#: A block holds about so many bytes of sets.
BLOCK_BYTES = 4 << 20


class WordHashes(dict):
    """Word -> 64-bit hash, remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, hashes: WordHashes, size: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a text, A-Z lowered."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def bands_for(similarity: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(1e-5) / math.log(1 - similarity**rows))


def family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of the universal hashes x -> a * x + b mod 2^32."""
    rng = np.random.default_rng(20240229)
    return (rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]


def band_keys(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int = ROWS) -> np.ndarray:
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[None, :]
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, x.shape[1], 1024):
        part = a * x[:, k : k + 1024]
        part += b
        np.minimum(low, part.min(axis=1), out=low)
    key = np.arange(len(a) // rows, dtype=np.uint64)
    for column in low.reshape(-1, rows).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key


_hashes = WordHashes()


def sketches(docs: DataFrame, bands: int, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, the fingerprint fa, fb and the band keys of every document; an empty set has no keys."""
    fields = "doc_id long, n_shingles long, fa long, fb long, bands array<long>"
    schema = arrow_schema(fields)
    a, b = family(bands * ROWS)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 2 << 20):
            sets = [shingle_set(t, _hashes, shingle) for t in text_bytes(chunk.column("text"))]
            spread = [mix64(s) for s in sets]
            yield record(
                schema,
                doc_id=chunk.column("doc_id"),
                n_shingles=[len(s) for s in sets],
                fa=np.asarray([s.sum(dtype=np.uint64) for s in spread], np.uint64).view(np.int64),
                fb=np.asarray([mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) for s in spread], np.uint64).view(np.int64),
                bands=[band_keys(s, a, b).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(sketch, fields)


def clusters(reps: DataFrame) -> DataFrame:
    """``id, component``: classes that reach each other over shared band keys."""
    rows = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("low"), F.count("id").alias("n")).where("n > 1")
    star = lookup(rows, kept(shared), ["key"], ["low"], "inner").where("id != low")
    return components(star.select(F.col("id").alias("a"), F.col("low").alias("b")))


def blocks(reps: DataFrame, cluster: DataFrame, percent: int) -> DataFrame:
    """doc_id, bands and the pairs of blocks that a document meets in, as arrays ``pair`` of texts and ``side``.

    Sizes of one class differ by less than the threshold allows, so links join equal or neighbouring classes.
    """
    size_class = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(percent / 100) + 1e-9)).cast("long")
    members = reps.join(cluster.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("size_class", size_class)
    members = kept(members.select("doc_id", "bands", "component", "size_class", "n_shingles"))
    sizes = members.groupBy("component", "size_class").agg(F.count("doc_id").alias("n"), F.max("n_shingles").alias("most"))
    each = F.greatest(F.lit(2), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("most")))).cast("long")
    parts = sizes.withColumn("parts", F.ceil(F.col("n") / F.least(each, F.lit(256)))).select("component", "size_class", "n", "parts")
    above = parts.select("component", (F.col("size_class") - 1).alias("size_class"), F.col("parts").alias("above"))
    below = parts.select("component", (F.col("size_class") + 1).alias("size_class"), F.col("parts").alias("below"))
    around = kept(parts.join(above, ["component", "size_class"], "left").join(below, ["component", "size_class"], "left").na.fill(0, ["above", "below"]))
    placed = lookup(members, around, ["component", "size_class"], ["parts", "above", "below"])
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    name = lambda c, low, c2, high: F.concat_ws("-", F.col("component"), c, low, c2, high)
    c, up, down = F.col("size_class"), F.col("size_class") + 1, F.col("size_class") - 1
    meets = F.concat(
        F.transform(upto(F.col("parts")), lambda q: F.struct(name(c, F.least(part, q), c, F.greatest(part, q)).alias("pair"), F.when(q >= part, 0).otherwise(1).alias("side"))),
        F.transform(upto(F.col("above")), lambda q: F.struct(name(c, part, up, q).alias("pair"), F.lit(0).alias("side"))),
        F.transform(upto(F.col("below")), lambda q: F.struct(name(down, q, c, part).alias("pair"), F.lit(1).alias("side"))),
    )
    return placed.select("doc_id", "bands", meets.alias("meets"))


def same_block(pair: str) -> bool:
    """Of a pair of blocks: are both the same?"""
    parts = pair.rsplit("-", 4)[1:]
    return parts[:2] == parts[2:]


def verified_links(docs: DataFrame, placed: DataFrame, percent: int, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``a, b``: for each pair of blocks a spanning forest of the pairs at ``percent`` or more that share a band."""
    fields = "doc_id long, sets binary, bands array<long>, pair string, side int"

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text", 1 << 20):
            out: dict[str, list] = {f.name: [] for f in arrow_schema(fields)}
            for key, text, bands, meets in zip(chunk.column("doc_id").to_pylist(), text_bytes(chunk.column("text")), chunk.column("bands").to_pylist(), chunk.column("meets").to_pylist()):
                held = shingle_set(text, _hashes, shingle).tobytes()
                for meet in meets:
                    for name, value in (("doc_id", key), ("sets", held), ("bands", bands), ("pair", meet["pair"]), ("side", meet["side"])):
                        out[name].append(value)
            yield record(arrow_schema(fields), **out)

    def verify(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("sets").to_pylist()]
        keys = np.asarray(table.column("bands").to_pylist(), np.int64)
        alone = same_block(table.column("pair")[0].as_py())
        root = list(range(len(ids)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for x in range(len(ids)):
            others = (keys[x + 1 :] == keys[x]).any(axis=1)
            if not alone:
                others &= side[x + 1 :] != side[x]
            for y in (x + 1 + np.flatnonzero(others)).tolist():
                small, large = sorted((len(sets[x]), len(sets[y])))
                if 100 * small < percent * large or find(x) == find(y):
                    continue
                both = np.sort(np.concatenate([sets[x], sets[y]]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (small + large - common):
                    root[find(y)] = find(x)
                    links.append((ids[x], ids[y]))
        pairs = np.asarray(links, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.join(placed, "doc_id").select("doc_id", "text", "bands", "meets").mapInArrow(expand, fields)
    return rows.groupBy("pair").applyInArrow(verify, "a long, b long")


def deduplicate(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (component_id = doc_id)."""
    sketch = kept(sketches(docs, bands_for(percent / 100), shingle, id_col, text_col))
    some = sketch.where("n_shingles > 0")
    classes = kept(some.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"), F.count("doc_id").alias("n")))
    reps = some.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").dropDuplicates(["doc_id"])
    reps = kept(reps.select("doc_id", "n_shingles", "bands"))
    placed = kept(blocks(reps, kept(clusters(reps)), percent))
    links = verified_links(docs, placed, percent, shingle, id_col, text_col)
    found = components(links).withColumnRenamed("id", "rep")
    known = classes.join(found, "rep", "left").select("fa", "fb", "n", F.coalesce("component", "rep").alias("component"))
    labelled = lookup(sketch.select("doc_id", "n_shingles", "fa", "fb"), kept(known), ["fa", "fb"], ["component"])
    own = F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), F.col("doc_id"))
    out = labelled.select("doc_id", "n_shingles", own.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
