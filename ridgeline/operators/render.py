"""From values to colours and picture tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import colour
from ridgeline.operators.reshape import pyramid_blocks
from ridgeline.operators.stats import distinct_breaks, quantile_breaks


def colorize(cells: DataFrame, ramp: str) -> DataFrame:
    """Add ``rgba`` by a fixed ramp; a constant of the code, so no join."""
    if ramp not in colour.RAMPS:
        raise ValueError(f"unknown ramp: {ramp}")
    return cells.withColumn("rgba", colour.classify(F.col("value"), colour.RAMPS[ramp]))


def colorize_by_quantiles(
    cells: DataFrame, run: str = "green-red-orange", reference: DataFrame | None = None
) -> DataFrame:
    """Add ``rgba`` by the quantile breaks of the whole job, so tiles show no seams.

    ``reference`` is the layer to take breaks from (the base level of a pyramid), by default the
    cells themselves. The breaks are one array of at most ten numbers, read as a scalar subquery.
    """
    if run not in colour.RUNS:
        raise ValueError(f"unknown colour run: {run}")
    codes = colour.RUNS[run]
    breaks = distinct_breaks(quantile_breaks(reference if reference is not None else cells, len(codes), ()), ())
    stops = breaks.select("breaks").scalar()
    painted = cells.withColumn("b_", stops)
    below = F.size(F.filter("b_", lambda b: b < F.col("value")))
    # Fewer distinct breaks than colours: spread them over the run.
    slot = F.when(F.size("b_") == 1, 0).otherwise(
        F.expr(f"(size(filter(b_, b -> b < value)) * {len(codes) - 1}) div (size(b_) - 1)")
    )
    table = F.array(*[F.lit(c).cast("long") for c in codes])
    chosen = F.when(F.col("value").isNotNull() & (below < F.size("b_")), F.try_element_at(table, (slot + 1).cast("int")))
    return painted.withColumn("rgba", chosen).drop("b_")


def paint(cells: DataFrame, op: str, reference: DataFrame | None = None) -> DataFrame:
    """The picture colours of a job: its fixed ramp, or a run stretched over quantiles."""
    if op in colour.RAMP_BY_OP:
        return colorize(cells, colour.RAMP_BY_OP[op])
    return colorize_by_quantiles(cells, colour.RUN_BY_OP.get(op, "green-red-orange"), reference=reference)


def paint_blocks(levels: DataFrame, op: str, reference: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Blocks with ``rgba``: the colour of each cell, 0 where there is none. ``paint`` on arrays.

    ``reference`` has the cells whose quantiles stretch a colour run; they are read again if they are ``stored``.
    """
    if op in colour.RAMP_BY_OP:
        breaks, codes = map(np.asarray, zip(*sorted(colour.RAMPS[colour.RAMP_BY_OP[op]])))
    else:
        if reference is None:
            raise ValueError(f"the colours of {op} need a reference")
        run = colour.RUNS[colour.RUN_BY_OP.get(op, "green-red-orange")]
        row = distinct_breaks(quantile_breaks(reference, len(run), (), stored), ()).first()  # at most ten numbers
        breaks = np.asarray(row["breaks"] if row and row["breaks"] else [], float)
        # Fewer distinct breaks than colours: spread them over the run.
        codes = np.asarray(run)[np.arange(len(breaks)) * (len(run) - 1) // max(1, len(breaks) - 1)]
    table = np.append(codes, 0).astype(np.int64)
    schema = T.StructType(levels.schema.fields[:-1] + [T.StructField("rgba", T.ArrayType(T.LongType()))])

    def fill(batches):
        for batch in batches:
            lists = batch.columns[-1]
            cells = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            colours = np.where(np.isnan(cells), 0, table[np.searchsorted(breaks, cells, "left")])
            ends = pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32())
            packed = pa.ListArray.from_arrays(ends, pa.array(colours))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=schema.names)

    return levels.mapInArrow(fill, schema)


def block_tiles(painted: DataFrame, job_id: str) -> DataFrame:
    """``picture_tiles`` of painted blocks on world-wide zoom grids: a block is a tile."""
    shown = painted.where(F.exists("rgba", lambda c: c != 0))
    return shown.select(F.lit(job_id).alias("job_id"), "z", F.col("bcol").alias("x"), F.col("brow").alias("y"), "rgba")


def tile_on_demand(stored: DataFrame, op: str, tile_size: int, base_zoom: int, z: int, x: int, y: int, reference: DataFrame | None = None) -> DataFrame:
    """One picture tile from the stored blocks of the base zoom: only those that lie below it are read, and no pyramid is built."""
    below = 1 << (base_zoom - z)
    under = lambda axis, at: F.col(axis).between(at * below, (at + 1) * below - 1)
    blocks = stored.where(under("brow", y) & under("bcol", x))
    return block_tiles(paint_blocks(pyramid_blocks(blocks, tile_size, base_zoom, z, every=False), op, reference), "")


def picture_tiles(painted: DataFrame, job_id: str, tile_size: int = 256) -> DataFrame:
    """``job_id, z, x, y, rgba`` with one array of ``tile_size^2`` colours; 0 is transparent.

    ``painted`` has ``z, row, col, rgba`` on world-wide zoom grids.
    """
    t = tile_size
    step = max(1, 2**22 // (t * t))
    placed = painted.where("rgba IS NOT NULL").select(
        "z",
        F.expr(f"col div {t}").alias("x"),
        F.expr(f"row div {t}").alias("y"),
        F.expr(f"cast((row % {t}) * {t} + col % {t} as int)").alias("at"),
        "rgba",
    )
    schema = T.StructType(
        [
            T.StructField("z", T.IntegerType()),
            T.StructField("x", T.LongType()),
            T.StructField("y", T.LongType()),
            T.StructField("rgba", T.ArrayType(T.LongType())),
        ]
    )

    def fill(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                at, colours = (batch.column(n).flatten().to_numpy() for n in ("at", "rgba"))
                sizes = np.diff(batch.column("at").offsets.to_numpy())
                pictures = np.zeros((batch.num_rows, t * t), dtype=np.int64)
                pictures[np.repeat(np.arange(batch.num_rows), sizes), at] = colours
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (t * t))
                cells = pa.ListArray.from_arrays(ends, pa.array(pictures.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("z", "x", "y")] + [cells], names=schema.names)

    # A tile has at most tile_size^2 cells; tiles are filled some four million colours at a time.
    tiles = placed.groupBy("z", "x", "y").agg(F.collect_list("at").alias("at"), F.collect_list("rgba").alias("rgba"))
    return tiles.mapInArrow(fill, schema).select(F.lit(job_id).alias("job_id"), "z", "x", "y", "rgba")
