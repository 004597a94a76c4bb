"""Halo exchange: the one shuffle behind every neighbourhood operator.

Each cell is sent to its own block and to the blocks whose halo holds it, so a
block sees every neighbour it needs. With blocks of 256 and a halo of 3 that
is 1.05 copies per cell. A group never exceeds ``(tile_size + 2 * halo)^2``
cells whatever the size or skew of the layers, because the block address is
part of the key. The kernels are numpy; Spark does the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.model import Layout


def halo_copies(cells: DataFrame, layout: Layout, halo: int) -> DataFrame:
    """Add ``brow, bcol``: one row per block that needs the cell. Cells outside the layout raise."""

    def blocks(axis: str, size: int) -> Column:
        t = layout.tile_size
        last = (size - 1) // t
        # "div" rounds towards zero, so positions before the first block clamp to 0 as wanted.
        return F.expr(f"sequence(greatest(0L, ({axis} - {halo}) div {t}), least({last}L, ({axis} + {halo}) div {t}))")

    inside = layout.checked(cells)
    if halo == 0:
        t = layout.tile_size
        return inside.withColumns({"brow": F.expr(f"row div {t}"), "bcol": F.expr(f"col div {t}")})
    return inside.withColumn("brow", F.explode(blocks("row", layout.rows))).withColumn(
        "bcol", F.explode(blocks("col", layout.cols))
    )


def gather(cells: DataFrame, side: int, lead: int, width: int, inputs: Sequence[str]) -> DataFrame:
    """One row per block: the places ``at`` of its cells in the padded square, and their values.

    The JVM builds the arrays; handing Python rows of arrays costs a third of handing it rows of
    cells. A task holds at most ``spark.sql.objectHashAggregate.sortBased.fallbackThreshold`` (128)
    open blocks before it sorts and spills, so its memory is bounded by the tile size.
    """
    at = f"cast((row - brow * {side} + {lead}) * {width} + col - bcol * {side} + {lead} as int)"
    known = [F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))).alias(n) for n in inputs]
    return (
        cells.select("layer", "brow", "bcol", F.expr(at).alias("at"), *known)
        .groupBy("layer", "brow", "bcol")
        .agg(*[F.collect_list(n).alias(n) for n in ("at", *inputs)])
    )


def map_blocks(gathered: DataFrame, inputs: Sequence[str], run, fields: Sequence[T.StructField]) -> DataFrame:
    """Call ``run(brow, bcol, at, values)`` per gathered block; it returns equally long arrays.

    The result has one row per block: its key and one array column per field.
    """
    arrow = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64()}
    kinds = [(f.name, arrow[type(f.dataType)]) for f in fields]
    key = [("layer", T.StringType()), ("brow", T.LongType()), ("bcol", T.LongType())]
    schema = T.StructType(
        [T.StructField(n, k) for n, k in key] + [T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields]
    )
    given = list(inputs)

    def call(batches):
        for batch in batches:
            offsets = batch.column("at").offsets.to_numpy()
            start = offsets[0]
            flat = {n: batch.column(n).flatten().to_numpy() for n in ("at", *given)}
            brows, bcols = batch.column("brow").to_pylist(), batch.column("bcol").to_pylist()
            for i in range(batch.num_rows):
                part = slice(offsets[i] - start, offsets[i + 1] - start)
                found = run(brows[i], bcols[i], flat["at"][part], {n: flat[n][part] for n in given})
                lists = []
                for name, kind in kinds:
                    values = pa.array(found[name], kind, from_pandas=True)
                    lists.append(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values))
                head = [batch.column(n).slice(i, 1) for n, _ in key]
                yield pa.RecordBatch.from_arrays(head + lists, names=schema.names)

    return gathered.mapInArrow(call, schema)


def spread_arrays(blocks: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per array element: the layer and the named columns. In generated code, no shuffle."""
    first, rest = names[0], list(names[1:])
    rows = blocks.select("layer", F.posexplode(first).alias("i_", first), *rest)
    return rows.select("layer", first, *[F.get(n, F.col("i_")).alias(n) for n in rest])


def evaluate(layout, halo, kernel, arrays, row0, col0, keep, first_input, first_output):
    """Run the kernel on one padded block; return its outputs and the mask of cells to keep."""
    t = layout.tile_size
    ry = np.arange(row0 - halo, row0 + t + halo)
    cx = np.arange(col0 - halo, col0 + t + halo)
    inside = ((ry >= 0) & (ry < layout.rows))[:, None] & ((cx >= 0) & (cx < layout.cols))[None, :]
    with np.errstate(all="ignore"):
        found = kernel(arrays, inside, (row0, col0))
    core = (slice(halo, halo + t), slice(halo, halo + t))
    mask = inside[core]
    if keep == "known":
        mask = mask & ~np.isnan(arrays[first_input][core])
    elif keep == "filled":
        mask = mask & ~np.isnan(found[first_output])
    return found, mask


def per_block(
    cells: DataFrame,
    layout: Layout,
    halo: int,
    kernel: Callable[..., dict[str, np.ndarray]],
    outputs: Sequence[str],
    inputs: Sequence[str] = ("value",),
    keep: str = "known",
) -> DataFrame:
    """Run ``kernel`` on every block.

    ``kernel(arrays, inside, origin)`` gets one padded array per input column, a mask of the
    cells that belong to the raster and the block's first ``(row, col)``; it returns one unpadded
    array per output. ``keep="known"`` returns the cells whose first input is known,
    ``"filled"`` those whose first output is known, ``"all"`` every cell of the raster.
    """
    t = layout.tile_size
    width = t + 2 * halo
    names, given = list(outputs), list(inputs)

    def run(brow, bcol, at, values):
        row0, col0 = brow * t, bcol * t
        arrays = {n: square_of(at, values[n], width) for n in given}
        found, mask = evaluate(layout, halo, kernel, arrays, row0, col0, keep, given[0], names[0])
        r, c = np.nonzero(mask)
        return {"row": r + row0, "col": c + col0, **{n: found[n][r, c] for n in names}}

    fields = [T.StructField("row", T.LongType()), T.StructField("col", T.LongType())]
    fields += [T.StructField(n, T.DoubleType()) for n in names]
    padded = halo_copies(cells.select("layer", "row", "col", *given), layout, halo)
    mapped = map_blocks(gather(padded, t, halo, width, given), given, run, fields)
    return spread_arrays(mapped, ["row", "col", *names])


def square_of(at: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """The padded square of a block; NaN where nothing is known."""
    out = np.full(width * width, np.nan)
    out[at] = values
    return out.reshape(width, width)
