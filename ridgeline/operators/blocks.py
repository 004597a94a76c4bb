"""The stored form of a large layer: one row per block, ``cells`` row-major.

A block row carries 65,536 cells in one array, so a shuffle moves array bytes
instead of addressed cells. Neighbourhood operators send each block's edge
strips to the blocks around it: one shuffle of ``1 + 4 * halo / tile_size``
times the layer. Local algebra needs no Python at all.

Of a layer whose blocks know little, the sparse form holds the known cells only: ``cells`` their values, ``places`` where
in the block they lie. ``to_blocks`` makes it on demand; ``reshape.mosaic_blocks`` and ``to_cells`` take either form.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.model import BLOCK_SCHEMA, Layout
from ridgeline.operators.neighbours import evaluate, gather, map_blocks, square_of

BLOCK_KEY = ["layer", "brow", "bcol"]


def table_of(rows: Sequence[tuple], schema: T.StructType) -> pa.Table:
    """Rows as an Arrow table; arrays become lists with NaN as NULL."""
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}
    arrays = []
    for field, values in zip(schema.fields, columns):
        if isinstance(field.dataType, T.ArrayType):
            flat = np.concatenate(values) if values else np.zeros(0)
            ends = np.cumsum([0] + [len(v) for v in values])
            inner = pa.array(flat, from_pandas=True)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner))
        else:
            arrays.append(pa.array(values, kinds[type(field.dataType)]))
    return pa.Table.from_arrays(arrays, names=schema.names)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The float arrays of a list column, NULL elements as NaN."""
    out = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        flat = chunk.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        sizes = np.diff(chunk.offsets.to_numpy())
        out.extend(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    return out


def to_blocks(cells: DataFrame, layout: Layout, sparse: bool = False) -> DataFrame:
    """Gather cells into blocks (one shuffle on the block key), whole ones or of the known cells only."""
    t = layout.tile_size

    def run(brow, bcol, at, values):
        return {"cells": square_of(at, values["value"], t).ravel()}

    placed = layout.checked(cells).withColumns({"brow": F.expr(f"row div {t}"), "bcol": F.expr(f"col div {t}")})
    if sparse:
        at, value = F.expr(f"cast((row - brow * {t}) * {t} + col - bcol * {t} as int)"), F.col("value").cast("double")
        known = value.isNotNull() & ~F.isnan(value)
        given = placed.select(*BLOCK_KEY, F.when(known, at).alias("places"), F.when(known, value).alias("cells"))
        # a task holds too few cells of such a block for lists to be worth making before the exchange
        return given.repartition(*BLOCK_KEY).groupBy(*BLOCK_KEY).agg(*[F.collect_list(n).alias(n) for n in ("places", "cells")])
    field = T.StructField("cells", T.DoubleType())
    return map_blocks(gather(placed, t, 0, t, ["value"]), ["value"], run, [field])


def to_cells(blocks: DataFrame, layout: Layout, column: str = "cells") -> DataFrame:
    """Spread blocks into cells of the raster; NODATA gives no row, a value beyond the layout raises. No shuffle."""
    t = layout.tile_size
    if "places" in blocks.columns:
        known = blocks.select(*BLOCK_KEY, F.posexplode("places").alias("i_", "at"), F.col(column).alias("known_"))
        cells = known.select(*BLOCK_KEY, "at", F.get("known_", F.col("i_")).alias("value"))
    else:
        cells = blocks.select(*BLOCK_KEY, F.posexplode(column).alias("at", "value"))
    return layout.checked(
        cells.where("value IS NOT NULL").select(
            "layer",
            F.expr(f"brow * {t} + at div {t}").alias("row"),
            F.expr(f"bcol * {t} + at % {t}").alias("col"),
            "value",
        )
    )


def local(blocks: DataFrame, change: Callable[[Column], Column], column: str = "cells") -> DataFrame:
    """Apply a Column function to every cell of every block, in the JVM."""
    return blocks.withColumn(column, F.transform(column, change))


def combine(a: DataFrame, b: DataFrame, join: Callable[[Column, Column], Column], how: str = "inner") -> DataFrame:
    """Cell-wise combination of two layers: an equi-join on the block, then ``zip_with``.

    ``inner`` drops blocks that either side lacks; with ``left`` the cells of a block that ``b`` lacks meet NULL.
    """
    right = b.select(*BLOCK_KEY, F.col("cells").alias("other"))
    joined = a.join(right, BLOCK_KEY, how).withColumn("other", F.coalesce("other", F.array().cast("array<double>")))
    return joined.select(*BLOCK_KEY, F.zip_with("cells", "other", join).alias("cells"))


def focal(
    blocks: DataFrame,
    layout: Layout,
    halo: int,
    kernel: Callable[..., dict[str, np.ndarray]],
    outputs: Sequence[str],
    keep: str = "known",
) -> DataFrame:
    """The block form of ``per_block``: same kernels, one array column per output.

    A block sends each block that its cells reach the strip which that one needs: the adjoining ones where the halo is
    no wider than a block, further rings of blocks where it is.
    """
    t, names = layout.tile_size, list(outputs)
    rings = -(-halo // t)
    last_row, last_col = (layout.rows - 1) // t, (layout.cols - 1) // t
    strips = T.StructType(
        BLOCK_SCHEMA.fields[:3]
        + [
            T.StructField("dr", T.IntegerType()),
            T.StructField("dc", T.IntegerType()),
            T.StructField("cells", T.ArrayType(T.DoubleType())),
        ]
    )
    # Part of a block that the block ``d`` further on needs, and its place in the padded array there.
    part = {d: slice(max(0, d * t - halo), min(t, d * t + t + halo)) for d in range(-rings, rings + 1)}
    place = {d: slice(p.start + halo - d * t, p.stop + halo - d * t) for d, p in part.items()}

    def cut(batches):
        for batch in batches:
            rows = []
            keys = zip(*(batch.column(k).to_pylist() for k in BLOCK_KEY))
            for (layer, brow, bcol), flat in zip(keys, _arrays(batch.column("cells"))):
                grid = flat.reshape(t, t)
                for dr in part:
                    for dc in part:
                        if 0 <= brow + dr <= last_row and 0 <= bcol + dc <= last_col:
                            piece = grid[part[dr], part[dc]].ravel()
                            rows.append((layer, brow + dr, bcol + dc, dr, dc, piece))
            for out in table_of(rows, strips).to_batches():
                yield out

    schema = T.StructType(
        BLOCK_SCHEMA.fields[:3] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]
    )

    def run(key, table):
        layer, brow, bcol = (k.as_py() for k in key)
        grid = np.full((t + 2 * halo, t + 2 * halo), np.nan)
        where = zip(table.column("dr").to_pylist(), table.column("dc").to_pylist())
        for (dr, dc), piece in zip(where, _arrays(table.column("cells"))):
            slot = grid[place[dr], place[dc]]
            slot[...] = piece.reshape(slot.shape)
        found, mask = evaluate(
            layout, halo, kernel, {"value": grid}, brow * t, bcol * t, keep, "value", names[0]
        )
        if not mask.any():
            return table_of([], schema)
        return table_of([(layer, brow, bcol, *(np.where(mask, found[n], np.nan).ravel() for n in names))], schema)

    pieces = blocks.select(*BLOCK_KEY, "cells").mapInArrow(cut, strips)
    # At most (2 * rings + 1)^2 pieces per block: nine where the halo is no wider than a block.
    return pieces.groupBy(*BLOCK_KEY).applyInArrow(run, schema)

