"""Stored layers from one grid to another, block to block.

A source block cuts out, for each target block that samples it, the rows and columns which that one samples, and sends
them there; the target block puts its pieces together and samples them as one array. A piece is never larger than twice
a target block in each direction, however the cell sizes differ, and a coarse block serves each of many fine ones with
the few cells it needs: no cell has a row or a key of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import geo
from ridgeline.model import BLOCK_SCHEMA, Layout
from ridgeline.operators.blocks import BLOCK_KEY, table_of

_PIECES = T.StructType(
    BLOCK_SCHEMA.fields[:3] + [T.StructField("srow", T.LongType()), T.StructField("scol", T.LongType()), T.StructField("cells", T.ArrayType(T.DoubleType()))]
)
#: Cells of the rows that make a batch.
BATCH_CELLS = 1 << 19
SPARSE = T.StructType(BLOCK_SCHEMA.fields[:3] + [T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("cells", T.ArrayType(T.DoubleType()))])
LEVELS = T.StructType([T.StructField("z", T.IntegerType())] + BLOCK_SCHEMA.fields)


def array_of(scalar: pa.Scalar) -> np.ndarray:
    """The doubles of one list, NULL as NaN."""
    return scalar.values.to_numpy(zero_copy_only=False).astype(np.float64)


def batches_of(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some megabytes, so that small blocks cost no batch each; NaN becomes NULL."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(v.size for v in row if isinstance(v, np.ndarray))
        if size >= BATCH_CELLS:
            yield from table_of(held, schema).to_batches()
            held, size = [], 0
    if held:
        yield from table_of(held, schema).to_batches()


def each_row(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named plain values of each row, then its batch and its place there."""
    for batch in batches:
        for i, row in enumerate(zip(*(batch.column(n).to_pylist() for n in names))):
            yield *row, batch, i


class _Axis:
    """Rows, or columns: which positions of the source a target block samples. Both projections keep the axes apart."""

    def __init__(self, maps, start, step, size, block, target_start, target_step, target_size, target_block, ahead):
        self.into, self.back = maps
        self.start, self.step, self.size, self.block = start, step, size, block
        self.target_start, self.target_step, self.target_size, self.target_block = target_start, target_step, target_size, target_block
        self.ahead, self.shift = ahead, 0.0 if ahead else 0.5

    def positions(self, target: int) -> np.ndarray:
        """Positions in source cells of the target block's cells, as far as the target grid reaches."""
        first = target * self.target_block
        index = np.arange(first, min(first + self.target_block, self.target_size))
        with np.errstate(all="ignore"):
            return (self.back(self.target_start + self.target_step * (index + 0.5)) - self.start) / self.step - 0.5 + self.shift

    def sampled(self, target: int) -> np.ndarray:
        """The source rows (columns) that the target block samples, rising."""
        at = np.floor(self.positions(target))
        at = at[np.isfinite(at)].astype(np.int64)
        both = np.unique(np.concatenate([at, at + 1]) if self.ahead else at)
        return both[(both >= 0) & (both < self.size)]

    def targets(self, source: int) -> range:
        """The target blocks that may sample this source block."""
        ends = np.array([source * self.block - self.ahead, (source + 1) * self.block], dtype=float)
        with np.errstate(all="ignore"):
            edges = self.into(self.start + self.step * (ends - self.shift + 0.5))
        index = np.sort((edges - self.target_start) / self.target_step - 0.5)
        first = max(0, math.floor(index[0]) - 1) if np.isfinite(index[0]) else 0
        last = min(self.target_size - 1, math.ceil(index[1]) + 1) if np.isfinite(index[1]) else self.target_size - 1
        return range(first // self.target_block, last // self.target_block + 1) if first <= last else range(0)

    def part(self, sampled: np.ndarray, source: int) -> slice:
        """Which of the sampled rows (columns) lie in the source block."""
        return slice(*np.searchsorted(sampled, [source * self.block, (source + 1) * self.block]).tolist())


def _axes(source: Layout, target: Layout, ahead: int) -> tuple[_Axis, _Axis]:
    (into_x, into_y), (back_x, back_y) = geo.axis_maps(source.crs, target.crs), geo.axis_maps(target.crs, source.crs)
    s, t = source, target
    rows = _Axis((into_y, back_y), s.y0, -s.cell_h, s.rows, s.tile_size, t.y0, -t.cell_h, t.rows, t.tile_size, ahead)
    cols = _Axis((into_x, back_x), s.x0, s.cell_w, s.cols, s.tile_size, t.x0, t.cell_w, t.cols, t.tile_size, ahead)
    return rows, cols


def resample_blocks(stored: DataFrame, source: Layout, target: Layout, method: str = "bilinear") -> DataFrame:
    """Stored blocks of the source as blocks of the target grid, by inverse mapping: no holes.

    ``nearest`` takes the cell that holds the target's centre; ``bilinear`` shares the weights of NODATA neighbours among
    the known ones. Target blocks without any known cell have no row.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method: {method}")
    ahead = 1 if method == "bilinear" else 0
    rows, cols = _axes(source, target, ahead)
    t, side = source.tile_size, target.tile_size

    def footprints(batches):
        for layer, brow, bcol, batch, i in each_row(batches, *BLOCK_KEY):
            grid = array_of(batch.column("cells")[i]).reshape(t, t)
            if np.isnan(grid).all():
                continue
            across = []
            for tcol in cols.targets(bcol):
                sampled = cols.sampled(tcol)
                if len(own := sampled[cols.part(sampled, bcol)]):
                    across.append((tcol, own - bcol * t))
            for trow in rows.targets(brow):
                sampled = rows.sampled(trow)
                own = sampled[rows.part(sampled, brow)] - brow * t
                for tcol, there in across if len(own) else ():
                    piece = grid[np.ix_(own, there)]
                    if not np.isnan(piece).all():
                        yield layer, trow, tcol, brow, bcol, piece.ravel()

    def cut(batches):
        return batches_of(footprints(batches), _PIECES)

    def sample(key, table):
        layer, trow, tcol = (k.as_py() for k in key)
        at = [rows.positions(trow), cols.positions(tcol)]
        wanted = [rows.sampled(trow), cols.sampled(tcol)]
        grid = np.full((len(wanted[0]) + 1, len(wanted[1]) + 1), np.nan)  # the last of each is what lies outside
        for srow, scol, piece in zip(*(table.column(n).to_pylist() for n in ("srow", "scol")), table.column("cells")):
            place = grid[rows.part(wanted[0], srow), cols.part(wanted[1], scol)]
            place[...] = array_of(piece).reshape(place.shape)

        def find(axis: int, index: np.ndarray) -> np.ndarray:
            where = np.searchsorted(wanted[axis], index)
            return np.where(np.append(wanted[axis], -1)[where] == index, where, len(wanted[axis]))

        low = [np.floor(np.where(np.isfinite(x), x, -9)).astype(np.int64) for x in at]
        if method == "nearest":
            value = grid[np.ix_(find(0, low[0]), find(1, low[1]))]
        else:
            share = [x - l for x, l in zip(at, low)]  # noqa: E741
            total, weight = np.zeros((len(at[0]), len(at[1]))), np.zeros((len(at[0]), len(at[1])))
            for i, wi in ((0, 1.0 - share[0]), (1, share[0])):
                for j, wj in ((0, 1.0 - share[1]), (1, share[1])):
                    v = grid[np.ix_(find(0, low[0] + i), find(1, low[1] + j))]
                    w = np.where(np.isnan(v), 0.0, wi[:, None] * wj[None, :])
                    total += w * np.where(np.isnan(v), 0.0, v)
                    weight += w
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where(weight > 0, total / weight, np.nan)
        out = np.full((side, side), np.nan)
        out[: value.shape[0], : value.shape[1]] = value
        return table_of([] if np.isnan(out).all() else [(layer, trow, tcol, out.ravel())], BLOCK_SCHEMA)

    pieces = stored.select(*BLOCK_KEY, "cells").mapInArrow(cut, _PIECES)
    return pieces.groupBy(*BLOCK_KEY).applyInArrow(sample, BLOCK_SCHEMA)


def crop_blocks(stored: DataFrame, layout: Layout, row0: int, row1: int, col0: int, col1: int) -> DataFrame:
    """The cells from ``row0, col0`` to ``row1, col1``, inclusive, in their blocks; the scan skips the other blocks."""
    t = layout.tile_size
    kept = stored.where(F.col("brow").between(row0 // t, row1 // t) & F.col("bcol").between(col0 // t, col1 // t))
    row, col = (lambda at: F.col("brow") * t + F.floor(at / t)), (lambda at: F.col("bcol") * t + at % t)
    inside = lambda v, at: F.when(row(at).between(row0, row1) & col(at).between(col0, col1), v)
    return kept.select(*BLOCK_KEY, F.transform("cells", inside).alias("cells"))


def mosaic_blocks(scenes: DataFrame, rank: str = "scene_rank") -> DataFrame:
    """One block of each address: every cell from the known value of the least-ranked scene.

    Scenes of one address stream through a task in the order of their rank, so a place that very many scenes cover needs
    the memory of two blocks. Blocks of which little is known travel as places and values, so that a sort holds what a
    shuffle moves: a shuffle of a few compressed megabytes would else be gigabytes of unknown cells in a task. Blocks of
    the sparse form stay in it: nothing is done for unknown cells.
    """
    names = [*BLOCK_KEY, rank]
    if "places" in scenes.columns:
        ordered = scenes.select(*names, "places", "cells").repartition(*BLOCK_KEY).sortWithinPartitions(*names)
        return ordered.mapInArrow(first_known_places, SPARSE)
    given = scenes.select(*names, "cells")
    schema = T.StructType(given.select(*names).schema.fields + [T.StructField("size", T.LongType()), T.StructField("cells", T.ArrayType(T.DoubleType()))])

    def pack(batches):
        for batch in batches:
            rows = [packed(array_of(cells)) for cells in batch.column("cells")]
            ends = np.cumsum([0] + [held.size for _, held in rows])
            held = pa.array(np.concatenate([np.zeros(0), *(held for _, held in rows)]), from_pandas=True)
            arrays = [pa.array([size for size, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + arrays, names=schema.names)

    ordered = given.mapInArrow(pack, schema).repartition(*BLOCK_KEY).sortWithinPartitions(*names)

    def first_known(batches):
        now, grid = None, None
        for *here, size, batch, i in each_row(batches, *BLOCK_KEY, "size"):
            cells = unpacked(size, array_of(batch.column("cells")[i]))
            if here == now:
                grid = np.where(np.isnan(grid), cells, grid)
                continue
            if now is not None:
                yield *now, grid
            now, grid = here, cells
        if now is not None:
            yield *now, grid

    return ordered.mapInArrow(lambda batches: batches_of(first_known(batches), BLOCK_SCHEMA), BLOCK_SCHEMA)


def first_known_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse blocks of one address, in the order of their rank, as one block; many blocks at a time.

    The last block of what was read waits, as its scenes may go on.
    """
    waits: pa.RecordBatch | None = None
    for batch in batches:
        batch = batch.select(SPARSE.names)
        ends = np.cumsum(np.diff(batch.column("places").offsets.to_numpy()))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + BATCH_CELLS, "right")))
            rows = batch.slice(start, stop - start)
            start = stop
            if waits is not None:
                rows = pa.Table.from_batches([waits, rows.cast(waits.schema)]).combine_chunks().to_batches()[0]
            merged = merge_places(rows)
            if merged.num_rows > 1:
                yield merged.slice(0, merged.num_rows - 1)
            waits = merged.slice(merged.num_rows - 1)
    if waits is not None:
        yield waits


def merge_places(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of adjoining rows of one address each place once, with its first value."""
    keys = [rows.column(n).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for n in BLOCK_KEY]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    heads = np.flatnonzero(new)
    block = np.repeat(np.cumsum(new) - 1, np.diff(rows.column("places").offsets.to_numpy()))
    places, values = (rows.column(n).flatten().to_numpy(zero_copy_only=False) for n in ("places", "cells"))
    order = np.lexsort((places, block))  # stable, so the least rank comes first
    block, places = block[order], places[order]
    first = np.append(True, (block[1:] != block[:-1]) | (places[1:] != places[:-1]))[: len(order)]
    ends = pa.array(np.append(0, np.cumsum(np.bincount(block[first], minlength=len(heads)))), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (places[first], values[order[first]])]
    return pa.RecordBatch.from_arrays([rows.column(n).take(pa.array(heads)) for n in BLOCK_KEY] + lists, names=SPARSE.names)


def packed(cells: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of cells, and the places and then the values of the known ones; 0 and the cells as they are if half are known."""
    at = np.flatnonzero(~np.isnan(cells))
    return (0, cells) if 2 * at.size >= cells.size else (cells.size, np.concatenate([at, cells[at]]))


def unpacked(size: int, held: np.ndarray) -> np.ndarray:
    """The cells again, NaN where unknown."""
    if not size:
        return held
    at, known = np.split(held, 2)
    out = np.full(size, np.nan)
    out[at.astype(np.int64)] = known
    return out


def halve(value: np.ndarray, count: np.ndarray | None, method: str) -> tuple[np.ndarray, np.ndarray | None]:
    """Four cells to one: the first known in row-major order, or sums and counts."""
    corners = [(slice(i, None, 2), slice(j, None, 2)) for i in (0, 1) for j in (0, 1)]
    if method == "average":
        return sum(value[c] for c in corners), sum(count[c] for c in corners)
    out = value[corners[0]]
    for corner in corners[1:]:
        out = np.where(np.isnan(out), value[corner], out)
    return out, None


def pyramid_blocks(stored: DataFrame, tile_size: int, base_zoom: int, end_zoom: int = 0, method: str = "nearest", every: bool = True) -> DataFrame:
    """``z, layer, brow, bcol, cells``: all zoom levels from ``base_zoom`` up, cells halved in each direction per level.

    ``nearest`` keeps the first known child in row-major order, ``average`` the mean of the known base cells. A block
    reduces itself for every level up to one cell, and sends each result to the block of that level it is part of: one
    exchange of a third of the layer serves ``log2(tile_size)`` levels. Without ``every`` only ``end_zoom`` is returned,
    and of the levels between only one in ``log2(tile_size)`` is put together.
    """
    if method not in ("nearest", "average"):
        raise ValueError(f"unknown method: {method}")
    t = tile_size
    if t < 2 or t & (t - 1):
        raise ValueError("the tile size must be a power of two")
    steps = t.bit_length() - 1
    lists = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("value", "count")]
    key = ["z", *BLOCK_KEY]
    pieces = T.StructType(LEVELS.fields[:4] + [T.StructField(n, T.LongType()) for n in ("side", "r", "c")] + lists)
    level = T.StructType(LEVELS.fields[:4] + lists)
    none = np.zeros(0)

    def reduce(zoom: int, depth: int):
        def parts(batches):
            for layer, brow, bcol, batch, i in each_row(batches, *BLOCK_KEY):
                value = array_of(batch.column("value")[i]).reshape(t, t)
                count = None
                if method == "average":
                    held = array_of(batch.column("count")[i])
                    count = held.reshape(t, t) if len(held) else (~np.isnan(value)).astype(float)
                    value = np.nan_to_num(value)
                for up in range(1, depth + 1):
                    value, count = halve(value, count, method)
                    side, mask = t >> up, (1 << up) - 1
                    if (every or up == depth) and ((count > 0).any() if method == "average" else not np.isnan(value).all()):
                        at = ((brow & mask) * side, (bcol & mask) * side)
                        yield zoom - up, layer, brow >> up, bcol >> up, side, *at, value.ravel(), none if count is None else count.ravel()

        return lambda batches: batches_of(parts(batches), pieces)

    def assemble(k, table):
        value, count = np.full((t, t), np.nan), np.zeros((t, t))
        for side, r, c, v, n in zip(*(table.column(n).to_pylist() for n in ("side", "r", "c")), table.column("value"), table.column("count")):
            value[r : r + side, c : c + side] = array_of(v).reshape(side, side)
            if method == "average":
                count[r : r + side, c : c + side] = array_of(n).reshape(side, side)
        if method == "average":
            value = np.where(count > 0, value, np.nan)
        return table_of([(*(x.as_py() for x in k), value.ravel(), count.ravel() if method == "average" else none)], level)

    base = stored.select(F.lit(base_zoom).alias("z"), *BLOCK_KEY, F.col("cells").alias("value"), F.array().cast("array<double>").alias("count"))
    out = base.select(*key, F.col("value").alias("cells"))
    current, zoom = base, base_zoom
    while zoom > end_zoom:
        depth = min(steps, zoom - end_zoom)
        found = current.mapInArrow(reduce(zoom, depth), pieces).groupBy(*key).applyInArrow(assemble, level)
        cells = F.col("value") if method == "nearest" else F.zip_with("value", "count", F.try_divide)
        level_cells = found.select(*key, cells.alias("cells"))
        out = out.unionByName(level_cells) if every else level_cells
        zoom -= depth
        current = found.where(F.col("z") == zoom)
    return out
