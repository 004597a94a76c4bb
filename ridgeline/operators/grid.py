"""Reshaping: reprojection, tiling, mosaicking, resampling, cropping, pyramids."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import geo
from ridgeline.model import CELL_KEY, CELL_SCHEMA, Layout
from ridgeline.operators.neighbours import gather, map_blocks, spread_arrays, square_of

# Half the Web Mercator world, and its cell size at zoom 0 with 256-cell tiles.
MERCATOR_HALF = 20037508.342789244
ZOOM0_CELL = 156543.03392804097


def crop(cells: DataFrame, layout: Layout, xmin: float, ymin: float, xmax: float, ymax: float):
    """Cells between the box's north-west and south-east cells, inclusive, re-based to (0, 0)."""
    col0 = max(0, math.floor((xmin - layout.x0) / layout.cell_w))
    col1 = min(layout.cols - 1, math.floor((xmax - layout.x0) / layout.cell_w))
    row0 = max(0, math.floor((layout.y0 - ymax) / layout.cell_h))
    row1 = min(layout.rows - 1, math.floor((layout.y0 - ymin) / layout.cell_h))
    if col1 < col0 or row1 < row0:
        raise ValueError("the box does not meet the layer")
    kept = cells.where(F.col("row").between(row0, row1) & F.col("col").between(col0, col1))
    out = kept.withColumns({"row": F.col("row") - row0, "col": F.col("col") - col0})
    cropped = Layout(
        layout.crs,
        layout.x0 + col0 * layout.cell_w,
        layout.y0 - row0 * layout.cell_h,
        layout.cell_w,
        layout.cell_h,
        col1 - col0 + 1,
        row1 - row0 + 1,
        layout.tile_size,
    )
    return out, cropped


def mosaic(readings: DataFrame, rank: str = "scene_rank") -> DataFrame:
    """One value per cell: the known value of the least-ranked scene.

    An aggregate with map-side combining, so a cell with very many readings costs no more than
    another one. Rank by one number where possible: a struct makes the aggregate sort.
    """
    return readings.where("value IS NOT NULL").groupBy(*CELL_KEY).agg(F.min_by("value", rank).alias("value"))


def nearest_onto(
    cells: DataFrame, layout: Layout, other: DataFrame, other_layout: Layout, name: str, match_layer: bool = True
) -> DataFrame:
    """Add the value of ``other`` at the centre of each cell (left join on the computed cell).

    With ``match_layer=False`` the one layer of ``other`` serves every layer of ``cells``.
    """
    if layout.crs != other_layout.crs:
        x, y = geo.project(layout.crs, other_layout.crs, layout.x_of(F.col("col")), layout.y_of(F.col("row")))
    else:
        x, y = layout.x_of(F.col("col")), layout.y_of(F.col("row"))
    keyed = cells.withColumns({"r_": other_layout.row_of(y), "c_": other_layout.col_of(x)})
    right = other.select(
        "layer", F.col("row").alias("r_"), F.col("col").alias("c_"), F.col("value").alias(name)
    ).hint("merge")  # its size before an explode would invite a broadcast
    if not match_layer:
        return keyed.join(right.drop("layer").hint("merge"), ["r_", "c_"], "left").drop("r_", "c_")
    return keyed.join(right, ["layer", "r_", "c_"], "left").drop("r_", "c_")


def target_layout(layout: Layout, crs: int, tile_size: int | None = None) -> Layout:
    """A grid in another CRS that covers the layer's corners with square cells of like size."""
    corners = [geo.project_point(layout.crs, crs, x, y) for x in layout.extent[::2] for y in layout.extent[1::2]]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    width, height = max(xs) - min(xs), max(ys) - min(ys)
    cell = math.sqrt(width * height / (layout.cols * layout.rows))
    return Layout(
        crs,
        min(xs),
        max(ys),
        cell,
        cell,
        max(1, math.ceil(width / cell - 1e-9)),
        max(1, math.ceil(height / cell - 1e-9)),
        tile_size or layout.tile_size,
    )


def resample(cells: DataFrame, source: Layout, target: Layout, method: str = "bilinear") -> DataFrame:
    """Values of the source on the target grid, by inverse mapping: no holes.

    The source is exchanged once, by block, with one extra row and column for ``bilinear``; each
    block then produces the target cells whose position falls in it. Both projections map rows to
    rows and columns to columns, so that is a rectangle, and a world-wide target grid costs only
    the cells near data. Bilinear weights of NODATA neighbours are shared among the known ones.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown method: {method}")
    t = source.tile_size
    ahead = 1 if method == "bilinear" else 0
    shift = 0.0 if method == "bilinear" else 0.5
    into_x, into_y = geo.axis_maps(source.crs, target.crs)
    back_x, back_y = geo.axis_maps(target.crs, source.crs)
    span = lambda axis: F.sequence(F.floor((F.col(axis) - ahead) / F.lit(t)), F.floor(F.col(axis) / F.lit(t)))
    given = (
        cells.where("value IS NOT NULL")
        .select("layer", "row", "col", F.col("value").cast("double").alias("value"))
        .withColumn("brow", F.explode(span("row")))
        .withColumn("bcol", F.explode(span("col")))
    )

    def positions(block, to_target, to_source, s0, s_step, t0, t_step, t_size):
        """Target indexes whose source position falls in the block, and those positions."""
        edges = to_target(s0 + s_step * (np.array([block * t, (block + 1) * t]) - shift + 0.5))
        ends = np.sort((edges - t0) / t_step - 0.5)
        index = np.arange(max(0, math.floor(ends[0]) - 1), min(t_size - 1, math.ceil(ends[1]) + 1) + 1)
        at = (to_source(t0 + t_step * (index + 0.5)) - s0) / s_step - 0.5 + shift
        mine = np.floor(np.floor(at) / t) == block
        return index[mine], at[mine]

    def run(brow, bcol, at, values):
        rows, fr = positions(brow, into_y, back_y, source.y0, -source.cell_h, target.y0, -target.cell_h, target.rows)
        cols, fc = positions(bcol, into_x, back_x, source.x0, source.cell_w, target.x0, target.cell_w, target.cols)
        grid = square_of(at, values["value"], t + 1)
        r, c = np.floor(fr), np.floor(fc)
        dr, dc = (fr - r)[:, None], (fc - c)[None, :]
        r, c = r.astype(np.int64) - brow * t, c.astype(np.int64) - bcol * t
        if method == "nearest":
            value = grid[np.ix_(r, c)]
        else:
            total, weight = np.zeros((r.size, c.size)), np.zeros((r.size, c.size))
            for i, wi in ((0, 1.0 - dr), (1, dr)):
                for j, wj in ((0, 1.0 - dc), (1, dc)):
                    v = grid[np.ix_(r + i, c + j)]
                    w = np.where(np.isnan(v), 0.0, wi * wj)
                    total += w * np.where(np.isnan(v), 0.0, v)
                    weight += w
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where(weight > 0, total / weight, np.nan)
        i, j = np.nonzero(~np.isnan(value))
        return {"row": rows[i], "col": cols[j], "value": value[i, j]}

    mapped = map_blocks(gather(given, t, 0, t + 1, ["value"]), ["value"], run, CELL_SCHEMA.fields[1:])
    return spread_arrays(mapped, ["row", "col", "value"])


def reproject(cells: DataFrame, source: Layout, crs: int, method: str = "bilinear", target: Layout | None = None):
    """The layers of ``cells`` in another CRS; returns cells and their layout."""
    target = target or target_layout(source, crs)
    return resample(cells, source, target, method), target


def with_tiles(cells: DataFrame, tile_size: int = 512) -> DataFrame:
    """Add the tile address ``trow, tcol`` of each cell."""
    return cells.withColumns(
        {"trow": F.expr(f"row div {tile_size}"), "tcol": F.expr(f"col div {tile_size}")}
    )


def tile_to_layout(readings: DataFrame, layout: Layout, rank: str = "scene_rank") -> DataFrame:
    """Mosaic the scenes of a grid and give every cell its tile."""
    return with_tiles(mosaic(readings, rank), layout.tile_size)


def retile(cells: DataFrame, layout: Layout, size: int, root: Column) -> DataFrame:
    """One row per fixed-size piece: name ``root_col_row``, cell count and extent."""
    tiled = with_tiles(cells, size)
    pieces = tiled.groupBy("layer", "trow", "tcol").agg(
        F.count("value").alias("n"),
        F.min("row").alias("r0"),
        F.max("row").alias("r1"),
        F.min("col").alias("c0"),
        F.max("col").alias("c1"),
    )
    return pieces.select(
        "layer",
        "trow",
        "tcol",
        "n",
        F.concat_ws("_", root, (F.col("tcol") + 1).cast("string"), (F.col("trow") + 1).cast("string")).alias("name"),
        (F.lit(layout.x0) + F.col("c0") * layout.cell_w).alias("xmin"),
        (F.lit(layout.y0) - (F.col("r1") + 1) * layout.cell_h).alias("ymin"),
        (F.lit(layout.x0) + (F.col("c1") + 1) * layout.cell_w).alias("xmax"),
        (F.lit(layout.y0) - F.col("r0") * layout.cell_h).alias("ymax"),
    )


def zoom_for(cell_size: float) -> int:
    return max(0, round(math.log2(ZOOM0_CELL / cell_size)))


def zoom_layout(layout: Layout, tile_size: int = 256) -> tuple[int, Layout]:
    """Nearest zoom level and its world-wide grid of ``tile_size`` tiles."""
    if layout.crs != 3857:
        raise ValueError("zoom levels are defined in Web Mercator")
    zoom = zoom_for(layout.resolution)
    side = tile_size * 2**zoom
    cell = 2 * MERCATOR_HALF / side
    return zoom, Layout(3857, -MERCATOR_HALF, MERCATOR_HALF, cell, cell, side, side, tile_size)


def slippy_keys(cells: DataFrame, layout: Layout) -> DataFrame:
    """Add ``z, x, y``: the web tile that holds each cell centre."""
    zoom = zoom_for(layout.resolution)
    span = 2 * MERCATOR_HALF / 2**zoom
    mx, my = geo.project(layout.crs, 3857, layout.x_of(F.col("col")), layout.y_of(F.col("row")))
    return cells.select(
        "*",
        F.lit(zoom).alias("z"),
        F.floor((mx + F.lit(MERCATOR_HALF)) / F.lit(span)).alias("x"),
        F.floor((F.lit(MERCATOR_HALF) - my) / F.lit(span)).alias("y"),
    )


def pyramid(cells: DataFrame, base_zoom: int, end_zoom: int = 0, method: str = "nearest", tile_size: int = 256) -> DataFrame:
    """All zoom levels from ``base_zoom`` up, cells halved in each direction per level.

    ``nearest`` keeps the first known child in row-major order, ``average`` the mean of the known
    base cells. A parent lies in the same block of ``tile_size`` cells as its children, so one
    exchange serves ``log2(tile_size)`` levels: each block computes all of them at once. The few
    cells left on the last of these levels go on to the next exchange.
    """
    if method not in ("nearest", "average"):
        raise ValueError(f"unknown method: {method}")
    kind = cells.schema["value"].dataType if method == "nearest" else T.DoubleType()
    steps = max(1, int(math.log2(tile_size)))
    base = cells.where("value IS NOT NULL").select(F.lit(base_zoom).alias("z"), "layer", "row", "col", "value")
    current = base.select("layer", "row", "col", F.col("value").cast("double").alias("a"), F.lit(1.0).alias("k"))
    out = base.withColumn("value", F.col("value").cast(kind))
    zoom = base_zoom
    while zoom > end_zoom:
        depth = min(steps, zoom - end_zoom)
        levels = _block_levels(current, zoom, depth, method)
        value = F.col("a") if method == "nearest" else F.try_divide("a", "k")
        out = out.unionByName(levels.select("z", "layer", "row", "col", value.cast(kind).alias("value")))
        zoom -= depth
        current = levels.where(F.col("z") == zoom).select("layer", "row", "col", "a", "k")
    return out


def _block_levels(cells: DataFrame, zoom: int, depth: int, method: str) -> DataFrame:
    """The ``depth`` levels above ``zoom``: ``z, layer, row, col, a, k`` (value or sum, and count)."""
    side = 2**depth

    def run(brow, bcol, at, values):
        a = square_of(at, values["a"], side)
        k = np.nan_to_num(square_of(at, values["k"], side))
        parts = []
        for up in range(1, depth + 1):
            children = [(a[i::2, j::2], k[i::2, j::2]) for i in (0, 1) for j in (0, 1)]
            k = sum(n for _, n in children)
            if method == "nearest":
                a = children[0][0]
                for child, _ in children[1:]:
                    a = np.where(np.isnan(a), child, a)
            else:
                a = np.where(k > 0, sum(np.where(np.isnan(v), 0.0, v) for v, _ in children), np.nan)
            i, j = np.nonzero(k > 0)
            size = side >> up
            level = np.full(i.size, zoom - up)
            parts.append({"z": level, "row": i + brow * size, "col": j + bcol * size, "a": a[i, j], "k": k[i, j]})
        return {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}

    fields = [T.StructField("z", T.IntegerType())] + CELL_SCHEMA.fields[1:3]
    fields += [T.StructField("a", T.DoubleType()), T.StructField("k", T.DoubleType())]
    placed = cells.withColumns({"brow": F.expr(f"row div {side}"), "bcol": F.expr(f"col div {side}")})
    mapped = map_blocks(gather(placed, side, 0, side, ["a", "k"]), ["a", "k"], run, fields)
    return spread_arrays(mapped, ["z", "row", "col", "a", "k"])
