"""Composite terrain products."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.model import CELL_KEY, Layout
from ridgeline.operators import kernels, local
from ridgeline.operators.focal import square_stats
from ridgeline.operators.neighbours import per_block
from ridgeline.operators.stats import distinct_breaks, quantile_breaks, ring_thresholds
from ridgeline.operators.vector import SYMBOL_RINGS, symbol_rings
from ridgeline.session import cut_lineage

# Fixed value: vertical scale of slopes on degree grids.
DEGREE_Z_FACTOR = 0.00000898


def _over(cells: DataFrame, layout: Layout, n: int, value: Column) -> DataFrame:
    return square_stats(cells, layout, n).select(*CELL_KEY, value.alias("value"))


def tpi(cells: DataFrame, layout: Layout, n: int = 3) -> DataFrame:
    """Topographic position ``(mean - min) / (max - min)``; flat windows give NODATA."""
    mean = F.try_divide("vsum", "vcount")
    return _over(cells, layout, n, F.try_divide(mean - F.col("vmin"), F.col("vmax") - F.col("vmin")))


def tpi_ratio(cells: DataFrame, layout: Layout, n: int = 1) -> DataFrame:
    """Topographic position with the ratio of the extremes: ``(mean - min) / (max / min)``."""
    mean = F.try_divide("vsum", "vcount")
    return _over(cells, layout, n, F.try_divide(mean - F.col("vmin"), F.try_divide("vmax", "vmin")))


def ruggedness(cells: DataFrame, layout: Layout, n: int = 1) -> DataFrame:
    """``sqrt(|max^2 - min^2|)``."""
    delta = F.col("vmax") * F.col("vmax") - F.col("vmin") * F.col("vmin")
    return _over(cells, layout, n, F.sqrt(F.abs(delta)))


def radius_in_cells(layout: Layout, diameter: float, units: str) -> float:
    if units == "map":
        return diameter / 2 / layout.resolution
    if units == "cells":
        return diameter / 2
    raise ValueError(f"unknown radius units: {units}")


def site_kernel(layout, radius, smooth, slope_limit, z_factor, masked, decimals):
    """Halo and kernel of the site scores: mean, slope, threshold and disc sum."""
    n = smooth or 0

    def kernel(arrays, inside, origin):
        z = arrays["value"]
        if smooth is not None:
            z = kernels.square_mean(z, n)
            z = np.where(inside[n : inside.shape[0] - n, n : inside.shape[1] - n], z, np.nan)
        east, south = kernels.horn_sums(z)
        slope = kernels.slope_degrees(east, south, layout.cell_w, layout.cell_h, z_factor)
        if masked:
            edge = n + 1
            slope = slope * arrays["mask"][edge : inside.shape[0] - edge, edge : inside.shape[1] - edge]
        if decimals is not None:
            slope = np.floor(slope * 10.0**decimals + 0.5) / 10.0**decimals
        suitable = np.where(np.isnan(slope), np.nan, ((slope > 0) & (slope < slope_limit)).astype(np.float64))
        total, count = kernels.disc_sum(suitable, radius)
        return {"value": np.where(count > 0, total, np.nan)}

    return n + 1 + int(math.floor(radius)), kernel


def site_scores(
    cells: DataFrame,
    layout: Layout,
    radius: float,
    smooth: int | None = 1,
    slope_limit: float = 15.0,
    z_factor: float = 1.0,
    masked: bool = False,
    decimals: int | None = None,
) -> DataFrame:
    """Number of suitable cells within ``radius`` cells of each cell.

    Mean, slope, threshold and disc sum run in one pass over each block: one halo exchange with
    the sum of the four reaches, not one per step. ``smooth=None`` leaves the mean out. With
    ``masked`` the column ``mask`` (0 or 1) multiplies the slope. ``decimals`` rounds the slope
    before it meets the limit.
    """
    halo, kernel = site_kernel(layout, radius, smooth, slope_limit, z_factor, masked, decimals)
    inputs = ("value", "mask") if masked else ("value",)
    return per_block(cells, layout, halo, kernel, ("value",), inputs=inputs, keep="filled")


def site_limits(scores: DataFrame) -> Column:
    """Thresholds of the rings as one scalar subquery (a struct ``center, middle, outer``). Scores are kept, and read again."""
    thresholds = ring_thresholds(distinct_breaks(quantile_breaks(scores, 10, (), stored=True), ()))
    return thresholds.select(F.struct("center", "middle", "outer").alias("limits")).scalar()


def site_rings(scores: DataFrame) -> DataFrame:
    """Classes 3, 2, 1, 0 of the scores against the last three of ten quantile breaks.

    The three thresholds enter as one scalar subquery.
    """
    limits = site_limits(scores)
    ring = local.ring_class(F.col("limits.center"), F.col("limits.middle"), F.col("limits.outer"))
    return scores.withColumn("limits", limits).select(*CELL_KEY, ring(F.col("value")).alias("value"))


def suitability(
    cells: DataFrame,
    layout: Layout,
    diameter: float = 50.0,
    radius_units: str = "map",
    smooth: int | None = 1,
    slope_limit: float = 15.0,
    z_factor: float = 1.0,
    masked: bool = False,
    rings=SYMBOL_RINGS,
    decimals: int | None = None,
) -> DataFrame:
    """Landing-site suitability: scores, rings and symbols around the best cells.

    With ``rings=()`` the classes are returned without symbols.
    """
    radius = radius_in_cells(layout, diameter, radius_units)
    scores = site_scores(cells, layout, radius, smooth, slope_limit, z_factor, masked, decimals)
    classes = site_rings(cut_lineage(scores))  # computed once, for the breaks and the classes
    return symbol_rings(classes, layout, rings) if rings else classes


def with_mask(cells: DataFrame, layout: Layout, cover: DataFrame, cover_layout: Layout, mask) -> DataFrame:
    """Add ``mask`` from a land-cover layer; unknown cover counts as 0."""
    keyed = local.mask_onto(cells, layout, cover, cover_layout, mask)
    return keyed.withColumn("mask", F.coalesce("mask", F.lit(0)))


def suitability_on_dry_land(cells, layout, cover, cover_layout, **options) -> DataFrame:
    """Suitability with the slope masked by water before the threshold."""
    keyed = local.mask_onto(cells, layout, cover, cover_layout, local.water_mask)
    keyed = keyed.withColumn("mask", F.coalesce("mask", F.lit(1)))
    return suitability(keyed, layout, masked=True, **options)


def suitable_elevation(cells, layout, cover, cover_layout) -> DataFrame:
    """Elevation kept on suitable land cover only, NODATA elsewhere and where not positive."""
    keyed = with_mask(cells, layout, cover, cover_layout, local.suitable_mask)
    return keyed.select(*CELL_KEY, local.keep_positive(F.abs(F.col("value") * F.col("mask"))).alias("value"))


def suitability_on_cover(
    cells, layout, cover, cover_layout, z_factor: float = DEGREE_Z_FACTOR, **options
) -> DataFrame:
    """Suitability of the elevation masked by land cover, without smoothing."""
    kept = suitable_elevation(cells, layout, cover, cover_layout)
    return suitability(kept, layout, smooth=None, z_factor=z_factor, **options)


def suitability_statistics(scores: DataFrame, k: int = 10) -> DataFrame:
    """``breaks, top, mean`` of the scores in one row."""
    scores = cut_lineage(scores.where("value IS NOT NULL").select("value"))
    breaks = distinct_breaks(quantile_breaks(scores, k, (), stored=True), ())
    totals = scores.agg(F.max("value").alias("top"), F.avg("value").alias("mean"))
    return totals.select(breaks.select("breaks").scalar().alias("breaks"), "top", "mean")


BATCH = ("slope", "aspect", "hillshade", "tpi", "tpi_ratio")


def batch(cells: DataFrame, tile_size: int = 256, n: int = 1, azimuth: float = 90.0, altitude: float = 40.0, z_factor: float = 1.0) -> DataFrame:
    """Slope, aspect, hillshade and both topographic positions of many scenes in one pass.

    ``cells`` also has ``cell_w, cell_h``: each layer keeps its own grid. Neither a loop over the
    scenes nor a join with their sizes is needed, and a scene that holds most cells is still split
    by block.
    """
    open_grid = Layout(0, 0.0, 0.0, 1.0, 1.0, 2**40, 2**40, tile_size)
    reach = max(1, n)

    def kernel(arrays, inside, origin):
        trim = lambda a, by: a[by : a.shape[0] - by, by : a.shape[1] - by]
        z, width, height = arrays["value"], trim(arrays["cell_w"], reach), trim(arrays["cell_h"], reach)
        return {
            **kernels.surface(trim(z, reach - 1), width, height, azimuth, altitude, z_factor),
            **kernels.position(trim(z, reach - n), n),
        }

    return per_block(cells, open_grid, reach, kernel, BATCH, inputs=("value", "cell_w", "cell_h"))
