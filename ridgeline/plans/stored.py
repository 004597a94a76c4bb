"""The same products on layers stored as blocks.

Blocks stay blocks from the scan to the write: the edge strips are the only
cells that are shuffled twice, and no cell is addressed on its own. This is
the form for very large layers; the cell-table form serves joins with other
tables.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.model import Layout
from ridgeline.operators import blocks, kernels, local, reshape
from ridgeline.operators.vector import CENTER_CLASS, SYMBOL_RINGS, ring_radii
from ridgeline.plans import products
from ridgeline.plans.layers import OBJECT_HEIGHT, removal_flags
from ridgeline.session import cut_lineage

SURFACES = ("slope", "aspect", "hillshade")
POSITIONS = ("tpi", "tpi_ratio", "ruggedness")


def surface(
    stored: DataFrame, layout: Layout, azimuth: float = 90.0, altitude: float = 40.0, z_factor: float = 1.0
) -> DataFrame:
    """Array columns ``slope, aspect, hillshade`` of each block."""

    def kernel(arrays, inside, origin):
        return kernels.surface(arrays["value"], layout.cell_w, layout.cell_h, azimuth, altitude, z_factor)

    return blocks.focal(stored, layout, 1, kernel, SURFACES)


def slope(stored: DataFrame, layout: Layout, z_factor: float = 1.0) -> DataFrame:
    def kernel(arrays, inside, origin):
        east, south = kernels.horn_sums(arrays["value"])
        return {"cells": kernels.slope_degrees(east, south, layout.cell_w, layout.cell_h, z_factor)}

    return blocks.focal(stored, layout, 1, kernel, ("cells",))


def square_stats(stored: DataFrame, layout: Layout, n: int) -> DataFrame:
    """Array columns ``vmin, vmax, vsum, vcount``."""

    def kernel(arrays, inside, origin):
        s = kernels.square_stats(arrays["value"], n)
        return {**s, "vmin": np.where(s["vcount"] > 0, s["vmin"], np.nan)}

    return blocks.focal(stored, layout, n, kernel, ("vmin", "vmax", "vsum", "vcount"), keep="filled")


def positions(stored: DataFrame, layout: Layout, n: int) -> DataFrame:
    """Array columns ``tpi, tpi_ratio, ruggedness``."""
    kernel = lambda arrays, inside, origin: kernels.position(arrays["value"], n)
    return blocks.focal(stored, layout, n, kernel, POSITIONS, keep="all")


def focal_sum(stored: DataFrame, layout: Layout, radius: float) -> DataFrame:
    def kernel(arrays, inside, origin):
        total, count = kernels.disc_sum(arrays["value"], radius)
        return {"cells": np.where(count > 0, total, np.nan)}

    return blocks.focal(stored, layout, int(math.floor(radius)), kernel, ("cells",), keep="filled")


def nearest_cover(layout: Layout, cover: DataFrame, cover_layout: Layout) -> DataFrame:
    """Classes of a coarser layer as blocks of the finer grid."""
    return reshape.resample_blocks(cover, cover_layout, layout, "nearest")


def cover_filtered(stored: DataFrame, layout: Layout, cover: DataFrame, cover_layout: Layout, mask: str = "zero") -> DataFrame:
    """Elevation on suitable land cover; elsewhere, and where no cover is known, 0 or NODATA."""
    if mask not in ("zero", "nodata"):
        raise ValueError(f"unknown mask: {mask}")
    other = F.lit(0.0) if mask == "zero" else F.lit(None).cast("double")
    keep = lambda v, c: F.when(v.isNull() | (F.coalesce(local.suitable_mask(c), F.lit(0)) == 1), v).otherwise(other)
    return blocks.combine(stored, nearest_cover(layout, cover, cover_layout), keep, "left")


def obstruction_removed(bare: DataFrame, first: DataFrame, height: float = OBJECT_HEIGHT) -> DataFrame:
    """Bare earth, NODATA where the first return stands more than ``height`` above it."""
    return blocks.combine(bare, first, lambda b, f: F.when(f > b + height, F.lit(None).cast("double")).otherwise(b), "left")


def object_height(bare: DataFrame, first: DataFrame, height: float = OBJECT_HEIGHT) -> DataFrame:
    """First return above bare earth where that is more than ``height``, else 0."""
    return blocks.combine(bare, first, lambda b, f: F.when(f - b > height, f - b).when((f - b).isNotNull(), 0.0))


def combined_removal(
    bare: DataFrame,
    layout: Layout,
    first: DataFrame | None = None,
    cover: DataFrame | None = None,
    cover_layout: Layout | None = None,
    height: float = OBJECT_HEIGHT,
) -> tuple[DataFrame, dict[str, bool]]:
    """Bare earth without obstructions and without unsuitable land cover, and which steps ran."""
    out = bare if first is None else obstruction_removed(bare, first, height)
    if cover is not None:
        out = cover_filtered(out, layout, cover, cover_layout, mask="nodata")
    return out, removal_flags(first is not None, cover is not None)


def suitability(
    stored: DataFrame,
    layout: Layout,
    diameter: float = 50.0,
    radius_units: str = "map",
    smooth: int | None = 1,
    slope_limit: float = 15.0,
    z_factor: float = 1.0,
    rings=SYMBOL_RINGS,
    decimals: int | None = None,
) -> DataFrame:
    """Landing-site suitability from blocks to blocks: two exchanges of blocks and one small histogram."""
    radius = products.radius_in_cells(layout, diameter, radius_units)
    halo, kernel = products.site_kernel(layout, radius, smooth, slope_limit, z_factor, False, decimals)
    scores = blocks.focal(stored, layout, halo, lambda a, i, o: {"cells": kernel(a, i, o)["value"]}, ("cells",), keep="filled")
    scores = cut_lineage(scores)
    limits = products.site_limits(blocks.to_cells(scores, layout))
    ring = lambda v: F.when(
        v.isNotNull(),
        local.ring_class(F.col("limits.center"), F.col("limits.middle"), F.col("limits.outer"))(v).cast("double"),
    )
    classes = blocks.local(scores.withColumn("limits", limits), ring).drop("limits")
    if not rings:
        return classes
    radii, reach = ring_radii(layout, rings)
    symbols = lambda a, i, o: {"cells": kernels.rings(a["value"], CENTER_CLASS, radii, reach)}
    return blocks.focal(classes, layout, reach, symbols, ("cells",), keep="filled")
