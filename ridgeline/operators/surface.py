"""Slope, aspect and hillshade from Horn's 3x3 differences.

A missing neighbour takes the centre's value; a missing centre stays NODATA.
The trigonometry is Column code, only the neighbour gather runs per block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.model import Layout
from ridgeline.operators import kernels
from ridgeline.operators.neighbours import halo_copies, per_block


def horn(cells: DataFrame, layout: Layout, form: str = "block") -> DataFrame:
    """Add ``east, south``: the weighted differences before division by the cell size."""
    if form == "window":
        return _horn_window(cells, layout)
    if form != "block":
        raise ValueError(f"unknown form: {form}")

    def kernel(arrays, inside, origin):
        east, south = kernels.horn_sums(arrays["value"])
        return {"east": east, "south": south}

    return per_block(cells, layout, 1, kernel, ("east", "south"))


def _horn_window(cells: DataFrame, layout: Layout) -> DataFrame:
    """The same differences in the JVM: four window passes over one shared exchange.

    Rows, columns and both diagonals of a block are each a window, so a missing edge neighbour
    never hides a corner. All four partitionings contain the block key, which is how the cells
    are already distributed, so only local sorts are added.
    """
    block = ["layer", "brow", "bcol"]
    known = cells.select("layer", "row", "col", F.col("value").cast("double").alias("c")).where("c IS NOT NULL")
    # A hash of the key: a constant layer would be dropped from the windows, not from the exchange.
    padded = halo_copies(known, layout, 1).withColumn("block", F.xxhash64(*block)).repartition("block")
    block = ["block", *block]

    def beside(key: Column, axis: str, back: str, ahead: str, df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*block, "lane").orderBy(axis)
        at = lambda d: F.coalesce(F.max("c").over(w.rangeBetween(d, d)), F.col("c"))
        return df.withColumn("lane", key).select("*", at(-1).alias(back), at(1).alias(ahead)).drop("lane")

    out = beside(F.col("row"), "col", "w", "e", padded)
    out = beside(F.col("col"), "row", "n", "s", out)
    out = beside(F.col("row") - F.col("col"), "row", "nw", "se", out)
    out = beside(F.col("row") + F.col("col"), "row", "ne", "sw", out)
    t = layout.tile_size
    own = (F.expr(f"row div {t}") == F.col("brow")) & (F.expr(f"col div {t}") == F.col("bcol"))
    return out.where(own).select(
        "layer",
        "row",
        "col",
        F.expr("(ne + 2 * e + se) - (nw + 2 * w + sw)").alias("east"),
        F.expr("(sw + 2 * s + se) - (nw + 2 * n + ne)").alias("south"),
    )


def _gradient(layout: Layout) -> tuple[Column, Column]:
    return (
        F.col("east") / F.lit(8.0 * layout.cell_w),
        F.col("south") / F.lit(8.0 * layout.cell_h),
    )


def slope_of(layout: Layout, z_factor: float = 1.0) -> Column:
    gx, gy = _gradient(layout)
    return F.degrees(F.atan(F.lit(z_factor) * F.sqrt(gx * gx + gy * gy)))


def aspect_of(layout: Layout) -> Column:
    """Downslope azimuth, clockwise from north; flat cells have none."""
    gx, gy = _gradient(layout)
    azimuth = F.degrees(F.atan2(-gx, gy))
    azimuth = F.when(azimuth < 0, azimuth + 360.0).otherwise(azimuth)
    return F.when((F.col("east") != 0) | (F.col("south") != 0), azimuth)


def hillshade_of(layout: Layout, azimuth: float, altitude: float, z_factor: float) -> Column:
    """0..127; the 127 scale is a fixed value."""
    gx, gy = _gradient(layout)
    az, alt = math.radians(azimuth), math.radians(altitude)
    slope = F.atan(F.lit(z_factor) * F.sqrt(gx * gx + gy * gy))
    aspect = F.atan2(-gx, gy)
    level = F.lit(math.sin(alt))
    lit = level * F.cos(slope) + F.lit(math.cos(alt)) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    flat = (F.col("east") == 0) & (F.col("south") == 0)
    light = F.when(flat, level).otherwise(lit)
    return F.floor(F.lit(127.0) * F.greatest(F.lit(0.0), light) + 0.5).cast("int")


def slope(cells: DataFrame, layout: Layout, z_factor: float = 1.0, form: str = "block") -> DataFrame:
    """Slope in degrees."""
    return horn(cells, layout, form).select("layer", "row", "col", slope_of(layout, z_factor).alias("value"))


def aspect(cells: DataFrame, layout: Layout, form: str = "block") -> DataFrame:
    return horn(cells, layout, form).select("layer", "row", "col", aspect_of(layout).alias("value"))


def hillshade(
    cells: DataFrame,
    layout: Layout,
    azimuth: float = 90.0,
    altitude: float = 40.0,
    z_factor: float = 1.0,
    form: str = "block",
) -> DataFrame:
    shade = hillshade_of(layout, azimuth, altitude, z_factor)
    return horn(cells, layout, form).select("layer", "row", "col", shade.alias("value"))
