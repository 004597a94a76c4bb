"""Square and disc neighbourhood statistics.

Windows are clipped at the raster edge and ignore NODATA. A cell without data
still gets a result when its window holds any.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.model import Layout
from ridgeline.operators import kernels
from ridgeline.operators.neighbours import halo_copies, per_block

STATS = ("vmin", "vmax", "vsum", "vcount")


def square_stats(cells: DataFrame, layout: Layout, n: int, form: str = "block") -> DataFrame:
    """``vmin, vmax, vsum, vcount`` over the (2n+1)^2 square, in one pass.

    ``form="block"`` runs a numpy kernel per block. ``form="window"`` stays in the JVM: two
    window passes over one shared exchange.
    """
    if n < 0:
        raise ValueError("the window size must not be negative")
    if form == "window":
        return _square_stats_window(cells, layout, n)
    if form != "block":
        raise ValueError(f"unknown form: {form}")

    def kernel(arrays, inside, origin):
        s = kernels.square_stats(arrays["value"], n)
        return {**s, "vmin": np.where(s["vcount"] > 0, s["vmin"], np.nan)}

    return per_block(cells, layout, n, kernel, STATS, keep="filled")


def _square_stats_window(cells: DataFrame, layout: Layout, n: int) -> DataFrame:
    t = layout.tile_size
    padded = halo_copies(cells.select("layer", "row", "col", F.col("value").cast("double")), layout, n)
    # Every cell of a padded block must be present, or a NODATA centre gets no second pass.
    span = lambda b, size: F.sequence(
        F.greatest(F.lit(0), F.col(b) * t - n).cast("long"),
        F.least(F.lit(size - 1), (F.col(b) + 1) * t - 1 + n).cast("long"),
    )
    frame = (
        padded.select("layer", "brow", "bcol")
        .distinct()
        .withColumn("row", F.explode(span("brow", layout.rows)))
        .withColumn("col", F.explode(span("bcol", layout.cols)))
        .withColumn("value", F.lit(None).cast("double"))
    )
    block = ["layer", "brow", "bcol"]
    dense = (
        padded.select(*block, "row", "col", "value")
        .unionByName(frame)
        .withColumn("block", F.xxhash64(*block))
        .repartition("block")
        .groupBy("block", *block, "row", "col")
        .agg(F.max("value").alias("value"))
    )
    block = ["block", *block]
    across = Window.partitionBy(*block, "row").orderBy("col").rangeBetween(-n, n)
    down = Window.partitionBy(*block, "col").orderBy("row").rangeBetween(-n, n)
    first = dense.select(
        *block,
        "row",
        "col",
        F.min("value").over(across).alias("a"),
        F.max("value").over(across).alias("b"),
        F.sum("value").over(across).alias("s"),
        F.count("value").over(across).alias("k"),
    )
    second = first.select(
        *block,
        "row",
        "col",
        F.min("a").over(down).alias("vmin"),
        F.max("b").over(down).alias("vmax"),
        F.sum("s").over(down).alias("vsum"),
        F.sum("k").over(down).cast("double").alias("vcount"),
    )
    own = (F.expr(f"row div {t}") == F.col("brow")) & (F.expr(f"col div {t}") == F.col("bcol"))
    return second.where(own & (F.col("vcount") > 0)).select("layer", "row", "col", *STATS)


def focal_min(cells: DataFrame, layout: Layout, n: int, form: str = "block") -> DataFrame:
    return square_stats(cells, layout, n, form).select("layer", "row", "col", F.col("vmin").alias("value"))


def focal_max(cells: DataFrame, layout: Layout, n: int, form: str = "block") -> DataFrame:
    return square_stats(cells, layout, n, form).select("layer", "row", "col", F.col("vmax").alias("value"))


def focal_mean(cells: DataFrame, layout: Layout, n: int, form: str = "block") -> DataFrame:
    """Sum over count, so cells beside NODATA weigh right."""
    mean = F.try_divide(F.col("vsum"), F.col("vcount"))
    return square_stats(cells, layout, n, form).select("layer", "row", "col", mean.alias("value"))


def focal_sum(cells: DataFrame, layout: Layout, radius: float) -> DataFrame:
    """Sum over the disc of ``radius`` cells."""
    reach = int(math.floor(radius))

    def kernel(arrays, inside, origin):
        total, count = kernels.disc_sum(arrays["value"], radius)
        return {"value": np.where(count > 0, total, np.nan)}

    return per_block(cells, layout, reach, kernel, ("value",), keep="filled")
