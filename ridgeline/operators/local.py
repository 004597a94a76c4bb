"""Local map algebra: one cell at a time, NODATA in gives NODATA out.

Binary operators are equi-joins on the cell address. The extension surface is
a Column function, so everything stays in generated code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.model import CELL_KEY, Layout
from ridgeline.operators.grid import nearest_onto

# Land-cover legend.
LAND_COVER = {
    1: "Forest, Deciduous",
    2: "Forest, Evergreen",
    3: "Scrub/Shrub",
    4: "Grassland",
    5: "Barren/Sparsely Vegetated",
    6: "Urban/Built-Up",
    7: "Agriculture, Other",
    8: "Agriculture, Rice",
    9: "Wetland, Permanent Herbaceous",
    10: "Wetland, Mangrove",
    11: "Water",
    12: "Ice/Snow",
    13: "Cloud/Cloud Shadow/No Data",
    14: "Wetland, Swamp",
    15: "Forest, Mixed",
}
SUITABLE_CLASSES = (4, 5, 7, 8)
WATER_CLASSES = (9, 10, 11, 14)


def local_map(cells: DataFrame, change: Callable[[Column], Column]) -> DataFrame:
    return cells.withColumn("value", change(F.col("value")))


def threshold_class(limit: float) -> Callable[[Column], Column]:
    """1 where ``0 < x < limit``, else 0; exactly 0 is not suitable."""
    return lambda v: F.when((v > 0) & (v < F.lit(limit)), 1).otherwise(0)


def ring_class(center: Column, middle: Column, outer: Column) -> Callable[[Column], Column]:
    return lambda v: F.when(v >= center, 3).when(v >= middle, 2).when(v >= outer, 1).otherwise(0)


def suitable_mask(v: Column) -> Column:
    return v.isin(*SUITABLE_CLASSES).cast("int")


def water_mask(v: Column) -> Column:
    """0 over water, 1 elsewhere."""
    return (~v.isin(*WATER_CLASSES)).cast("int")


def keep_class(wanted: int) -> Callable[[Column], Column]:
    return lambda v: F.when(v == wanted, v)


def keep_positive(v: Column) -> Column:
    return F.when(v > 0, v)


def local_sqrt(v: Column) -> Column:
    return F.when(v >= 0, F.sqrt(v))


def land_cover_legend(spark) -> DataFrame:
    """The fifteen classes with their two masks, as a table to join reports with."""
    legend = spark.createDataFrame(list(LAND_COVER.items()), "cls int, title string")
    return legend.select("cls", "title", suitable_mask(F.col("cls")).alias("suitable"), water_mask(F.col("cls")).alias("dry"))


def combine(a: DataFrame, b: DataFrame, join: Callable[[Column, Column], Column], how: str = "inner") -> DataFrame:
    """Cell-aligned join of two layers. ``inner`` drops cells either side lacks.

    A merge join is asked for: the optimizer does not see how far an explode multiplied the cells, and would broadcast.
    """
    right = b.select(*CELL_KEY, F.col("value").alias("other")).hint("merge")
    return a.join(right, CELL_KEY, how).select(*CELL_KEY, join(F.col("value"), F.col("other")).alias("value"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x - y)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: x * y)


def divide(a: DataFrame, b: DataFrame) -> DataFrame:
    """Division by zero gives NODATA."""
    return combine(a, b, F.try_divide)


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    return combine(a, b, lambda x, y: (x == y).cast("int"))


def local_if(a: DataFrame, b: DataFrame, test: Callable[[Column, Column], Column], then) -> DataFrame:
    """``then`` where the test holds, the first layer's value elsewhere."""
    return combine(a, b, lambda x, y: F.when(test(x, y), then).otherwise(x), how="left")


def mask_onto(cells: DataFrame, layout: Layout, cover: DataFrame, cover_layout: Layout, mask) -> DataFrame:
    """The mask of a coarser class layer on the cells of a finer one (column ``mask``)."""
    return nearest_onto(cells, layout, cover, cover_layout, "cls").withColumn("mask", mask(F.col("cls"))).drop("cls")
