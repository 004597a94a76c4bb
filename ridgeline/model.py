"""Data model.

A raster layer is a *cell table*: ``layer STRING, row BIGINT, col BIGINT,
value``. NODATA is a NULL value or an absent row. A ``Layout`` is the small
driver-side description of the grid the cells lie on. ``layer`` is part of
every grouping and join key, so one job handles any number of scenes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL_KEY = ["layer", "row", "col"]

CELL_SCHEMA = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("row", T.LongType()),
        T.StructField("col", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("brow", T.LongType()),
        T.StructField("bcol", T.LongType()),
        T.StructField("cells", T.ArrayType(T.DoubleType())),
    ]
)

LAYOUT_SCHEMA = T.StructType(
    [
        T.StructField("layer", T.StringType()),
        T.StructField("crs", T.IntegerType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("cell_w", T.DoubleType()),
        T.StructField("cell_h", T.DoubleType()),
        T.StructField("cols", T.LongType()),
        T.StructField("rows", T.LongType()),
        T.StructField("tile_size", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class Layout:
    """Grid geometry: ``(x0, y0)`` is the upper-left corner, rows run south."""

    crs: int
    x0: float
    y0: float
    cell_w: float
    cell_h: float
    cols: int
    rows: int
    tile_size: int = 256

    @property
    def resolution(self) -> float:
        return math.sqrt(self.cell_w * self.cell_h)

    @property
    def extent(self) -> tuple[float, float, float, float]:
        return (
            self.x0,
            self.y0 - self.rows * self.cell_h,
            self.x0 + self.cols * self.cell_w,
            self.y0,
        )

    def with_tile_size(self, tile_size: int) -> Layout:
        return replace(self, tile_size=tile_size)

    # Cell <-> map coordinates.
    def x_of(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + F.lit(0.5)) * F.lit(self.cell_w)

    def y_of(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + F.lit(0.5)) * F.lit(self.cell_h)

    def col_of(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / F.lit(self.cell_w))

    def row_of(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / F.lit(self.cell_h))

    def contains(self, row: Column, col: Column) -> Column:
        return row.between(0, self.rows - 1) & col.between(0, self.cols - 1)

    def checked(self, cells: DataFrame) -> DataFrame:
        """The cells as they are; one outside the layout ends the job, as its address would be taken for another one."""
        message = F.concat_ws(" ", F.lit("cell outside the layout:"), F.col("row").cast("string"), F.col("col").cast("string"))
        held = self.contains(F.col("row"), F.col("col"))
        return cells.withColumn("row", F.when(held, F.col("row")).otherwise(F.raise_error(message).cast("long")))

    def grid(self, spark, layer: str | None = None) -> DataFrame:
        """All cell addresses of the layout, generated in parallel."""
        ids = spark.range(self.rows * self.cols)
        out = ids.select(
            F.expr(f"id div {self.cols}").alias("row"),
            F.expr(f"id % {self.cols}").alias("col"),
        )
        return out if layer is None else out.select(F.lit(layer).alias("layer"), "row", "col")


def grid_to_map(df: DataFrame, layout: Layout) -> DataFrame:
    """Add the map coordinates ``x, y`` of each cell centre."""
    return df.withColumns({"x": layout.x_of(F.col("col")), "y": layout.y_of(F.col("row"))})


def map_to_grid(df: DataFrame, layout: Layout, x: str = "x", y: str = "y") -> DataFrame:
    """Add the ``row, col`` of the cell that holds each point."""
    return df.withColumns({"row": layout.row_of(F.col(y)), "col": layout.col_of(F.col(x))})
