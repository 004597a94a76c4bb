"""Rasters, scenes, points and requests derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.model import Layout

TILE = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout(spark: SparkSession, sf_dir: str) -> Layout:
    """The elevation grid: one row per embedding (``vec_id`` has no gaps), 64 columns."""
    rows = table(spark, sf_dir, "embeddings").count()
    return Layout(3857, -8654000.0, 4710000.0, 200.0, 200.0, 64, rows, TILE)


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row"), F.posexplode("embedding").alias("p", "e")
    )
    z = F.floor(F.col("e").cast("double") * 1000) + 1000
    return cells.select(
        F.lit("dem").alias("layer"), "row", F.col("p").cast("long").alias("col"), z.cast("long").alias("value")
    )


def dem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dem(spark, sf_dir).where((F.col("row") * 13 + F.col("col") * 29) % 11 != 0)


def first_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    raised = F.when(
        (F.col("row") * 31 + F.col("col") * 17) % 7 == 0, (F.col("row") + F.col("col")) % 40
    ).otherwise(0)
    return dem(spark, sf_dir).withColumn("value", F.col("value") + raised)


def landcover_layout(lay: Layout) -> Layout:
    return Layout(lay.crs, lay.x0, lay.y0, lay.cell_w * 4, lay.cell_h * 4, lay.cols // 4, -(-lay.rows // 4), TILE)


def landcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = dem(spark, sf_dir).select(F.expr("row div 4").alias("row"), F.expr("col div 4").alias("col")).distinct()
    cls = 1 + (F.col("row") * 7 + F.col("col") * 3) % 15
    return coarse.select(F.lit("dem").alias("layer"), "row", "col", cls.cast("int").alias("value"))


def sparse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several scenes over one grid: every line item is one reading of a cell.

    The rank orders by order, line and price in one number; (order, line) alone is not unique.
    """
    line = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.lit("sparse").alias("layer"),
        F.col("l_partkey").alias("row"),
        F.col("l_suppkey").alias("col"),
        F.floor("l_extendedprice").cast("long").alias("value"),
        (line * 2**24 + F.floor("l_extendedprice")).alias("scene_rank"),
    )


def sparse_layout(spark: SparkSession, sf_dir: str) -> Layout:
    """The grid of part and supplier keys, as far as line items have any."""
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_partkey"), F.max("l_suppkey")).first()
    rows, cols = (max(0, -1 if key is None else key) + 1 for key in last)
    return Layout(3857, 0.0, 0.0, 1.0, 1.0, cols, rows, TILE)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        sparse_records(spark, sf_dir)
        .groupBy("layer", "row", "col")
        .agg(F.min("value").alias("value"))
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ["sources", "noobs", "lcnoobs", "hover"])), (s % 4 + 1).cast("int"))
    xmin = (F.lit(-78000000) + (s % 10) * 90000) / 1e6
    ymin = (F.lit(36000000) + ((s * 7) % 13) * 70000) / 1e6
    xmax = (F.lit(-78000000) + (s % 10) * 90000 + 100000) / 1e6
    ymax = (F.lit(36000000) + ((s * 7) % 13) * 70000 + 100000) / 1e6
    stem = F.concat(F.lit("scene_"), s.cast("string"), F.when(s % 9 == 0, F.lit("_wgs84")).otherwise(F.lit("")))
    head = F.when(s % 2 == 0, F.lit("s3://scenes/")).otherwise(F.lit("hdfs://"))
    uri = F.concat(head, kind, F.lit("/10M/"), stem, F.when(s % 5 == 0, F.lit(".TIF")).otherwise(F.lit(".tif")))
    return table(spark, sf_dir, "supplier").select(
        s.alias("scene_id"),
        kind.alias("type"),
        F.lit("10M").alias("dataset"),
        F.lit("10M").alias("resolution"),
        F.lit("tif").alias("filetype"),
        uri.alias("uri"),
        F.lit("10M").alias("directory"),
        F.lit("HDFS").alias("location"),
        stem.alias("filename"),
        xmin.alias("xmin"),
        ymin.alias("ymin"),
        xmax.alias("xmax"),
        ymax.alias("ymax"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("dem").alias("layer"),
        k.alias("point_id"),
        ((k * 11) % n).alias("row"),
        ((k * 7) % 64).alias("col"),
    )


def request_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lon/lat box per customer, spread over the area of the scenes."""
    k = F.col("c_custkey")
    west = F.lit(-78000000) + ((k * 37) % 1000) * 900
    south = F.lit(36000000) + ((k * 53) % 1000) * 900
    return table(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        (west / 1e6).alias("xmin"),
        (south / 1e6).alias("ymin"),
        ((west + 20000) / 1e6).alias("xmax"),
        ((south + 20000) / 1e6).alias("ymax"),
    )


def aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"),
        F.col("l_linenumber").alias("pos"),
        F.col("l_quantity").alias("diameter"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
    )
