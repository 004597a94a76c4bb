"""Picture tiles and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.session import path_exists


def write_tiles(tiles: DataFrame, root: str) -> None:
    """Store picture tiles under ``job_id=/z=``.

    Tiles are spread by address first: a deep zoom level holds most tiles of a job, so the folder
    alone would be one hot key.
    """
    spread = tiles.repartition("job_id", "z", "x", "y").sortWithinPartitions("z", "x", "y")
    # A job that runs again replaces its own folders and no others.
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id", "z").parquet(root)


def read_tile(spark: SparkSession, root: str, job_id: str, z: int, x: int, y: int) -> DataFrame:
    """One tile: folders prune job and zoom, row-group statistics x and y."""
    stored = spark.read.parquet(root)
    return stored.where((F.col("job_id") == job_id) & (F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))


def write_documents(documents: DataFrame, root: str, key: str) -> None:
    """Add documents as JSON lines; one whose ``key`` is there already is left out, so a second run changes nothing."""
    spark = documents.sparkSession
    if path_exists(spark, root):
        known = spark.read.schema(documents.schema).json(root).select(key)
        documents = documents.join(known, key, "left_anti").select(*documents.columns)
    documents.write.mode("append").json(root)
