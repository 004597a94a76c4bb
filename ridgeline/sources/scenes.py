"""Scenes and layers in Parquet, as blocks in folders that prune the scan.

Scenes lie under ``scene_id=``; a join with the scenes that a search has found reads their folders only. Layers lie under
``type=/resolution=/filename=``, where the URI of their catalog document points to; their layouts are a table beside them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import geo, text
from ridgeline.model import BLOCK_SCHEMA, CELL_SCHEMA, LAYOUT_SCHEMA, Layout
from ridgeline.operators.blocks import BLOCK_KEY, to_cells
from ridgeline.operators.grid import target_layout
from ridgeline.operators.reshape import resample_blocks
from ridgeline.session import joinable
from ridgeline.sources.catalog import scene_document

SCENE_BLOCKS = T.StructType([T.StructField("scene_id", T.LongType())] + BLOCK_SCHEMA.fields[1:])
#: Scenes of one job that are sent to all tasks; the list of a larger job meets the scenes in a shuffle.
SENT_SCENES = 100_000


def read_cells(spark: SparkSession, uris: Sequence[str]) -> DataFrame:
    """Cells of scene files (Parquet; ``hdfs://`` or ``s3a://``), with the file as ``uri``."""
    if not uris:
        raise ValueError("no scene to read")
    return spark.read.schema(CELL_SCHEMA).parquet(*uris).withColumn("uri", F.input_file_name())


def write_scenes(scene_blocks: DataFrame, root: str) -> None:
    """Store ``scene_id, brow, bcol, cells`` by scene. Blocks are spread by address first, as one scene may hold most."""
    spread = scene_blocks.select(*SCENE_BLOCKS.names).repartition("scene_id", "brow", "bcol").sortWithinPartitions("scene_id", "brow", "bcol")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scene_id").parquet(root)


def read_scenes(spark: SparkSession, root: str) -> DataFrame:
    """All stored scenes; what is read of them is up to ``of_scenes`` and to filters on ``brow`` and ``bcol``."""
    return spark.read.schema(SCENE_BLOCKS).parquet(root).select(*SCENE_BLOCKS.names)


def of_scenes(stored: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of the chosen scenes; ``scene_id`` of both is joined, not collected.

    A list that is small is sent to the scan, which then reads the folders of these scenes alone.
    """
    wanted = chosen.select("scene_id")
    return stored.join(joinable(wanted, wanted.limit(SENT_SCENES + 1).count(), SENT_SCENES), "scene_id", "left_semi")


def resolution_label(layout: Layout) -> str:
    """Label of a lon/lat layer: metres per row along its west edge."""
    if layout.crs != 4326:
        raise ValueError("the label is defined on lon/lat layers")
    xmin, ymin, _, ymax = layout.extent
    metres = geo.haversine_metres(xmin, ymax, xmin, ymin) / layout.rows
    if metres >= 1:
        step = 100 if metres >= 100 else 10 if metres >= 10 else 1
        return f"{int(metres // step) * step}M"
    return f"{int(metres * 10) * 10}cm"


def _layouts(root: str) -> str:
    return f"{root.rstrip('/')}-layouts"


def _file_name(kind: str, layout: Layout, made_by: str) -> Column:
    """The same name for the same layer of the same job, so that a job that runs again replaces its own layer."""
    return F.concat(text.stable_id(*map(F.lit, (kind, made_by, repr(layout)))), F.lit(".tif"))


def write_layer(stored: DataFrame, layout: Layout, root: str, kind: str, resolution: str, made_by: str = "") -> DataFrame:
    """Store a layer's blocks and its layout; returns its catalog document, whose URI ``open_layer`` reads.

    The document comes last: a layer without one is not found, so a job that fails leaves nothing half done in sight.
    Blocks are sorted by address within each file, so readers of a region prune row groups.
    """
    name = _file_name(kind, layout, made_by)
    replaced = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    blocks = stored.select(*BLOCK_KEY, "cells", F.lit(kind).alias("type"), F.lit(resolution).alias("resolution"), name.alias("filename"))
    replaced(blocks.sortWithinPartitions("layer", "brow", "bcol")).partitionBy("type", "resolution", "filename").parquet(root)
    one = stored.sparkSession.range(1)
    fields = [F.lit(getattr(layout, f.name)).cast(f.dataType).alias(f.name) for f in LAYOUT_SCHEMA.fields[1:]]
    replaced(one.select(*fields, name.alias("filename"))).partitionBy("filename").parquet(_layouts(root))
    return one.select(scene_document(kind, name, F.lit(resolution), *map(F.lit, layout.extent)).alias("d")).select("d.*")


def open_layer(spark: SparkSession, root: str, uri: str) -> tuple[DataFrame, Layout]:
    """Blocks and layout of the layer that a document's URI names; the folder names prune both scans."""
    parts = uri.removeprefix("hdfs://").split("/")
    if not uri.startswith("hdfs://") or len(parts) != 3:
        raise ValueError(f"not the URI of a stored layer: {uri}")
    kind, resolution, name = parts
    row = spark.read.parquet(_layouts(root)).where(F.col("filename") == name).first()
    if row is None:
        raise ValueError(f"no layer is stored as {uri}")
    layout = Layout(**{f.name: row[f.name] for f in LAYOUT_SCHEMA.fields[1:]})
    return _stored(spark, root).where((F.col("type") == kind) & (F.col("resolution") == resolution) & (F.col("filename") == name)).select(*BLOCK_KEY, "cells"), layout


def _stored(spark: SparkSession, root: str) -> DataFrame:
    names = [T.StructField(n, T.StringType()) for n in ("type", "resolution", "filename")]
    return spark.read.schema(T.StructType(BLOCK_SCHEMA.fields + names)).parquet(root)


def read_layer(spark: SparkSession, root: str, kind: str, layout: Layout, resolution: str | None = None) -> DataFrame:
    """Cells of the stored layers of a kind; the folder names prune the scan."""
    stored = _stored(spark, root).where(F.col("type") == kind)
    if resolution is not None:
        stored = stored.where(F.col("resolution") == resolution)
    return to_cells(stored, layout)


def to_lonlat(stored: DataFrame, layout: Layout) -> tuple[DataFrame, Layout]:
    if layout.crs == 4326:
        return stored, layout
    target = target_layout(layout, 4326)
    return resample_blocks(stored, layout, target), target


def upload(stored: DataFrame, layout: Layout, kind: str, root: str, made_by: str = "") -> tuple[DataFrame, Layout]:
    """Bring a scene to lon/lat, label its resolution, store it, and return its document."""
    moved, target = to_lonlat(stored, layout)
    return write_layer(moved, target, root, kind, resolution_label(target), made_by), target
