"""The scene catalog as a table: searches, documents, inventory."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.functions import geo, text

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
_wkt = T.StructType(_text("@WKT"))

SCENE_DOCUMENT = T.StructType(
    [
        T.StructField("origin", _wkt),
        *_text("dataset", "uri", "directory"),
        T.StructField("center", _wkt),
        *_text("location"),
        T.StructField("bbox", _wkt),
        *_text("filetype", "type", "filename", "resolution"),
    ]
)
JOB_DOCUMENT = T.StructType(
    [
        *_text("dataset", "jobid", "resolution"),
        T.StructField("bbox", _wkt),
        *_text("urlRoot", "result", "jobtype", "projection", "contentType"),
    ]
)
SEARCHABLE = ("dataset", "type", "resolution", "filetype", "uri")


def search_box(scenes: DataFrame, kind: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Scenes of a type whose box meets the query box. Five plain comparisons, all pushed down."""
    return scenes.where(
        (F.col("type") == kind)
        & (F.col("xmin") <= xmax)
        & (F.col("xmax") >= xmin)
        & (F.col("ymin") <= ymax)
        & (F.col("ymax") >= ymin)
    )


def search_radius(scenes: DataFrame, lon: float, lat: float, metres: float) -> DataFrame:
    """Scenes whose centre lies within ``metres`` of a point; adds ``metres``.

    A box in degrees is compared first: it is pushed down, the great-circle distance is not.
    """
    spread_lat = math.degrees(metres / (geo.EARTH_KM * 1000)) * 1.001
    coslat = max(math.cos(math.radians(min(90.0, abs(lat) + spread_lat))), 1e-6)
    spread_lon = min(360.0, spread_lat / coslat * 1.001)
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    near = scenes.where((F.col("ymin") <= lat + spread_lat) & (F.col("ymax") >= lat - spread_lat))
    if abs(lon) + spread_lon <= 180.0:
        near = near.where((F.col("xmin") <= lon + spread_lon) & (F.col("xmax") >= lon - spread_lon))
    distance = geo.haversine(F.lit(lon), F.lit(lat), cx, cy)
    return near.withColumn("metres", distance).where(F.col("metres") <= metres)


def search_box_radius(scenes: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Radius search from a box: its centre, reaching to its north-east corner."""
    dx, dy = (xmax - xmin) / 2, (ymax - ymin) / 2
    radius = (dx * dx + dy * dy) ** 0.5 * geo.METRES_PER_DEGREE
    return search_radius(scenes, xmin + dx, ymin + dy, radius)


def job_scenes(scenes: DataFrame, kind: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """The scenes a job reads: a box search without those stored in ``wgs84``."""
    return search_box(scenes, kind, xmin, ymin, xmax, ymax).where(~F.col("uri").contains("wgs84"))


def envelopes(scenes: DataFrame) -> DataFrame:
    """``scene_id, content``: the document as stored, nested as text in an envelope."""
    document = F.to_json(
        F.struct(
            F.struct(text.point_wkt(F.col("xmin"), F.col("ymin")).alias("@WKT")).alias("origin"),
            "dataset",
            "uri",
            "directory",
            F.struct(_centre_wkt().alias("@WKT")).alias("center"),
            "location",
            F.struct(text.box_wkt(*map(F.col, ("xmin", "ymin", "xmax", "ymax"))).alias("@WKT")).alias("bbox"),
            "filetype",
            "type",
            "filename",
            "resolution",
        )
    )
    return scenes.select("scene_id", F.to_json(F.struct(document.alias("document"))).alias("content"))


def _centre_wkt():
    return text.point_wkt((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2)


def match_documents(stored: DataFrame, prop: str, value: str) -> DataFrame:
    """Parse stored documents and keep those whose property equals ``value``, ignoring case."""
    if prop not in SEARCHABLE:
        raise ValueError(f"not a searchable property: {prop}")
    # Exploding an array of one parses a text once, and not again for each use of what it holds.
    once = lambda content, *names: F.inline(F.array(F.from_json(content, T.StructType(_text(*names)))))
    parsed = stored.select("scene_id", once("content", "document")).select("scene_id", once("document", *{prop, "uri"}))
    bucket, key = text.split_uri(F.col("uri"))
    return parsed.where(F.lower(F.col(prop)) == value.lower()).select("scene_id", "uri", bucket.alias("bucket"), key.alias("key"))


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files under a folder: ``path, length, modified``. File contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return (
        files.load(folder)
        .select("path", "length", F.col("modificationTime").alias("modified"))
        .where(~F.col("path").endswith(","))
    )


def scene_document(kind: str, file_name, resolution, xmin, ymin, xmax, ymax):
    """Struct of a layer's document. ``origin`` is the lower-left corner."""
    return F.struct(
        F.struct(text.point_wkt(xmin, ymin).alias("@WKT")).alias("origin"),
        resolution.alias("dataset"),
        F.concat_ws("/", F.lit(f"hdfs://{kind}"), resolution, file_name).alias("uri"),
        resolution.alias("directory"),
        F.struct(text.point_wkt((xmin + xmax) / 2, (ymin + ymax) / 2).alias("@WKT")).alias("center"),
        F.lit("HDFS").alias("location"),
        F.struct(text.box_wkt(xmin, ymin, xmax, ymax).alias("@WKT")).alias("bbox"),
        F.lit("tif").alias("filetype"),
        F.lit(kind).alias("type"),
        file_name.alias("filename"),
        resolution.alias("resolution"),
    )


def job_document(job_id, op, resolution, xmin, ymin, xmax, ymax, result):
    """Struct of a job's document; an empty resolution marks box and url as unknown."""
    known = F.length(resolution) > 0
    unknown = F.lit("Unknown")
    return F.struct(
        job_id.alias("dataset"),
        job_id.alias("jobid"),
        F.when(known, resolution).otherwise(unknown).alias("resolution"),
        F.struct(F.when(known, text.box_wkt(xmin, ymin, xmax, ymax)).otherwise(unknown).alias("@WKT")).alias("bbox"),
        F.when(known, F.concat(F.lit("/api/catalog/tile/for/"), job_id)).otherwise(unknown).alias("urlRoot"),
        result.alias("result"),
        op.alias("jobtype"),
        F.lit("EPSG:3857").alias("projection"),
        F.lit("image/png").alias("contentType"),
    )
