"""Paths, well-known text and JSON documents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_uri(uri: Column) -> tuple[Column, Column]:
    """``s3://bucket/key`` -> (bucket, key); ``hdfs://path`` -> ("hdfs", path); else ("empty", "empty")."""
    s3 = r"(?i)^s3[an]?://([^/]+)/(.*)$"
    hdfs = r"(?i)^hdfs://(.*)$"
    bucket = F.when(uri.rlike(s3), F.regexp_extract(uri, s3, 1)).when(uri.rlike(hdfs), F.lit("hdfs"))
    key = F.when(uri.rlike(s3), F.regexp_extract(uri, s3, 2)).when(uri.rlike(hdfs), F.regexp_extract(uri, hdfs, 1))
    return F.coalesce(bucket, F.lit("empty")), F.coalesce(key, F.lit("empty"))


def is_scene_file(path: Column) -> Column:
    return F.lower(path).contains(".tif")


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def number_text(value: Column) -> Column:
    """Fixed six decimals, so the text does not depend on how an engine prints doubles."""
    return F.format_string("%.6f", value)


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), number_text(x), F.lit(" "), number_text(y), F.lit(")"))


def box_wkt(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Ring: lower left, upper left, upper right, lower right, lower left."""
    corners = [(xmin, ymin), (xmin, ymax), (xmax, ymax), (xmax, ymin), (xmin, ymin)]
    texts = [F.concat_ws(" ", number_text(x), number_text(y)) for x, y in corners]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(",", *texts), F.lit("))"))


def stable_id(*parts: Column) -> Column:
    """An id that the same parts always give."""
    return F.sha2(F.concat_ws("|", *parts), 256)
