"""Request documents: building, parsing, and site requests with aircraft lists."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMAND = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "geometry",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
                ]
            ),
        ),
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    ]
)
# Spacing between aircraft by day and by night, site diameter and slope limit.
DAY_BUFFER, NIGHT_BUFFER = 35, 50
SITE_DIAMETER, SITE_SLOPE = "25", "15.0"
AIRCRAFT_DETAILS = ("kind", "approach", "dimension", "degrees", "obstacleRatio")


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Closed ring: lower left, lower right, upper right, upper left, lower left."""
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.array(F.array(*[F.array(x, y) for x, y in corners]))


def point_list(x: Column, y: Column) -> Column:
    return F.array(F.array(F.array(x, y)))


def feature_json(kind: Column, geometry: str, coordinates: Column, properties: Mapping[str, Column]) -> Column:
    return F.to_json(
        F.struct(
            kind.alias("type"),
            F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry"),
            property_map(properties).alias("properties"),
        )
    )


def pipeline_json(kind: Column, properties: Mapping[str, Column]) -> Column:
    return F.to_json(F.struct(kind.alias("type"), property_map(properties).alias("properties")))


def property_map(properties: Mapping[str, Column]) -> Column:
    return F.create_map(*[part for k, v in properties.items() for part in (F.lit(k), v.cast("string"))])


def parse(requests: DataFrame, column: str = "body") -> DataFrame:
    """Add ``command``; a body without a geometry is a pipeline command. Broken bodies raise."""
    return requests.withColumn("command", F.from_json(column, COMMAND, {"mode": "FAILFAST"}))


def text_property(key: str) -> Column:
    return F.coalesce(F.try_element_at("command.properties", F.lit(key)), F.lit(""))


def number_property(key: str, default: float) -> Column:
    """The property as a number, the default when it is missing; a malformed number raises."""
    return F.coalesce(F.try_element_at("command.properties", F.lit(key)).cast("double"), F.lit(float(default)))


def integer_property(key: str, default: int) -> Column:
    return F.coalesce(F.try_element_at("command.properties", F.lit(key)).cast("int"), F.lit(default))


def is_pipeline() -> Column:
    return F.col("command.geometry").isNull()


def corner(number: int) -> tuple[Column, Column]:
    """Longitude and latitude of a corner of the first ring; NULL when there is none."""
    at = F.try_element_at(F.try_element_at("command.geometry.coordinates", F.lit(1)), F.lit(number + 1))
    return at[0], at[1]


def box() -> tuple[Column, Column, Column, Column]:
    """West, south, east, north from corners 0 and 2."""
    west, south = corner(0)
    east, north = corner(2)
    return west, south, east, north


def _largest(aircraft: DataFrame, tie: Column) -> Column:
    details = [c for c in AIRCRAFT_DETAILS if c in aircraft.columns]
    return F.max_by(F.struct("diameter", *details), F.struct(F.col("diameter"), tie)).alias("largest")


def area_diameter(buffer: float = DAY_BUFFER) -> Column:
    """Diameter of an area that holds all aircraft of a request."""
    return F.sum(F.col("diameter") + F.lit(buffer))


def site_parameters(
    aircraft: DataFrame,
    tie: Column,
    day: bool = True,
    diameter: str = SITE_DIAMETER,
    slope: str = SITE_SLOPE,
) -> DataFrame:
    """One row per site request: largest aircraft, total diameter and the command's properties.

    Among aircraft of equal diameter the last by ``tie`` counts. Aggregates with map-side
    combining, so a request with very many aircraft is no hot group.
    """
    buffer = DAY_BUFFER if day else NIGHT_BUFFER
    per_request = aircraft.groupBy("request_id").agg(_largest(aircraft, tie), area_diameter(buffer).alias("total"))
    details = {c: F.col(f"largest.{c}") for c in AIRCRAFT_DETAILS if c in aircraft.columns}
    properties = property_map(
        {
            "op": F.lit("hlz"),
            "optype": F.lit("analytic"),
            "jobid": F.col("request_id"),
            **details,
            "diameter": F.lit(diameter),
            "distanceBuffer": F.lit(buffer),
            "spacing": F.lit("true"),
            "slope": F.lit(slope),
        }
    )
    return per_request.select("request_id", "largest", "total", properties.alias("properties"))


def aircraft_of(requests: DataFrame, column: str = "helicopters") -> DataFrame:
    """Spread the aircraft lists of site requests; text fields become numbers."""
    spread = requests.select("request_id", F.posexplode(column).alias("pos", "a"))
    return spread.select(
        "request_id",
        "pos",
        F.col("a.diameter").cast("double").alias("diameter"),
        F.col("a.type").alias("kind"),
        F.col("a.approach").alias("approach"),
        F.col("a.dimension").alias("dimension"),
        F.col("a.degrees").alias("degrees"),
        F.col("a.obstacleRatio").alias("obstacleRatio"),
    )
