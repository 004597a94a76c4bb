"""Geodesy as Column expressions, with plain-number twins for driver-side layouts."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius (km), Mercator sphere radius (m), its latitude limit, and metres per degree.
EARTH_KM = 6371.0
MERCATOR_RADIUS = 6378137.0
MERCATOR_LATITUDE = 85.05112878
METRES_PER_DEGREE = 110996.45


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        half_lon
    ) * F.sin(half_lon)
    return F.lit(EARTH_KM) * (2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))) * 1000


def haversine_metres(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    half_lat, half_lon = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    a = math.sin(half_lat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(half_lon) ** 2
    return EARTH_KM * 2 * math.atan2(math.sqrt(a), math.sqrt(1 - a)) * 1000


def project(source: int, target: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Between lon/lat (4326) and Web Mercator (3857)."""
    if source == target:
        return x, y
    if (source, target) == (4326, 3857):
        lat = F.greatest(F.lit(-MERCATOR_LATITUDE), F.least(F.lit(MERCATOR_LATITUDE), y))
        return (
            F.lit(MERCATOR_RADIUS) * F.radians(x),
            F.lit(MERCATOR_RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)),
        )
    if (source, target) == (3857, 4326):
        return (
            F.degrees(x / F.lit(MERCATOR_RADIUS)),
            F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(MERCATOR_RADIUS))) - F.lit(math.pi / 2)),
        )
    raise ValueError(f"no projection from {source} to {target}")


def project_point(source: int, target: int, x: float, y: float) -> tuple[float, float]:
    if source == target:
        return x, y
    if (source, target) == (4326, 3857):
        lat = max(-MERCATOR_LATITUDE, min(MERCATOR_LATITUDE, y))
        return MERCATOR_RADIUS * math.radians(x), MERCATOR_RADIUS * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
    if (source, target) == (3857, 4326):
        return math.degrees(x / MERCATOR_RADIUS), math.degrees(2 * math.atan(math.exp(y / MERCATOR_RADIUS)) - math.pi / 2)
    raise ValueError(f"no projection from {source} to {target}")


def axis_maps(source: int, target: int):
    """The projection as two numpy functions, one per axis."""
    if source == target:
        return (lambda x: x), (lambda y: y)
    if (source, target) == (4326, 3857):

        def north(y):
            lat = np.clip(y, -MERCATOR_LATITUDE, MERCATOR_LATITUDE)
            return MERCATOR_RADIUS * np.log(np.tan(math.pi / 4 + np.radians(lat) / 2))

        return (lambda x: MERCATOR_RADIUS * np.radians(x)), north
    if (source, target) == (3857, 4326):
        return (
            lambda x: np.degrees(x / MERCATOR_RADIUS),
            lambda y: np.degrees(2 * np.arctan(np.exp(y / MERCATOR_RADIUS)) - math.pi / 2),
        )
    raise ValueError(f"no projection from {source} to {target}")


def resolution_label(metres: Column) -> Column:
    """Metres per row as a label: down to hundreds, tens or ones with ``M``, else tenths as ``cm``."""
    whole = (
        F.when(metres >= 100, F.floor(metres / 100) * 100)
        .when(metres >= 10, F.floor(metres / 10) * 10)
        .otherwise(F.floor(metres))
    )
    tenths = F.floor(metres * 10) * 10
    return F.when(metres >= 1, F.concat(whole.cast("string"), F.lit("M"))).otherwise(
        F.concat(tenths.cast("string"), F.lit("cm"))
    )
