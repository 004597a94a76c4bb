"""Raster and terrain analytics as Spark DataFrame jobs."""

from ridgeline.model import Layout

__all__ = ["Layout"]
