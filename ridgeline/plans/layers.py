"""Layers derived from pairs of rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.model import CELL_KEY, Layout
from ridgeline.operators import local
from ridgeline.plans.products import with_mask

# Fixed value: an object stands more than this above the ground.
OBJECT_HEIGHT = 1.0


def obstruction_removed(bare: DataFrame, first: DataFrame, height: float = OBJECT_HEIGHT) -> DataFrame:
    """Bare earth, NODATA where the first return stands more than ``height`` above it."""
    return local.local_if(bare, first, lambda b, f: f > b + height, None)


def object_height(bare: DataFrame, first: DataFrame, height: float = OBJECT_HEIGHT) -> DataFrame:
    """First return above bare earth where that is more than ``height``, else 0."""
    return local.combine(bare, first, lambda b, f: F.when(f - b > height, f - b).otherwise(F.when((f - b).isNotNull(), 0)))


def cover_filtered(
    cells: DataFrame, layout: Layout, cover: DataFrame, cover_layout: Layout, mask: str = "zero"
) -> DataFrame:
    """Elevation on suitable land cover; elsewhere 0 or NODATA."""
    if mask not in ("zero", "nodata"):
        raise ValueError(f"unknown mask: {mask}")
    keyed = with_mask(cells, layout, cover, cover_layout, local.suitable_mask)
    product = F.col("value") * F.col("mask")
    value = product if mask == "zero" else F.when(F.col("mask") == 1, F.col("value"))
    return keyed.select(*CELL_KEY, value.alias("value"))


def combined_removal(
    bare: DataFrame,
    layout: Layout,
    first: DataFrame | None = None,
    cover: DataFrame | None = None,
    cover_layout: Layout | None = None,
    height: float = OBJECT_HEIGHT,
) -> tuple[DataFrame, dict[str, bool]]:
    """Bare earth without obstructions and without unsuitable land cover.

    An absent input skips its step; the flags say which steps ran.
    """
    out = bare
    if first is not None:
        out = obstruction_removed(out, first, height)
    if cover is not None:
        if cover_layout is None:
            raise ValueError("land cover needs its layout")
        out = cover_filtered(out, layout, cover, cover_layout, mask="nodata")
    return out, removal_flags(first is not None, cover is not None)


def removal_flags(first: bool, cover: bool) -> dict[str, bool]:
    """Which steps of a combined removal ran."""
    return {
        "result": True,
        "bareearthstored": True,
        "firstreturnstored": first,
        "landcoverincluded": cover,
        "firstreturnincluded": first,
        "obstructionstored": True,
    }


def flags_row(spark, flags: dict[str, bool]) -> DataFrame:
    """The flags as one row of text columns."""
    return spark.range(1).select(*[F.lit(str(v).lower()).alias(k) for k, v in flags.items()])
