"""Shapes of the physical plans."""

import os

import pytest
from pyspark.sql import functions as F

from ridgeline.model import Layout
from ridgeline.operators import focal, grid, surface
from ridgeline.plans import products
from ridgeline.sources import catalog

SF = "/root/testdata/sf0.001"
LAY = Layout(3857, 0.0, 0.0, 200.0, 200.0, 256, 256, 64)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cells(spark, layer=True):
    name = F.lit("a") if layer else F.concat(F.lit("l"), (F.col("id") % 3).cast("string"))
    return spark.range(65536).select(
        name.alias("layer"), F.expr("id div 256").alias("row"), F.expr("id % 256").alias("col"), F.col("id").alias("value")
    )


@pytest.mark.parametrize("layer", [True, False])
def test_one_exchange_per_neighbourhood(spark, layer):
    for df in (
        surface.slope(cells(spark, layer), LAY),
        focal.square_stats(cells(spark, layer), LAY, 2),
        products.tpi(cells(spark, layer), LAY),
        products.site_scores(cells(spark, layer), LAY, 3.0),
        grid.resample(cells(spark, layer), LAY, Layout(4326, 0.0, 0.0, 0.01, 0.01, 100, 100)),
        surface.slope(cells(spark, layer), LAY, form="window"),
    ):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_pyramid_exchanges_once_per_tile_depth(spark):
    shown = plan(grid.pyramid(cells(spark), 8, 0, tile_size=256))
    assert shown.count("Exchange hashpartitioning") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_search_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "scenes")
    spark.range(10).select(
        F.col("id").alias("scene_id"),
        F.lit("sources").alias("type"),
        F.lit("u").alias("uri"),
        *[F.col("id").cast("double").alias(c) for c in ("xmin", "ymin", "xmax", "ymax")],
    ).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    shown = plan(catalog.search_box(spark.read.parquet(path), "sources", 1.0, 1.0, 2.0, 2.0).select("scene_id"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = shown[shown.index("PushedFilters") :]
    for part in ("EqualTo(type,sources)", "LessThanOrEqual(xmin,2.0)", "GreaterThanOrEqual(xmax,1.0)"):
        assert part in pushed
    assert "uri" not in shown[shown.index("ReadSchema") :]


def test_aligned_cells_are_never_broadcast(spark):
    from ridgeline.operators import local
    from ridgeline.operators.blocks import to_blocks, to_cells

    few = to_cells(to_blocks(cells(spark).limit(100), LAY), LAY)
    for df in (local.subtract(cells(spark), few), grid.nearest_onto(cells(spark), LAY, few, LAY, "cls")):
        assert "BroadcastHashJoin" not in plan(df)


def test_cells_outside_the_layout_raise(spark):
    from ridgeline.operators.blocks import to_blocks

    stray = spark.createDataFrame([("a", -1, 2, 1.0)], "layer string, row long, col long, value double")
    with pytest.raises(Exception, match="outside the layout"):
        to_blocks(stray, LAY).collect()
