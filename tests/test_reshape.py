"""Reshaping of stored blocks against the cell forms and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_array, grid_cells
from ridgeline.model import Layout
from ridgeline.operators import blocks, grid, render, reshape


def rough(shape, seed=1, gaps=0.15):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 100, shape).astype(float)
    a[rng.random(shape) < gaps] = np.nan
    return a


def bag(cells, places=9):
    return sorted((r["layer"], r["row"], r["col"], round(r["value"], places)) for r in cells.collect())


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
@pytest.mark.parametrize(
    "target",
    [
        Layout(3857, 97.0, 903.0, 7.0, 7.0, 50, 40, 16),  # finer
        Layout(3857, 90.0, 910.0, 63.0, 63.0, 6, 5, 4),  # coarser: blocks sample a few of many cells
        Layout(3857, 100.0, 900.0, 10.0, 10.0, 31, 23, 8),  # the same grid, other blocks
        Layout(3857, 195.0, 853.0, 0.5, 0.5, 40, 30, 8),  # very fine, a part only
        Layout(4326, 0.0008, 0.0082, 0.00007, 0.00007, 50, 40, 16),
    ],
)
def test_block_form_equals_the_cell_form(spark, target, method):
    a = rough((23, 31))
    source = Layout(3857, 100.0, 900.0, 10.0, 10.0, 31, 23, 5)
    cells = grid_cells(spark, a).unionByName(grid_cells(spark, a + 1000, "b"))
    found = blocks.to_cells(reshape.resample_blocks(blocks.to_blocks(cells, source), source, target, method), target)
    want = bag(grid.resample(cells, source, target, method))
    assert bag(found) == want and len(want) > 20


def test_one_coarse_cell_serves_many_blocks(spark):
    coarse, fine = Layout(3857, 0, 0, 64, 64, 2, 1, 4), Layout(3857, 0, 0, 1, 1, 128, 64, 8)
    cells = spark.createDataFrame([("a", 0, 0, 5.0), ("a", 0, 1, 7.0)], "layer string, row long, col long, value double")
    out = reshape.resample_blocks(blocks.to_blocks(cells, coarse), coarse, fine, "nearest")
    assert out.count() == 128
    got = as_array(blocks.to_cells(out, fine), (64, 128))
    assert (got[:, :64] == 5).all() and (got[:, 64:] == 7).all()
    pieces = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in pieces and pieces.count("Exchange hashpartitioning") == 2  # to blocks, and the footprints
    with pytest.raises(ValueError):
        reshape.resample_blocks(out, fine, coarse, "cubic")


@pytest.mark.parametrize("method", ["nearest", "average"])
@pytest.mark.parametrize("tile, base, end", [(2, 5, 0), (8, 5, 1), (16, 5, 0), (32, 6, 2)])
def test_pyramids_equal_the_cell_form(spark, method, tile, base, end):
    a = rough((29, 41), 4, 0.4)
    a[8:16, 16:32] = np.nan
    lay = Layout(3857, 0, 0, 1, 1, 41, 29, tile)
    cells = grid_cells(spark, a)
    levels = reshape.pyramid_blocks(blocks.to_blocks(cells, lay), tile, base, end, method)
    got = {}
    for r in levels.collect():
        for i, v in enumerate(r["cells"]):
            if v is not None:
                got[r["z"], r["brow"] * tile + i // tile, r["bcol"] * tile + i % tile] = round(v, 9)
    want = {(r["z"], r["row"], r["col"]): round(r["value"], 9) for r in grid.pyramid(cells, base, end, method, tile).collect()}
    assert got == want
    with pytest.raises(ValueError):
        reshape.pyramid_blocks(levels, 12, 3)


def test_mosaic_streams_scenes_in_rank_order(spark):
    lay = Layout(3857, 0, 0, 1, 1, 10, 12, 4)
    scenes = [rough((12, 10), s, 0.6) for s in range(7)]
    parts = [blocks.to_blocks(grid_cells(spark, a), lay).withColumn("scene_rank", F.lit(k)) for k, a in enumerate(scenes)]
    every = parts[0]
    for p in parts[1:]:
        every = p.unionByName(every)
    got = as_array(blocks.to_cells(reshape.mosaic_blocks(every.repartition(5)), lay), (12, 10))
    want = scenes[0]
    for a in scenes[1:]:
        want = np.where(np.isnan(want), a, want)
    np.testing.assert_array_equal(got, want)


def test_crop_keeps_addresses(spark):
    a = rough((20, 20), 2)
    lay = Layout(3857, 0, 0, 1, 1, 20, 20, 6)
    got = as_array(blocks.to_cells(reshape.crop_blocks(blocks.to_blocks(grid_cells(spark, a), lay), lay, 3, 13, 5, 12), lay), (20, 20))
    want = np.full_like(a, np.nan)
    want[3:14, 5:13] = a[3:14, 5:13]
    np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("op", ["hover", "hlz", "tpi", "hillshade", "slope"])
def test_painted_blocks_equal_painted_cells(spark, op):
    a = rough((16, 16), 6) / 50 - 0.5 if op == "tpi" else rough((16, 16), 6)
    lay = Layout(3857, 0, 0, 1, 1, 16, 16, 8)
    cells = grid_cells(spark, a)
    levels = reshape.pyramid_blocks(blocks.to_blocks(cells, lay), 8, 3, 1)
    tiles = render.block_tiles(render.paint_blocks(levels, op, cells), "j")
    plain = render.picture_tiles(render.paint(grid.pyramid(cells, 3, 1, "nearest", 8), op, cells), "j", 8)
    key = lambda r: (r["z"], r["x"], r["y"])
    assert {key(r): list(r["rgba"]) for r in tiles.collect()} == {key(r): list(r["rgba"]) for r in plain.collect()}
