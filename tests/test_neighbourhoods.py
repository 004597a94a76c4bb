"""Analytic surfaces, and the window, block and stored-block forms against brute force."""

import math

import numpy as np
import pytest

from conftest import as_array, grid_cells
from ridgeline.model import Layout
from ridgeline.operators import blocks, focal, kernels, surface
from ridgeline.plans import products
from ridgeline.operators.vector import symbol_rings


def layout(shape, tile=16, cell=1.0):
    return Layout(3857, 0.0, 0.0, cell, cell, shape[1], shape[0], tile)


@pytest.fixture(scope="module")
def rough():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 500, (40, 37)).astype(float)
    a[rng.random(a.shape) < 0.2] = np.nan
    a[17:35, 3:30] = np.nan  # a hole larger than a block
    return a


def brute(a, offsets, reduce):
    out = np.full(a.shape, np.nan)
    for r, c in np.ndindex(a.shape):
        seen = [
            a[r + dr, c + dc]
            for dr, dc in offsets
            if 0 <= r + dr < a.shape[0] and 0 <= c + dc < a.shape[1] and not np.isnan(a[r + dr, c + dc])
        ]
        if seen:
            out[r, c] = reduce(seen)
    return out


def box(n):
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1)]


@pytest.mark.parametrize("form,tile", [("block", 16), ("block", 64), ("block", 2), ("window", 16)])
def test_square_forms_agree_with_brute_force(spark, rough, form, tile):
    found = focal.square_stats(grid_cells(spark, rough), layout(rough.shape, tile), 3, form).toPandas()
    for name, reduce in (("vmin", min), ("vmax", max), ("vsum", sum), ("vcount", len)):
        got = np.full(rough.shape, np.nan)
        got[found["row"], found["col"]] = found[name]
        np.testing.assert_array_equal(got, brute(rough, box(3), reduce))


@pytest.mark.parametrize("radius,tile", [(0.0, 16), (1.0, 16), (2.5, 16), (5.0, 64), (5.0, 4)])
def test_disc_sum(spark, rough, radius, tile):
    inside = [(i, j) for i, j in box(6) if i * i + j * j <= radius * radius]
    got = as_array(focal.focal_sum(grid_cells(spark, rough), layout(rough.shape, tile), radius), rough.shape)
    np.testing.assert_array_equal(got, brute(rough, inside, sum))


def horn_brute(a):
    east, south = np.full(a.shape, np.nan), np.full(a.shape, np.nan)
    for r, c in np.ndindex(a.shape):
        if np.isnan(a[r, c]):
            continue

        def at(dr, dc):
            i, j = r + dr, c + dc
            known = 0 <= i < a.shape[0] and 0 <= j < a.shape[1] and not np.isnan(a[i, j])
            return a[i, j] if known else a[r, c]

        east[r, c] = (at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))
        south[r, c] = (at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))
    return east, south


@pytest.mark.parametrize("form,tile", [("block", 16), ("block", 64), ("window", 16)])
def test_horn_forms_agree_with_brute_force(spark, rough, form, tile):
    found = surface.horn(grid_cells(spark, rough), layout(rough.shape, tile), form)
    for name, want in zip(("east", "south"), horn_brute(rough)):
        np.testing.assert_array_equal(as_array(found, rough.shape, name), want)


@pytest.mark.parametrize("halo_n,tile", [(1, 16), (3, 16), (9, 8), (20, 8)])
def test_stored_blocks_agree_with_cells(spark, rough, halo_n, tile):
    lay = layout(rough.shape, tile)
    cells = grid_cells(spark, rough)
    kernel = lambda arrays, inside, origin: {
        k: v if k == "vcount" else np.where(kernels.square_stats(arrays["value"], halo_n)["vcount"] > 0, v, np.nan)
        for k, v in kernels.square_stats(arrays["value"], halo_n).items()
        if k in ("vmax", "vcount")
    }
    stored = blocks.to_blocks(cells, lay)
    found = blocks.focal(stored, lay, halo_n, kernel, ("vmax",), keep="filled")
    got = as_array(blocks.to_cells(found, lay, "vmax"), rough.shape)
    np.testing.assert_array_equal(got, brute(rough, box(halo_n), max))


def test_stored_blocks_local_algebra(spark, rough):
    lay = layout(rough.shape)
    stored = blocks.to_blocks(grid_cells(spark, rough), lay)
    np.testing.assert_array_equal(as_array(blocks.to_cells(stored, lay), rough.shape), rough)
    doubled = blocks.local(stored, lambda v: v * 2)
    both = blocks.combine(doubled, stored, lambda a, b: a - b)
    np.testing.assert_array_equal(as_array(blocks.to_cells(both, lay), rough.shape), rough)


def test_plane_has_constant_slope_and_aspect(spark):
    r, c = np.mgrid[0:20, 0:20]
    lay = layout((20, 20), 8, cell=200.0)
    cells = grid_cells(spark, 3.0 * c + 4.0 * r)
    slope = as_array(surface.slope(cells, lay), (20, 20))[1:-1, 1:-1]
    aspect = as_array(surface.aspect(cells, lay), (20, 20))[1:-1, 1:-1]
    np.testing.assert_allclose(slope, math.degrees(math.atan(5 / 200)))
    np.testing.assert_allclose(aspect, 323.13010235415598)


def test_flat_ground(spark):
    lay = layout((9, 9), 4)
    cells = grid_cells(spark, np.full((9, 9), 7.0))
    assert set(as_array(surface.slope(cells, lay), (9, 9)).ravel()) == {0.0}
    assert np.isnan(as_array(surface.aspect(cells, lay), (9, 9))).all()
    assert np.isnan(as_array(products.tpi(cells, lay), (9, 9))).all()
    shade = as_array(surface.hillshade(cells, lay), (9, 9))
    assert set(shade.ravel()) == {math.floor(127 * math.sin(math.radians(40)) + 0.5)}


def test_cone_faces_all_ways(spark):
    r, c = np.mgrid[-15:16, -15:16]
    lay = layout((31, 31))
    facing = as_array(surface.aspect(grid_cells(spark, 100.0 - np.hypot(r, c)), lay), (31, 31))
    assert facing[1, 15] == pytest.approx(0.0, abs=1e-6) or facing[1, 15] == pytest.approx(360.0, abs=1e-6)
    assert facing[15, 29] == pytest.approx(90.0)
    assert facing[29, 15] == pytest.approx(180.0)
    assert facing[15, 1] == pytest.approx(270.0)


def test_statistics_are_ordered(spark, rough):
    found = focal.square_stats(grid_cells(spark, rough), layout(rough.shape), 2)
    assert found.where("vmin > vsum / vcount OR vsum / vcount > vmax").count() == 0
    position = products.tpi(grid_cells(spark, rough), layout(rough.shape), 2)
    assert position.where("value < 0 OR value > 1").count() == 0


def test_layers_do_not_mix(spark, rough):
    other = np.flipud(rough)
    both = grid_cells(spark, rough).unionByName(grid_cells(spark, other, "b"))
    found = focal.focal_max(both, layout(rough.shape), 2)
    for layer, a in (("a", rough), ("b", other)):
        got = as_array(found.where(f"layer = '{layer}'"), rough.shape)
        np.testing.assert_array_equal(got, brute(a, box(2), max))


def test_batch_agrees_with_single_products(spark, rough):
    from pyspark.sql import functions as F

    lay = layout(rough.shape, 16, 5.0)
    cells = grid_cells(spark, rough + 1)
    sized = cells.withColumns({"cell_w": F.lit(5.0), "cell_h": F.lit(5.0)})
    found = products.batch(sized, 16, 2)
    known = ~np.isnan(rough)
    for name, single in (
        ("slope", surface.slope(cells, lay)),
        ("aspect", surface.aspect(cells, lay)),
        ("hillshade", surface.hillshade(cells, lay)),
        ("tpi", products.tpi(cells, lay, 2)),
        ("tpi_ratio", products.tpi_ratio(cells, lay, 2)),
    ):
        want = as_array(single, rough.shape)
        np.testing.assert_allclose(as_array(found, rough.shape, name)[known], want[known], atol=1e-9)


@pytest.mark.parametrize("tile", [4, 16, 64])
def test_site_scores_do_not_depend_on_blocks(spark, rough, tile):
    scores = products.site_scores(grid_cells(spark, rough), layout(rough.shape, tile, 300.0), 2.0, decimals=6)
    got = as_array(scores, rough.shape)
    mean = brute(rough, box(1), lambda v: sum(v) / len(v))
    east, south = horn_brute(mean)
    slope = np.degrees(np.arctan(np.hypot(east / 2400.0, south / 2400.0)))
    ok = np.where(np.isnan(slope), np.nan, ((slope > 1e-9) & (slope < 15)).astype(float))
    disc = [(i, j) for i, j in box(2) if i * i + j * j <= 4]
    np.testing.assert_array_equal(got, brute(ok, disc, sum))


@pytest.mark.parametrize("tile", [4, 16])
def test_symbol_rings_cross_blocks(spark, tile):
    a = np.zeros((20, 20))
    a[8, 7] = 3
    got = as_array(symbol_rings(grid_cells(spark, a), layout((20, 20), tile), ((100, 5.0), (110, 3.0), (120, 1.0))), (20, 20))
    r, c = np.mgrid[0:20, 0:20]
    d2 = (r - 8) ** 2 + (c - 7) ** 2
    want = np.select([d2 <= 1, d2 <= 9, d2 <= 25], [120.0, 110.0, 100.0], 0.0)
    np.testing.assert_array_equal(got, want)


def test_unknown_forms_raise(spark, rough):
    with pytest.raises(ValueError):
        focal.square_stats(grid_cells(spark, rough), layout(rough.shape), 1, form="other")
    with pytest.raises(ValueError):
        products.radius_in_cells(layout((3, 3)), 5.0, "feet")
