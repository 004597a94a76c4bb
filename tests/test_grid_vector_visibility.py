import math

import numpy as np
import pytest

from conftest import as_array, grid_cells
from ridgeline.functions import geo
from ridgeline.model import Layout
from ridgeline.operators import grid, vector, visibility


def layout(shape, tile=16, cell=1.0):
    return Layout(3857, 0.0, 0.0, cell, cell, shape[1], shape[0], tile)


def test_projection_round_trip():
    for lon, lat in ((-77.5, 39.0), (0.0, 0.0), (179.9, -84.9)):
        x, y = geo.project_point(4326, 3857, lon, lat)
        back = geo.project_point(3857, 4326, x, y)
        assert back == pytest.approx((lon, lat), abs=1e-9)
    assert geo.project_point(4326, 3857, 0.0, 90.0)[1] == pytest.approx(grid.MERCATOR_HALF, rel=1e-6)


def test_haversine_is_symmetric():
    a = geo.haversine_metres(-77.0, 38.0, -76.0, 39.0)
    assert a == pytest.approx(geo.haversine_metres(-76.0, 39.0, -77.0, 38.0))
    assert geo.haversine_metres(0, 0, 0, 1) == pytest.approx(math.pi * 6371000 / 180)


@pytest.mark.parametrize("tile", [5, 16, 64])
def test_resampling_does_not_depend_on_blocks(spark, tile):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 100, (23, 31)).astype(float)
    a[rng.random(a.shape) < 0.15] = np.nan
    source = Layout(3857, 100.0, 900.0, 10.0, 10.0, 31, 23, tile)
    target = Layout(3857, 97.0, 903.0, 7.0, 7.0, 50, 40, 16)
    got = as_array(grid.resample(grid_cells(spark, a), source, target), (40, 50))
    near = as_array(grid.resample(grid_cells(spark, a), source, target, "nearest"), (40, 50))
    want, want_near = np.full((40, 50), np.nan), np.full((40, 50), np.nan)
    for r, c in np.ndindex(want.shape):
        x, y = 97.0 + (c + 0.5) * 7, 903.0 - (r + 0.5) * 7
        fr, fc = (900.0 - y) / 10 - 0.5, (x - 100.0) / 10 - 0.5
        r0, c0 = math.floor(fr), math.floor(fc)
        total = weight = 0.0
        for i, wi in ((r0, 1 - (fr - r0)), (r0 + 1, fr - r0)):
            for j, wj in ((c0, 1 - (fc - c0)), (c0 + 1, fc - c0)):
                if 0 <= i < 23 and 0 <= j < 31 and not np.isnan(a[i, j]):
                    total += wi * wj * a[i, j]
                    weight += wi * wj
        if weight > 0:
            want[r, c] = total / weight
        i, j = math.floor(fr + 0.5), math.floor(fc + 0.5)
        if 0 <= i < 23 and 0 <= j < 31:
            want_near[r, c] = a[i, j]
    np.testing.assert_allclose(got, want, atol=1e-9)
    np.testing.assert_array_equal(near, want_near)


def test_zoom_layout_covers_only_cells_near_data(spark):
    lay = Layout(4326, -77.0, 39.0, 0.001, 0.001, 20, 20, 8)
    zoom, world = grid.zoom_layout(grid.target_layout(lay, 3857))
    found = grid.resample(grid_cells(spark, np.ones((20, 20))), lay, world)
    assert zoom == grid.zoom_for(world.resolution) and world.cols == 256 * 2**zoom
    n = found.count()
    assert 100 < n < 2500
    assert found.where("value <> 1").count() == 0


def test_crop_then_pyramid(spark):
    a = np.arange(64, dtype=float).reshape(8, 8)
    lay = layout((8, 8))
    part, small = grid.crop(grid_cells(spark, a), lay, 2.0, -6.5, 4.5, -3.0)
    assert (small.cols, small.rows) == (3, 4)
    np.testing.assert_array_equal(as_array(part, (4, 3)), a[3:7, 2:5])
    levels = grid.pyramid(grid_cells(spark, a), 3, 0, "nearest", 2)
    assert {(r["z"], r["count"]) for r in levels.groupBy("z").count().collect()} == {(3, 64), (2, 16), (1, 4), (0, 1)}
    top = grid.pyramid(grid_cells(spark, a), 3, 0, "average", 2).where("z = 0").first()
    assert top["value"] == a.mean()


def test_mosaic_takes_first_known(spark):
    rows = [("a", 0, 0, None, 1), ("a", 0, 0, 5.0, 2), ("a", 0, 0, 6.0, 3), ("a", 0, 1, 7.0, 9)]
    readings = spark.createDataFrame(rows, "layer string, row long, col long, value double, scene_rank int")
    assert {(r["col"], r["value"]) for r in grid.mosaic(readings).collect()} == {(0, 5.0), (1, 7.0)}


def ring_reference(z, row, col, radius):
    """Horizon of each cell, written per cell with recursion to the ring before it."""
    h = {(0, 0): z[row, col]}
    at = lambda dr, dc: (
        z[row + dr, col + dc]
        if 0 <= row + dr < z.shape[0] and 0 <= col + dc < z.shape[1] and dr * dr + dc * dc <= radius * radius
        else np.nan
    )
    eye, seen = z[row, col], {}
    for ring in range(1, radius + 1):
        for dr in range(-ring, ring + 1):
            for dc in range(-ring, ring + 1):
                if max(abs(dr), abs(dc)) != ring:
                    continue
                if ring == 1:
                    h[dr, dc] = at(dr, dc)
                else:
                    pr, pc = dr * (ring - 1) / ring, dc * (ring - 1) / ring
                    if abs(dr) == ring:
                        i = int(round(pr))
                        lo, f = math.floor(pc + 1e-12), pc - math.floor(pc + 1e-12)
                        f = 0.0 if abs(f) < 1e-9 else f
                        before = h[i, lo] if f == 0 else (1 - f) * h[i, lo] + f * h[i, lo + 1]
                    else:
                        j = int(round(pc))
                        lo, f = math.floor(pr + 1e-12), pr - math.floor(pr + 1e-12)
                        f = 0.0 if abs(f) < 1e-9 else f
                        before = h[lo, j] if f == 0 else (1 - f) * h[lo, j] + f * h[lo + 1, j]
                    reach = before + (before - eye) / (ring - 1)
                    h[dr, dc] = np.nan if np.isnan(reach) or np.isnan(at(dr, dc)) else max(at(dr, dc), reach)
                if not np.isnan(at(dr, dc)):
                    seen[row + dr, col + dc] = int(at(dr, dc) == h[dr, dc])
    return seen


def test_ring_viewshed_agrees_with_recurrence(spark):
    rng = np.random.default_rng(11)
    z = rng.integers(0, 30, (26, 26)).astype(float)
    z[4, 5] = np.nan
    observers = spark.createDataFrame([("a", 1, 12, 12), ("a", 2, 1, 20), ("a", 3, 4, 5)], "layer string, observer_id long, row long, col long")
    found = visibility.ring_viewshed(observers, grid_cells(spark, z), layout(z.shape), 7).collect()
    for who, (r, c) in ((1, (12, 12)), (2, (1, 20))):
        got = {(x["row"], x["col"]): x["visible"] for x in found if x["observer_id"] == who}
        assert got.pop((r, c)) == 1
        assert got == ring_reference(z, r, c, 7)
    assert not [x for x in found if x["observer_id"] == 3]


def test_wall_hides_what_lies_behind(spark):
    z = np.zeros((11, 21))
    z[:, 10] = 50.0
    seen = visibility.viewshed(
        spark.createDataFrame([("a", 0, 5, 5)], "layer string, observer_id long, row long, col long"),
        grid_cells(spark, z),
        layout(z.shape),
        15,
        observer_height=2.0,
    )
    got = {(r["row"], r["col"]): r["visible"] for r in seen.collect()}
    assert all(v == (1 if c <= 10 else 0) for (r, c), v in got.items())
    high = visibility.viewshed(
        spark.createDataFrame([("a", 0, 5, 5)], "layer string, observer_id long, row long, col long"),
        grid_cells(spark, z),
        layout(z.shape),
        15,
        observer_height=2.0,
        target_height=500.0,
    )
    assert high.where("visible = 0").count() == 0


def test_line_is_connected(spark):
    lay = layout((30, 30))
    vertices = spark.createDataFrame(
        [(1, 0, 2.5, -3.5), (1, 1, 20.5, -9.5), (1, 2, 20.5, -25.5), (2, 0, 5.5, -5.5), (2, 1, 5.5, -5.5)],
        "line_id long, seq int, x double, y double",
    )
    cells = {(r["row"], r["col"]) for r in vector.burn_lines(vertices, lay).collect()}
    assert {(3, 2), (9, 20), (25, 20), (5, 5)} <= cells
    path = cells - {(5, 5)}
    assert len(path) == 19 + 16
    for r, c in path - {(25, 20)}:
        assert any((r + i, c + j) in path for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def test_points_at_the_edge_stay_inside(spark):
    lay = layout((5, 5))
    pts = spark.createDataFrame([("a", 0, 0), ("a", 4, 4)], "layer string, row long, col long")
    near = vector.cells_around(pts, lay, 2.0)
    assert near.where("row < 0 OR col < 0 OR row > 4 OR col > 4").count() == 0
    assert near.where("d2 > 4").count() == 0
    assert near.count() == 2 * 6


def sight_reference(z, row, col, radius, eye=0.0, up=0.0):
    """Sight lines, one sample after the other."""
    seen = {}
    for r, c in np.argwhere(~np.isnan(z)).tolist():
        dr, dc = r - row, c - col
        if dr * dr + dc * dc > radius * radius:
            continue
        n = max(abs(dr), abs(dc))
        rise = z[r, c] + up - z[row, col] - eye
        samples = [(k, z[row + (2 * k * dr + n) // (2 * n), col + (2 * k * dc + n) // (2 * n)]) for k in range(1, n)]
        seen[r, c] = int(not any((s - z[row, col] - eye) * n > rise * k for k, s in samples))
    return seen


def many_blocks(seed=3):
    rng = np.random.default_rng(seed)
    z = np.cumsum(rng.integers(-3, 4, (61, 70)), axis=1).astype(float) + rng.integers(0, 4, (61, 70))
    z[rng.random(z.shape) < 0.03] = np.nan
    z[16:24, 32:40] = np.nan  # a block without data
    observers = [(k, int(r), int(c)) for k, (r, c) in enumerate(zip(rng.integers(0, 61, 9), rng.integers(0, 70, 9)))] + [(20, 30, 30), (21, 30, 30)]
    return z, [(k, r, c) for k, r, c in observers if not np.isnan(z[r, c])]


@pytest.mark.parametrize("pairs", [1 << 20, 64])
def test_sight_lines_over_more_than_three_blocks(spark, monkeypatch, pairs):
    """A radius of three blocks and a half, in one group of observers for each block and in many."""
    monkeypatch.setattr(visibility, "PAIRS", pairs)
    z, observers = many_blocks()
    df = spark.createDataFrame([("a", *o) for o in [*observers, (20, 30, 30)]], "layer string, observer_id long, row long, col long")
    got = visibility.viewshed(df, grid_cells(spark, z), layout(z.shape, 8), 28, observer_height=1.0, target_height=0.5).collect()
    for who, r, c in observers:
        assert {(x["row"], x["col"]): x["visible"] for x in got if x["observer_id"] == who} == sight_reference(z, r, c, 28, 1.0, 0.5)
    assert len(got) == len({(x["observer_id"], x["row"], x["col"]) for x in got})


@pytest.mark.parametrize("tile", [8, 16, 100])
def test_rings_over_more_than_three_blocks(spark, tile):
    z, observers = many_blocks(5)
    df = spark.createDataFrame([("a", *o) for o in observers], "layer string, observer_id long, row long, col long")
    got = visibility.ring_viewshed(df, grid_cells(spark, z), layout(z.shape, tile), 27).collect()
    for who, r, c in observers:
        own = {(x["row"], x["col"]): x["visible"] for x in got if x["observer_id"] == who}
        assert own.pop((r, c)) == 1 and own == ring_reference(z, r, c, 27)


def test_corridors_hold_every_sample():
    rng = np.random.default_rng(1)
    for t in (4, 7):
        for _ in range(200):
            r, c, tr, tc = rng.integers(0, 80, 4).tolist()
            blocks_ = set(visibility.corridor((r, r, c, c), (tr // t, tc // t), t))
            dr, dc = tr - r, tc - c
            n = max(abs(dr), abs(dc))
            for k in range(1, n):
                assert ((r + (2 * k * dr + n) // (2 * n)) // t, (c + (2 * k * dc + n) // (2 * n)) // t) in blocks_
        assert len(list(visibility.corridor((0, 3, 0, 3), (40, 40), t))) < 6 * 41  # a band, not the square


def test_observers_outside_the_layout_raise(spark):
    stray = spark.createDataFrame([("a", 1, 99, 0)], "layer string, observer_id long, row long, col long")
    z = np.zeros((5, 5))
    with pytest.raises(Exception, match="outside the layout"):
        visibility.viewshed(stray, grid_cells(spark, z), layout(z.shape), 3).collect()
    none = visibility.ring_viewshed(stray.limit(0), grid_cells(spark, z), layout(z.shape), 3)
    assert none.count() == 0 and visibility.viewshed(stray.limit(0), grid_cells(spark, z), layout(z.shape), 3).count() == 0


def test_lines_are_clipped_before_they_are_walked(spark):
    rng = np.random.default_rng(6)
    lay = layout((40, 50), 8)
    ends = np.concatenate([rng.uniform(-30, 80, (60, 4)), rng.uniform(-500, 500, (60, 4)), [[3, -3, 3, -3], [-1e9, -5.2, 1e9, -6.9], [5.5, 2e9, 9.5, -3e9], [1e9, 1e9, 2e9, 1e9]]])
    rows = [(i, s, float(e[2 * s]), float(e[2 * s + 1])) for i, e in enumerate(ends) for s in (0, 1)]
    df = spark.createDataFrame(rows, "line_id long, seq int, x double, y double")
    got = {(r["row"], r["col"]) for r in vector.burn_lines(df, lay).collect()}
    want = set()
    for x0, y0, x1, y1 in ends.tolist():
        r0, c0, r1, c1 = math.floor(-y0), math.floor(x0), math.floor(-y1), math.floor(x1)
        dr, dc = r1 - r0, c1 - c0
        n = max(abs(dr), abs(dc))
        inside = range(n + 1) if n < 10**5 else {k for a, d, size in ((r0, dr, 40), (c0, dc, 50)) if d for v in range(-1, size + 1) for k in range((v - a) * n // d - 2 - n // abs(d), (v - a) * n // d + 3 + n // abs(d)) if 0 <= k <= n} if n // max(1, min(abs(dr), abs(dc)) or n) < 10**5 else range(0)
        if n >= 10**5 and not inside:  # nearly level: step along the longer axis
            a, d, size = (r0, dr, 40) if abs(dr) == n else (c0, dc, 50)
            inside = [k for k in ((v - a) * (1 if d > 0 else -1) for v in range(size)) if 0 <= k <= n]
        for k in inside:
            at = (r0, c0) if n == 0 else (r0 + (2 * k * dr + n) // (2 * n), c0 + (2 * k * dc + n) // (2 * n))
            if 0 <= at[0] < 40 and 0 <= at[1] < 50:
                want.add(at)
    assert got == want
    far = vector.burn_lines(spark.createDataFrame([(1, 0, 1e6, 1e6), (1, 1, 2e6, 3e6)], "line_id long, seq int, x double, y double"), lay)
    assert far.count() == 0
