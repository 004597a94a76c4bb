import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import as_array, grid_cells
from ridgeline.model import Layout
from ridgeline.operators import blocks, regions, stats


def expected_breaks(values, k):
    ordered = np.sort(values)
    return {i: ordered[-(-i * len(ordered) // k) - 1] for i in range(1, k + 1)}


@pytest.mark.parametrize("kind", ["ties", "real", "outlier", "negative", "tight", "single"])
def test_narrowed_breaks_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "ties": rng.integers(0, 5, 999).astype(float),
        "real": rng.normal(1000, 50, 1500),
        "outlier": np.append(rng.random(800), [1e38, -1e38]),
        "negative": -np.abs(rng.normal(0, 3, 777)),
        "tight": 1000 + rng.random(1200) * 1e-7,
        "single": np.array([4.25]),
    }[kind]
    cells = spark.createDataFrame([("a", 0, i, float(v)) for i, v in enumerate(values)], "layer string, row long, col long, value double")
    for k in (10, 3):
        got = {r["i"]: r["brk"] for r in stats.quantile_breaks(cells, k).collect()}
        assert got == expected_breaks(values, k)


def test_breaks_equal_sorted_ranks(spark):
    import math

    rng = np.random.default_rng(6)
    layers = {
        "hot": [float((k * 7919) % 101) for k in range(3000)],
        "tiny": [float(x) for x in 10.0 ** rng.uniform(-12, -3, 3000)],
        "denormal": [5e-324 * int(x) for x in rng.integers(-1000, 1000, 500)] + [-1e300, 1e300, 0.0],
        "signs": [float(x) for x in np.round(rng.normal(size=2000), 2)],
    }
    rows = [(name, k, 0, v) for name, values in layers.items() for k, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "layer string, row long, col long, value double")
    got = {(r["layer"], r["i"]): r["brk"] for r in stats.quantile_breaks(cells, 10).collect()}
    for name, values in layers.items():
        ordered = sorted(values)
        for i in range(1, 11):
            assert got[name, i] == ordered[math.ceil(i * len(ordered) / 10) - 1]


def test_breaks_of_more_than_a_million_values(spark):
    cells = spark.range(1_100_000).select(F.lit("a").alias("layer"), F.col("id").alias("row"), F.lit(0).alias("col"), F.col("id").cast("double").alias("value"))
    got = {r["i"]: r["brk"] for r in stats.quantile_breaks(cells, 10).collect()}
    assert got == {i: i * 110_000.0 - 1 for i in range(1, 11)}


def test_few_breaks_share_one_threshold(spark):
    breaks = spark.createDataFrame([([0.0, 4.0],), ([0.0, 1.0, 2.0, 5.0],)], "breaks array<double>")
    rows = stats.ring_thresholds(breaks).select("center", "middle", "outer").collect()
    assert [tuple(r) for r in rows] == [(4.0, 4.0, 4.0), (5.0, 2.0, 1.0)]


def flood(a):
    """Region ids by breadth-first search."""
    ids = np.full(a.shape, -1, dtype=np.int64)
    for r, c in np.ndindex(a.shape):
        if np.isnan(a[r, c]) or ids[r, c] >= 0:
            continue
        ids[r, c] = r * a.shape[1] + c
        todo = [(r, c)]
        while todo:
            i, j = todo.pop()
            for y, x in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                inside = 0 <= y < a.shape[0] and 0 <= x < a.shape[1]
                if inside and ids[y, x] < 0 and a[y, x] == a[i, j]:
                    ids[y, x] = ids[r, c]
                    todo.append((y, x))
    return ids


@pytest.mark.parametrize("kind", ["noise", "one", "snake"])
def test_regions_agree_with_flood_fill(spark, kind):
    rng = np.random.default_rng(5)
    a = {
        "noise": np.where(rng.random((30, 26)) < 0.1, np.nan, rng.integers(0, 2, (30, 26))),
        "one": np.ones((33, 17)),
        "snake": np.ones((29, 29)),
    }[kind].astype(float)
    if kind == "snake":
        a[1::2, :] = 0.0
        a[1::4, -1] = 1.0
        a[3::4, 0] = 1.0
    lay = Layout(3857, 0, 0, 1, 1, a.shape[1], a.shape[0], 8)
    got = as_array(regions.label(grid_cells(spark, a), lay), a.shape, "region")
    want = flood(a).astype(float)
    want[want < 0] = np.nan
    np.testing.assert_array_equal(got, want)


def test_region_reports(spark):
    a = np.array([[1, 1, 2], [2, 1, 2], [2, 2, 2]], dtype=float)
    lay = Layout(3857, 0, 0, 1, 1, 3, 3, 2)
    labelled = regions.label_blocks(blocks.to_blocks(grid_cells(spark, a), lay), lay)
    rows = {r["region"]: (r["value"], r["cells"], r["row0"], r["row1"], r["col0"], r["col1"]) for r in regions.summary(labelled, lay).collect()}
    assert rows == {0: (1.0, 3, 0, 1, 0, 1), 2: (2.0, 6, 0, 2, 0, 2)}
    assert {(r["value"], r["regions"]) for r in regions.regions_per_value(labelled, lay).collect()} == {(1.0, 1), (2.0, 1)}
    edges = regions.outline(labelled, lay)
    assert edges.where("region = 0").count() == 8
    assert "Generate" not in labelled._jdf.queryExecution().executedPlan().toString()  # no cell rows


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_outline_equals_a_plain_one(spark, tile):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((21, 17)) < 0.1, np.nan, rng.integers(0, 3, (21, 17))).astype(float)
    lay = Layout(3857, 0, 0, 1, 1, 17, 21, tile)
    got = {tuple(r) for r in regions.outline(regions.label_blocks(blocks.to_blocks(grid_cells(spark, a), lay), lay), lay).select("region", "row", "col", "side").collect()}
    ids, want = np.pad(flood(a), 1, constant_values=-1), set()
    for r, c in np.argwhere(ids >= 0).tolist():
        for side, dr, dc in (("N", -1, 0), ("E", 0, 1), ("S", 1, 0), ("W", 0, -1)):
            if ids[r + dr, c + dc] != ids[r, c]:
                want.add((int(ids[r, c]), r - 1, c - 1, side))
    assert got == want


def test_ids_beyond_doubles(spark):
    """A corner of a grid of 2^62 cells: neighbouring ids that no double tells apart."""
    far = 2**31 - 4
    lay = Layout(3857, 0, 0, 1, 1, 2**31, 2**31, 4)
    rows = [("a", far + r, far + c, float(v)) for r, c, v in ((0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 1), (1, 1, 1), (1, 2, 1))]
    cells = spark.createDataFrame(rows, "layer string, row long, col long, value double")
    got = {(r["row"] - far, r["col"] - far): r["region"] for r in regions.label(cells, lay).collect()}
    first = far * 2**31 + far
    assert got == {(0, 0): first, (0, 2): first, (1, 0): first, (1, 1): first, (1, 2): first, (0, 1): first + 1}
    with pytest.raises(ValueError):
        regions.label(cells, Layout(3857, 0, 0, 1, 1, 2**32, 2**32, 4))


def test_codes_order_as_values_do(spark):
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2**64, 4000, dtype=np.uint64).view(np.float64)
    edges = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), np.inf, -np.inf, 1.7976931348623157e308, 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2)]
    values = np.concatenate([bits[~np.isnan(bits)], edges, 2.0 ** np.arange(-1074, 1024), np.nextafter(2.0 ** np.arange(-1070, 1024), 0)])
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", stats.ordered_code(F.col("v")).alias("c"))
    got = rows.select("v", "c", stats.coded_value(F.col("c")).alias("back")).collect()
    assert all(r["v"] == r["back"] for r in got)
    expected = np.asarray([r["v"] for r in got]).view(np.int64)
    expected = np.where(expected < 0, -(expected & (2**63 - 1)), expected)
    assert [r["c"] for r in got] == expected.tolist()


@pytest.mark.parametrize("open_rows", [100_000, 3])
def test_breaks_of_many_layers_by_either_join(spark, monkeypatch, open_rows):
    monkeypatch.setattr(stats, "OPEN_ROWS", open_rows)
    rng = np.random.default_rng(1)
    rows = [(f"l{k % 23}" if k % 23 else None, float(rng.normal()) if k % 3 else 0.0) for k in range(3000)]
    cells = spark.createDataFrame(rows, "layer string, value double")
    got = {(r["layer"], r["i"]): r["brk"] for r in stats.quantile_breaks(cells, 4).collect()}
    for layer in {r[0] for r in rows}:
        want = expected_breaks(np.asarray([v for name, v in rows if name == layer]), 4)
        assert {i: got[layer, i] for i in want} == want
    whole = spark.createDataFrame([(2**62 + k,) for k in range(7)] + [(-(2**62),)] * 5, "value long")
    assert [r["brk"] for r in stats.quantile_breaks(whole, 2, ()).orderBy("i").collect()] == [2**62, 2**62 + 6]
    assert stats.quantile_breaks(cells.limit(0)).count() == 0


def test_a_frequent_value_is_combined_before_the_exchange(spark):
    """Two thirds of a layer are zero: what is exchanged is a count for each task."""
    cells = spark.range(0, 30_000, 1, 8).select(F.lit("a").alias("layer"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).otherwise(0.0).alias("value"))
    counts = stats._part_counts(cells.select("layer", stats.ordered_code(F.col("value")).alias("code_"), F.lit(1).alias("n_")), None, ["layer"])
    shown = counts._jdf.queryExecution().executedPlan().toString()
    assert shown.index("partial_sum") > shown.index("hashpartitioning")  # below it: before the exchange
