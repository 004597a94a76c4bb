"""Steps whose memory or bounds must not depend on how large the tables are."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import phrases
from ridgeline.model import Layout
from ridgeline.operators import blocks, reshape, vector
from workloads.registry import QUERIES


def test_mosaic_of_keys_beyond_a_million(spark, tmp_path):
    rows = [(0, 0, 2, 5.5), (0, 0, 1, 7.9), (1_200_000, 60_000, 1, 3.2), (1_200_000, 60_000, 1, 2.1), (1_050_000, 5, 7, 9.0)]
    lines = spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["t3_mosaic_stored_blocks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 7), (1_050_000, 5, 9), (1_200_000, 60_000, 2)]


def test_mosaic_sorts_known_cells_only(spark):
    cells = [1.0] + [None] * 4095
    scenes = spark.createDataFrame([("a", i, 0, cells, i) for i in range(50)], "layer string, brow long, bcol long, cells array<double>, scene_rank int")
    plan = reshape.mosaic_blocks(scenes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2
    got = {r["brow"]: r["cells"] for r in reshape.mosaic_blocks(scenes).collect()}
    assert got == {i: cells for i in range(50)}


@pytest.mark.parametrize("known", [0, 1, 7, 8, 16])
def test_packed_blocks_come_back(known):
    cells = np.full(16, np.nan)
    cells[np.random.default_rng(known).permutation(16)[:known]] = np.arange(known) - 0.5
    size, held = reshape.packed(cells)
    assert held.size <= 16 and (held.size == 2 * known if known < 8 else size == 0)
    np.testing.assert_array_equal(reshape.unpacked(size, held), cells)


def test_points_are_dealt_to_tasks_by_the_rows_they_make(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROWS_OF_TASK", 1000, raising=False)
    lay = Layout(3857, 0.0, 0.0, 1.0, 1.0, 64, 2000, 16)
    places = [(k * 11 % 2000, k * 7 % 64) for k in range(800)] + [(5, 5)] * 800
    points = spark.createDataFrame([(k, r, c) for k, (r, c) in enumerate(places)], "point_id long, row long, col long").coalesce(1)
    near = vector.cells_around(points, lay, 3.0)
    disc = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
    want = Counter((k, r + i, c + j, i * i + j * j) for k, (r, c) in enumerate(places) for i, j in disc if 0 <= r + i < 2000 and 0 <= c + j < 64)
    assert Counter(map(tuple, near.select("point_id", "row", "col", "d2").collect())) == want
    held = [r["count"] for r in near.groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 4000 and len(held) > 20  # 45,000 rows came from one task


def test_burnt_points_of_one_cell_are_split_by_their_other_columns(spark, monkeypatch):
    monkeypatch.setattr(vector, "ROWS_OF_TASK", 1000, raising=False)
    dealt = []
    around = vector.cells_around
    monkeypatch.setattr(vector, "cells_around", lambda *given: dealt.append(around(*given)) or dealt[-1])
    lay = Layout(3857, 0.0, 0.0, 1.0, 1.0, 64, 200, 16)
    points = spark.range(800).selectExpr("'a' AS layer", "id AS point_id", "5L AS row", "5L AS col").coalesce(1)
    cells = lay.grid(spark, "a").withColumn("value", F.lit(0))
    burnt = vector.burn_points(cells, points, lay, 3.0, 7)
    assert burnt.count() == 200 * 64
    disc = {(5 + i, 5 + j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9}
    assert {(r["row"], r["col"]) for r in burnt.where("value = 7").collect()} == disc
    held = [r["count"] for r in dealt[0].groupBy(F.spark_partition_id()).count().collect()]
    assert max(held) < 4000 and len(held) > 10


def test_rows_of_phrase_counts_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "SUMS_OF_PART", 1000, raising=False)
    folder = str(tmp_path)
    text = " ".join(f"w{k}" for k in range(200_000)) + ". " + "one two three. " * 40
    docs = spark.createDataFrame([(text, "en")], "text string, lang string").coalesce(1)
    phrases.coded(docs, 1, "lang", "text").write.partitionBy("shard").parquet(f"{folder}/coded")
    first = phrases.count_cycles(spark, folder, 30, 1, 3, 16)
    counts = spark.read.parquet(f"{folder}/counts").where("n = 1 and step = 0").agg(F.sum("entries"), F.max("entries")).first()
    assert counts[0] == 200_003 and counts[1] <= 1 << 17  # a row held all words of a text, or two million phrases
    states = [spark.read.parquet(str(f)).count() for f in (tmp_path / "state").iterdir()]
    assert states == [512]  # 32 rows took the sums of any number of words
    found = phrases.frequent(spark, folder, first, 30, 3).where("n > 1").select("n", "a").collect()
    assert sorted(map(tuple, found)) == [(2, 40), (2, 40), (3, 40)]


def test_sparse_blocks_hold_known_cells_only(spark):
    lay = Layout(3857, 0.0, 0.0, 1.0, 1.0, 700, 900, 64)
    rng = np.random.default_rng(5)
    cells = {(s, int(r), int(c)): float(v) for s in range(1, 5) for r, c, v in zip(rng.integers(0, 900, 800), rng.integers(0, 700, 800), rng.normal(size=800))}
    cells |= {(s, 70 + k // 9, 70 + k % 9): None if (s + k) % 3 else float(s * 100 + k) for s in range(1, 5) for k in range(81)}
    cells |= {(1, 899, 699): float("nan"), (2, 0, 0): float("inf")}
    rows = [(str(s), r, c, v) for (s, r, c), v in cells.items()]
    table = spark.createDataFrame(rows, "layer string, row long, col long, value double").repartition(5)
    known = {k: v for k, v in cells.items() if v is not None and v == v}
    want = {(r, c): known[s, r, c] for s, r, c in sorted(known, reverse=True)}
    found = {}
    for sparse in (False, True):
        stored = blocks.to_blocks(table, lay, sparse)
        assert {(r["layer"], r["row"], r["col"]): r["value"] for r in blocks.to_cells(stored, lay).collect()} == {(str(s), r, c): v for (s, r, c), v in known.items()}
        scenes = stored.withColumn("scene_rank", F.col("layer").cast("int")).withColumn("layer", F.lit(None).cast("string"))
        mosaic = reshape.mosaic_blocks(scenes)
        assert mosaic.select("brow", "bcol").distinct().count() == mosaic.count()
        found[sparse] = {(r["row"], r["col"]): r["value"] for r in blocks.to_cells(mosaic, lay).collect()}
        if sparse:
            held = stored.agg(F.sum(F.size("cells")), F.sum(F.size("places"))).first()
            assert tuple(held) == (len(known), len(known))
    assert found[False] == found[True] == want


def test_stored_mosaic_of_lines_moves_known_cells_only(spark, tmp_path, monkeypatch):
    stored = []
    make = blocks.to_blocks
    monkeypatch.setattr(blocks, "to_blocks", lambda *a, **b: stored.append(make(*a, **b)) or stored[-1])
    lines = spark.createDataFrame([(k * 100, k * 70, k % 7, float(k)) for k in range(50)], "l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["t3_mosaic_stored_blocks"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k * 100, k * 70, k) for k in range(50)]
    assert stored[0].agg(F.sum(F.size("cells"))).first()[0] == 50  # 4,096 cells of each block went through Python twice


def test_sparse_blocks_merge_across_batches(monkeypatch):
    monkeypatch.setattr(reshape, "BATCH_CELLS", 3)
    rows = [("m", 0, 0, [1, 2], [1.0, 2.0]), ("m", 0, 0, [2, 3], [9.0, 3.0]), ("m", 0, 0, [], []), ("m", 0, 0, [0, 1, 4], [5.0, 9.0, 4.0]), ("m", 0, 1, [], []), (None, 0, 1, [7], [7.0])]
    whole = pa.RecordBatch.from_pylist([dict(zip(reshape.SPARSE.names, r)) for r in rows], pa.schema([("layer", pa.string()), ("brow", pa.int64()), ("bcol", pa.int64()), ("places", pa.list_(pa.int32())), ("cells", pa.list_(pa.float64()))]))
    for size in (1, 2, 4, 6):
        got = [r for b in reshape.first_known_places(whole.slice(k, size) for k in range(0, 6, size)) for r in b.to_pylist()]
        assert [tuple(r.values()) for r in got] == [("m", 0, 0, [0, 1, 2, 3, 4], [5.0, 1.0, 2.0, 3.0, 4.0]), ("m", 0, 1, [], []), (None, 0, 1, [7], [7.0])]
