"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import graph, langid, lines, minhash, mixing, packing, pivots, quality, substrings, toxicity
from ridgeline.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, length long, kept boolean, block long, bits string, stays_id int, n int"
LONG = " ".join(f"w{k}" for k in range(30_000))
ROWS = [
    (1, "one two three four five six seven eight", "en", "src0"),
    (2, "ONE two three four five six seven  eight", "en", None),
    (2, "ONE two three four five six seven  eight", "en", None),
    (3, None, "en", "src1"),
    (4, "", None, "src1"),
    (5, "  \n\t\n", "de", "other"),
    (6, LONG, "de", "src2"),
    (7, LONG + " more", None, "src2"),
    (None, "null id", "fr", "src2"),
    (9, "a\r\nb\x00c\n\n1234 5678", "es", ""),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 0, 1, 2, True, 3, "b", 4, 5) for i, t, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (6, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def test_packing(docs):
    rows = packing.pack(docs, tokenizer(), 2048).collect()
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert [r["length"] for r in rows if r["doc_id"] == 3] == [1]


def test_quality(docs, labels, spark):
    rows = quality.assess(docs, labels).collect()
    assert len(rows) == len(ROWS) and [r["n_words"] for r in rows if r["doc_id"] == 3] == [0]
    none = quality.assess(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)
    assert quality.assess(docs.limit(0), labels).count() == 0


def test_trees_follow_their_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = (rng.random(2000) < 1 / (1 + np.exp(-6 * (x[:, 0] - x[:, 1] + 0.3 * np.sin(20 * x[:, 0]))))).astype(float)
    trees = quality.Boosting([1, -1, 0]).fit(x, y)
    grid = np.linspace(0, 1, 200)
    for f, sign in ((0, 1), (1, -1)):
        probe = np.tile(rng.random(3), (200, 1))
        probe[:, f] = grid
        assert (np.diff(trees.margin(probe)) * sign >= -1e-12).all()
    assert np.mean((trees.probability(x) > 0.5) == y) > 0.8


def test_language(docs):
    rows = {r["doc_id"]: r for r in langid.identify(docs, F.lit(True)).collect()}
    assert rows[3]["lang_pred"] == rows[4]["lang_pred"] == rows[5]["lang_pred"] == "und" and rows[3]["score"] == 0
    assert rows[6]["lang_pred"] in ("en", "de", "fr", "es")
    assert {r["lang_pred"] for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    margins = rng.normal(size=(4000, 3))
    p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
    truth = np.asarray([rng.choice(3, p=q) for q in p])
    assert langid.calibrate(5 * margins, truth) == pytest.approx(5, rel=0.15)


def test_toxicity(docs, labels):
    assert toxicity.assess(docs, labels).count() == len(ROWS)
    assert not any(r["rejected"] for r in toxicity.assess(docs, labels.where("toxic = 0")).collect())
    kept = toxicity.clean(docs, toxicity.Ordinal({"one": 9.0}, np.asarray([1.0])))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {3, 4, 5, 6, 7, 9, None}
    assert toxicity.assess(docs.limit(0), labels).count() == 0


def test_thresholds_rise_and_weights_are_shared():
    rows = [[0]] * 60 + [[1]] * 60 + [[0, 1]] * 60 + [[]] * 60
    grades = np.asarray([1] * 60 + [1] * 30 + [0] * 30 + [2] * 60 + [0] * 60)
    w, theta = toxicity.fit_ordinal(rows, grades, 2)
    assert (np.diff(theta) >= 0).all() and w[0] > 0 and w[1] > 0
    above = toxicity.Ordinal({}, theta).above([w[0] + w[1], 0.0])
    assert above[0].sum() > 1.5 and above[1].sum() < 0.5


def test_line_dedup(docs, spark):
    rows = {r["doc_id"]: r for r in lines.deduplicate(docs).collect()}
    assert rows[2]["text"] == "" and rows[2]["n_removed"] == 1 and rows[3]["text"] is None
    assert rows[5]["text"] == "  \n\t\n" and rows[7]["text"] == "" and rows[9]["n_removed"] == 0
    assert lines.deduplicate(docs).columns[: len(docs.columns)] == docs.columns
    assert lines.deduplicate(docs.limit(0)).count() == 0


def test_near_copies(docs, spark):
    rows = minhash.deduplicate(docs, 85).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and found[2]["component_id"] == 1 and found[7]["component_id"] == 6
    assert found[3]["n_shingles"] == 0 and found[3]["kept"] and found[None]["kept"]
    assert minhash.deduplicate(docs.limit(0), 85).count() == 0


def test_a_large_group_of_near_copies(spark):
    """A star: all are linked with the base, few with each other; sizes and blocks vary."""
    base = [f"w{k}" for k in range(400)]
    texts = [base] + [[*base[:k], f"x{k}", *base[k + 1 :]] for k in range(0, 400, 2)] + [base[: 400 - k] for k in range(1, 60)]
    rows = spark.createDataFrame([(1000 + k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    assert {r["component_id"] for r in minhash.deduplicate(rows, 85).collect()} == {1000}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(3)
    edges = {"chain": [(k, k + 1) for k in range(200)], "star": [(0, k) for k in range(1, 300)], "random": [tuple(map(int, e)) for e in rng.integers(0, 400, (300, 2))], "none": []}[shape]
    root = list(range(401))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1] or x in got}


def test_vectors(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=16)
    rows = [(k, [float(x) for x in near + 0.03 * rng.normal(size=16)], 0, 1) for k in range(60)] + [(100 + k, [float(x) for x in rng.normal(size=16)], 0, 1) for k in range(60)]
    rows += [(200, None, 0, 1), (201, [], 0, 1), (202, [0.0] * 16, 0, 1), (203, [1.0, None] * 8, 0, 1), (204, [float("nan")] * 16, 0, 1), (205, [math.inf] * 16, 0, 1)]
    rows += [(300, rows[0][1], 0, 1), (301, [1e-300] * 16, 0, 1), (302, [1e300] * 16, 0, 1), (303, [1.0] * 3, 0, 1), (304, [2.0] * 3, 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, pivot int")
    got = {r["vec_id"]: r for r in pivots.link(df).collect()}
    unit = {i: np.asarray(v) / np.max(np.abs(v)) for i, v, _, _ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = {i: sum(j != i and len(u) == len(v) and u @ v >= 0.95 for j, v in unit.items()) for i, u in unit.items()}
    assert sum(got[i]["n_links"] for i in unit) >= 0.95 * sum(links.values()) and all(got[i]["n_links"] <= links[i] for i in unit)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(200, 206))
    assert got[300]["component_id"] == 0 and got[302]["component_id"] == 301 and got[304]["component_id"] == 303
    assert pivots.link(df.limit(0)).count() == 0


def test_recall_of_the_pivot_index(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    points = np.repeat(centres, 30, 0) + rng.normal(size=(1200, 32)) * rng.uniform(0.05, 0.22, (1200, 1))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(5)
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    exact = (unit @ unit.T >= 0.95).sum() - len(unit)
    found = pivots.link(df).agg(F.sum("n_links")).first()[0]
    assert 0.9 * exact <= found <= exact


def test_mixing(docs):
    out = mixing.mix(docs, {"src0": 3.0, "src1": 0.0, "src2": 1.0}, other_weight=1.0, epochs=200.0)
    rows = out.collect()
    assert out.columns == [*[c for c in docs.columns if c != "copy"], "copy", "rate", "shuffle_key"]
    assert [r["shuffle_key"] for r in rows] == sorted(r["shuffle_key"] for r in rows)
    share = sum(r["source"] == "src0" for r in rows) / len(rows)
    assert share == pytest.approx(3 / 5, abs=0.1) and not any(r["source"] == "src1" for r in rows)
    assert mixing.mix(docs.limit(0), {"src0": 1.0}).count() == 0
    assert mixing.mix(docs, {}, other_weight=0.0).count() == 0


def test_repetitions_follow_the_distribution(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix(rows, {"a": 1.0, "b": 1.0}).groupBy("source", "doc_id").count().groupBy("source", "count").count().toDF("source", "times", "docs").collect()
    for source, n, rate in (("a", 10_000, 2.0), ("b", 30_000, 2 / 3)):
        for times in (1, 2, 3):
            expected = n * math.exp(-rate) * rate**times / math.factorial(times)
            found = next(r["docs"] for r in out if (r["source"], r["times"]) == (source, times))
            assert found == pytest.approx(expected, abs=5 * math.sqrt(expected))


def test_substrings(docs, spark):
    rows = substrings.deduplicate(docs, 50).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ROWS) and found[3]["n_bytes"] == 0 and found[6]["starts"] == []
    assert found[7]["starts"] == [0] and found[7]["ends"] == [len(LONG)] and bytes(found[7]["kept"]) == b" more"
    assert found[2]["starts"] == []
    assert substrings.deduplicate(docs.limit(0), 50).count() == 0


def test_substrings_of_few_letters_and_many_partitions(spark):
    rng = np.random.default_rng(2)
    pool = ["".join(rng.choice(list("ab"), 70)) for _ in range(6)]
    texts = ["".join(pool[k] if rng.random() < 0.5 else "".join(rng.choice(list("abé"), 30)) for k in rng.integers(0, 6, 5)) for _ in range(60)]
    texts += ["é" * 80, "é" * 30, "a" + "é" * 40, "a" * 49, "a" * 50, "a" * 51]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    first = {}
    for r in sorted(substrings.deduplicate(df, 50).collect()):
        data = texts[r["doc_id"]].encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], r["doc_id"]) < r["doc_id"]:
                gone[p : p + 50] = True
        assert bytes(r["kept"]) == np.frombuffer(data, np.uint8)[~gone].tobytes()


def test_expansion_gives_common_prefixes():
    rng = np.random.default_rng(4)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    order = substrings.suffix_order(text, 50)
    around = np.concatenate([text, text, text])
    value = substrings.common_prefixes(text, order, 50)
    for row in range(1, len(text)):
        a, b = around[order[row - 1] :][:50], around[order[row] :][:50]
        same = int(np.argmin(a == b)) if (a != b).any() else -1
        assert value[row] == same
