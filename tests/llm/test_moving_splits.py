"""Splits of the input that move between the jobs of one query, as where executors are lost or added."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import ctw, substrings

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 8))
    passage = " ".join(word() for _ in range(12))
    rows = [(k, " ".join(word() for _ in range(150)) + (passage if k % 40 == 0 else "")) for k in range(1200)]
    path = str(tmp_path_factory.mktemp("splits") / "documents.parquet")
    table = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id")
    table.write.option("parquet.block.size", 65536).option("parquet.page.size.row.check.min", 10).option("parquet.page.size.row.check.max", 10).parquet(path)
    return spark.read.parquet(path)


def moving(spark, monkeypatch, module, step):
    """From this step on the input comes in other splits."""
    inner = getattr(module, step)

    def moved(*args):
        spark.conf.set(SPLIT, "300k")
        return inner(*args)

    monkeypatch.setattr(module, step, moved)
    spark.conf.set(SPLIT, "200k")


def test_the_input_has_splits(spark, docs):
    starts = {}
    for size in ("200k", "300k"):
        spark.conf.set(SPLIT, size)
        starts[size] = {r[0] for r in docs.select(F.input_file_block_start()).distinct().collect()}
    spark.conf.unset(SPLIT)
    assert len(starts["200k"]) > 2 and starts["200k"] != starts["300k"]


def test_substrings(spark, docs, monkeypatch):
    expected = sorted(map(repr, substrings.deduplicate(docs, 50).collect()))
    moving(spark, monkeypatch, substrings, "segments")
    got = sorted(map(repr, substrings.deduplicate(docs, 50).collect()))
    spark.conf.unset(SPLIT)
    assert sum("starts=[]" not in r for r in expected) == 29 and got == expected


def test_scores(spark, docs, monkeypatch):
    train = F.col("doc_id") % 5 != 0
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens")
    expected = sorted(ctw.evaluate(docs, train).collect())
    moving(spark, monkeypatch, ctw, "string_logs")
    got = sorted(ctw.evaluate(docs, train).collect())
    spark.conf.unset(SPLIT)
    for a, b in zip(got, expected, strict=True):
        assert [a[c] for c in columns] == [b[c] for c in columns] and a["score"] == pytest.approx(b["score"], rel=1e-6)
