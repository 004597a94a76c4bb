"""Cases in which an operator once departed from its contract."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import ctw, langid, lines, pivots


def test_base_score_divides_by_one_more_than_all_words(spark):
    rows = spark.createDataFrame([(1, "a b a"), (2, "c")], "doc_id long, text string")
    got = {r["doc_id"]: r["base_score"] for r in ctw.evaluate(rows, F.col("doc_id") == 1).collect()}
    # in training: a twice, b and an end once; four tokens, three of them different
    assert got[1] == pytest.approx(sum(math.log10((c + 1) / (4 + 3 + 1)) for c in (2, 1, 2, 1)))
    assert got[2] == pytest.approx(math.log10(1 / 8) + math.log10(2 / 8))


def test_vectors_without_an_id(spark):
    near, far = [1.0, 0.0, 0.01], [0.0, 1.0, 0.0]
    rows = [(None, near), (None, [1.0, 0.0, 0.0]), (None, far), (None, None), (5, far), (7, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, pivots.link(df).collect()), key=repr)
    expected = [(None, 1, None, True), (None, 1, None, False), (None, 1, 5, False), (None, 0, None, True), (5, 1, 5, True), (7, 0, 7, True)]
    assert got == sorted(expected, key=repr)


@pytest.mark.parametrize("text, letter", [("½ ² 5", False), ("① ③ 12", False), ("_ 7 !", False), ("½ é", True), ("中", True), ("ª", True)])
def test_letters(spark, text, letter):
    model = langid.Model(["de", "en"], np.zeros((16, 2), np.float32), np.asarray([0.0, 1.0]), 1.0)
    row = langid.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (row["lang_pred"], row["score"] > 0) == (("en", True) if letter else ("und", False))


@pytest.mark.parametrize("percent", [50, 60, 66, 70, 75, 80, 90])
def test_short_lines_at_every_threshold(spark, percent):
    texts = ["aa bb cc dd", "aa bb cc", "ee ff", "ee ff gg", "hh", "hh ii", "aa bb cc dd jj", "kk ll mm nn oo pp", "kk ll mm nn oo"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(t.split()) for t in texts]
    similar = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    expected = {k: any(similar(sets[j], s) for j in range(k)) for k, s in enumerate(sets)}
    got = {r["doc_id"]: r["n_removed"] == 1 for r in lines.deduplicate(rows, percent).collect()}
    assert got == expected
