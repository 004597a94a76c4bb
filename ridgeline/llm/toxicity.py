"""Toxicity: cumulative-link ordinal regression on sparse text features.

A document has the features "holds this word" and "holds a word that starts with these letters" (three to six). One
weight vector is shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k), with theta_0 <= theta_1 <= ...; the
expected severity is the sum of these probabilities. Weights are fitted by proximal gradient steps with an L1 penalty,
on a bounded sample of graded documents, over the features whose frequency differs most between clean and other
documents of the sample. Scoring looks at every word of every text.

Odd cases: a null or empty text has no feature; a null grade is not learned from; without graded documents of both
kinds nothing is rejected; repeated rows are each scored; other columns are not read and may have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, chunks, kept, record

WORDS = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6)


def words(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def features(held: set[str]) -> set[str]:
    """Words as they are, prefixes with a dash."""
    found = set(held)
    for k in PREFIXES:
        found.update([w[:k] + "-" for w in held if len(w) > k])
    return found


def candidates(graded: DataFrame, most: int = 4000, least_docs: int = 4) -> list[str]:
    """The features whose share of documents differs most between grade 0 and the rest (by z score)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, other, n = Counter(), Counter(), [0, 0]
        for chunk in chunks(batches, "text"):
            for text, grade in zip(chunk.column("text").to_pylist(), chunk.column("grade").to_pylist()):
                (other if grade else clean).update(features(words(text or "")))
                n[grade > 0] += 1
        names = ["", *(clean.keys() | other.keys())]
        clean[""], other[""] = n
        for k in range(0, len(names), 50_000):
            part = names[k : k + 50_000]
            yield record(arrow_schema("feature string, clean long, other long"), feature=part, clean=[clean[f] for f in part], other=[other[f] for f in part])

    counted = graded.mapInArrow(count, "feature string, clean long, other long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("other").alias("other"))
    total = counted.where(F.col("feature") == "").first()
    if total is None or not total["clean"] or not total["other"]:
        return []
    a, b = F.col("other") / total["other"], F.col("clean") / total["clean"]
    both = (F.col("other") + F.col("clean")) / (total["other"] + total["clean"])
    z = (a - b) / F.sqrt(both * (1 - both) * (1 / total["other"] + 1 / total["clean"]) + 1e-12)
    apart = counted.where((F.col("feature") != "") & (F.col("other") + F.col("clean") >= least_docs)).withColumn("z", z)
    return sorted(r["feature"] for r in apart.orderBy(F.abs("z").desc(), "feature").limit(most).collect())


@dataclass
class Ordinal:
    weights: dict[str, float]
    thresholds: np.ndarray

    def score(self, text: str) -> float:
        return sum(self.weights[f] for f in sorted(features(words(text)) & self.weights.keys()))

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return 1 / (1 + np.exp(-(np.asarray(scores, float)[:, None] - self.thresholds[None, :])))


def fit_ordinal(rows: list[list[int]], grades: np.ndarray, n_features: int, l1: float = 2e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds for rows of feature numbers, by accelerated proximal gradient descent.

    The loss is the sum over thresholds of the logistic loss of "grade > k"; thresholds are not penalised.
    """
    levels = np.arange(int(grades.max()))
    beyond = (grades[:, None] > levels[None, :]).astype(float)
    lengths = np.asarray([len(r) for r in rows])
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if lengths.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    often = np.bincount(flat, minlength=n_features) / len(rows)
    scale = 1 / np.sqrt(np.maximum(often, 1e-6))  # rare features move as fast as frequent ones
    w, theta = np.zeros(n_features), np.log((1 - beyond.mean(0)) / np.maximum(beyond.mean(0), 1e-6))
    v, u, t = w.copy(), theta.copy(), 1.0
    probe = np.ones(n_features)
    for _ in range(30):  # the largest eigenvalue bounds the curvature
        probe /= np.linalg.norm(probe)
        probe = np.bincount(flat, np.bincount(owner, (probe * scale)[flat], len(rows))[owner], n_features) * scale / len(rows)
    step = 3.6 / (len(levels) * (1 + np.linalg.norm(probe)))
    for _ in range(steps):
        score = np.bincount(owner, (v * scale)[flat], len(rows))
        error = 1 / (1 + np.exp(-(score[:, None] - u[None, :]))) - beyond
        gw = np.bincount(flat, error.sum(1)[owner], n_features) * scale / len(rows)
        moved = v - step * gw
        nw = np.sign(moved) * np.maximum(np.abs(moved) - step * l1 * scale, 0)
        nt = np.maximum.accumulate(u + step * error.mean(0))
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, u = nw + (t - 1) / after * (nw - w), nt + (t - 1) / after * (nt - theta)
        w, theta, t = nw, nt, after
    return w * scale, theta


def held_features(graded: DataFrame, names: list[str]) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Of the graded sample: grades, the numbers of the features each text holds, and its number of different words."""
    number = {f: k for k, f in enumerate(names)}
    fields = "grade int, held array<int>, size int"

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            found = [words(t or "") for t in chunk.column("text").to_pylist()]
            held = [sorted(number[f] for f in features(w) & number.keys()) for w in found]
            yield record(arrow_schema(fields), grade=chunk.column("grade"), held=held, size=[len(w) for w in found])

    rows = sorted((r["grade"], r["held"], r["size"]) for r in graded.mapInArrow(pick, fields).collect())
    return np.asarray([g for g, _, _ in rows]), [h for _, h, _ in rows], np.asarray([n for _, _, n in rows])


def fit(graded: DataFrame, most_features: int = 4000, levels: int = 1) -> Ordinal | None:
    """A model from ``text, grade`` (0, 1, ...), a bounded sample that the caller has drawn; None if all grades agree.

    Where labels only tell clean from toxic, ``levels`` > 1 splits grade 1 into that many grades of like size: by the
    share of a text's words that a first fit weighs as toxic.
    """
    names = candidates(graded, most_features)
    if not names:
        return None
    grades, held, sizes = held_features(graded, names)
    w, theta = fit_ordinal(held, grades, len(names))
    if levels > 1 and grades.max() == 1:
        toxic = [k for k in range(len(names)) if w[k] > 0 and not names[k].endswith("-")]
        share = np.asarray([len(set(h).intersection(toxic)) for h in held]) / np.maximum(sizes, 1)
        cuts = np.quantile(share[grades > 0], np.linspace(0, 1, levels + 1)[1:-1])
        grades = np.where(grades > 0, 1 + np.searchsorted(cuts, share, "left"), 0)
        w, theta = fit_ordinal(held, grades, len(names))
    return Ordinal({f: float(w[k]) for k, f in enumerate(names) if w[k]}, theta)


def score(docs: DataFrame, model: Ordinal | None, reject: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, severity (expected), grade (most probable), rejected (P(grade > 0) >= ``reject``)."""
    fields = "doc_id long, severity double, grade int, rejected boolean"
    schema = arrow_schema(fields)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            if model is None:
                above = np.zeros((chunk.num_rows, 1))
            else:
                above = model.above([model.score(t or "") for t in chunk.column("text").to_pylist()])
            each = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            yield record(schema, doc_id=chunk.column("doc_id"), severity=above.sum(1), grade=each.argmax(1).astype(np.int32), rejected=above[:, 0] >= reject)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rate, fields)


def clean(docs: DataFrame, model: Ordinal | None, reject: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``score`` does not reject. Nothing is shuffled."""
    if model is None:
        return docs

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, text_col):
            above = model.above([model.score(t or "") for t in chunk.column(text_col).to_pylist()])
            yield chunk.filter(pa.array(above[:, 0] < reject))

    return docs.mapInArrow(pick, docs.schema)


def graded_sample(docs: DataFrame, labels: DataFrame, grade: Column, sample: int = 8000) -> DataFrame:
    """``text, grade`` of about ``sample`` labelled documents at most, half of them of grade 0, drawn by a hash of the id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).dropna()
    sizes = known.agg(F.count_if(F.col("grade") == 0).alias("clean"), F.count_if(F.col("grade") > 0).alias("other")).first()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    rate = lambda n: F.lit(int((1 << 30) * min(1.0, sample / 2 / max(n, 1))))
    drawn = known.where(draw < F.when(F.col("grade") == 0, rate(sizes["clean"])).otherwise(rate(sizes["other"])))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").select("text", "grade")  # about ``sample`` rows of two numbers


def assess(docs: DataFrame, labels: DataFrame, sample: int = 8000, levels: int = 3, reject: float = 0.5) -> DataFrame:
    """Severity of every document, learned from labels ``doc_id, toxic``: grade 0 is clean, 1 to ``levels`` toxic."""
    return score(docs, learn(docs, labels, sample, levels), reject)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 8000, levels: int = 3) -> Ordinal | None:
    return fit(kept(graded_sample(docs, labels, F.col("toxic"), sample)), levels=levels)
