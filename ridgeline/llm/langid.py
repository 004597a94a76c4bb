"""Language identification: multinomial logistic regression on TF-IDF weights of character n-grams.

Features: n-grams of one to three characters of the lower-cased text, hashed to ``slots`` features. A feature's weight
in a document is its share of the document's n-grams times its inverse document frequency, counted over *all* training
documents. The regression is trained on a bounded sample with follow-the-regularised-leader and elastic-net penalties,
which leaves most weights at zero; a temperature fitted on a part of the sample that training has not seen calibrates
the probabilities. Because term shares are linear, a text is scored by averaging one table row per character.

Odd cases: a null text, or one without a letter (fractions, superscripts and digits are none), is ``und`` with score 0; a
null language is never learned from; with no training document at all everything is ``und``; equal probabilities go to
the language that sorts first; repeated rows are each predicted, a null id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, chunks, record

UNKNOWN = "und"
SLOTS = 1 << 17


def grams(text: str, slots: int) -> np.ndarray:
    """The slot of every n-gram, n = 1 to 3, of the text between two spaces."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    one = points * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + one[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + one[2:]
    both = np.concatenate([one, two, three])
    return ((both ^ (both >> np.uint32(16))) & np.uint32(slots - 1)).astype(np.int32)


def texts(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for chunk in chunks(batches, "text", most):
        yield chunk, [t or "" for t in chunk.column("text").to_pylist()]


def document_frequencies(training: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, int]:
    """In how many training documents each slot occurs, and their number. A fixed number of counts, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, n = np.zeros(slots, np.int64), np.zeros(slots, bool), 0
        for _, some in texts(batches):
            for text in some:
                seen[grams(text, slots)] = True
                held = np.flatnonzero(seen)
                found[held] += 1
                seen[held] = False
                n += 1
        held = np.flatnonzero(found)
        yield record(arrow_schema("slot int, n long"), slot=np.append(held, -1), n=np.append(found[held], n))

    df = np.zeros(slots, np.int64)
    total = 0
    for row in training.select("text").mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas().itertuples():
        if row.slot < 0:
            total = int(row.n)
        else:
            df[row.slot] = row.n
    return df, total


def sample_features(training: DataFrame, idf: np.ndarray, per_lang: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, slots, weights) of about ``per_lang`` documents a language at most, drawn by a hash of their id (which serves for nothing else)."""
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}  # a row a language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rate = F.lit(0)
    for lang, n in sorted(sizes.items()):
        rate = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * min(1.0, per_lang / n)))).otherwise(rate)
    slots = len(idf)
    fields = "lang string, slot binary, weight binary, mark long"  # arrays as bytes: a collected list is many times larger

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, some in texts(batches):
            found = [np.unique(grams(t, slots), return_counts=True) for t in some]
            weights = [(n / n.sum() * idf[s]).astype(np.float32).tobytes() for s, n in found]
            yield record(arrow_schema(fields), lang=chunk.column("lang"), slot=[s.tobytes() for s, _ in found], weight=weights, mark=chunk.column("mark"))

    drawn = training.where(draw < rate).select("lang", "text", F.xxhash64("doc_id", F.lit(7)).alias("mark"))
    rows = drawn.mapInArrow(weigh, fields).collect()
    rows.sort(key=lambda r: (r["mark"], r["lang"]))
    return [(r["lang"], np.frombuffer(r["slot"], np.int32), np.frombuffer(r["weight"], np.float32).astype(float)) for r in rows]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # slots x languages: weight times inverse document frequency
    bias: np.ndarray
    temperature: float


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, rounds: int = 3) -> Model:
    """Follow-the-regularised-leader (per coordinate) on four fifths of the rows; the last fifth sets the temperature."""
    langs = sorted({lang for lang, _, _ in rows})
    where = {lang: k for k, lang in enumerate(langs)}
    z = np.zeros((len(idf) + 1, len(langs)))
    n = np.zeros_like(z)

    def weights(at: np.ndarray) -> np.ndarray:
        part = z[at]
        return -np.sign(part) * np.maximum(np.abs(part) - l1, 0) / ((beta + np.sqrt(n[at])) / alpha + l2)

    def with_bias(slots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(slots, len(idf)), np.append(x * SCALE, 1.0)

    learned = [r for k, r in enumerate(rows) if k % 5] or rows
    for _ in range(rounds):
        for lang, slots, x in learned:
            at, value = with_bias(slots, x)
            w = weights(at)
            score = value @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[where[lang]] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(len(idf) + 1))
    unseen = rows[::5]
    margins = np.asarray([value @ w[at] for at, value in (with_bias(s, x) for _, s, x in unseen)]).reshape(-1, len(langs))
    truth = np.asarray([where[lang] for lang, _, _ in unseen], int)
    return Model(langs, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], calibrate(margins, truth))


#: Term shares are small; this brings the weights of a text to the order of one.
SCALE = 10.0


def calibrate(margins: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid from a twentieth to twenty, refined once."""

    def loss(t: float) -> float:
        m = margins / t
        m = m - m.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(m)), truth])) if len(m) else t

    grid = np.exp(np.linspace(-3, 3, 61))
    best = min(grid, key=loss)
    return float(min(best * np.exp(np.linspace(-0.1, 0.1, 41)), key=loss))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every whole text."""
    fields = "doc_id long, lang_pred string, score double"
    schema = arrow_schema(fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, some in texts(batches):
            best, sure = [], []
            for text in some:
                if model is None or not any(map(str.isalpha, text)):
                    best.append(UNKNOWN)
                    sure.append(0.0)
                    continue
                at = grams(text, len(model.table))
                total = np.zeros(len(model.langs))
                for k in range(0, len(at), 1 << 18):
                    total += model.table[at[k : k + (1 << 18)]].sum(axis=0, dtype=np.float64)
                m = (total / len(at) + model.bias) / model.temperature
                p = np.exp(m - m.max())
                p /= p.sum()
                best.append(model.langs[int(np.argmax(p))])
                sure.append(float(p.max()))
            yield record(schema, doc_id=chunk.column("doc_id"), lang_pred=best, score=sure)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, fields)


def fit(training: DataFrame, per_lang: int = 1000, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from all document frequencies and about ``per_lang`` documents of each language at most; None without any."""
    known = training.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    df, total = document_frequencies(known, slots)
    if not total:
        return None
    idf = np.log((1 + total) / (1 + df)) + 1
    return train(sample_features(known, idf, per_lang), idf)


def identify(docs: DataFrame, learn_from: Column, per_lang: int = 1000) -> DataFrame:
    """Predictions for all documents by a model learned from those where ``learn_from`` holds."""
    return predict(docs, fit(docs.where(learn_from), per_lang))
