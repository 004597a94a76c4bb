"""Quality rules and a monotone gradient-boosted classifier over statistics of whole documents.

``statistics`` makes one pass over the texts and leaves one small row a document. ``fit`` grows boosted trees for the
logistic loss on histograms of those statistics, over a bounded sample of labelled documents; on chosen statistics
the score can only fall (or only rise) as they grow. The trees are flattened into arrays of nodes, and scoring walks
all trees of a batch of rows at once.

Odd cases: a null text has no word; an empty table gives an empty result; rows that repeat are judged each by itself;
labels that are null are left out; if all labels agree or there are none, the verdict is "keep". Only the named columns
are read, so further columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import SPACES, arrow_schema, chunks, kept, record, text_bytes

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
LATER = bytes(range(0x80, 0xC0))  # later bytes of a code point
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_lines", "n_punctuation"]
PUNCTUATION = b"!\"'(),-./:;?@[\\]^_`{}~+="

#: Statistics that the trees see, and the direction in which each may move the score for good: -1 down, 0 either way.
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": -1, "digit_share": 0, "words_per_line": 0, "punctuation_share": 0}


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered[at : at + 3] = b"\1\1\1"
    return covered.count(1)


def count_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = text.split(b"\n")
    spoken = [line for line in lines if line.strip(SPACES)]
    size = len(text)
    return (
        len(words),
        len(text.translate(None, SPACES + LATER)),
        size - len(text.translate(None, SYMBOLS)),
        len(spoken) - len(set(spoken)),
        repeated_words(words),
        len(set(words)),
        size - len(text.translate(None, UPPER)),
        size - len(text.translate(None, DIGITS)),
        len(spoken),
        size - len(text.translate(None, PUNCTUATION)),
    )


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts of every whole text."""
    fields = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    schema = arrow_schema(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, "text"):
            rows = np.asarray([count_text(t) for t in text_bytes(chunk.column("text"))], np.int64).reshape(-1, len(COUNTS))
            yield record(schema, doc_id=chunk.column("doc_id"), **{c: rows[:, k] for k, c in enumerate(COUNTS)})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(count, fields)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics of FEATURES, a row for each document."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.column_stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / words, c["n_distinct"] / words, c["n_upper"] / chars, c["n_digits"] / chars,
        words / np.maximum(c["n_lines"], 1), c["n_punctuation"] / chars,
    ])


@dataclass
class Trees:
    """All trees in one set of node arrays; a leaf is its own child."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class Boosting:
    """``directions[f]``: 1 if the score may only rise with statistic f, -1 if it may only fall, 0 if it may do both."""

    directions: list[int]
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    least_weight: float = 4.0
    penalty: float = 1.0
    nodes: list = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.nodes = []
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        base = float(np.log(share / (1 - share)))
        roots: list[int] = []
        if len(y) and 0 < y.sum() < len(y):
            cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
            coded = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
            margin = np.full(len(y), base)
            for _ in range(self.trees):
                p = 1 / (1 + np.exp(-margin))
                first = len(self.nodes)
                roots.append(first)
                self._grow(coded, cuts, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), 0, -np.inf, np.inf)
                flat = self._flat([first], base)
                margin += flat.margin(x) - base
        return self._flat(roots, base)

    def _flat(self, roots: list[int], base: float) -> Trees:
        columns = list(zip(*self.nodes)) or [[]] * 5
        feature, left, right = (np.asarray(columns[k], np.int64) for k in (0, 2, 3))
        return Trees(np.asarray(roots, np.int64), feature, np.asarray(columns[1], float), left, right, np.asarray(columns[4], float), base, self.depth)

    def _value(self, gradient: float, weight: float, low: float, high: float) -> float:
        return float(np.clip(gradient / (weight + self.penalty), low, high))

    def _grow(self, coded, cuts, gradient, weight, rows, depth: int, low: float, high: float) -> int:
        """Adds the node of these rows, whose values must stay in [low, high], and all below it."""
        at = len(self.nodes)
        g, h = float(gradient[rows].sum()), float(weight[rows].sum())
        self.nodes.append((0, 0.0, at, at, self.rate * self._value(g, h, low, high)))
        if depth == self.depth:
            return at
        best, split = 1e-9, None
        for f, direction in enumerate(self.directions):
            n = len(cuts[f]) + 1
            if n < 2:
                continue
            codes = coded[rows, f]
            gl = np.cumsum(np.bincount(codes, gradient[rows], n))[:-1]
            hl = np.cumsum(np.bincount(codes, weight[rows], n))[:-1]
            gr, hr = g - gl, h - hl
            vl = np.clip(gl / (hl + self.penalty), low, high)
            vr = np.clip(gr / (hr + self.penalty), low, high)
            gain = gl * vl - 0.5 * (hl + self.penalty) * vl**2 + gr * vr - 0.5 * (hr + self.penalty) * vr**2
            gain[(hl < self.least_weight) | (hr < self.least_weight) | ((vr - vl) * direction < 0)] = -np.inf
            k = int(np.argmax(gain))
            v = self._value(g, h, low, high)
            gained = gain[k] - (g * v - 0.5 * (h + self.penalty) * v**2)
            if gained > best:
                best, split = gained, (f, k, float(vl[k]), float(vr[k]))
        if split is None:
            return at
        f, k, vl, vr = split
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[self.directions[f]]
        goes = coded[rows, f] <= k
        left = self._grow(coded, cuts, gradient, weight, rows[goes], depth + 1, *bounds[0])
        right = self._grow(coded, cuts, gradient, weight, rows[~goes], depth + 1, *bounds[1])
        self.nodes[at] = (f, float(cuts[f][k]), left, right, 0.0)
        return at


def fit(stats: DataFrame, labels: DataFrame, sample: int = 20_000, id_col: str = "doc_id", label_col: str = "quality") -> Trees:
    """Trees for "the label is 1", from at most about ``sample`` labelled documents, drawn by a hash of their id."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    total = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / max(total, 1)))))
    rows = stats.join(drawn, "doc_id").select("doc_id", "label", *COUNTS).toPandas().sort_values(["doc_id", "label"])
    y = (rows["label"].to_numpy() == 1).astype(float)
    return Boosting(list(FEATURES.values())).fit(features({c: rows[c].to_numpy() for c in COUNTS}), y)


def judge(stats: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """Adds ``good`` (the probability of a good document) and ``kept``: not base_failed, and ``good >= least``."""
    columns = stats.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS})
            good = np.concatenate([trees.probability(x[k : k + 2000]) for k in range(0, len(x), 2000)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good)], names=[*batch.schema.names, "good"])

    fields = ", ".join(f"{c} long" for c in columns) + ", good double"
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = stats.mapInArrow(score, fields).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= least))


def assess(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: float = 0.5) -> DataFrame:
    """Statistics, the score and the verdict of every document."""
    stats = kept(statistics(docs))
    return judge(stats, fit(stats, labels, sample), least)
