"""Hard negatives by a vertical (BOND) scan: branch and bound over columns of vector components.

Components are scaled and floored to whole numbers, so scores (inner products) are exact. Rows lie in blocks that hold
their components column by column, with the least and greatest value of each column. For an anchor the columns of a block
are read in the order of the anchor's own magnitudes, largest first. After every few columns the remaining ones bound each
candidate's score from both sides, by their least and greatest values; candidates that can no longer be among the first,
or fall into a window, leave the candidate list, until the scores of the rest are exact.

Two scans: the first finds each anchor's positives, the best rows of its own label; the second, for each of their scores
p, the best rows of other labels with a score from ``low`` to ``high`` percent of p. Anchors come in groups and blocks in
stripes; every group meets every stripe in a task of its own, which carries what it has found from block to block and
returns only the first few rows for each anchor. Neither side is broadcast; a label that most rows share is spread as all
others, since blocks are dealt by hash.

Odd cases: rows with a null label or vector, an empty vector, or a null or non-finite component take no part, nor do
vectors whose scaled length reaches 2^31, as their scores may not fit 64 bits; vectors only meet vectors of their own
length; a null id comes after all others in ties; rows that repeat an id are rows of their own, so an anchor's copies are
other rows of its label and each is an anchor itself; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, kept, record

#: Rows in a block, blocks in a stripe, anchors in a group; columns read between two looks at the bounds.
BLOCK = 8192
STRIPE = 2
GROUP = 2048
STEP = 8
NO_ID = (1 << 63) - 1
BLOCKS = "dim int, stripe long, rows binary, ids binary, named binary, labels binary, kind string, columns binary"
ANCHORS = ["dim", "grp", "row", "label", "v"]


def usable(vectors: DataFrame, anchor: Column, scale: float, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """row (a number of its own), vec_id, label, anchor, dim and the whole components ``v`` of the rows that take part."""
    source = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    source = source.where(F.col("label").isNotNull() & (F.size("x") > 0) & ~bad)
    whole = source.withColumn("v", F.transform("x", lambda x: F.floor(x * F.lit(float(scale)))))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    short = whole.where(length < 2.0**62)
    return kept(short.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "anchor", F.size("v").alias("dim"), "v"))


def vertical(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt to blocks, with their components column by column."""
    schema = arrow_schema(BLOCKS)

    def turn(key: tuple, table: pa.Table) -> pa.Table:
        matrix = components(table).T
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(matrix).max() <= np.iinfo(k).max)
        ids = table.column("vec_id")
        return pa.Table.from_batches([record(
            schema, dim=[key[0].as_py()], stripe=[key[1].as_py() // STRIPE], rows=[table.column("row").to_numpy().tobytes()],
            ids=[ids.fill_null(NO_ID).to_numpy().tobytes()], named=[np.asarray(ids.is_valid()).tobytes()],
            labels=[table.column("label").to_numpy().tobytes()], kind=[np.dtype(kind).str], columns=[np.ascontiguousarray(matrix, kind).tobytes()],
        )])

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("dim", "block").applyInArrow(turn, BLOCKS)


def components(table: pa.Table) -> np.ndarray:
    """A row for each vector; all have one length."""
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


class Block:
    """One block in a task."""

    def __init__(self, row: dict):
        self.rows, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("rows", "ids", "labels"))
        self.named = np.frombuffer(row["named"], bool)
        self.columns = np.frombuffer(row["columns"], row["kind"]).reshape(row["dim"], -1)
        self.low, self.high = self.columns.min(axis=1).astype(float), self.columns.max(axis=1).astype(float)
        self.magnitude = np.maximum(np.abs(self.low), np.abs(self.high))

    def scan(self, anchor: np.ndarray, chosen: np.ndarray, stays: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of the chosen places those that ``stays(least, most)`` keeps to the end, and their exact scores."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        reach = float(np.abs(a).astype(float) @ self.magnitude[order])
        exact = reach < 2.0**52  # then all sums are exact in doubles
        kind = np.float64 if exact else np.int64
        weights = a.astype(kind)
        slack = 0.0 if exact else reach * 2.0**-40  # bounds are doubles, and may be rounded
        ends = np.sort(a.astype(float) * np.stack([self.low[order], self.high[order]]), axis=0)
        rest = np.zeros((2, len(a) + 1))
        rest[:, :-1] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
        score = np.zeros(len(chosen), kind)
        for k in range(0, len(a), STEP):
            if not len(chosen):
                break
            read = order[k : k + STEP]
            score = score + weights[k : k + STEP] @ self.columns[read[:, None], chosen].astype(kind)
            low, high = rest[:, min(k + STEP, len(a))]
            last = k + STEP >= len(a)
            left = stays(score if last else score + (low - slack), score if last else score + (high + slack))
            if not left.all():
                chosen, score = chosen[left], score[left]
        return chosen, score.astype(np.int64)

    def first(self, places: np.ndarray, scores: np.ndarray, most: int) -> list[tuple]:
        """The ``most`` first of the places as sortable rows: -score, without an id, id, row."""
        order = np.lexsort((self.rows[places], self.ids[places], ~self.named[places], -scores))[:most]
        return [(-int(scores[i]), not self.named[places[i]], int(self.ids[places[i]]), int(self.rows[places[i]])) for i in order]


def kth(values: np.ndarray, k: int) -> float:
    """The k-th greatest value, or minus infinity where there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def best_of_label(blocks: list[Block], row: int, label: int, anchor: np.ndarray, most: int) -> list[tuple]:
    """The first rows of the anchor's label, itself left out."""
    found: list[tuple] = []
    for block in blocks:
        floor = -found[most - 1][0] if len(found) >= most else -np.inf
        chosen = np.flatnonzero((block.labels == label) & (block.rows != row))
        places, scores = block.scan(anchor, chosen, lambda least, greatest: greatest >= max(floor, kth(least, most)))
        found = sorted(found + block.first(places, scores, most))[:most]
    return found


def best_in_windows(blocks: list[Block], label: int, anchor: np.ndarray, windows: list[tuple[int, int]], most: int) -> list[list[tuple]]:
    """For each window of scores the first rows of other labels in it."""
    found: list[list[tuple]] = [[] for _ in windows]
    for block in blocks:
        floors = [max(low, -own[most - 1][0]) if len(own) >= most else low for (low, _), own in zip(windows, found)]

        def stays(least: np.ndarray, greatest: np.ndarray) -> np.ndarray:
            left = np.zeros(len(least), bool)
            for (low, high), floor in zip(windows, floors):
                surely = least[(least >= low) & (greatest <= high)]
                left |= (greatest >= max(floor, kth(surely, most))) & (least <= high)
            return left

        places, scores = block.scan(anchor, np.flatnonzero(block.labels != label), stays)
        for k, (low, high) in enumerate(windows):
            inside = (scores >= low) & (scores <= high)
            found[k] = sorted(found[k] + block.first(places[inside], scores[inside], most))[:most]
    return found


def meet(anchors: DataFrame, groups: int, blocks: DataFrame, stripes: int, find: Callable[[list[Block], pa.Table], Iterator[tuple]], fields: str) -> DataFrame:
    """Every group of anchors with every stripe of blocks, each pair in a task of its own."""
    schema = arrow_schema(fields)

    def run(own: pa.Table, stripe: pa.Table) -> pa.Table:
        rows = list(find([Block(r) for r in stripe.to_pylist()], own)) if own.num_rows and stripe.num_rows else []
        return pa.Table.from_batches([record(schema, **{f.name: [r[k] for r in rows] for k, f in enumerate(schema)})])

    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left, right = anchors.withColumn("stripe", upto(stripes)), blocks.withColumn("grp", upto(groups))
    keys = ["dim", "stripe", "grp"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, fields)


def ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first rows of each group: score falling, ids rising, rows without one last."""
    order = [F.desc("score"), F.asc_nulls_last("other_id"), F.asc("other_row")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)


def mine(
    vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``anchor`` holds."""
    rows = usable(vectors, anchor, scale, id_col, label_col, vector_col)
    size = rows.agg(F.count("row").alias("n"), F.count_if("anchor").alias("anchors")).first()
    groups = max(1, -(-size["anchors"] // GROUP))
    count = max(1, -(-size["n"] // BLOCK))
    stripes = -(-count // STRIPE)
    blocks = kept(vertical(rows, count))
    anchors = rows.where("anchor").withColumn("grp", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups).cast("long")))

    def each(own: pa.Table) -> Iterator[tuple[int, int, np.ndarray]]:
        return zip(own.column("row").to_pylist(), own.column("label").to_pylist(), components(own))

    def find_positives(stripe: list[Block], own: pa.Table) -> Iterator[tuple]:
        for row, label, v in each(own):
            for score, unnamed, other, other_row in best_of_label(stripe, row, label, v, positives):
                yield row, -score, None if unnamed else other, other_row

    def find_negatives(stripe: list[Block], own: pa.Table) -> Iterator[tuple]:
        for (row, label, v), scores in zip(each(own), own.column("scores").to_pylist()):
            wanted = sorted(set(scores))
            windows = [(-(-low * p // 100), high * p // 100) for p in wanted]
            for p, found in zip(wanted, best_in_windows(stripe, label, v, windows, negatives)):
                for score, unnamed, other, other_row in found:
                    yield row, p, -score, None if unnamed else other, other_row

    near = meet(anchors.select(*ANCHORS), groups, blocks, stripes, find_positives, "row long, score long, other_id long, other_row long")
    near = kept(ranked(near, ["row"], positives).select("row", F.col("score").alias("positive_score"), F.col("other_id").alias("positive_id")))
    scores = near.groupBy("row").agg(F.collect_set("positive_score").alias("scores"))  # at most ``positives`` of them
    hard = meet(anchors.select(*ANCHORS).join(scores, "row"), groups, blocks, stripes, find_negatives, "row long, positive_score long, score long, other_id long, other_row long")
    hard = ranked(hard, ["row", "positive_score"], negatives)
    named = near.join(rows.where("anchor").select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.join(hard, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
