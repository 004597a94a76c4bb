"""Near-duplicate vectors by a pivot-permutation index.

Pivots are reference vectors, a sample that grows as the square root of the table up to ``MOST_PIVOTS`` and is thinned
out: of pivots within twice the angle of a link one stays, so a dense group has one or few however many rows it holds. A
vector is described by its ``LISTED`` nearest pivots; inverted lists hold for each pivot the vectors posted to it, and
vectors that meet in a list are verified by cosine in double precision.

A vector's partners have their own nearest pivot on the vector's side of, or near, the plane between that pivot and the
vector's. Where that leaves at most ``LISTED - SHARED + 1`` pivots, the vector is posted to all of them and finds every
partner, as each vector is posted to its nearest pivot. Others are posted to that many of the lowest-numbered pivots
that describe them: two of them with ``SHARED`` pivots in common always meet.

Lists are cut into blocks and every pair of blocks meets in one task, so a long list is spread; a pair is looked at only
in the lowest list of both. A task returns for each vector how many links it found and one vector that links reach, never
the pairs. Equal vectors are one class throughout. Recall against brute force is measured in the tests.

Odd cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length never link; rows that repeat an id count as copies of it. A row without an id is a vector of its own,
after all with one: it counts as a link of others, and ``component_id`` is null where no id is reachable, of which rows
one is kept. Ids are below 2^62. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import arrow_schema, kept, record
from ridgeline.llm.graph import components, lookup

MOST_PIVOTS = 8192
LISTED = 16
SHARED = 4
BLOCK = 1024
#: Rows without an id have numbers from here on.
NO_ID = 1 << 62
#: Cosines this close to the threshold are computed anew, one pair at a time.
ROUNDING = 1e-9


def units(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id (never null), the unit vector as bytes of doubles (null where it links with nothing) and its fingerprint fa, fb."""
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.when(F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.col("v"))
    fields = "vec_id long, unit binary"

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v"):
                if not v.is_valid:
                    out.append(None)
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield record(arrow_schema(fields), vec_id=batch.column("vec_id"), unit=out)

    own = F.coalesce("vec_id", F.lit(NO_ID) + F.monotonically_increasing_id())
    scaled = source.select(own.alias("vec_id"), usable.alias("v")).mapInArrow(scale, fields)
    return scaled.withColumn("fa", F.xxhash64("unit")).withColumn("fb", F.xxhash64(F.lit(1), "unit"))


def thinned(sample: np.ndarray, least: float) -> np.ndarray:
    """Of the sample, in its order, the vectors further than twice the angle of a link from all before that stay."""
    apart = 2 * least * least - 1 if least > 0 else -1.0
    stays, n = np.empty_like(sample), 0
    for v in sample:
        if not n or (stays[:n] @ v).max() < apart:
            stays[n] = v
            n += 1
    return stays[:n]


def choose_pivots(reps: DataFrame, total: int, least: float) -> dict[int, np.ndarray]:
    """Reference vectors by length: a bounded sample of the classes, drawn by a hash of the id, thinned out."""
    wanted = min(MOST_PIVOTS, max(32, 2 * math.isqrt(total)))
    rows = reps.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(wanted).select("unit").collect()
    by_length: dict[int, list[np.ndarray]] = {}
    for row in rows:
        v = np.frombuffer(row["unit"])
        by_length.setdefault(len(v), []).append(v)
    return {n: thinned(np.asarray(v), least) for n, v in by_length.items()}


def posts(vectors: np.ndarray, pivots: np.ndarray, least: float) -> list[np.ndarray]:
    """The numbers of the pivots that each unit vector is posted to, in rising order."""
    most = LISTED - SHARED + 1
    sims = vectors @ pivots.T
    home = sims.argmax(axis=1)
    # |u - v| <= reach for a partner u, and u q >= u p if its nearest pivot is q: then v p - v q <= reach |p - q|
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots[home] @ pivots.T)))
    near = sims >= sims.max(axis=1, keepdims=True) - reach * apart - ROUNDING
    few = near.sum(axis=1) <= most
    listed = np.argsort(-sims, axis=1, kind="stable")[:, :LISTED]
    fewest = max(1, listed.shape[1] - (SHARED - 1))  # short descriptions, where there are few pivots
    lowest = np.sort(listed, axis=1)[:, :fewest]
    return [np.flatnonzero(near[i]) if few[i] else np.union1d(lowest[i], home[i]) for i in range(len(vectors))]


def describe(reps: DataFrame, pivots: dict[int, np.ndarray], least: float) -> DataFrame:
    """vec_id, n, unit and ``lists``: the pivots it is posted to, rising. Numbers of other lengths do not overlap."""
    first, at = {}, 0
    for n, v in sorted(pivots.items()):
        first[n], at = at, at + len(v)
    fields = "vec_id long, n long, unit binary, lists array<int>"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 250):
                batch = whole.slice(k, 250)
                found = [np.frombuffer(b) for b in batch.column("unit").to_pylist()]
                lists: list = [None] * len(found)
                for size in {len(v) for v in found}:
                    rows = [i for i, v in enumerate(found) if len(v) == size]
                    if size not in pivots:  # one list for a length that the sample has missed
                        for i in rows:
                            lists[i] = np.asarray([-size])
                        continue
                    for i, o in zip(rows, posts(np.asarray([found[i] for i in rows]), pivots[size], least)):
                        lists[i] = first[size] + o
                yield record(arrow_schema(fields), vec_id=batch.column("vec_id"), n=batch.column("n"), unit=batch.column("unit"), lists=lists)

    return reps.select("vec_id", "n", "unit").mapInArrow(rank, fields)


def posted(described: DataFrame) -> DataFrame:
    """One row for each list and pair of blocks that a vector takes part in: pivot, pair, side, vec_id, n, unit, lists."""
    rows = described.withColumn("pivot", F.explode("lists"))
    sizes = rows.groupBy("pivot").agg(F.count("vec_id").alias("n")).select(F.col("pivot").cast("long").alias("pivot"), "n", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    sized = lookup(rows.withColumn("pivot", F.col("pivot").cast("long")).withColumnRenamed("n", "copies"), kept(sizes), ["pivot"], ["blocks"])
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    meets = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda q: F.struct(F.concat_ws("-", F.least(block, q), F.greatest(block, q)).alias("pair"), F.when(q >= block, 0).otherwise(1).alias("side")),
    )
    out = sized.select("pivot", F.explode(meets).alias("meet"), "vec_id", "copies", "unit", "lists")
    return out.select("pivot", F.col("meet.pair").alias("pair"), F.col("meet.side").alias("side"), "vec_id", "copies", "unit", "lists")


def verified(lists: DataFrame, least: float) -> DataFrame:
    """``id, found, low``: links found (copies counted) for a vector in one pair of blocks, and the lowest vector reached."""

    def verify(table: pa.Table) -> pa.Table:
        ids, copies = table.column("vec_id").to_numpy(), table.column("copies").to_numpy()
        side, pivot = table.column("side").to_numpy(), table.column("pivot")[0].as_py()
        matrix = np.asarray([np.frombuffer(b) for b in table.column("unit").to_pylist()])  # a list has one length
        # lists below this one have had their turn: a pair that meets in one of them was seen there
        before = [[p for p in x if p < pivot] for x in table.column("lists").to_pylist()]
        numbers = np.unique(np.asarray([p for x in before for p in x], np.int64))
        earlier = np.zeros((len(ids), len(numbers)), np.float32)
        for i, x in enumerate(before):
            earlier[i, np.searchsorted(numbers, x)] = 1
        low, high = table.column("pair")[0].as_py().split("-")
        left = np.arange(len(ids)) if low == high else np.flatnonzero(side == 0)
        right = left if low == high else np.flatnonzero(side == 1)
        ends = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(0, len(left), 256):
            own = left[k : k + 256]
            sims = matrix[own] @ matrix[right].T
            wanted = (sims >= least - ROUNDING) & (earlier[own] @ earlier[right].T == 0)
            if low == high:
                wanted &= own[:, None] < right[None, :]
            i, j = np.nonzero(wanted)
            a, b = own[i], right[j]
            close = np.flatnonzero(sims[i, j] < least + ROUNDING)
            far = np.ones(len(a), bool)
            far[close] = np.einsum("ij,ij->i", matrix[a[close]], matrix[b[close]]) >= least
            ends.append((a[far], b[far]))
        a, b = (np.concatenate(x) for x in zip(*ends))
        found = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        order = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        lowest = order.copy()
        while len(a):  # lower neighbours spread until nothing changes
            before = lowest.copy()
            np.minimum.at(lowest, a, before[b])
            np.minimum.at(lowest, b, before[a])
            if (lowest == before).all():
                break
        by_order = np.sort(ids, kind="stable")
        some = found > 0
        return pa.table({"id": ids[some], "found": found[some].astype(np.int64), "low": by_order[lowest[some]]})

    return lists.groupBy("pivot", "pair").applyInArrow(verify, "id long, found long, low long")


def link(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    scaled = kept(units(vectors, id_col, vector_col))
    valid = scaled.where(F.col("unit").isNotNull())
    classes = kept(valid.groupBy("fa", "fb").agg(F.min("vec_id").alias("rep"), F.count("vec_id").alias("n")))
    reps = valid.join(classes.select(F.col("rep").alias("vec_id"), "fa", "fb", "n"), ["vec_id", "fa", "fb"]).dropDuplicates(["vec_id", "fa", "fb"])
    reps = kept(reps.select("vec_id", "n", "unit"))
    described = describe(reps, choose_pivots(reps, reps.count(), least), least)
    found = kept(verified(posted(described), least))
    reached = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    counts = found.groupBy("id").agg(F.sum("found").alias("found"))
    known = classes.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(reached.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("fa", "fb", "n", (F.coalesce("found", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = lookup(scaled.select("vec_id", "fa", "fb", F.col("unit").isNotNull().alias("valid")), kept(known), ["fa", "fb"], ["n_links", "component"])
    out = out.select("vec_id", F.when(F.col("valid"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(F.col("valid"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    given = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return out.select(given("vec_id"), "n_links", given("component_id"), "kept")
