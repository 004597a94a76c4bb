"""Box overlap join: bucketed equi-join, never all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")


def overlap_join(requests: DataFrame, scenes: DataFrame, request_key: str, scene_key: str, size: float, salts: int = 8) -> DataFrame:
    """Pairs whose boxes meet; boxes that only touch do meet.

    Both sides have ``xmin, ymin, xmax, ymax``. A box belongs to the grid level whose buckets are at least as wide as it
    (``size * 2^level``), where it lies in four buckets at most. Two boxes meet on the coarser of their two levels: a box
    is also looked up in the buckets around it on the coarser levels that the other side has, so it gives at most four
    rows for each of these, however large or small it is. A pair is kept only in the bucket of the lower-left corner of
    the common area, so no de-duplication is needed. The finer boxes of a bucket are split over ``salts`` keys, so a
    crowded place, or a box that meets all others, is not one task.
    """
    left, right = (df.select(key, *BOX).withColumn("own_", _level(size)) for df, key in ((requests, request_key), (scenes, scene_key)))
    # A level is the logarithm of a width, so there are few.
    a, b = _buckets(left, _levels(right), size, 1), _buckets(right, _levels(left), size, 2)
    a, b = _dealt(a, request_key, salts, finer=2).alias("a"), _dealt(b, scene_key, salts, finer=1).alias("b")
    keys = ["part_", "level_", "salt_", "bx_", "by_"]
    # The optimizer does not see how far the explodes multiply rows: no broadcast here.
    joined = a.hint("merge").join(b, keys)
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("level_"))
    meets = (
        (F.col("a.xmin") <= F.col("b.xmax"))
        & (F.col("a.xmax") >= F.col("b.xmin"))
        & (F.col("a.ymin") <= F.col("b.ymax"))
        & (F.col("a.ymax") >= F.col("b.ymin"))
    )
    here = (F.floor(F.greatest("a.xmin", "b.xmin") / step) == F.col("bx_")) & (
        F.floor(F.greatest("a.ymin", "b.ymin") / step) == F.col("by_")
    )
    return joined.where(meets & here).select(request_key, scene_key)


def _level(size: float) -> Column:
    widest = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    return F.when(widest > size, F.ceil(F.log2(widest / size))).otherwise(0).cast("int")


def _levels(boxes: DataFrame) -> list[int]:
    return sorted(r[0] for r in boxes.select("own_").distinct().collect())


def _buckets(boxes: DataFrame, others: list[int], size: float, coarser: int) -> DataFrame:
    """A row for each bucket: boxes of the same level meet in part 0; part ``coarser`` has the coarser boxes of this side,
    and the other part the finer ones on the levels of the other side's coarser ones."""
    above = F.filter(F.array(*[F.lit(n) for n in others]).cast("array<int>"), lambda n: n > F.col("own_"))
    place = lambda part, level: F.struct(F.lit(part).alias("part_"), level.alias("level_"))
    own = F.array(place(0, F.col("own_")))
    if others:  # those that the other side has finer boxes for
        own = F.when(F.col("own_") > min(others), F.array(place(0, F.col("own_")), place(coarser, F.col("own_")))).otherwise(own)
    rows = boxes.withColumn("p_", F.explode(F.concat(own, F.transform(above, lambda n: place(3 - coarser, n)))))
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("p_.level_"))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    rows = rows.withColumn("bx_", F.explode(span("xmin", "xmax"))).withColumn("by_", F.explode(span("ymin", "ymax")))
    return rows.select("*", "p_.part_", "p_.level_").drop("p_", "own_")


def _dealt(rows: DataFrame, key: str, salts: int, finer: int) -> DataFrame:
    """Finer boxes, in part ``finer``, have one salt, coarser ones every salt; of equal ones the right side has one."""
    one = F.array(F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    single = F.col("part_") == finer
    if finer == 1:  # the right side
        single = single | (F.col("part_") == 0)
    return rows.withColumn("salt_", F.explode(F.when(single, one).otherwise(every)))


def present(wanted: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Rows whose key the inventory holds."""
    return wanted.join(inventory.select(key), key, "left_semi")


def missing(wanted: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """Rows whose key the inventory lacks."""
    return wanted.join(inventory.select(key), key, "left_anti")
