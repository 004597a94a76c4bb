"""Connected components, and lookups by keys of which one may be very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import kept

#: A key is hot if more than one row in so many has it, so there are fewer hot keys than this.
HOT_SHARE = 1024


def lookup(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], how: str = "left") -> DataFrame:
    """``left`` with the ``values`` of the row of ``right`` that has its ``keys``.

    ``right`` has one row a key and the number ``n`` of rows of ``left`` that have it. Hot keys, of which there can be
    only ``HOT_SHARE``, are looked up by broadcast; their rows then go to the shuffled join under keys that match
    nothing and spread evenly. All key columns are 64-bit integers.
    """
    total = right.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()["total"]
    hot = right.where(F.col("n") > F.lit(max(32, total // HOT_SHARE)))
    found = F.broadcast(hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys], *[F.col(v).alias(f"hot_{v}") for v in values], F.lit(True).alias("is_hot")))
    first = left.join(found, [F.col(k) == F.col(f"hot_{k}") for k in keys], "left").drop(*[f"hot_{k}" for k in keys])
    spread = F.when(F.col("is_hot"), F.monotonically_increasing_id()).otherwise(F.col(keys[0]))
    first = first.withColumn("at_key", spread).withColumn("at_hot", F.coalesce(F.col("is_hot"), F.lit(False)))
    plain = right.select(*[F.col(k).alias(f"at_{i}") for i, k in enumerate(keys)], *[F.col(v).alias(f"own_{v}") for v in values], F.lit(True).alias("is_own"))
    same = [F.col("at_key") == F.col("at_0"), ~F.col("at_hot")] + [F.col(k) == F.col(f"at_{i}") for i, k in enumerate(keys) if i]
    both = first.join(plain.withColumn("side", F.lit(False)), same, "left")
    if how == "inner":
        both = both.where(F.col("is_hot") | F.col("is_own"))
    kept_columns = [c for c in left.columns if c not in values]
    return both.select(*kept_columns, *[F.when(F.col("is_hot"), F.col(f"hot_{v}")).otherwise(F.col(f"own_{v}")).alias(v) for v in values])


def _with_minimum(edges: DataFrame) -> DataFrame:
    """``a, b`` with the smallest neighbour of ``a`` as ``low``."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("b").alias("n"))
    return lookup(edges, low, ["a"], ["low"])


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every id in the links ``a, b``; the component is the smallest id that links reach.

    Alternating large-star (each larger neighbour of a vertex is linked to the vertex's smallest neighbour or itself)
    and small-star (the smaller neighbours and the vertex itself are linked to the smallest one) until nothing moves.
    """
    edges = kept(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_minimum(both).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "low").alias("b")).where("a != b").distinct()
        large = kept(large)
        low = _with_minimum(large)
        small = low.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b"))).where("a != b").distinct()
        edges = kept(small)
        state = edges.agg(F.count("a").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
