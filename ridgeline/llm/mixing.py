"""Mixing sources to target weights by Poisson replication.

A source with share ``w`` of the wanted rows and ``n`` documents has the mean repetition rate ``w * total / n``. Each
document is repeated as often as a Poisson variable of that mean says, taken by inverting the distribution at a number
in [0, 1) hashed from the document's id and a seed; so the result does not depend on partitions or on a rerun. The
copies are then put into one global random order, by a hash of id and copy.

Sources without a weight, and null ones, are one further group that has ``other_weight``. A weight of 0 leaves a source
out; weights are shared out among the groups that have documents. Only the counts of the named groups reach the driver,
and the table of distributions that is broadcast has one row for each of them. Repeated rows count each and get equal
numbers of copies; a null id hashes as empty text. Columns named copy, rate or shuffle_key are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = ""
ADDED = ["copy", "rate", "shuffle_key"]


def hashed(*parts: Column) -> Column:
    """The first 52 bits of the md5 of the parts joined by bars."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def distribution(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... of a Poisson variable, up to where doubles no longer tell it from 1."""
    if rate <= 0:
        return [2.0]
    total, out = 0.0, []
    for k in range(math.ceil(rate + 12 * math.sqrt(rate) + 40)):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        out.append(total)
    return out


def rates(counts: dict[str, int], weights: dict[str, float], other_weight: float, total: int) -> dict[str, float]:
    wanted = {s: weights.get(s, other_weight if s == OTHER else 0.0) for s in counts}
    whole = sum(wanted.values())
    return {s: wanted[s] / whole * total / n if whole > 0 else 0.0 for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str, float], other_weight: float = 1.0, epochs: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs`` with copy (from 1), rate and shuffle_key, in the order of shuffle_key.

    About ``epochs`` times as many rows as ``docs`` has.
    """
    own = [c for c in docs.columns if c not in ADDED]
    source = F.col(source_col)
    group = F.when(source.isin(list(weights)), source).otherwise(F.lit(OTHER))
    # the row stays apart, so that its columns may have any name
    grouped = docs.select(group.alias("mix_group"), F.col(id_col).alias("id"), F.struct(*own).alias("row"))
    counts = {r["mix_group"]: r["count"] for r in grouped.groupBy("mix_group").count().collect()}  # the named groups
    mean = rates(counts, weights, other_weight, round(epochs * sum(counts.values())))
    rows = [(s, float(m), distribution(m)) for s, m in sorted(mean.items())]
    table = docs.sparkSession.createDataFrame(rows, "mix_group string, rate double, below array<double>")
    drawn = hashed(F.col("id"), F.lit(seed)) / F.lit(float(1 << 52))
    times = F.size(F.filter("below", lambda c: c <= drawn))
    repeated = grouped.join(F.broadcast(table), "mix_group").withColumn("times", times).where("times > 0")
    copies = repeated.select("row", "id", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"), "rate")
    keyed = copies.withColumn("shuffle_key", hashed(F.col("id"), F.col("copy"), F.lit(seed)))
    return keyed.orderBy("shuffle_key", "id", "copy").select(*[F.col("row").getField(c).alias(c) for c in own], "copy", "rate", "shuffle_key")


def mix_sql(weights: dict[str, float], other_weight: float = 1.0, seed: int = 17, columns: str = "doc_id, text, lang, source, n_chars") -> str:
    """The same mix of a table ``documents`` at one epoch, in DuckDB's SQL."""
    listed = ", ".join(f"('{s}', {float(w)!r}::DOUBLE)" for s, w in [*weights.items(), (OTHER, other_weight)])
    names = ", ".join(f"'{s}'" for s in weights)
    bits = lambda text: f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"
    return f"""
WITH w(mix_group, weight) AS (VALUES {listed}),
d AS (SELECT *, CASE WHEN source IN ({names}) THEN source ELSE '' END AS mix_group FROM documents),
n AS (SELECT mix_group, count(*) AS n FROM d GROUP BY 1),
r AS (SELECT mix_group, weight / (SELECT sum(weight) FROM n JOIN w USING (mix_group)) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate
      FROM n JOIN w USING (mix_group)),
p AS (SELECT mix_group, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
      FROM (SELECT mix_group, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM r WHERE rate > 0)),
c AS (SELECT mix_group, list(c ORDER BY k) AS below FROM (SELECT mix_group, k, sum(p) OVER (PARTITION BY mix_group ORDER BY k) AS c FROM p) GROUP BY 1),
t AS (SELECT d.*, rate, {bits(f"concat_ws('|', doc_id, {seed})")} / 4503599627370496.0::DOUBLE AS u, below FROM d JOIN r USING (mix_group) JOIN c USING (mix_group)),
x AS (SELECT *, unnest(range(1, 1 + len(list_filter(below, lambda b: b <= u)))) AS copy FROM t)
SELECT {columns}, CAST(copy AS INTEGER) AS copy, {bits(f"concat_ws('|', doc_id, copy, {seed})")} AS shuffle_key FROM x
"""
