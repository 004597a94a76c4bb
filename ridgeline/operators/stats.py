"""Histograms, quantile breaks and summary statistics of layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.operators.grid import with_tiles
from ridgeline.session import cut_lineage

#: Bits counted in a round, and open parts that are sent to every task; more of them meet the codes in a shuffle.
DIGIT = 16
OPEN_ROWS = 100_000


def histogram(cells: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Cells per value; counts are combined before the exchange, so a common value is not a hot key."""
    return cells.where("value IS NOT NULL").groupBy(*by, "value").agg(F.count("*").alias("n"))


def tile_histogram(cells: DataFrame, tile_size: int) -> DataFrame:
    return histogram(with_tiles(cells, tile_size), ("layer", "trow", "tcol"))


def ordered_code(value: Column) -> Column:
    """A 64-bit number for each double that orders as the doubles do: its bits, negated below zero.

    Powers of two divide without rounding, so this is exact down to the smallest doubles. Both zeros are 0; NaN comes last.
    """
    size = F.abs(value)
    power = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(size))
    exponent = F.when(power(near) > size, near - 1).when(power(near + 1) <= size, near + 1).otherwise(near)
    normal = (exponent + 1023) * F.lit(2**52) + ((size / power(exponent) - 1) * F.lit(2.0**52)).cast("long")
    bits = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size < F.lit(2.0**-1022), (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long"))
        .when(size == F.lit(float("inf")), F.lit(2047 << 52))
        .otherwise(normal)
    )
    return F.when(F.isnan(value), F.lit(4095 << 51)).when(value < 0, -bits).otherwise(bits)


def coded_value(code: Column) -> Column:
    """The double of an ordered code."""
    bits = F.abs(code)
    exponent, rest = F.shiftright(bits, 52), bits.bitwiseAND(F.lit(2**52 - 1)).cast("double")
    size = (
        F.when(exponent == 0, rest * F.lit(2.0**-537) * F.lit(2.0**-537))
        .when(exponent == 2047, F.when(rest == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
        .otherwise((1 + rest / F.lit(2.0**52)) * F.pow(F.lit(2.0), exponent - 1023))
    )
    return F.when(code < 0, -size).otherwise(size)


def quantile_breaks(cells: DataFrame, k: int = 10, by: Sequence[str] = ("layer",), stored: bool = False) -> DataFrame:
    """``i, brk``: the least value that at least ``ceil(i * N / k)`` cells do not exceed, i = 1..k.

    Exact, by radix selection on 64-bit codes that order as the values do. The first round counts the codes by their
    upper ``DIGIT`` bits; each further one cuts the ranges that hold a break, from their least code to their greatest,
    into at most 2^16 parts, until a part that holds a break has one value only: at most five rounds. Counts are combined
    before the exchange, so a value that a third of the cells have is no hot key. Codes are kept between the rounds, or
    computed again in each where the cells are ``stored`` and cheap to read.
    """
    by = list(by)
    kind = cells.schema["value"].dataType
    whole = isinstance(kind, T.IntegralType)
    code = F.col("value").cast("long") if whole else ordered_code(F.col("value").cast("double"))
    codes = cells.where("value IS NOT NULL").select(*by, code.alias("code_"), F.lit(1).cast("long").alias("n_"))
    codes = codes if stored else cut_lineage(codes)
    found, open_, n = [], None, 1
    while n:
        hits, _ = _bounded(_hits(_part_counts(codes, open_, by), k))
        found.append(hits.where("lo = hi").select(*by, "i", F.col("lo").alias("code_")))
        first_round = open_ is None
        open_, n = _bounded(_open_parts(hits, by))
        if n <= OPEN_ROWS:
            open_ = F.broadcast(open_)
        elif first_round:
            # Very many layers: their values meet the open parts in a shuffle, each value once.
            codes = cut_lineage(codes.groupBy(*by, "code_").agg(F.sum("n_").alias("n_")))
    value = F.col("code_") if whole else coded_value(F.col("code_"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select(*by, "i", value.cast(kind).alias("brk"))


def _bounded(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows, and how many they are: as a local table up to ``OPEN_ROWS``, beyond that kept in Spark."""
    few = rows.limit(OPEN_ROWS + 1).toArrow()
    if few.num_rows <= OPEN_ROWS:
        return rows.sparkSession.createDataFrame(few, rows.schema), few.num_rows
    rows = cut_lineage(rows)
    return rows, rows.count()


def _open_parts(hits: DataFrame, by: list[str]) -> DataFrame:
    """The parts that hold a break and more than one value: as few as the breaks."""
    parts = hits.where("lo < hi").select(
        *[F.col(c).alias(f"{c}_open") for c in by], F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), (F.col("cum") - F.col("n")).alias("below_"), "total"
    )
    return parts.distinct().withColumn("top_", F.shiftright("lo_", 64 - DIGIT))


def _part_counts(codes: DataFrame, open_: DataFrame | None, by: list[str]) -> DataFrame:
    """For each part of the codes: ``n``, ``cum`` up to its end, ``total``, its least and greatest code."""
    counts = [F.sum("n_").alias("n"), F.min("code_").alias("lo"), F.max("code_").alias("hi")]
    top = F.shiftright("code_", 64 - DIGIT)
    if open_ is None:
        runs = codes.groupBy(*by, top.alias("part_")).agg(*counts)
        return runs.withColumns(
            {"cum": F.sum("n").over(Window.partitionBy(*by).orderBy("part_")), "total": F.sum("n").over(Window.partitionBy(*by))}
        )
    inside = (top == F.col("top_")) & F.col("code_").between(F.col("lo_"), F.col("hi_"))
    for c in by:
        inside = inside & F.col(c).eqNullSafe(F.col(f"{c}_open"))
    bits = F.ceil(F.log2((F.col("hi_") - F.col("lo_") + 1).cast("double"))).cast("int")
    part = F.call_function("shiftright", F.col("code_") - F.col("lo_"), F.greatest(F.lit(0), bits - DIGIT))
    runs = codes.join(open_, inside).groupBy(*by, "lo_", "below_", "total", part.alias("part_")).agg(*counts)
    return runs.withColumn("cum", F.col("below_") + F.sum("n").over(Window.partitionBy(*by, "lo_").orderBy("part_")))


def _hits(ranked: DataFrame, k: int) -> DataFrame:
    """One row per break index whose rank falls in this row's run ``(cum - n, cum]``."""
    # Rank i is ceil(i * total / k) in whole numbers.
    rank = "((i * total + {k} - 1) div {k})".format(k=k)
    first = f"least({k}L, greatest(1L, ((cum - n) * {k}) div total))"
    return ranked.withColumn("i", F.explode(F.expr(f"sequence({first}, {k}L)"))).where(
        F.expr(f"{rank} > cum - n AND {rank} <= cum")
    )


def distinct_breaks(breaks: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """The breaks as one ascending array without repeats (at most k values per row)."""
    return breaks.groupBy(*by).agg(F.array_sort(F.collect_set("brk")).alias("breaks"))


def ring_thresholds(breaks: DataFrame) -> DataFrame:
    """``center, middle, outer``: the last three distinct breaks; all the greatest when fewer."""
    b = F.col("breaks")
    top = F.element_at(b, -1)
    pick = lambda back: F.when(F.size(b) >= 3, F.try_element_at(b, F.lit(-back))).otherwise(top)
    return breaks.select("*", top.alias("center"), pick(2).alias("middle"), pick(3).alias("outer"))


def summary(cells: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Count, least, greatest and mean of the known cells."""
    return (
        cells.where("value IS NOT NULL")
        .groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.min("value").alias("vmin"),
            F.max("value").alias("vmax"),
            F.avg("value").alias("vmean"),
        )
    )


def tile_count(cells: DataFrame, tile_size: int) -> DataFrame:
    """Tiles that hold data, per layer."""
    tiles = with_tiles(cells, tile_size).select("layer", "trow", "tcol").distinct()
    return tiles.groupBy("layer").agg(F.count("*").alias("tiles"))
