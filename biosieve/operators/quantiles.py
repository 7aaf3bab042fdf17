"""Exact interpolated quantiles without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _bucket(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Bucket number of ``v`` in [lo, hi]; never decreasing in ``v``, so order is kept across buckets."""
    raw = F.floor((v - lo) / (hi - lo) * buckets).cast("int")
    return F.when(hi > lo, F.least(raw, F.lit(buckets - 1))).otherwise(0)


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-missing values with their frequency per group: ``_g`` (group struct), ``_v``, ``_n``.

    Without groups the key is computed from the value (it is always false) rather than a literal:
    joins on a literal key lose it and would be planned as a nested loop.
    """
    group = F.struct(*by) if by else F.struct(F.isnan(F.col(value).cast("double")).alias("_all"))
    return (
        df.select(group.alias("_g"), F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy("_g", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], buckets: int = 2048) -> DataFrame:
    """Quantiles (linear interpolation between order statistics) of a :func:`value_counts` table.

    Returns ``_g, q0, q1, …``. The wanted ranks are located by counting twice over ``buckets`` intervals, the second time only
    inside the intervals hit, and only the sub-intervals that hold a wanted rank are sorted.
    """
    names = [f"q{i}" for i in range(len(probs))]
    totals = counts.groupBy("_g").agg(F.sum("_n").alias("_total"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    low = [F.floor((F.col("_total") - 1) * F.lit(float(p))) for p in probs]
    high = [F.least(r + 1, F.col("_total") - 1) for r in low]
    ranks = F.array_distinct(F.array(*low, *high))

    def hits(before: Column) -> Column:
        return F.filter(ranks, lambda r: (r >= before) & (r < before + F.col("_n")))

    def running(keys: list[str], order: str) -> Column:
        return F.sum("_n").over(W.partitionBy(*keys).orderBy(order)) - F.col("_n")

    # first pass: frequency per interval of the group's range
    first = counts.join(totals, "_g").withColumn("_b", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), buckets)).drop("_lo", "_hi")
    hit1 = (
        first.groupBy("_g", "_total", "_b")
        .agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_before", running(["_g"], "_b"))
        .filter(F.size(hits(F.col("_before"))) > 0)
        .select("_g", "_b", "_before", "_lo", "_hi")
    )
    # second pass: frequency per sub-interval of the intervals hit, spanning their actual values
    second = first.join(hit1, ["_g", "_b"]).withColumn("_c", _bucket(F.col("_v"), F.col("_lo"), F.col("_hi"), buckets))
    hit2 = (
        second.groupBy("_g", "_total", "_b", "_c", "_before")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_start", F.col("_before") + running(["_g", "_b"], "_c"))
        .filter(F.size(hits(F.col("_start"))) > 0)
        .select("_g", "_b", "_c", "_start")
    )
    # last pass: order the few values of the sub-intervals hit
    found = (
        second.join(hit2, ["_g", "_b", "_c"])
        .withColumn("_at", F.col("_start") + running(["_g", "_b", "_c"], "_v"))
        .withColumn("_rank", F.explode(hits(F.col("_at"))))
        .select("_g", "_total", "_rank", "_v")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank, F.col("_v")))

    cols = []
    for p, q, lo, hi in zip(probs, names, low, high):
        a, b = at(lo), at(hi)
        frac = F.first(((F.col("_total") - 1) * F.lit(float(p))) - lo)
        cols.append((a + (b - a) * frac).alias(q))
    return found.groupBy("_g").agg(*cols)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles ``q0, q1, …`` of ``value`` per group of ``by``, missing values ignored."""
    out = quantiles_of_counts(value_counts(df, value, by), probs)
    names = [f"q{i}" for i in range(len(probs))]
    return out.select(*[F.col(f"_g.`{c}`").alias(c) for c in by], *names)
