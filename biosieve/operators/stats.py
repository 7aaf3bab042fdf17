"""Aggregations, per-group statistics and the numbers behind the usual charts."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.functions.scores import n_distinct, strict_mean, strict_sum, yes_flag
from biosieve.operators.quantiles import quantiles_of_counts, value_counts

CELL = ("target_x", "target_y")


def best_score(results: DataFrame, keys: Sequence[str] = ("species", *CELL)) -> DataFrame:
    """Highest score per species and cell; NULL when a cell has only missing scores."""
    return results.groupBy(*keys).agg(F.max("score").alias("score"))


def species_per_cell(results: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Number of species with a positive score per cell; cells without one keep NULL.

    One aggregation over all rows gives every cell, so no join back to the list of cells is needed.
    A missing species name counts as one more species.
    """
    positive = F.col("score") > 0
    named = F.count_distinct(F.when(positive, F.col("species")))
    unnamed = F.coalesce(F.max((positive & F.col("species").isNull()).cast("int")), F.lit(0))
    return results.groupBy(*cell).agg(F.nullif(named + unnamed, F.lit(0)).alias("n_species"))


def exclusion_table(
    listed: DataFrame, phyla: Sequence[str], name: str = "preferred_scientific_name", phylum: str = "phylum", category: str = "category"
) -> DataFrame:
    """Distinct names per exclusion category (rows) and phylum (columns)."""
    counts = listed.groupBy(category, phylum).agg(n_distinct(name).alias("_n"))
    return counts.groupBy(category).pivot(phylum, list(phyla)).agg(F.first("_n"))


def vector_counts(
    assessed: DataFrame, vectors: dict[str, str] | None = None, taxa: str = "taxa", na_rm: bool = False
) -> DataFrame:
    """Species active in each introduction vector per taxon as ``(taxa, vector, count)``.

    A count is NULL when one of the taxon's flags is missing, unless ``na_rm``.
    """
    vectors = vectors or K.VECTORS
    total = F.sum if na_rm else strict_sum
    sums = assessed.groupBy(taxa).agg(*[total(yes_flag(c)).alias(label) for c, label in vectors.items()])
    return sums.unpivot([taxa], list(vectors.values()), "vector", "count")


def question_counts(
    assessed: DataFrame, questions: Sequence[str] = ("qu_1", "qu_2", "qu_3", "qu_4"), species: str = "species_latin", taxa: str = "taxa"
) -> DataFrame:
    """Distinct species per question, taxon and score."""
    return (
        assessed.select(species, taxa, *questions)
        .unpivot([species, taxa], list(questions), "question", "score")
        .groupBy("question", taxa, "score")
        .agg(n_distinct(species).alias("n"))
    )


def category_counts(df: DataFrame, category: str, fill: str) -> DataFrame:
    """Rows per category and fill group with the category total, most frequent category first."""
    return (
        df.groupBy(category, fill)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("total", F.sum("n").over(W.partitionBy(category)))
        .orderBy(F.desc("total"), category, fill)
    )


def order_by_frequency(df: DataFrame, col: str, reverse: bool = False) -> DataFrame:
    """Categories with their count, most frequent first (last when ``reverse``), ties by name."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(*([F.asc("n"), F.desc(col)] if reverse else [F.desc("n"), F.asc(col)]))


def n_scenarios(df: DataFrame) -> DataFrame:
    """Number of climate scenarios (rows) per species."""
    return df.groupBy("species").agg(F.count(F.lit(1)).alias("n_climates"))


def duplicate_count(df: DataFrame, key: str) -> DataFrame:
    """How many rows repeat a key seen before."""
    return df.agg((F.count(F.lit(1)) - n_distinct(key)).alias("n_duplicates"))


def species_count(df: DataFrame, species: str = "species") -> DataFrame:
    return df.agg(n_distinct(species).alias("n_species"))


def five_number(
    df: DataFrame, group: Sequence[str], value: str, limits: tuple[float, float] | None = None
) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers within 1.5 box lengths, number of outliers.

    ``limits`` drops values outside a range before anything is computed.
    """
    counts = value_counts(df if limits is None else df.filter(F.col(value).between(*limits)), value, group)
    boxes = quantiles_of_counts(counts, (0.25, 0.5, 0.75))
    reach = 1.5 * (F.col("q2") - F.col("q0"))
    inside = F.col("_v").between(F.col("q0") - reach, F.col("q2") + reach)
    return (
        counts.join(boxes, "_g")
        .groupBy("_g", "q0", "q1", "q2")
        .agg(
            F.sum("_n").alias("n"),
            F.min(F.when(inside, F.col("_v"))).alias("lower_whisker"),
            F.max(F.when(inside, F.col("_v"))).alias("upper_whisker"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("n_outliers"),
        )
        .select(
            *[F.col(f"_g.`{c}`").alias(c) for c in group],
            "n", "lower_whisker", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"), "upper_whisker", "n_outliers",
        )
    )


def box_outliers(df: DataFrame, group: Sequence[str], value: str, limits: tuple[float, float] | None = None) -> DataFrame:
    """Values beyond the whiskers with their frequency, one row per group and value."""
    counts = value_counts(df if limits is None else df.filter(F.col(value).between(*limits)), value, group)
    boxes = quantiles_of_counts(counts, (0.25, 0.75))
    reach = 1.5 * (F.col("q1") - F.col("q0"))
    return (
        counts.join(boxes, "_g")
        .filter(~F.col("_v").between(F.col("q0") - reach, F.col("q1") + reach))
        .select(*[F.col(f"_g.`{c}`").alias(c) for c in group], F.col("_v").alias("value"), F.col("_n").alias("n"))
    )


def column_summary(df: DataFrame, col: str) -> DataFrame:
    """Minimum, quartiles, mean, maximum and number of missing values of one column."""
    counts = value_counts(df, col)
    quart = quantiles_of_counts(counts, (0.25, 0.5, 0.75)).select(F.struct("q0", "q1", "q2").alias("q"))
    plain = df.agg(
        F.min(col).alias("min"), F.avg(col).alias("mean"), F.max(col).alias("max"), F.count_if(F.col(col).isNull()).alias("n_missing")
    )
    return plain.withColumn("_q", quart.scalar()).select(
        "min", F.col("_q.q0").alias("q1"), F.col("_q.q1").alias("median"), "mean", F.col("_q.q2").alias("q3"), "max", "n_missing"
    )


def histogram(df: DataFrame, col: str, width: float = 1.0) -> DataFrame:
    """Counts in bins centred on multiples of ``width``, closed on the right, gaps filled with 0."""
    k = F.ceil((F.col(col) - width / 2) / F.lit(width)).cast("long")
    counts = df.filter(F.col(col).isNotNull()).groupBy(k.alias("_k")).agg(F.count(F.lit(1)).alias("count"))
    bins = counts.agg(F.min("_k").alias("a"), F.max("_k").alias("b")).select(F.explode(F.sequence("a", "b")).alias("_k"))
    return bins.join(counts, "_k", "left").select((F.col("_k") * width).alias("bin"), F.coalesce("count", F.lit(0)).alias("count"))


def density(df: DataFrame, col: str, group: Sequence[str], points: int = 512) -> DataFrame:
    """Gaussian kernel density per group at ``points`` places over the range of all groups.

    Bandwidth is 0.9 min(sd, IQR / 1.34) n^(-1/5) with the usual fall-backs for a constant group;
    groups of one row are dropped. Each distinct value only reaches the grid places within nine
    bandwidths, beyond which a double holds nothing of its kernel, and is summed before the shuffle.
    """
    counts = value_counts(df, col, group)
    spans = counts.agg(F.min("_v").alias("a"), F.max("_v").alias("b")).select(F.struct("a", "b").alias("s"))
    quart = quantiles_of_counts(counts, (0.25, 0.75))
    n, mean = F.sum("_n"), F.sum(F.col("_n") * F.col("_v")) / F.sum("_n")
    centre = counts.groupBy("_g").agg(n.alias("_total"), mean.alias("_m"), F.min("_v").alias("_x1"))
    spread = (
        counts.join(centre, "_g")
        .groupBy("_g", "_total", "_x1")
        .agg(F.sum(F.col("_n") * F.pow(F.col("_v") - F.col("_m"), 2)).alias("_ss"))
        .filter(F.col("_total") > 1)
        .join(quart, "_g")
    )
    sd = F.sqrt(F.col("_ss") / (F.col("_total") - 1))
    lo = F.least(sd, (F.col("q1") - F.col("q0")) / 1.34)
    width = F.when(lo > 0, lo).when(sd > 0, sd).when(F.col("_x1") != 0, F.abs("_x1")).otherwise(1.0)
    bw = spread.select("_g", "_total", (0.9 * width * F.pow(F.col("_total").cast("double"), F.lit(-0.2))).alias("_bw"))

    span = spans.scalar()
    a, step = span.getField("a"), (span.getField("b") - span.getField("a")) / (points - 1)
    reach = 9 * F.col("_bw")
    place = lambda x: F.when(F.col("_step") > 0, (x - F.col("_a")) / F.col("_step"))
    first = F.greatest(F.lit(0), F.coalesce(F.ceil(place(F.col("_v") - reach)), F.lit(0)))
    last = F.least(F.lit(points - 1), F.coalesce(F.floor(place(F.col("_v") + reach)), F.lit(points - 1)))
    x = F.col("_a") + F.col("_i") * F.col("_step")
    kernel = F.exp(-0.5 * F.pow((x - F.col("_v")) / F.col("_bw"), 2)) / math.sqrt(2 * math.pi)
    sums = (
        counts.join(bw, "_g")
        .withColumn("_a", a)
        .withColumn("_step", step)
        .withColumn("_from", first.cast("int"))
        .withColumn("_to", last.cast("int"))
        .filter(F.col("_from") <= F.col("_to"))
        .withColumn("_i", F.explode(F.sequence("_from", "_to")))
        .groupBy("_g", "_i")
        .agg(F.sum(F.col("_n") * kernel).alias("_k"))
    )
    grid = bw.select("_g", "_total", "_bw", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_i"))
    return grid.join(sums, ["_g", "_i"], "left").select(
        *[F.col(f"_g.`{c}`").alias(c) for c in group],
        (a + F.col("_i") * step).alias("x"),
        (F.coalesce("_k", F.lit(0.0)) / (F.col("_total") * F.col("_bw"))).alias("density"),
    )


def pairwise_fit(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Least-squares line of every later rater on every earlier one, in one pass over the rows."""
    pairs = list(combinations(raters, 2))
    fits = df.agg(
        *[
            F.struct(
                F.lit(x).alias("rater_x"),
                F.lit(y).alias("rater_y"),
                F.regr_count(F.col(y), F.col(x)).alias("n"),
                F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
            ).alias(f"p{i}")
            for i, (x, y) in enumerate(pairs)
        ]
    )
    return fits.select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))])))


def extent(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """Bounding box."""
    return points.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))


def min_occurrences(records: DataFrame, n: int = 2, key: str = "species") -> DataFrame:
    """Records of species that have at least ``n`` records.

    Counts are combined before the shuffle and joined back, so a dominant species is never
    gathered in one window partition.
    """
    often = records.groupBy(key).agg(F.count(F.lit(1)).alias("_freq")).filter(F.col("_freq") >= n).select(F.col(key).alias("_key"))
    return records.join(often, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def ensemble_mean(models: dict[str, DataFrame], na_rm: bool = False, tag: str = "batch") -> DataFrame:
    """Results of several climate models stacked, with each species' mean score and row count.

    Without ``na_rm`` one missing score makes the species' mean NULL.
    """
    from biosieve.operators.lists import stack

    rows = stack(models, tag)
    mean = F.avg("score") if na_rm else strict_mean("score")
    means = rows.groupBy(F.col("species").alias("_key")).agg(mean.alias("avg_score"), F.count(F.lit(1)).alias("n"))
    return rows.join(means, F.col("species").eqNullSafe(F.col("_key")), "left").drop("_key")


def first_per_key(df: DataFrame, key: Iterable[str], order: Iterable[str]) -> DataFrame:
    """First row per key under an explicit order.

    Spark keeps only each partition's first rows before the shuffle, so a key with many copies
    arrives already reduced.
    """
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def dedupe_records(records: DataFrame, key: Sequence[str] = ("lon", "lat", "specieskey", "datasetkey"), order: Sequence[str] = ("record_id",)) -> DataFrame:
    """One record per place, species and dataset: the one with the lowest record id."""
    return first_per_key(records, key, order)


def top_k_scores(df: DataFrame, k: int = 2, keys: Sequence[str] = ("species", *CELL), ties: Sequence[str] = ()) -> DataFrame:
    """The rows of the ``k`` best scores per species and cell with their rank."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), *ties))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def row_ids(df: DataFrame, order: Sequence[str], out: str = "id") -> DataFrame:
    """Consecutive ids from 1 in a total order, without sending all rows through one task.

    The range-sorted rows are written once so their partitions stay fixed. Only the partitions' row
    counts (as many rows as partitions) take part in the running total.
    """
    from biosieve.session import durable

    sorted_rows = durable(df.orderBy(*order))
    # a fixed partition numbers its rows from (partition << 33), which gives partition and place
    numbered = sorted_rows.withColumn("_mid", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_place", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    return numbered.join(starts, "_part").select(*df.columns, (F.col("_start") + F.col("_place") + 1).alias(out))


def cell_ids(df: DataFrame, cell: Sequence[str] = CELL, out: str = "id") -> DataFrame:
    """Rows with a consecutive id of their cell, cells ordered by their coordinates."""
    ids = row_ids(df.select(*cell).distinct(), cell, out)
    keys = ids.select(*[F.col(c).alias(f"_{c}") for c in cell], out)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell]
    return df.join(keys, same, "left").drop(*[f"_{c}" for c in cell])
