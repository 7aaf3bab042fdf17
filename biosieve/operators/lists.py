"""List algebra on species names: joins, set operations, exclusion reasons."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.functions.names import canonical_key
from biosieve.functions.scores import climate_band, is_text
from biosieve.operators.filters import score_filter


def _keys(df: DataFrame, col: str, normalise: bool) -> DataFrame:
    key = canonical_key(col) if normalise else F.col(col)
    return df.select(key.alias("_key")).distinct()


def _matches(col: str, normalise: bool) -> Column:
    return (canonical_key(col) if normalise else F.col(col)).eqNullSafe(F.col("_key"))


def anti_names(a: DataFrame, b: DataFrame, on: str, other: str | None = None, normalise: bool = False) -> DataFrame:
    """Rows of ``a`` whose name is missing from ``b``.

    Key columns may differ in name; a missing name equals a missing name. ``normalise`` compares
    names regardless of ``_`` or space and of letter case.
    """
    return a.join(_keys(b, other or on, normalise), _matches(on, normalise), "left_anti")


def semi_names(a: DataFrame, b: DataFrame, on: str, other: str | None = None, normalise: bool = False) -> DataFrame:
    """Rows of ``a`` whose name occurs in ``b``."""
    return a.join(_keys(b, other or on, normalise), _matches(on, normalise), "left_semi")


def exclude_cascade(a: DataFrame, others: list[tuple[DataFrame, str]], on: str, normalise: bool = False) -> DataFrame:
    """Rows of ``a`` found in none of several lists, each given with its key column.

    The lists' keys are pooled first, so ``a`` is joined once however long the chain is.
    """
    pooled = reduce(DataFrame.unionByName, [_keys(df, col, normalise) for df, col in others]).distinct()
    return a.join(pooled, _matches(on, normalise), "left_anti")


def assessments(risk: DataFrame, intake: DataFrame, key: str = "species_latin", score: str = "global_environmental_risk") -> DataFrame:
    """Scored risk rows with their in-take columns.

    Columns of the same name other than the key get the suffixes ``_x`` (risk) and ``_y`` (in-take).
    """
    shared = [c for c in risk.columns if c in intake.columns and c != key]
    left = risk.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = intake.withColumnsRenamed({c: f"{c}_y" for c in shared} | {key: "_key"})
    return (
        left.join(right, F.col(key).eqNullSafe(F.col("_key")), "left")
        .drop("_key")
        .filter(F.col(score).isNotNull() & (F.col(score).cast("string") != "NA"))
    )


def merge_lists(a: DataFrame, b: DataFrame, on: str, other: str | None = None) -> DataFrame:
    """``a`` plus one bare row per name found only in ``b``; unnamed rows are dropped."""
    extra = anti_names(b.select(F.col(other or on).alias(on)), a, on)
    return a.unionByName(extra, allowMissingColumns=True).filter(is_text(on))


def flag_listed(a: DataFrame, listed: DataFrame, on: str, other: str | None = None, flag: str = "already_listed") -> DataFrame:
    """``a`` with a 0/1 marker telling whether its name is on the list."""
    marked = _keys(listed, other or on, False).withColumn("_hit", F.lit(1))
    return a.join(marked, _matches(on, False), "left").withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_key", "_hit")


def species_in_both(a: DataFrame, b: DataFrame, on: str = "species") -> DataFrame:
    """Rows of ``a`` whose species has a row in ``b``."""
    return semi_names(a, b, on)


def no_vector(intake: DataFrame, risk: DataFrame, key: str = "species_latin") -> DataFrame:
    """In-take species that were never assessed."""
    return anti_names(intake, risk, key)


def stack(inputs: dict[str, DataFrame], tag: str = "batch", missing: bool = False) -> DataFrame:
    """Append tables by column name, each labelled in column ``tag``; duplicates stay."""
    parts = [df.withColumn(tag, F.lit(label)) for label, df in inputs.items()]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=missing), parts)


def distinct_rows(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.select(*cols).distinct()


def scenario_partition(
    df: DataFrame, rejected: DataFrame, baseline: str = K.BASELINE_SCENARIO, future: str = K.FUTURE_SCENARIO
) -> DataFrame:
    """Label each species not rejected as matched in both scenarios, only the baseline or only the future."""
    seen = (
        df.groupBy("species")
        .agg(
            F.max((F.col("climate") == baseline).cast("int")).alias("_base"),
            F.max((F.col("climate") == future).cast("int")).alias("_future"),
        )
        .select(
            "species",
            F.when((F.col("_base") == 1) & (F.col("_future") == 1), "both")
            .when(F.col("_base") == 1, "baseline")
            .when(F.col("_future") == 1, "future")
            .alias("scenario"),
        )
        .filter(F.col("scenario").isNotNull())
    )
    return anti_names(seen, rejected, "species")


def region_species_list(
    historic: DataFrame, future: DataFrame, regions: Iterable[str], filter_future: bool = True
) -> DataFrame:
    """Distinct species with a match in the regions under either scenario.

    ``filter_future=False`` takes every species of the future table, whatever its region.
    """
    regions = list(regions)
    later = score_filter(future, regions) if filter_future else future
    return score_filter(historic, regions).select("species").unionByName(later.select("species")).distinct()


def region_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct species of list ``a`` that are not on list ``b``."""
    return anti_names(a.select("species").distinct(), b, "species")


def watchlist_coverage(lists: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Names found in exactly one of several lists, with that list's label.

    Each input is ``label: (table, name column)``. Covers both directions of a comparison.
    """
    tagged = [df.select(F.col(col).alias("name"), F.lit(label).alias("list")) for label, (df, col) in lists.items()]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("name")
        .agg(F.min("list").alias("list"), F.max("list").alias("_last"))
        .filter(F.col("list") == F.col("_last"))
        .select("name", "list")
    )


def to_screen(compare: DataFrame, known: DataFrame, scenario: str, tag: str = "batch") -> DataFrame:
    """Rows of one scenario whose species was not reviewed before."""
    return anti_names(compare.filter(F.col(tag) == scenario), known, "species")


# An exclusion rule: (reason, list of (table, name column), True when listed / False when absent).
Rule = tuple[str, list[tuple[DataFrame, str]], bool]


def classify_exclusion(candidates: DataFrame, rules: list[Rule], on: str, normalise: bool = True, out: str = "category") -> DataFrame:
    """First matching exclusion reason per candidate, NULL when no rule applies.

    All rule lists are pooled into one (name, bit mask) table, so the candidates take part in a
    single join however many rules there are.
    """
    tagged = [
        _keys(df, col, normalise).withColumn("_bit", F.lit(1 << i).cast("long"))
        for i, (_, sets, _) in enumerate(rules)
        for df, col in sets
    ]
    pooled = reduce(DataFrame.unionByName, tagged).groupBy("_key").agg(F.bit_or("_bit").alias("_mask"))
    joined = candidates.join(pooled, _matches(on, normalise), "left").withColumn("_mask", F.coalesce("_mask", F.lit(0).cast("long")))
    reason = F
    for i, (label, _, listed) in enumerate(rules):
        hit = F.col("_mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0
        reason = reason.when(hit if listed else ~hit, label)
    return joined.withColumn(out, reason).drop("_key", "_mask")


def risk_tier(assessed: DataFrame, score: str = "global_environmental_risk") -> DataFrame:
    """Moderate-risk rows: not data deficient, not due for a second look, not high risk.

    Exclusion is by species, so one deficient row removes all rows of that species.
    """
    from biosieve.operators.filters import data_deficient, high_risk, needs_second_look

    key = "species_latin"
    others = [data_deficient(assessed), needs_second_look(assessed), high_risk(assessed, score)]
    return exclude_cascade(assessed, [(df, key) for df in others], key)


def scenario_summary(results: dict[str, DataFrame]) -> DataFrame:
    """Mean score and climate band per species and scenario, scenarios stacked.

    The mean covers all non-zero rows of a species in its table: cells, models and ranks alike.
    """
    from biosieve.functions.scores import strict_mean

    def one(df: DataFrame) -> DataFrame:
        means = score_filter(df).groupBy("species").agg(strict_mean("score").alias("avg_score"))
        return means.select("species", "avg_score", climate_band("avg_score").alias("clim_match"))

    return stack({label: one(df) for label, df in results.items()})
