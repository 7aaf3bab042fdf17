"""Projections and row predicates. NULL rules are stated where they differ from plain SQL."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.functions.scores import in_set, is_text


def project(
    df: DataFrame, cols: list[str] | None = None, rename: dict[str, str] | None = None, drop: Iterable[str] = ()
) -> DataFrame:
    """Keep and order ``cols`` (all when omitted), drop ``drop``, then rename."""
    out = df.select(*cols) if cols else df
    return out.drop(*drop).withColumnsRenamed(rename or {})


def exclude_classes(df: DataFrame, col: str = "class", classes: Iterable[str] = K.EXCLUDED_CLASSES) -> DataFrame:
    """Rows whose class is not listed; rows without a class stay."""
    return df.filter(~in_set(col, classes))


def only_classes(df: DataFrame, col: str = "class", classes: Iterable[str] = K.EXCLUDED_CLASSES) -> DataFrame:
    """Rows whose class is listed (the complement of :func:`exclude_classes`)."""
    return df.filter(F.col(col).isin(*classes))


def invasive_history(df: DataFrame, col: str = "invasive_somewhere", value: str = "invasive") -> DataFrame:
    return df.filter(F.col(col) == value)


def named_only(df: DataFrame, col: str) -> DataFrame:
    """Rows with a name: neither NULL nor the text "NA"."""
    return df.filter(is_text(col))


def confident_names(
    df: DataFrame, source: str | None = K.NAME_SOURCE, min_score: float = K.MIN_NAME_SCORE, confused: bool = False
) -> DataFrame:
    """Resolved names of one source with score >= ``min_score``.

    ``confused=True`` gives the names at or below the bound, from every source.
    """
    if confused:
        return df.filter(F.col("score") <= min_score)
    kept = df.filter(F.col("score") >= min_score)
    return kept if source is None else kept.filter(F.col("data_source_title") == source)


def occurrence_predicates(
    df: DataFrame,
    taxon_keys: DataFrame,
    min_year: int = K.FIRST_RECORD_YEAR,
    bases: Iterable[str] = K.EXCLUDED_RECORD_BASES,
) -> DataFrame:
    """Present, located, recent records of the wanted taxa whose basis is not excluded."""
    keys = taxon_keys.select(F.col(taxon_keys.columns[0]).alias("_key")).distinct()
    return df.filter(
        ~F.col("has_geospatial_issue")
        & F.col("has_coordinate")
        & (F.col("occurrence_status") == "PRESENT")
        & (F.col("year") >= min_year)
        & ~in_set("basis_of_record", bases)
    ).join(keys, F.col("taxon_key") == F.col("_key"), "left_semi")


def coordinate_quality(
    df: DataFrame, precision: str = "coordinateprecision", uncertainty: str = "coordinateuncertaintyinmeters"
) -> DataFrame:
    """Drop imprecise coordinates and placeholder uncertainties; a missing value passes."""
    p, u = F.col(precision), F.col(uncertainty)
    return df.filter(
        (p.isNull() | (p < K.MAX_COORDINATE_PRECISION))
        & (u.isNull() | (u < K.MAX_COORDINATE_UNCERTAINTY))
        & ~in_set(u, K.PLACEHOLDER_UNCERTAINTIES)
    )


def nonzero_coordinates(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Drop points at (0, 0)."""
    return df.filter((F.col(lat) != 0) | (F.col(lon) != 0))


def score_filter(df: DataFrame, targets: Iterable[str] | None = None) -> DataFrame:
    """Non-zero scores, optionally only of some target regions."""
    kept = df.filter(F.col("score") != 0)
    return kept if targets is None else kept.filter(F.col("target").isin(*targets))


def habitat_filter(df: DataFrame, col: str, habitats: Iterable[str]) -> DataFrame:
    """Rows whose habitat text is exactly one of ``habitats``."""
    return df.filter(F.col(col).isin(*habitats))


def screened_species(df: DataFrame) -> DataFrame:
    """Aquatic species that are neither native nor established and whose climate fits."""
    wanted = {"native": "N", "established": "N", "aquatic": "Y", "climate_mismatch": "N"}
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in wanted.items()]))


def flagged_species(sheets: list[DataFrame], flag: str, values: Iterable[str]) -> DataFrame:
    """Distinct species whose ``flag`` has one of ``values`` in any screening sheet."""
    parts = [s.filter(F.col(flag).isin(*values)).select("species") for s in sheets]
    return reduce(DataFrame.unionByName, parts).distinct()


def high_risk(df: DataFrame, col: str = "global_environmental_risk", lo: int = K.HIGH_RISK_RANGE[0], hi: int = K.HIGH_RISK_RANGE[1]) -> DataFrame:
    """Whole scores from ``lo`` to ``hi``; fractional scores never match."""
    return df.filter(F.col(col).isin(*range(lo, hi + 1)))


def data_deficient(df: DataFrame, questions: Iterable[str] = ("qu_1", "qu_2", "qu_3", "qu_4")) -> DataFrame:
    """Rows with at least one question scored 0 (unknown)."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(q) == 0 for q in questions]))


def needs_second_look(df: DataFrame, col: str = "secondary_assessment") -> DataFrame:
    return df.filter(F.col(col).isin(*K.SECOND_LOOK_FLAGS))


def species_of_interest(df: DataFrame, names: DataFrame, col: str = "species", name_col: str | None = None) -> DataFrame:
    """Rows whose ``col`` occurs in the list ``names``; a missing name matches a missing name."""
    wanted = names.select(F.col(name_col or names.columns[0]).alias("_name")).distinct()
    return df.join(wanted, F.col(col).eqNullSafe(F.col("_name")), "left_semi")


def presence_list(matrix: DataFrame, region: str) -> DataFrame:
    """Distinct species marked ``Y`` in one region column of a presence matrix."""
    return matrix.filter(F.col(f"`{region}`") == "Y").select("species").distinct()


def scenario_rows(matrix: DataFrame, climate: str, regions: Iterable[str] = ()) -> DataFrame:
    """Distinct rows of one climate scenario without the region columns."""
    return matrix.filter(F.col("climate") == climate).drop(*regions).distinct()
