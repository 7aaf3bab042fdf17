"""Summaries of the risk assessment sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame

from biosieve.operators import filters as P
from biosieve.operators import lists as L
from biosieve.operators import stats as S

SCORE = "global_environmental_risk"


def risk_overview(risk: DataFrame, intake: DataFrame, regulated: DataFrame) -> dict[str, DataFrame]:
    """Tiers, vectors, listing status, data gaps and box-plot numbers of all assessed species."""
    assessed = L.assessments(risk, intake)
    high = P.high_risk(assessed)
    deficient = P.data_deficient(assessed)
    second = P.needs_second_look(assessed)
    moderate = L.risk_tier(assessed)
    box = lambda df, limits=None: S.five_number(df, ["taxa"], SCORE, limits)
    listed = L.flag_listed(high, regulated, "species_latin", "scientific_name")
    return {
        "assessed": assessed,
        "high": high,
        "highest": P.high_risk(assessed, lo=12, hi=12),
        "deficient": deficient,
        "second_look": second,
        "moderate": moderate,
        "vectors": S.vector_counts(assessed),
        "high_vectors": S.vector_counts(high),
        "listing": S.category_counts(listed, "already_listed", "taxa"),
        "gaps": S.question_counts(deficient),
        "boxes": box(assessed),
        "family_boxes": S.five_number(assessed, ["taxa", "family"], SCORE),
        "deficient_boxes": box(deficient),
        "second_look_boxes": box(second),
        "moderate_boxes": box(moderate, (2, 8)),
        "histogram": S.histogram(assessed, SCORE),
    }
