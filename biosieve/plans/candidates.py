"""From a raw candidate list to the names worth assessing, and the reason for every removal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.operators import filters as P
from biosieve.operators.lists import anti_names
from biosieve.operators.naming import remove_regulated, resolve_names
from biosieve.operators.stats import first_per_key
from biosieve.session import durable


def candidate_funnel(
    candidates: DataFrame,
    reference: DataFrame,
    completed: DataFrame,
    regulated: DataFrame,
    classes=K.EXCLUDED_CLASSES,
    source: str = K.NAME_SOURCE,
    min_score: float = K.MIN_NAME_SCORE,
) -> DataFrame:
    """Resolved names still to assess: in scope, invasive somewhere, confidently named, neither assessed nor regulated.

    ``reference`` holds ``matched_name, data_source_title``; ``completed`` holds ``species_latin``;
    ``regulated`` holds patterns in ``scientific_name``.
    """
    invasive = P.invasive_history(P.exclude_classes(candidates, classes=classes))
    named = P.named_only(invasive, "preferred_scientific_name")
    resolved = resolve_names(named, reference, "preferred_scientific_name", min_score)
    confident = P.confident_names(resolved, source, min_score)
    order = [F.desc("score"), "submitted_name"]
    first = first_per_key(confident, ["matched_name"], order).withColumnRenamed("matched_name", "scientific_name")
    open_names = anti_names(first, completed, "scientific_name", "species_latin", normalise=True)
    return remove_regulated(open_names, regulated.select(F.col("scientific_name").alias("pattern")), "scientific_name", "pattern")


def rejected_names(names: DataFrame, reference: DataFrame, name: str = "submitted_name", min_score: float = K.MIN_NAME_SCORE, floor: float = 0.7) -> DataFrame:
    """Names set aside as confused: something resembles them, but nothing from ``min_score`` on.

    Returns ``submitted_name, score, n_matches``: the best score of each and how many reference names reach
    ``floor``. Names without any match from ``floor`` on are unknown rather than confused.

    A name with a match from ``min_score`` on is never set aside, and the lower the score, the more pairs there are to
    compare. So such names are found and left out first, and only the others are resolved down to ``floor``.
    """
    if floor < min_score <= 1:
        sure = durable(resolve_names(names, reference, name, min_score).select(F.col("submitted_name").alias("_sure")).distinct())
        names = names.select(name).join(sure, F.col(name) == F.col("_sure"), "left_anti")
    resolved = resolve_names(names, reference, name, floor)
    best = resolved.groupBy("submitted_name").agg(F.max("score").alias("score"), F.count_distinct("matched_name").alias("n_matches"))
    return best.filter(F.col("score") < min_score)
