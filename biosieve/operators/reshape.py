"""Wide and long forms of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.operators.lists import exclude_cascade, stack


def presence_matrix(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``Y`` per (species, climate) row and region column, NULL where there is no match."""
    return df.groupBy("species", "climate").pivot("target", list(targets)).agg(F.first(F.lit("Y")))


def region_matrix(lists: dict[str, DataFrame], rejected: list[tuple[DataFrame, str]]) -> DataFrame:
    """Species still to review per region: 1 in the column of each region that lists them.

    ``rejected`` are reviewed or rejected name tables with their key columns; names are compared
    regardless of ``_`` or space.
    """
    open_rows = exclude_cascade(stack(lists, "region"), rejected, "species", normalise=True)
    return open_rows.groupBy("species").pivot("region", list(lists)).agg(F.first(F.lit(1.0)))


def scores_long(df: DataFrame, scores: Sequence[str] = ("score_current", "score_future")) -> DataFrame:
    """One row per target, cell and scenario; the cell is named by its coordinates."""
    cell = F.concat_ws(" ", F.col("target_x").cast("string"), F.col("target_y").cast("string"))
    return (
        df.select("target", cell.alias("cell"), *scores)
        .unpivot(["target", "cell"], list(scores), "scenario", "score")
        .withColumn("scenario", F.regexp_replace("scenario", "^score_", ""))
    )


def question_scores_long(df: DataFrame, questions: Sequence[str], species: str = "species_latin") -> DataFrame:
    """One row per species row and chosen question."""
    return df.select(species, *questions).unpivot([species], list(questions), "question", "score")
