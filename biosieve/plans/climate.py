"""From climate layers and occurrences to banded species per region."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.functions.projection import to_mollweide
from biosieve.functions.scores import climate_band
from biosieve.operators.filters import score_filter
from biosieve.operators.lists import region_species_list, scenario_summary, stack
from biosieve.operators.matching import climate_match, point_climate
from biosieve.operators.reshape import presence_matrix
from biosieve.operators.stats import min_occurrences
from biosieve.sources.geography import Grid


def species_scores(
    points: DataFrame, cells: DataFrame, grid: Grid, targets: DataFrame, layers: Sequence[str], sensitivity: int = 1, mollweide: bool = False
) -> DataFrame:
    """Match scores for occurrence points ``species, lon, lat`` against target cells.

    Species with one record are dropped. Records are counted per species and cell before the
    climate is attached, so repeated places are joined and scored once.
    """
    records = min_occurrences(points.select("species", "lon", "lat"))
    placed = to_mollweide(records) if mollweide else records.withColumns({"x": F.col("lon"), "y": F.col("lat")})
    counted = placed.groupBy("species", grid.row_of(F.col("y")).alias("_r"), grid.col_of(F.col("x")).alias("_c")).agg(F.count(F.lit(1)).alias("n"))
    known = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *layers)
    occ = counted.join(known, ["_r", "_c"]).select("species", "n", *layers)
    return climate_match(occ, targets, layers, sensitivity)


def regional_bands(occurrences: DataFrame, targets: DataFrame, layers: Sequence[str], regions: Sequence[str]) -> DataFrame:
    """Mean non-zero score, number of cells and climate band per species over some regions.

    Only the cells of those regions are scored.
    """
    wanted = targets.filter(F.col("target").isin(*regions))
    scores = score_filter(climate_match(occurrences, wanted, layers))
    means = scores.groupBy("species").agg(F.avg("score").alias("avg_score"), F.count(F.lit(1)).alias("n"))
    return means.select("species", "avg_score", "n", climate_band("avg_score").alias("clim_match"))


def scenario_comparison(baseline: DataFrame, models: dict[str, DataFrame], targets: Sequence[str]) -> dict[str, DataFrame]:
    """Regional lists, presence matrix and banded summary of a baseline and several future models."""
    now = score_filter(baseline, targets)
    later = score_filter(stack(models), targets)
    scenarios = stack({"1981-2010": now.select("species", "target"), "2011-2040": later.select("species", "target")}, "climate")
    return {
        "species": region_species_list(baseline, later, targets),
        "matrix": presence_matrix(scenarios.distinct(), targets),
        "summary": scenario_summary({"2011_2040": later, "1981_2010": now}),
    }


__all__ = ["species_scores", "regional_bands", "scenario_comparison", "point_climate"]
