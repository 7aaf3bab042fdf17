"""From downloaded occurrence records to clean records ready for climate matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.functions.scores import to_event_date
from biosieve.operators import filters as P
from biosieve.operators.spatial import away_from_sites, drop_species_present, on_land
from biosieve.operators.stats import dedupe_records, min_occurrences
from biosieve.session import durable


def clean_occurrences(
    records: DataFrame,
    taxon_keys: DataFrame,
    names: DataFrame,
    land: DataFrame,
    sites: DataFrame,
    radius_m: float = K.SITE_BUFFER_METRES,
    size: float = 1.0,
) -> DataFrame:
    """Records that pass selection, quality, deduplication, list membership, land and site tests.

    The cheap row filters run first; the one shuffle over all records is the deduplication, whose
    copies are dropped before it.
    """
    kept = P.nonzero_coordinates(P.coordinate_quality(P.occurrence_predicates(records, taxon_keys)))
    listed = P.species_of_interest(dedupe_records(kept), names)
    dry = on_land(listed, land, size=size)
    clean = away_from_sites(dry, sites, radius_m)
    return clean.withColumn("eventdate", to_event_date("eventdate")).withColumnsRenamed({"species": "scientific_name", "eventdate": "date"}).withColumn("obs_source", F.lit("GBIF"))


def assessable_records(clean: DataFrame, area: DataFrame, size: float = 1.0) -> DataFrame:
    """Records ``species, lon, lat`` of species absent from the assessment area with two or more records.

    Both steps read their input twice (to find the species and to keep the rows), so each input is
    stored first and the cleaning before it runs once.
    """
    absent = drop_species_present(durable(clean), area, size=size)
    slim = absent.select(F.replace(F.col("scientific_name"), F.lit(" "), F.lit("_")).alias("species"), "lon", "lat")
    return min_occurrences(durable(slim))
