"""Registry of queries with their SQL, and the frames that bind operators to the given tables.

A frame lists column expressions valid in both Spark SQL and DuckDB, so both sides read the same
binding. Every frame covers its whole table; ``where`` states a condition that defines a list.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_FRAMES: dict[str, tuple[str, dict[str, str], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def frame(name: str, table: str, where: str | None = None, **cols: str) -> None:
    _FRAMES[name] = (table, cols, where)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, cols, where = _FRAMES[name]
    df = table(spark, sf_dir, source)
    if where:
        df = df.filter(where)
    return df.selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


def sql(body: str, *frames: str, ctes: str = "") -> str:
    """SELECT text over the named frames (and further ``ctes``)."""
    parts = []
    for name in frames:
        source, cols, where = _FRAMES[name]
        listed = ", ".join(f"{e} AS {c}" for c, e in cols.items())
        parts.append(f"{name} AS (SELECT {listed} FROM {source}{' WHERE ' + where if where else ''})")
    if ctes:
        parts.append(ctes)
    return f"WITH {', '.join(parts)} {body}" if parts else body


def r6(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round the named columns (never to -0.0)."""
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in cols})


def r6_sql(*cols: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in cols)


# occurrences: 150 species, coordinates on a 0.1 degree lattice
frame(
    "occ", "events",
    record_id="event_id",
    species="'sp_' || CAST(user_id AS STRING)",
    specieskey="user_id",
    datasetkey="event_type",
    lon="CAST(event_id * 7919 % 3600 AS DOUBLE) / 10 - 180",
    lat="CAST(event_id * 104729 % 1800 AS DOUBLE) / 10 - 90",
    coordinateprecision="CASE WHEN user_id % 3 = 0 THEN NULL ELSE value / 20000 END",
    coordinateuncertaintyinmeters="CASE WHEN user_id % 4 = 0 THEN NULL ELSE round(value * 100) END",
    taxon_key="user_id",
    has_geospatial_issue="value > 400",
    has_coordinate="value > 1",
    occurrence_status="CASE WHEN event_type = 'error' THEN 'ABSENT' ELSE 'PRESENT' END",
    year="1980 + CAST(event_id % 50 AS INT)",
    basis_of_record="CASE event_type WHEN 'click' THEN 'HUMAN_OBSERVATION' WHEN 'view' THEN NULL ELSE 'MACHINE_OBSERVATION' END",
    eventdate="ts",
)
# the same records on a coarse lattice, so that places repeat and (0, 0) occurs
frame(
    "places", "events",
    record_id="event_id", specieskey="user_id", datasetkey="event_type", value="value",
    lon="CAST(event_id % 8 AS DOUBLE) * 45 - 180", lat="CAST(event_id % 5 AS DOUBLE) * 45 - 90",
)
# match results: species x region x cell with scores 0 to 6
frame(
    "results", "lineitem",
    species="'sp_' || CAST(l_partkey AS STRING)",
    target="l_returnflag",
    target_x="CAST(l_suppkey % 50 AS DOUBLE) * 1000",
    target_y="CAST(l_suppkey - l_suppkey % 50 AS DOUBLE) * 20",
    score="l_linenumber - 1",
    model="l_linestatus",
    climate="CASE WHEN l_linestatus = 'F' THEN '1981-2010' ELSE '2011-2040' END",
    ord="l_orderkey",
)
# the same for species of few rows
frame(
    "rare_results", "lineitem",
    species="'sp_' || CAST(l_orderkey AS STRING)", target="l_returnflag", score="l_linenumber - 1", model="l_linestatus",
    climate="CASE WHEN l_linestatus = 'F' THEN '1981-2010' ELSE '2011-2040' END",
)
# the same with a cell belonging to one region only
frame(
    "region_cells", "lineitem",
    species="'sp_' || CAST(l_partkey AS STRING)",
    target="l_returnflag",
    target_x="CAST(ascii(l_returnflag) * 1000000 + l_suppkey % 50 AS DOUBLE)",
    target_y="CAST(l_suppkey - l_suppkey % 50 AS DOUBLE)",
    score="l_linenumber - 1",
    model="l_linestatus",
)
# the same with missing scores and species
frame(
    "gappy", "lineitem",
    species="nullif('sp_' || CAST(l_partkey AS STRING), 'sp_7')",
    target="l_returnflag",
    target_x="CAST(l_suppkey % 50 AS DOUBLE) * 1000",
    target_y="CAST(l_suppkey - l_suppkey % 50 AS DOUBLE) * 20",
    score="CASE WHEN l_partkey % 10 = 3 THEN nullif(l_linenumber - 1, 6) ELSE l_linenumber - 1 END",
    model="l_linestatus",
)
_NAME = "p_name || ' ' || p_type || ' ' || p_brand"
frame(
    "candidates", "part",
    preferred_scientific_name=f"nullif({_NAME}, 'red bolt ECONOMY Brand#1')",
    organism_type="p_type", kingdom="p_name", phylum="p_type", **{"class": "nullif(p_brand, 'Brand#7')"},
    invasive_somewhere="CASE WHEN p_size % 2 = 0 THEN 'invasive' ELSE 'not recorded' END",
    habitat="""CASE p_size % 3 WHEN 0 THEN '["freshwater"]' WHEN 1 THEN '["terrestrial","freshwater"]' ELSE 'marine' END""",
    size="p_size",
)
frame("completed", "part", where="p_size = 7", species_latin="replace(" + _NAME + ", ' ', '_')")
frame("listed", "part", where="p_size BETWEEN 10 AND 12", scientific_name=_NAME)
frame("mapped", "part", where="p_size >= 20", species=_NAME)
frame(
    "sheet_a", "part",
    species="replace(" + _NAME + ", ' ', '_')",
    native="CASE p_size % 5 WHEN 0 THEN 'Y' WHEN 1 THEN 'DD' ELSE 'N' END",
    established="CASE p_size % 7 WHEN 0 THEN 'Y' WHEN 1 THEN 'DD' ELSE 'N' END",
    aquatic="CASE p_size % 4 WHEN 0 THEN 'N' WHEN 1 THEN NULL ELSE 'Y' END",
)
frame(
    "sheet_b", "part",
    species="replace(" + _NAME + ", ' ', '_')",
    native="CASE p_size % 6 WHEN 0 THEN 'Y' ELSE 'N' END",
    established="CASE p_size % 8 WHEN 0 THEN 'Y' WHEN 1 THEN 'DD' ELSE 'N' END",
    aquatic="CASE p_size % 9 WHEN 0 THEN 'N' WHEN 1 THEN 'DD' ELSE 'Y' END",
    climate_mismatch="CASE p_size % 10 WHEN 0 THEN 'Y' WHEN 1 THEN 'DD' ELSE 'N' END",
)
frame(
    "risk", "customer",
    species_latin="c_name",
    species_common="'common ' || c_name",
    taxa="c_mktsegment",
    family="'family ' || CAST(c_nationkey AS STRING)",
    qu_1="CAST(c_custkey % 4 AS INT)",
    qu_2="CAST(c_custkey % 5 - 1 AS INT)",
    qu_3="c_nationkey % 4",
    qu_4="c_nationkey % 3 + 1",
    global_environmental_risk="nullif(CAST(c_custkey % 13 AS INT), 5)",
    secondary_assessment="CASE c_custkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'yes' WHEN 2 THEN 'uncertain' WHEN 3 THEN NULL WHEN 4 THEN 'Maybe' ELSE 'No' END",
)
_FLAG = "CASE {e} WHEN 0 THEN 'Yes' WHEN 1 THEN 'yes' ELSE 'No' END"
frame(
    "intake", "customer", where="c_acctbal > 0",
    species_latin="c_name",
    species_common="'taken ' || c_name",
    pet_aquarium=_FLAG.format(e="c_custkey % 3"),
    aquaculture=_FLAG.format(e="c_custkey % 4"),
    rec_fish=_FLAG.format(e="c_custkey % 5"),
    biofouler=_FLAG.format(e="c_nationkey % 3"),
    bilge_water="CASE c_nationkey % 6 WHEN 0 THEN 'Yes' WHEN 1 THEN NULL ELSE 'No' END",
    water_garden=_FLAG.format(e="c_custkey % 2"),
)
frame("regulated", "customer", where="c_acctbal < 0", scientific_name="c_name")

# records in groups of four per species
frame(
    "tracks", "events",
    record_id="event_id",
    specieskey="CAST(floor(event_id / 4) AS BIGINT)",
    lon="CAST(event_id * 7919 % 3600 AS DOUBLE) / 10 - 180",
    lat="CAST(event_id * 104729 % 1800 AS DOUBLE) / 10 - 90",
)
frame(
    "sites", "supplier",
    lon="CAST(s_suppkey * 7919 % 3600 AS DOUBLE) / 10 - 180 + 0.03",
    lat="CAST(s_suppkey * 104729 % 1800 AS DOUBLE) / 10 - 90",
)
# line items on a 100 x 200 grid of 1.8 degree cells
frame("gridded", "lineitem", row="l_suppkey % 100", col="l_partkey % 200", bio01="l_quantity", bio05="l_discount", bio06="l_tax", model="l_linestatus")
