"""Queries for occurrence records, windows, top-k, sources and sinks."""

from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.bindings.base import load, query, r6, sql, table
from biosieve.functions.names import clean_headers, clean_name, fix_names, promote_header
from biosieve.functions.scores import climate_band, default_zero, to_event_date, yes_flag
from biosieve.operators import filters as P
from biosieve.operators import lists as L
from biosieve.operators import stats as S
from biosieve.session import scratch_path
from biosieve.sources import tables as T

OCC = "record_id, specieskey, datasetkey, lon, lat"


@query("occurrence_predicates", sql(f"""SELECT {OCC}, year FROM occ WHERE NOT has_geospatial_issue AND has_coordinate AND occurrence_status = 'PRESENT' AND year >= 1990
  AND (basis_of_record IS NULL OR basis_of_record NOT IN ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN', 'HUMAN_OBSERVATION', 'PRESERVED_SPECIMEN', 'OBSERVATION'))
  AND taxon_key IN (SELECT s_suppkey FROM supplier)""", "occ"))
def _(spark, sf):
    out = P.occurrence_predicates(load(spark, sf, "occ"), table(spark, sf, "supplier").select("s_suppkey"))
    return out.select(*OCC.split(", "), "year")


@query("coordinate_quality", sql(f"""SELECT {OCC} FROM occ WHERE (coordinateprecision < 0.01 OR coordinateprecision IS NULL)
  AND (coordinateuncertaintyinmeters < 10000 OR coordinateuncertaintyinmeters IS NULL)
  AND (coordinateuncertaintyinmeters IS NULL OR coordinateuncertaintyinmeters NOT IN (301, 3036, 999, 9999))""", "occ"))
def _(spark, sf):
    return P.coordinate_quality(load(spark, sf, "occ")).select(*OCC.split(", "))


@query("nonzero_coordinates", sql("SELECT * FROM places WHERE NOT (lat = 0 AND lon = 0)", "places"))
def _(spark, sf):
    return P.nonzero_coordinates(load(spark, sf, "places"))


@query("dedupe_records", sql("""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lon, lat, specieskey, datasetkey ORDER BY record_id) AS rn FROM places) WHERE rn = 1""", "places"))
def _(spark, sf):
    return S.dedupe_records(load(spark, sf, "places"))


@query("first_per_key", sql("""SELECT species, target, target_x, target_y, score FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY score DESC, target, target_x, target_y) AS rn FROM results) WHERE rn = 1""", "results"))
def _(spark, sf):
    order = [F.desc("score"), "target", "target_x", "target_y"]
    return S.first_per_key(load(spark, sf, "results"), ["species"], order).select("species", "target", "target_x", "target_y", "score")


@query("min_occurrences", sql("""SELECT species, target, score FROM pairs WHERE pair IN (SELECT pair FROM pairs GROUP BY pair HAVING count(*) >= 2)""", "results", ctes="pairs AS (SELECT species, target, score, species || ' ' || CAST(CAST(target_x + target_y AS BIGINT) AS STRING) AS pair FROM results)"))
def _(spark, sf):
    pair = F.concat_ws(" ", "species", (F.col("target_x") + F.col("target_y")).cast("long").cast("string"))
    return S.min_occurrences(load(spark, sf, "results").withColumn("pair", pair), 2, "pair").select("species", "target", "score")


@query("ensemble_mean", sql("""SELECT g.species, g.target, g.score, g.model AS batch, round(m.a, 6) AS avg_score, m.n FROM gappy g
  JOIN (SELECT species, CASE WHEN count(score) = count(*) THEN avg(score) END AS a, count(*) AS n FROM gappy GROUP BY species) m ON g.species IS NOT DISTINCT FROM m.species""", "gappy"))
def _(spark, sf):
    rows = load(spark, sf, "gappy")
    models = {m: rows.filter(F.col("model") == m).select("species", "target", "score") for m in ("F", "O")}
    return r6(S.ensemble_mean(models), "avg_score").select("species", "target", "score", "batch", "avg_score", "n")


@query("top_k_scores", sql("""SELECT species, target_x, target_y, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY species, target_x, target_y ORDER BY score DESC) AS rn FROM results) WHERE rn <= 2""", "results"))
def _(spark, sf):
    return S.top_k_scores(load(spark, sf, "results").select("species", "target_x", "target_y", "score"))


@query("best_score", sql("SELECT species, target_x, target_y, max(score) AS score FROM gappy GROUP BY species, target_x, target_y", "gappy"))
def _(spark, sf):
    return S.best_score(load(spark, sf, "gappy"))


@query("row_ids", sql("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS id FROM orders"))
def _(spark, sf):
    return S.row_ids(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("cell_ids", sql("""SELECT species, target_x, target_y, id FROM results JOIN (SELECT target_x, target_y, row_number() OVER (ORDER BY target_x, target_y) AS id
  FROM (SELECT DISTINCT target_x, target_y FROM results)) USING (target_x, target_y)""", "results"))
def _(spark, sf):
    return S.cell_ids(load(spark, sf, "results").select("species", "target_x", "target_y"))


# ---- scalar functions -------------------------------------------------------------------------


@query("clean_name", sql("""SELECT species, replace(species, '_', ' ') AS spaced, regexp_replace(species, '_', ' ') AS first_spaced,
  replace(preferred, ' ', '_') AS joined FROM (SELECT replace(p_name || ' ' || p_type || ' ' || p_brand, ' ', '_') AS species, p_name || ' ' || p_type AS preferred FROM part)"""))
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr("replace(p_name || ' ' || p_type || ' ' || p_brand, ' ', '_') AS species", "p_name || ' ' || p_type AS preferred")
    return df.select("species", clean_name("species").alias("spaced"), clean_name("species", "first").alias("first_spaced"), clean_name("preferred", to="_").alias("joined"))


@query("clean_headers", sql("SELECT c_name AS species_latin, c_mktsegment AS bilge_water, c_custkey AS qu_1 FROM customer"))
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_name", "c_mktsegment", "c_custkey").toDF("Species.Latin", "Bilge  Water", "Qu.1")
    return clean_headers(df)


@query("promote_header", sql("SELECT s_name AS scientific_name, CAST(s_suppkey AS STRING) AS id FROM supplier"))
def _(spark, sf):
    rows = table(spark, sf, "supplier").selectExpr("s_name AS _c0", "CAST(s_suppkey AS STRING) AS _c1")
    header = rows.selectExpr("'scientific_name'", "'id'").distinct()
    return promote_header(header.union(rows), ["scientific_name", "id"], "scientific_name")


@query("fix_names", sql("SELECT p_partkey, CASE p_name WHEN 'red bolt' THEN 'scarlet bolt' WHEN 'old gear' THEN 'worn gear' ELSE p_name END AS p_name FROM part"))
def _(spark, sf):
    return fix_names(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", {"red bolt": "scarlet bolt", "old gear": "worn gear"})


@query("climate_band", sql("SELECT l_orderkey, l_linenumber, CASE WHEN s <= 1 THEN 'Low' WHEN s <= 2 THEN 'Medium' WHEN s <= 5 THEN 'High' END AS clim_match FROM (SELECT *, l_quantity / 8 AS s FROM lineitem)"))
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", climate_band(F.col("l_quantity") / 8).alias("clim_match"))


@query("yes_flag", sql("SELECT species_latin, CAST(bilge_water = 'Yes' AS INT) AS bilge, CAST(pet_aquarium = 'Yes' AS INT) AS pet FROM intake", "intake"))
def _(spark, sf):
    return load(spark, sf, "intake").select("species_latin", yes_flag("bilge_water").alias("bilge"), yes_flag("pet_aquarium").alias("pet"))


@query("default_zero", sql("SELECT species_latin, coalesce(global_environmental_risk, 0) AS risk FROM risk", "risk"))
def _(spark, sf):
    return load(spark, sf, "risk").select("species_latin", default_zero("global_environmental_risk").alias("risk"))


@query("to_event_date", sql("SELECT event_id, CAST(ts AS DATE) AS date FROM events"))
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", to_event_date("ts").alias("date"))


# ---- sources and sinks ------------------------------------------------------------------------


@query("read_table", sql("SELECT preferred_scientific_name, phylum, size FROM candidates", "candidates"))
def _(spark, sf):
    path = scratch_path(spark, "read_table")
    df = load(spark, sf, "candidates").select(F.col("size").alias("X"), "preferred_scientific_name", "phylum", "size")
    T.write_table(df, path, "csv")
    return T.read_table(spark, path, "preferred_scientific_name string, phylum string, size int", row_numbers=True)


@query("write_table", sql("SELECT species, target, score FROM gappy", "gappy"))
def _(spark, sf):
    path = scratch_path(spark, "write_table")
    T.write_table(load(spark, sf, "gappy").select("species", "target", "score"), path)
    return spark.read.parquet(path)


@query("write_by_species", sql("SELECT record_id, species, lon, lat FROM occ", "occ"))
def _(spark, sf):
    path = scratch_path(spark, "write_by_species")
    T.write_by_species(load(spark, sf, "occ").select("record_id", "species", "lon", "lat"), path)
    return T.read_by_species(spark, path).select("record_id", F.col("species").cast("string").alias("species"), "lon", "lat")


def _tree(spark, sf):
    """One ``Genus_species.csv`` per species, written from the occurrence table."""
    path = scratch_path(spark, "species_tree")
    occ = load(spark, sf, "occ").select("species", "lon", "lat", F.col("species").alias("folder"))
    occ.hint("rebalance", F.col("folder")).write.partitionBy("folder").option("header", "true").csv(path)
    return T.read_species_tree(spark, path, "species string, lon double, lat double")


@query("read_species_tree", sql("SELECT species, lon, lat, species AS folder FROM occ", "occ"))
def _(spark, sf):
    tree = _tree(spark, sf)
    return tree.select("species", "lon", "lat", F.regexp_extract("source_file", "folder=([^/]+)/", 1).alias("folder"))


@query("species_from_path", sql("SELECT record_id, 'genus ' || species AS species FROM (SELECT record_id, replace(species, '_', ' ') AS species FROM occ)", "occ"))
def _(spark, sf):
    paths = load(spark, sf, "occ").select("record_id", F.concat(F.lit("data/doc/genus_"), F.col("species"), F.lit(".csv")).alias("source_file"))
    return T.species_from_path(paths).select("record_id", "species")


_DONE = "value > 480"


@query("pending_species", sql("SELECT record_id, species, lon, lat FROM occ WHERE specieskey NOT IN (SELECT user_id FROM events WHERE value > 480)", "occ"))
def _(spark, sf):
    done = table(spark, sf, "events").filter(_DONE).select(F.concat(F.lit("sp_"), F.col("user_id").cast("string")).alias("species"))
    return T.pending_species(load(spark, sf, "occ"), done).select("record_id", "species", "lon", "lat")


@query("append_climate_scores", sql("""SELECT species, max(score) AS score FROM (SELECT 'sp_' || CAST(user_id AS STRING) AS species, floor(value / 50) AS score FROM events) GROUP BY species"""))
def _(spark, sf):
    path = scratch_path(spark, "score_store")
    records = table(spark, sf, "events").selectExpr("'sp_' || CAST(user_id AS STRING) AS species", "CAST(floor(value / 50) AS DOUBLE) AS score", "event_type")
    score = lambda df: df.groupBy("species").agg(F.max("score").alias("score"))
    # species with a top score are finished first; the second run adds only the rest
    first = records.join(records.filter("score >= 9").select("species").distinct(), "species", "left_semi")
    T.append_climate_scores(first, path, score)
    T.append_climate_scores(records, path, score)
    return T.read_by_species(spark, path).select(F.col("species").cast("string").alias("species"), "score")
