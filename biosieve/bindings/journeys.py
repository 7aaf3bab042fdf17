"""Queries that run whole chains of operators."""

from pyspark.sql import functions as F

from biosieve.bindings.base import load, query, r6, sql, table
from biosieve.bindings.lists import CLASSES, IN_CLASSES
from biosieve.bindings.maps import _edges, _edges_sql, _inside_sql
from biosieve.functions.projection import EARTH_RADIUS
from biosieve.plans.candidates import candidate_funnel
from biosieve.plans.occurrences import assessable_records, clean_occurrences
from biosieve.plans.risk import risk_overview

_RADIUS = 30000.0
_CLEAN = f"""kept AS (SELECT * FROM occ WHERE NOT has_geospatial_issue AND has_coordinate AND occurrence_status = 'PRESENT' AND year >= 1990
    AND (basis_of_record IS NULL OR basis_of_record NOT IN ('FOSSIL_SPECIMEN', 'LIVING_SPECIMEN', 'HUMAN_OBSERVATION', 'PRESERVED_SPECIMEN', 'OBSERVATION'))
    AND taxon_key IN (SELECT user_id FROM events WHERE value > 300)
    AND (coordinateprecision < 0.01 OR coordinateprecision IS NULL) AND (coordinateuncertaintyinmeters < 10000 OR coordinateuncertaintyinmeters IS NULL)
    AND (coordinateuncertaintyinmeters IS NULL OR coordinateuncertaintyinmeters NOT IN (301, 3036, 999, 9999)) AND NOT (lat = 0 AND lon = 0)),
  single AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lon, lat, specieskey, datasetkey ORDER BY record_id) AS rn FROM kept) WHERE rn = 1
    AND species IN (SELECT 'sp_' || CAST(user_id AS STRING) FROM events WHERE value < 2)),
  {_edges_sql('supplier', 'nation')}, {_inside_sql('single', 'record_id')},
  clean AS (SELECT * FROM single o WHERE record_id IN (SELECT record_id FROM inside) AND NOT EXISTS (SELECT 1 FROM sites s WHERE 2 * {EARTH_RADIUS} * asin(least(1.0, sqrt(
    pow(sin(radians(s.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - o.lon) / 2), 2)))) <= {_RADIUS}))"""


def _clean(spark, sf):
    events = table(spark, sf, "events")
    keys = events.filter("value > 300").select("user_id")
    names = events.filter("value < 2").select(F.concat(F.lit("sp_"), F.col("user_id").cast("string")).alias("species"))
    return clean_occurrences(load(spark, sf, "occ"), keys, names, _edges(spark, sf, "supplier", "nation"), load(spark, sf, "sites"), _RADIUS)


@query("clean_occurrences", sql("SELECT record_id, species AS scientific_name, lon, lat, CAST(eventdate AS DATE) AS date, 'GBIF' AS obs_source FROM clean", "occ", "sites", ctes=_CLEAN))
def _(spark, sf):
    return _clean(spark, sf).select("record_id", "scientific_name", "lon", "lat", "date", "obs_source")


_PART = "p_name || ' ' || p_type || ' ' || p_brand"
_CUT = "substr({c}, 1, CAST(3 + size % 9 AS INT)) || substr({c}, CAST(5 + size % 9 AS INT))"


@query("candidate_funnel", sql(f"""SELECT scientific_name, round(score, 6) AS score FROM (SELECT matched_name AS scientific_name, max(score) AS score FROM
    (SELECT matched_name, 1 - levenshtein(lower(submitted_name), lower(matched_name)) / CAST(greatest(length(submitted_name), length(matched_name)) AS DOUBLE) AS score
     FROM (SELECT DISTINCT {_CUT.format(c='preferred_scientific_name')} AS submitted_name FROM candidates WHERE (class IS NULL OR class NOT IN {IN_CLASSES}) AND invasive_somewhere = 'invasive' AND preferred_scientific_name IS NOT NULL),
          (SELECT DISTINCT {_PART} AS matched_name FROM part)) WHERE score >= 0.8 GROUP BY matched_name)
  WHERE scientific_name NOT IN (SELECT replace(species_latin, '_', ' ') FROM completed)
    AND NOT EXISTS (SELECT 1 FROM part WHERE p_size = 9 AND regexp_matches(scientific_name, '^' || replace(p_name, ' ', '.+') || ' LARGE'))""", "candidates", "completed"))
def _(spark, sf):
    cand = load(spark, sf, "candidates").withColumn("preferred_scientific_name", F.expr(_CUT.format(c="preferred_scientific_name")))
    part = table(spark, sf, "part")
    reference = part.selectExpr(f"{_PART} AS matched_name", "'parts' AS data_source_title")
    patterns = part.filter("p_size = 9").selectExpr("'^' || replace(p_name, ' ', '.+') || ' LARGE' AS scientific_name")
    out = candidate_funnel(cand, reference, load(spark, sf, "completed"), patterns, CLASSES, "parts")
    return r6(out.select("scientific_name", "score"), "score")


@query("risk_listing", sql("""SELECT *, CAST(sum(n) OVER (PARTITION BY already_listed) AS BIGINT) AS total FROM (SELECT CASE WHEN species_latin IN (SELECT scientific_name FROM regulated) THEN 1 ELSE 0 END AS already_listed, taxa, count(*) AS n
  FROM risk WHERE global_environmental_risk BETWEEN 7 AND 12 GROUP BY 1, 2)""", "risk", "regulated"))
def _(spark, sf):
    return risk_overview(load(spark, sf, "risk"), load(spark, sf, "intake"), load(spark, sf, "regulated"))["listing"]


@query("assessable_records", sql("""SELECT species, lon, lat FROM clean WHERE specieskey NOT IN (SELECT specieskey FROM clean JOIN area USING (record_id))
  AND species IN (SELECT species FROM clean GROUP BY species HAVING count(*) >= 2)""", "occ", "sites",
  ctes=_CLEAN + ", area AS (SELECT record_id FROM clean, edges WHERE region = 'n_3' AND lon <= greatest(x1, x2) AND lat BETWEEN least(y1, y2) AND greatest(y1, y2) GROUP BY record_id"
  " HAVING sum(CASE WHEN (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1"
  " OR bool_or((x2 - x1) * (lat - y1) = (lon - x1) * (y2 - y1) AND lon BETWEEN least(x1, x2) AND greatest(x1, x2)))"))
def _(spark, sf):
    area = _edges(spark, sf, "nation").filter("region = 'n_3'")
    # the spaced form of the names is kept in this table, so the underscores change nothing
    return assessable_records(_clean(spark, sf), area)
