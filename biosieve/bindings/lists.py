"""Queries for filters, list algebra, set operations and reshaping."""

from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.bindings.base import load, query, r6, r6_sql, sql
from biosieve.operators import filters as P
from biosieve.operators import lists as L
from biosieve.operators import reshape as R

# stand-ins for the class vocabulary in the given tables
CLASSES = ("Brand#1", "Brand#2", "Brand#3", "Brand#11", "Brand#12")
IN_CLASSES = "(" + ", ".join(f"'{c}'" for c in CLASSES) + ")"
PHYLA = ("ECONOMY", "STANDARD", "LARGE", "PROMO", "SMALL", "MEDIUM")
CAND = "preferred_scientific_name, organism_type, phylum, class, invasive_somewhere, size"


def _cand(df):
    return df.select(*CAND.split(", "))


@query("project", sql("SELECT preferred_scientific_name AS scientific_name, phylum, size AS n_size FROM candidates", "candidates"))
def _(spark, sf):
    return P.project(load(spark, sf, "candidates"), ["preferred_scientific_name", "phylum", "class", "size"],
                     {"preferred_scientific_name": "scientific_name", "size": "n_size"}, ["class"])


@query("exclude_classes", sql(f"SELECT {CAND} FROM candidates WHERE class IS NULL OR class NOT IN {IN_CLASSES}", "candidates"))
def _(spark, sf):
    return _cand(P.exclude_classes(load(spark, sf, "candidates"), classes=CLASSES))


@query("only_classes", sql(f"SELECT {CAND} FROM candidates WHERE class IN {IN_CLASSES}", "candidates"))
def _(spark, sf):
    return _cand(P.only_classes(load(spark, sf, "candidates"), classes=CLASSES))


@query("invasive_history", sql(f"SELECT {CAND} FROM candidates WHERE invasive_somewhere = 'invasive'", "candidates"))
def _(spark, sf):
    return _cand(P.invasive_history(load(spark, sf, "candidates")))


@query("named_only", sql(f"SELECT {CAND} FROM candidates WHERE preferred_scientific_name IS NOT NULL AND preferred_scientific_name <> 'NA'", "candidates"))
def _(spark, sf):
    return _cand(P.named_only(load(spark, sf, "candidates"), "preferred_scientific_name"))


def _resolved(spark, sf):
    return load(spark, sf, "candidates").select(
        F.col("preferred_scientific_name").alias("submitted_name"),
        (F.col("size") / 50).alias("score"),
        F.when(F.col("phylum") == "LARGE", "other").otherwise(K.NAME_SOURCE).alias("data_source_title"),
    )


_RESOLVED = f"""resolved AS (SELECT preferred_scientific_name AS submitted_name, CAST(size AS DOUBLE) / 50 AS score,
  CASE WHEN phylum = 'LARGE' THEN 'other' ELSE '{K.NAME_SOURCE}' END AS data_source_title FROM candidates)"""


@query("confident_names", sql(f"SELECT * FROM resolved WHERE data_source_title = '{K.NAME_SOURCE}' AND score >= 0.8", "candidates", ctes=_RESOLVED))
def _(spark, sf):
    return P.confident_names(_resolved(spark, sf))


@query("confused_names", sql("SELECT * FROM resolved WHERE score <= 0.8", "candidates", ctes=_RESOLVED))
def _(spark, sf):
    return P.confident_names(_resolved(spark, sf), confused=True)


@query("score_filter", sql("SELECT species, target, target_x, target_y, score FROM results WHERE target IN ('A', 'R') AND score <> 0", "results"))
def _(spark, sf):
    return P.score_filter(load(spark, sf, "results"), ["A", "R"]).select("species", "target", "target_x", "target_y", "score")


@query("habitat_filter", sql("""SELECT preferred_scientific_name, habitat FROM candidates
  WHERE habitat IN ('["freshwater"]', '["freshwater","brackish","marine"]', '["terrestrial","freshwater"]')""", "candidates"))
def _(spark, sf):
    return P.habitat_filter(load(spark, sf, "candidates"), "habitat", K.FRESHWATER_JSON_HABITATS).select("preferred_scientific_name", "habitat")


@query("screened_species", sql("SELECT * FROM sheet_b WHERE native = 'N' AND established = 'N' AND aquatic = 'Y' AND climate_mismatch = 'N'", "sheet_b"))
def _(spark, sf):
    return P.screened_species(load(spark, sf, "sheet_b"))


_FLAGGED = """SELECT DISTINCT species FROM (SELECT species, {f} AS f FROM sheet_a UNION ALL SELECT species, {f} FROM sheet_b) WHERE f IN ({v})"""


def _flagged(spark, sf, flag, values):
    return P.flagged_species([load(spark, sf, "sheet_a"), load(spark, sf, "sheet_b")], flag, values)


@query("flagged_species", sql(_FLAGGED.format(f="aquatic", v="'N', 'DD'"), "sheet_a", "sheet_b"))
def _(spark, sf):
    return _flagged(spark, sf, "aquatic", ["N", "DD"])


@query("species_of_interest", sql(f"SELECT {CAND} FROM candidates WHERE EXISTS (SELECT 1 FROM listed WHERE scientific_name IS NOT DISTINCT FROM preferred_scientific_name)", "candidates", "listed"))
def _(spark, sf):
    return _cand(P.species_of_interest(load(spark, sf, "candidates"), load(spark, sf, "listed"), "preferred_scientific_name"))


TARGETS = ("A", "N", "R")
_MATRIX = """matrix AS (SELECT species, climate,
  max(CASE WHEN target = 'A' THEN 'Y' END) AS A, max(CASE WHEN target = 'N' THEN 'Y' END) AS N, max(CASE WHEN target = 'R' THEN 'Y' END) AS R
  FROM results WHERE score <> 0 GROUP BY species, climate)"""


def _matrix(spark, sf):
    hits = P.score_filter(load(spark, sf, "results")).select("species", "target", "climate")
    return R.presence_matrix(L.distinct_rows(hits, ["species", "target", "climate"]), TARGETS)


@query("presence_matrix", sql("SELECT * FROM matrix", "results", ctes=_MATRIX))
def _(spark, sf):
    return _matrix(spark, sf)


@query("presence_list", sql("SELECT DISTINCT species FROM matrix WHERE N = 'Y'", "results", ctes=_MATRIX))
def _(spark, sf):
    return P.presence_list(_matrix(spark, sf), "N")


@query("scenario_rows", sql("SELECT DISTINCT species, climate FROM matrix WHERE climate = '1981-2010'", "results", ctes=_MATRIX))
def _(spark, sf):
    return P.scenario_rows(_matrix(spark, sf), K.BASELINE_SCENARIO, TARGETS)


@query("anti_names", sql(f"""SELECT {CAND} FROM candidates WHERE NOT EXISTS (SELECT 1 FROM completed
  WHERE replace(species_latin, '_', ' ') IS NOT DISTINCT FROM preferred_scientific_name)""", "candidates", "completed"))
def _(spark, sf):
    return _cand(L.anti_names(load(spark, sf, "candidates"), load(spark, sf, "completed"), "preferred_scientific_name", "species_latin", normalise=True))


@query("exclude_cascade", sql(f"""SELECT {CAND} FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM completed WHERE replace(species_latin, '_', ' ') = c.preferred_scientific_name)
  AND NOT EXISTS (SELECT 1 FROM listed WHERE scientific_name = c.preferred_scientific_name)
  AND NOT EXISTS (SELECT 1 FROM sheet_a WHERE aquatic = 'N' AND replace(species, '_', ' ') = c.preferred_scientific_name)""", "candidates", "completed", "listed", "sheet_a"))
def _(spark, sf):
    sheet = load(spark, sf, "sheet_a")
    others = [(load(spark, sf, "completed"), "species_latin"), (load(spark, sf, "listed"), "scientific_name"), (sheet.filter("aquatic = 'N'"), "species")]
    return _cand(L.exclude_cascade(load(spark, sf, "candidates"), others, "preferred_scientific_name", normalise=True))


@query("merge_lists", sql("""SELECT preferred_scientific_name, phylum, size FROM candidates WHERE preferred_scientific_name IS NOT NULL AND preferred_scientific_name <> 'NA'
  UNION ALL SELECT scientific_name, NULL, NULL FROM renamed WHERE NOT EXISTS (SELECT 1 FROM candidates WHERE preferred_scientific_name = scientific_name)""",
  "candidates", "listed", ctes="renamed AS (SELECT upper(scientific_name) AS scientific_name FROM listed)"))
def _(spark, sf):
    renamed = load(spark, sf, "listed").select(F.upper("scientific_name").alias("scientific_name"))
    cand = load(spark, sf, "candidates").select("preferred_scientific_name", "phylum", "size")
    return L.merge_lists(cand, renamed, "preferred_scientific_name", "scientific_name")


@query("species_in_both", sql("SELECT * FROM matrix m WHERE climate = '1981-2010' AND EXISTS (SELECT 1 FROM matrix f WHERE f.climate = '2011-2040' AND f.species = m.species)", "results", ctes=_MATRIX))
def _(spark, sf):
    m = _matrix(spark, sf)
    return L.species_in_both(m.filter(F.col("climate") == K.BASELINE_SCENARIO), m.filter(F.col("climate") == K.FUTURE_SCENARIO))


@query("stack", sql("""SELECT species, aquatic, NULL AS climate_mismatch, 'first' AS batch FROM sheet_a
  UNION ALL SELECT species, aquatic, climate_mismatch, 'second' FROM sheet_b""", "sheet_a", "sheet_b"))
def _(spark, sf):
    a, b = load(spark, sf, "sheet_a").select("species", "aquatic"), load(spark, sf, "sheet_b").select("species", "aquatic", "climate_mismatch")
    return L.stack({"first": a, "second": b}, missing=True)


@query("distinct_rows", sql("SELECT DISTINCT species, target, climate FROM results", "results"))
def _(spark, sf):
    return L.distinct_rows(load(spark, sf, "results"), ["species", "target", "climate"])


# species that occur in a few rows each, so that scenarios and regions differ in their species
_SCEN = "scen AS (SELECT DISTINCT species, climate FROM rare_results WHERE score <> 0)"


def _scen(spark, sf):
    return load(spark, sf, "rare_results").filter("score <> 0").select("species", "climate").distinct()


_RARE_REJECTED = "rejected AS (SELECT DISTINCT species FROM rare_results WHERE target = 'N' AND score = 0)"


def _rare_rejected(spark, sf):
    return load(spark, sf, "rare_results").filter("target = 'N' AND score = 0").select("species").distinct()


_REJECTED = "rejected AS (SELECT DISTINCT species FROM results WHERE target = 'N' AND score = 0 AND model = 'O')"


def _rejected(spark, sf):
    return load(spark, sf, "results").filter("target = 'N' AND score = 0 AND model = 'O'").select("species").distinct()


@query("scenario_partition", sql("""SELECT species, CASE WHEN count(*) = 2 THEN 'both' WHEN min(climate) = '1981-2010' THEN 'baseline' ELSE 'future' END AS scenario
  FROM scen WHERE species NOT IN (SELECT species FROM rejected) GROUP BY species""", "rare_results", ctes=f"{_SCEN}, {_RARE_REJECTED}"))
def _(spark, sf):
    return L.scenario_partition(_scen(spark, sf), _rare_rejected(spark, sf))


def _hist_future(spark, sf):
    res = load(spark, sf, "rare_results")
    return res.filter("model = 'F'"), res.filter("model = 'O'")


def _region_list(spark, sf, regions):
    hist, future = _hist_future(spark, sf)
    return L.region_species_list(hist, future, regions)


def _region_sql(*regions):
    listed = ", ".join(f"'{r}'" for r in regions)
    return f"SELECT DISTINCT species FROM rare_results WHERE target IN ({listed}) AND score <> 0"


@query("region_species_list", sql(_region_sql("A", "R"), "rare_results"))
def _(spark, sf):
    return _region_list(spark, sf, ["A", "R"])


@query("region_gap", sql(f"{_region_sql('A')} EXCEPT {_region_sql('R')}", "rare_results"))
def _(spark, sf):
    return L.region_gap(_region_list(spark, sf, ["A"]), _region_list(spark, sf, ["R"]))


@query("watchlist_coverage", sql("""SELECT name, min(list) AS list FROM (SELECT preferred_scientific_name AS name, 'ours' AS list FROM candidates
  UNION ALL SELECT scientific_name, 'listed' FROM listed UNION ALL SELECT species_latin, 'completed' FROM completed) GROUP BY name HAVING count(DISTINCT list) = 1""", "candidates", "listed", "completed"))
def _(spark, sf):
    return L.watchlist_coverage({
        "ours": (load(spark, sf, "candidates"), "preferred_scientific_name"),
        "listed": (load(spark, sf, "listed"), "scientific_name"),
        "completed": (load(spark, sf, "completed"), "species_latin"),
    })


_COMPARE = """summary AS (SELECT species, avg(score) AS avg_score, climate AS batch FROM results WHERE score <> 0 GROUP BY species, climate)"""
_BAND = "CASE WHEN avg_score <= 1 THEN 'Low' WHEN avg_score <= 2 THEN 'Medium' WHEN avg_score <= 5 THEN 'High' END"


def _summary(spark, sf):
    res = load(spark, sf, "results")
    return L.scenario_summary({c: res.filter(F.col("climate") == c) for c in (K.BASELINE_SCENARIO, K.FUTURE_SCENARIO)})


@query("scenario_summary", sql(f"SELECT species, round(avg_score, 6) AS avg_score, {_BAND} AS clim_match, batch FROM summary", "results", ctes=_COMPARE))
def _(spark, sf):
    return r6(_summary(spark, sf), "avg_score")


@query("to_screen", sql(f"SELECT species, {_BAND} AS clim_match, batch FROM summary WHERE batch = '2011-2040' AND species NOT IN (SELECT species FROM rejected)", "results", ctes=f"{_COMPARE}, {_REJECTED}"))
def _(spark, sf):
    return L.to_screen(_summary(spark, sf), _rejected(spark, sf), K.FUTURE_SCENARIO).drop("avg_score")


@query("region_matrix", sql(f"""SELECT species, max(CASE WHEN region = 'A' THEN 1.0::DOUBLE END) AS A, max(CASE WHEN region = 'N' THEN 1.0::DOUBLE END) AS N, max(CASE WHEN region = 'R' THEN 1.0::DOUBLE END) AS R
  FROM ({" UNION ALL ".join(f"SELECT species, '{t}' AS region FROM ({_region_sql(t)})" for t in TARGETS)}) WHERE species NOT IN (SELECT species FROM rejected) GROUP BY species""", "rare_results", ctes=_RARE_REJECTED))
def _(spark, sf):
    return R.region_matrix({t: _region_list(spark, sf, [t]) for t in TARGETS}, [(_rare_rejected(spark, sf), "species")])


_REASONS = (
    ("Assessed", ["SELECT replace(species_latin, '_', ' ') FROM completed"], True),
    ("Mandate Mismatch", [f"SELECT preferred_scientific_name FROM candidates WHERE class IN {IN_CLASSES}", "SELECT replace(species, '_', ' ') FROM sheet_a WHERE aquatic = 'N'"], True),
    ("No Invasion History", ["SELECT preferred_scientific_name FROM candidates WHERE invasive_somewhere <> 'invasive' AND phylum = 'PROMO'"], True),
    ("Naming Confusion", ["SELECT preferred_scientific_name FROM candidates WHERE size = 30"], True),
    ("Lack of Geospatial Data", ["SELECT species FROM mapped"], False),
    ("Indigenous to Area", ["SELECT replace(species, '_', ' ') FROM sheet_b WHERE native = 'Y'"], True),
    ("Present in Area", ["SELECT replace(species, '_', ' ') FROM sheet_b WHERE established IN ('Y', 'DD')"], True),
    ("No Vector", ["SELECT scientific_name FROM listed"], True),
    ("Climate Mismatch", ["SELECT replace(species, '_', ' ') FROM sheet_b WHERE aquatic <> 'DD'"], False),
    ("Climate Mismatch", ["SELECT replace(species, '_', ' ') FROM sheet_b WHERE climate_mismatch = 'Y'"], True),
)
_REASON_SQL = "CASE " + " ".join(
    f"WHEN {'' if listed else 'NOT '}coalesce({' OR '.join(f'preferred_scientific_name IN ({s})' for s in sets)}, false) THEN '{label}'"
    for label, sets, listed in _REASONS
) + " END"
# names without text are dropped first: SQL membership of NULL differs from list membership
_CLASSIFIED = f"classified AS (SELECT preferred_scientific_name, phylum, class, size, {_REASON_SQL} AS category FROM candidates WHERE preferred_scientific_name IS NOT NULL)"
_CLASS_FRAMES = ("candidates", "completed", "sheet_a", "sheet_b", "mapped", "listed")


def _classified(spark, sf):
    cand = P.named_only(load(spark, sf, "candidates"), "preferred_scientific_name").select("preferred_scientific_name", "phylum", "class", "size", "invasive_somewhere")
    a, b = load(spark, sf, "sheet_a"), load(spark, sf, "sheet_b")
    name = "preferred_scientific_name"
    rules = [
        ("Assessed", [(load(spark, sf, "completed"), "species_latin")], True),
        ("Mandate Mismatch", [(P.only_classes(cand, classes=CLASSES), name), (a.filter("aquatic = 'N'"), "species")], True),
        ("No Invasion History", [(cand.filter("invasive_somewhere <> 'invasive' AND phylum = 'PROMO'"), name)], True),
        ("Naming Confusion", [(cand.filter("size = 30"), name)], True),
        ("Lack of Geospatial Data", [(load(spark, sf, "mapped"), "species")], False),
        ("Indigenous to Area", [(b.filter("native = 'Y'"), "species")], True),
        ("Present in Area", [(b.filter("established IN ('Y', 'DD')"), "species")], True),
        ("No Vector", [(load(spark, sf, "listed"), "scientific_name")], True),
        ("Climate Mismatch", [(b.filter("aquatic <> 'DD'"), "species")], False),
        ("Climate Mismatch", [(b.filter("climate_mismatch = 'Y'"), "species")], True),
    ]
    return L.classify_exclusion(cand, rules, name).drop("invasive_somewhere")


@query("classify_exclusion", sql("SELECT * FROM classified", *_CLASS_FRAMES, ctes=_CLASSIFIED))
def _(spark, sf):
    return _classified(spark, sf)


@query("exclusion_table", sql("SELECT category, " + ", ".join(f"nullif(count(DISTINCT CASE WHEN phylum = '{p}' THEN preferred_scientific_name END), 0) AS {p}" for p in PHYLA) + " FROM classified GROUP BY category", *_CLASS_FRAMES, ctes=_CLASSIFIED))
def _(spark, sf):
    from biosieve.operators.stats import exclusion_table

    return exclusion_table(_classified(spark, sf), PHYLA)
