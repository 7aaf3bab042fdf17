"""Queries for risk tiers, counts and the numbers behind charts."""

from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.bindings.base import load, query, r6, r6_sql, sql, table
from biosieve.operators import filters as P
from biosieve.operators import lists as L
from biosieve.operators import reshape as R
from biosieve.operators import stats as S

RISK = "species_latin, taxa, qu_1, qu_2, qu_3, qu_4, global_environmental_risk, secondary_assessment"


def _risk(df):
    return df.select(*RISK.split(", "))


@query("high_risk", sql(f"SELECT {RISK} FROM risk WHERE global_environmental_risk BETWEEN 7 AND 12", "risk"))
def _(spark, sf):
    return _risk(P.high_risk(load(spark, sf, "risk")))


@query("highest_risk", sql(f"SELECT {RISK} FROM risk WHERE global_environmental_risk = 12", "risk"))
def _(spark, sf):
    return _risk(P.high_risk(load(spark, sf, "risk"), lo=12, hi=12))


@query("data_deficient", sql(f"SELECT {RISK} FROM risk WHERE qu_1 = 0 OR qu_2 = 0 OR qu_3 = 0 OR qu_4 = 0", "risk"))
def _(spark, sf):
    return _risk(P.data_deficient(load(spark, sf, "risk")))


_SECOND = "('Yes', 'yes', 'uncertain', 'Maybe', 'maybe')"


@query("needs_second_look", sql(f"SELECT {RISK} FROM risk WHERE secondary_assessment IN {_SECOND}", "risk"))
def _(spark, sf):
    return _risk(P.needs_second_look(load(spark, sf, "risk")))


@query("risk_tier", sql(f"""SELECT {RISK} FROM risk WHERE NOT (qu_1 = 0 OR qu_2 = 0 OR qu_3 = 0 OR qu_4 = 0)
  AND coalesce(secondary_assessment NOT IN {_SECOND}, true) AND coalesce(global_environmental_risk NOT BETWEEN 7 AND 12, true)""", "risk"))
def _(spark, sf):
    return _risk(L.risk_tier(load(spark, sf, "risk")))


@query("assessments", sql("""SELECT r.species_latin, r.species_common AS species_common_x, i.species_common AS species_common_y, taxa, global_environmental_risk, pet_aquarium, bilge_water
  FROM risk r LEFT JOIN intake i ON r.species_latin = i.species_latin WHERE global_environmental_risk IS NOT NULL""", "risk", "intake"))
def _(spark, sf):
    out = L.assessments(load(spark, sf, "risk"), load(spark, sf, "intake"))
    return out.select("species_latin", "species_common_x", "species_common_y", "taxa", "global_environmental_risk", "pet_aquarium", "bilge_water")


@query("flag_listed", sql("""SELECT species_latin, taxa, CASE WHEN species_latin IN (SELECT scientific_name FROM regulated) THEN 1 ELSE 0 END AS already_listed FROM risk""", "risk", "regulated"))
def _(spark, sf):
    return L.flag_listed(load(spark, sf, "risk"), load(spark, sf, "regulated"), "species_latin", "scientific_name").select("species_latin", "taxa", "already_listed")


@query("no_vector", sql("SELECT species_latin, pet_aquarium FROM intake WHERE species_latin NOT IN (SELECT species_latin FROM risk WHERE global_environmental_risk > 3)", "risk", "intake"))
def _(spark, sf):
    return L.no_vector(load(spark, sf, "intake"), load(spark, sf, "risk").filter("global_environmental_risk > 3")).select("species_latin", "pet_aquarium")


_VECTOR_SQL = " UNION ALL ".join(
    f"SELECT taxa, '{label}' AS vector, CASE WHEN count({c}) = count(*) THEN CAST(sum(CASE WHEN {c} = 'Yes' THEN 1 WHEN {c} IS NOT NULL THEN 0 END) AS BIGINT) END AS count FROM a GROUP BY taxa"
    for c, label in K.VECTORS.items()
)


@query("vector_counts", sql(_VECTOR_SQL, "risk", "intake", ctes="a AS (SELECT taxa, " + ", ".join(K.VECTORS) + " FROM risk r JOIN intake i ON r.species_latin = i.species_latin)"))
def _(spark, sf):
    joined = load(spark, sf, "risk").select("species_latin", "taxa").join(load(spark, sf, "intake"), "species_latin")
    return S.vector_counts(joined)


_QUESTIONS = ("qu_1", "qu_2", "qu_3", "qu_4")
_Q_UNION = " UNION ALL ".join(f"SELECT species_latin, taxa, '{q}' AS question, {q} AS score FROM risk" for q in _QUESTIONS)


@query("question_counts", sql(f"SELECT question, taxa, score, count(DISTINCT species_latin) AS n FROM ({_Q_UNION}) GROUP BY question, taxa, score", "risk"))
def _(spark, sf):
    return S.question_counts(load(spark, sf, "risk"))


@query("question_scores_long", sql("SELECT species_latin, 'qu_1' AS question, qu_1 AS score FROM risk UNION ALL SELECT species_latin, 'qu_2', qu_2 FROM risk", "risk"))
def _(spark, sf):
    return R.question_scores_long(load(spark, sf, "risk"), ["qu_1", "qu_2"])


@query("category_counts", sql("SELECT *, CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS total FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)"))
def _(spark, sf):
    return S.category_counts(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


@query("order_by_frequency", sql("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name"))
def _(spark, sf):
    return S.order_by_frequency(table(spark, sf, "part"), "p_name")


@query("n_scenarios", sql("SELECT species, count(*) AS n_climates FROM (SELECT DISTINCT species, climate FROM results) GROUP BY species", "results"))
def _(spark, sf):
    return S.n_scenarios(L.distinct_rows(load(spark, sf, "results"), ["species", "climate"]))


@query("duplicate_count", sql("SELECT count(*) - count(DISTINCT species) - CAST(count(*) > count(species) AS INT) AS n_duplicates FROM gappy", "gappy"))
def _(spark, sf):
    return S.duplicate_count(load(spark, sf, "gappy"), "species")


@query("species_count", sql("SELECT count(DISTINCT species) + CAST(count(*) > count(species) AS INT) AS n_species FROM gappy", "gappy"))
def _(spark, sf):
    return S.species_count(load(spark, sf, "gappy"))


@query("species_per_cell", sql("""SELECT target_x, target_y, nullif(count(DISTINCT CASE WHEN score > 0 THEN species END) + coalesce(max(CASE WHEN score > 0 AND species IS NULL THEN 1 ELSE 0 END), 0), 0) AS n_species
  FROM gappy GROUP BY target_x, target_y""", "gappy"))
def _(spark, sf):
    return S.species_per_cell(load(spark, sf, "gappy"))


def _box_sql(source, group, value):
    return f"""SELECT {group}, CAST(count(*) AS BIGINT) AS n, min(CASE WHEN ok THEN v END) AS lower_whisker, any_value(a) AS q1, any_value(b) AS median, any_value(c) AS q3,
      max(CASE WHEN ok THEN v END) AS upper_whisker, count(CASE WHEN NOT ok THEN 1 END) AS n_outliers
      FROM (SELECT *, v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) AS ok FROM
        (SELECT {group}, CAST({value} AS DOUBLE) AS v FROM {source} WHERE {value} IS NOT NULL)
        JOIN (SELECT {group}, quantile_cont(CAST({value} AS DOUBLE), 0.25) AS a, quantile_cont(CAST({value} AS DOUBLE), 0.5) AS b, quantile_cont(CAST({value} AS DOUBLE), 0.75) AS c
              FROM {source} WHERE {value} IS NOT NULL GROUP BY {group}) USING ({group})) GROUP BY {group}"""


@query("five_number", sql(_box_sql("risk", "taxa", "global_environmental_risk"), "risk"))
def _(spark, sf):
    return S.five_number(load(spark, sf, "risk"), ["taxa"], "global_environmental_risk")


_BOX = ("n", "lower_whisker", "q1", "median", "q3", "upper_whisker", "n_outliers")
_BOX_R6 = r6_sql("lower_whisker", "q1", "median", "q3", "upper_whisker")


@query("five_number_many_values", sql(f"SELECT o_orderpriority, n, n_outliers, {_BOX_R6} FROM ({_box_sql('priced', 'o_orderpriority', 'v2')})", ctes="priced AS (SELECT o_orderpriority, o_totalprice * o_totalprice AS v2 FROM orders)"))
def _(spark, sf):
    priced = table(spark, sf, "orders").select("o_orderpriority", (F.col("o_totalprice") * F.col("o_totalprice")).alias("v2"))
    return r6(S.five_number(priced, ["o_orderpriority"], "v2"), "lower_whisker", "q1", "median", "q3", "upper_whisker")


@query("box_outliers", sql("""SELECT o_orderpriority, v AS value, count(*) AS n FROM (SELECT o_orderpriority, pow(o_totalprice, 3) AS v FROM orders)
  JOIN (SELECT o_orderpriority, quantile_cont(pow(o_totalprice, 3), 0.25) AS a, quantile_cont(pow(o_totalprice, 3), 0.75) AS c FROM orders GROUP BY ALL) USING (o_orderpriority)
  WHERE NOT v BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a) GROUP BY o_orderpriority, v""".replace("pow(o_totalprice, 3)", "o_totalprice * o_totalprice * o_totalprice")))
def _(spark, sf):
    p = F.col("o_totalprice")
    return S.box_outliers(table(spark, sf, "orders").select("o_orderpriority", (p * p * p).alias("v")), ["o_orderpriority"], "v")


@query("column_summary", sql(f"""SELECT {r6_sql('min', 'q1', 'median', 'mean', 'q3', 'max')}, n_missing FROM (SELECT min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, avg(v) AS mean,
  quantile_cont(v, 0.75) AS q3, max(v) AS max, count(*) - count(v) AS n_missing FROM d)""", ctes="d AS (SELECT CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS v FROM lineitem)"))
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice * (1 - l_discount) END AS v")
    return r6(S.column_summary(df, "v"), "min", "q1", "median", "mean", "q3", "max")


@query("histogram", sql("""SELECT CAST(k AS DOUBLE) AS bin, count(r) AS count FROM (SELECT unnest(range((SELECT min(b) FROM h), (SELECT max(b) FROM h) + 1)) AS k) LEFT JOIN (SELECT b, 1 AS r FROM h) ON b = k GROUP BY k""",
  "risk", ctes="h AS (SELECT CAST(ceil(global_environmental_risk - 0.5) AS BIGINT) AS b FROM risk WHERE global_environmental_risk IS NOT NULL)"))
def _(spark, sf):
    return S.histogram(load(spark, sf, "risk"), "global_environmental_risk")


@query("density", sql("""SELECT question, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - v) / bw, 2))) / sqrt(2 * pi()) / (any_value(n) * any_value(bw)), 6) + 0.0 AS density
  FROM (SELECT question, CAST(score AS DOUBLE) AS v FROM q)
  JOIN (SELECT question, count(*) AS n, 0.9 * least(stddev_samp(score), (quantile_cont(CAST(score AS DOUBLE), 0.75) - quantile_cont(CAST(score AS DOUBLE), 0.25)) / 1.34) * pow(count(*), -0.2) AS bw FROM q GROUP BY question) USING (question)
  CROSS JOIN (SELECT lo + i * (hi - lo) / 511 AS x FROM (SELECT CAST(min(score) AS DOUBLE) AS lo, CAST(max(score) AS DOUBLE) AS hi FROM q), (SELECT unnest(range(512)) AS i))
  GROUP BY question, x""", "risk", ctes="q AS (SELECT 'qu_1' AS question, qu_1 AS score FROM risk UNION ALL SELECT 'qu_2', qu_2 FROM risk)"))
def _(spark, sf):
    long = R.question_scores_long(load(spark, sf, "risk"), ["qu_1", "qu_2"])
    return r6(S.density(long, "score", ["question"]), "x", "density")


_RATERS = ("a1", "a2", "a3", "a4")
_RATED = "rated AS (SELECT CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS a1, l_discount AS a2, l_tax AS a3, l_linenumber + l_quantity AS a4 FROM lineitem)"
_PAIRS = [(x, y) for i, x in enumerate(_RATERS) for y in _RATERS[i + 1 :]]


@query("pairwise_fit", sql(" UNION ALL ".join(
    f"SELECT '{x}' AS rater_x, '{y}' AS rater_y, CAST(regr_count({y}, {x}) AS BIGINT) AS n, round(regr_slope({y}, {x}), 6) + 0.0 AS slope, round(regr_intercept({y}, {x}), 6) + 0.0 AS intercept FROM rated"
    for x, y in _PAIRS), ctes=_RATED))
def _(spark, sf):
    rated = table(spark, sf, "lineitem").selectExpr("CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS a1", "l_discount AS a2", "l_tax AS a3", "l_linenumber + l_quantity AS a4")
    return r6(S.pairwise_fit(rated, _RATERS), "slope", "intercept")


@query("extent", sql("SELECT min(lon) AS xmin, max(lon) AS xmax, min(lat) AS ymin, max(lat) AS ymax FROM occ", "occ"))
def _(spark, sf):
    return S.extent(load(spark, sf, "occ"))


_CHANGE = """current AS (SELECT species, target, target_x, target_y, max(score) AS score FROM region_cells WHERE model = 'F' GROUP BY ALL),
  future AS (SELECT species, target, target_x, target_y, max(score) AS score FROM region_cells WHERE model = 'O' GROUP BY ALL),
  change AS (SELECT species, target_x, target_y, coalesce(c.target, f.target) AS target, c.score AS score_current, f.score AS score_future, f.score - c.score AS diff
    FROM current c FULL JOIN future f USING (species, target_x, target_y))"""


def _change(spark, sf):
    from biosieve.operators.matching import scenario_change

    res = load(spark, sf, "region_cells")
    key = ("species", "target", "target_x", "target_y")
    return scenario_change(*[S.best_score(res.filter(F.col("model") == m), key) for m in ("F", "O")])


@query("scenario_change", sql("SELECT * FROM change", "region_cells", ctes=_CHANGE))
def _(spark, sf):
    return _change(spark, sf)


@query("scores_long", sql("""SELECT target, CAST(CAST(target_x AS BIGINT) AS STRING) || ' ' || CAST(CAST(target_y AS BIGINT) AS STRING) AS cell, 'current' AS scenario, score_current AS score FROM change
  UNION ALL SELECT target, CAST(CAST(target_x AS BIGINT) AS STRING) || ' ' || CAST(CAST(target_y AS BIGINT) AS STRING), 'future', score_future FROM change""", "region_cells", ctes=_CHANGE))
def _(spark, sf):
    whole = _change(spark, sf).withColumn("target_x", F.col("target_x").cast("long")).withColumn("target_y", F.col("target_y").cast("long"))
    return R.scores_long(whole)
