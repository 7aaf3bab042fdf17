"""Queries for name matching."""

from pyspark.sql import functions as F

from biosieve.bindings.base import load, query, r6, sql, table
from biosieve.operators import naming as N
from biosieve.plans.candidates import rejected_names

_NAME = "p_name || ' ' || p_type || ' ' || p_brand"
_BACKBONE = f"backbone AS (SELECT upper(replace({_NAME}, ' ', '_')) AS canonical_name, CASE WHEN min(p_size) > 40 THEN NULL ELSE min(p_partkey) END AS usage_key FROM part GROUP BY 1)"


@query("match_backbone", sql("""SELECT preferred_scientific_name, size, usage_key FROM candidates JOIN backbone ON lower(preferred_scientific_name) = lower(replace(canonical_name, '_', ' '))
  WHERE usage_key IS NOT NULL""", "candidates", ctes=_BACKBONE))
def _(spark, sf):
    backbone = (
        table(spark, sf, "part").selectExpr(f"upper(replace({_NAME}, ' ', '_')) AS canonical_name", "p_partkey", "p_size")
        .groupBy("canonical_name")
        .agg(F.expr("CASE WHEN min(p_size) > 40 THEN NULL ELSE min(p_partkey) END").alias("usage_key"))
    )
    return N.match_backbone(load(spark, sf, "candidates"), backbone, "preferred_scientific_name").select("preferred_scientific_name", "size", "usage_key")


# patterns with a gap, with an end anchor, with alternatives, and a very short one
_PATTERNS = {
    "replace(p_name, ' ', '.+')": "p_size = 7",
    "p_type || ' ' || p_brand || '$'": "p_size = 8",
    "'^(' || p_name || '|none) S'": "p_size = 9",
    "substr(p_name, 1, 2)": "p_size = 10",
}
# regulated names with an authority in brackets, which a name may leave out
_REGULATED = {e: w for e, w in _PATTERNS.items() if "substr" not in e} | {"p_name || ' ' || p_type || '( [(]' || p_brand || '[)])?'": "p_size = 11"}


def _pattern_sql(patterns):
    return "patterns AS (" + " UNION ".join(f"SELECT {e} AS pattern FROM part WHERE {w}" for e, w in patterns.items()) + ")"


_PATTERN_SQL, _REGULATED_SQL = _pattern_sql(_PATTERNS), _pattern_sql(_REGULATED)


def _patterns(spark, sf, patterns=_PATTERNS):
    part = table(spark, sf, "part")
    out = None
    for expr, where in patterns.items():
        piece = part.filter(where).selectExpr(f"{expr} AS pattern")
        out = piece if out is None else out.union(piece)
    return out.distinct()


@query("regex_match", sql("SELECT preferred_scientific_name, size, pattern FROM candidates JOIN patterns ON regexp_matches(preferred_scientific_name, pattern)", "candidates", ctes=_PATTERN_SQL))
def _(spark, sf):
    out = N.regex_match(load(spark, sf, "candidates"), _patterns(spark, sf), "preferred_scientific_name", "pattern")
    return out.select("preferred_scientific_name", "size", "pattern")


@query("literal_match", sql("SELECT preferred_scientific_name, size, scientific_name FROM candidates LEFT JOIN (SELECT DISTINCT p_type || ' ' || p_brand AS scientific_name FROM part WHERE p_size = 8) ON contains(preferred_scientific_name, scientific_name)", "candidates"))
def _(spark, sf):
    lists = table(spark, sf, "part").filter("p_size = 8").selectExpr("p_type || ' ' || p_brand AS scientific_name").distinct()
    out = N.regex_match(load(spark, sf, "candidates"), lists, "preferred_scientific_name", "scientific_name", literal=True, how="left")
    return out.select("preferred_scientific_name", "size", "scientific_name")


@query("remove_regulated", sql("""SELECT preferred_scientific_name, size FROM candidates WHERE NOT EXISTS (SELECT 1 FROM patterns WHERE regexp_matches(preferred_scientific_name, pattern))""", "candidates", ctes=_REGULATED_SQL))
def _(spark, sf):
    return N.remove_regulated(load(spark, sf, "candidates"), _patterns(spark, sf, _REGULATED), "preferred_scientific_name", "pattern").select("preferred_scientific_name", "size")


# every name with one to six letters in a row left out, doubled or replaced
_AT, _N = "CAST(3 + p_partkey % 9 AS INT)", "CAST(1 + p_partkey % 6 AS INT)"
_ODD = f"substr({_NAME}, 1, {_AT}) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN substr('qzxjvk', 1, {_N}) ELSE substr({_NAME}, {_AT}, 2 * {_N}) END || substr({_NAME}, {_AT} + 1 + {_N})"
_KEY = "trim(regexp_replace(lower(replace({c}, '_', ' ')), '\\s+', ' ', 'g'))"
_SCORED = f"""scored AS (SELECT submitted_name, matched_name, 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) AS score
  FROM (SELECT DISTINCT {_ODD} AS submitted_name, {_KEY.format(c=_ODD)} AS a FROM part), (SELECT DISTINCT {_NAME} AS matched_name, {_KEY.format(c=_NAME)} AS b FROM part))"""


def _spelt(spark, sf):
    """Submitted names and the reference list."""
    part = table(spark, sf, "part")
    return part.selectExpr(f"{_ODD} AS submitted_name"), part.selectExpr(f"{_NAME} AS matched_name", "'parts' AS data_source_title")


@query("resolve_names", sql("SELECT submitted_name, matched_name, round(score, 6) AS score, 'parts' AS data_source_title FROM scored WHERE score >= 0.8", ctes=_SCORED))
def _(spark, sf):
    return r6(N.resolve_names(*_spelt(spark, sf)), "score")


@query("rejected_names", sql("""SELECT submitted_name, round(max(score), 6) AS score, count(*) AS n_matches FROM scored WHERE score >= 0.7
  GROUP BY submitted_name HAVING max(score) < 0.8""", ctes=_SCORED))
def _(spark, sf):
    return r6(rejected_names(*_spelt(spark, sf)), "score")
