"""The queries of this subpackage, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biosieve.llm.class_lm import class_scores
from biosieve.llm.decontaminate import benchmark_hits
from biosieve.llm.importance import resample
from biosieve.llm.licenses import license_scan
from biosieve.llm.line_dedup import dedup_lines, kept_digest
from biosieve.llm.mixing import mixing_weights
from biosieve.llm.near_dup import near_duplicates
from biosieve.llm.neighbours import nearest
from biosieve.llm.pii import personal_data, span_digest
from biosieve.llm.quality import quality_scores
from biosieve.llm.token_output import encode_corpus
from biosieve.llm.toxicity import toxicity_scores
from biosieve.llm.vector_codes import compress

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines
), owners AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS lost FROM keyed k LEFT JOIN owners o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_projected_neighbours")
def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("vec_id") % 20 == 0)


@query("op2_line_runs", _LINES_SQL)
def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(dedup_lines(table(spark, sf_dir, "documents")))


@query("op3_rare_token_licenses")
def op3_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


@query("op4_kneser_ney_quality")
def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_tensored_minhash")
def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query("op6_pigeonhole_benchmark")
def op6_pigeonhole_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_raked_mix")
def op7_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_weights(table(spark, sf_dir, "documents"))


@query("op8_elias_fano_tokens")
def op8_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


@query("op9_class_bigrams")
def op9_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"))


@query("op10_disclosure_spans")
def op10_disclosure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(personal_data(table(spark, sf_dir, "documents")))


@query("op11_clause_grammar")
def op11_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_overlapped_resampling")
def op12_overlapped_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _nearest_sql(turn: int) -> str:
    """Nearest entry of each part: distance first, then the lower index."""
    square = "(" + " + ".join(f"(v.w[{i}] - c.w[{i}]) * (v.w[{i}] - c.w[{i}])" for i in range(1, 5)) + ")"
    return f"""a{turn} AS (SELECT vec_id, p, min(64 * {square} + e) % 64 AS e, min({square}) AS d FROM parts v JOIN c{turn} c USING (p) GROUP BY vec_id, p)"""


def _means_sql(turn: int) -> str:
    """Entries moved to the means of their parts, rounded down."""
    return f"""m{turn} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w
  FROM (SELECT p, a.e, i, CAST(sum(w[i]) AS BIGINT) AS s, count(*) AS n FROM parts JOIN a{turn} a USING (vec_id, p), range(1, 5) r(i) GROUP BY p, a.e, i) GROUP BY p, e
), c{turn + 1} AS (SELECT c.p, c.e, coalesce(m.w, c.w) AS w FROM c{turn} c LEFT JOIN m{turn} m USING (p, e))"""


_CODES_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS (SELECT vec_id, p, v[4 * p + 1 : 4 * p + 4] AS w FROM kept, range(16) r(p)),
c0 AS (SELECT p, e, w FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 64),
{_nearest_sql(0)}, {_means_sql(0)}, {_nearest_sql(1)}, {_means_sql(1)}, {_nearest_sql(2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(CAST(w[i] AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM c2, range(1, 5) r(i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book
"""


@query("op13_equal_average_codes", _CODES_SQL)
def op13_equal_average_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))
