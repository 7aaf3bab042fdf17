"""Exact quantiles, box plots, densities, ids against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from biosieve.operators import stats as S
from biosieve.operators.quantiles import exact_quantiles, quantiles_of_counts, value_counts
from tests.conftest import rows

PROBS = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def _frame(spark, groups):
    data = [(g, float(v)) for g, values in groups.items() for v in values]
    return spark.createDataFrame(data, "g string, v double")


@pytest.mark.parametrize("buckets", [2, 7, 2048])
def test_quantiles_match_numpy(spark, buckets):
    rng = np.random.default_rng(5)
    groups = {
        "normal": rng.normal(size=500),
        "one": [3.5],
        "two": [1.0, 2.0],
        "constant": [4.0] * 50,
        "outlier": np.concatenate([rng.uniform(0, 1e-6, 300), [1e12, -1e12]]),
        "copies": np.concatenate([[5.0] * 400, rng.uniform(0, 10, 200)]),
        None: rng.integers(0, 5, 99),
    }
    df = _frame(spark, groups).union(spark.createDataFrame([("normal", None), ("void", None), ("one", float("nan"))], "g string, v double"))
    got = {r["_g"]["g"]: [r[f"q{i}"] for i in range(len(PROBS))] for r in quantiles_of_counts(value_counts(df, "v", ["g"]), PROBS, buckets=buckets).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12, abs=1e-12)


def test_quantiles_equal_plain_percentiles(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    plain = df.groupBy("g").agg(*[F.percentile("v", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(PROBS)])
    assert rows(exact_quantiles(df, "v", PROBS, ["g"])) == rows(plain)


def test_best_score_keeps_payload(spark):
    df = spark.createDataFrame([("a", "r", 1.0, 2.0, s, f"m{s}") for s in range(3)], "species string, target string, target_x double, target_y double, score int, model string")
    best = S.top_k_scores(df, 1, ["species", "target_x", "target_y"])
    assert rows(best.select("score", "model", "rank")) == [(2, "m2", 1)] and set(best.columns) == {*df.columns, "rank"}


def test_box_plot(spark):
    df = _frame(spark, {"a": [1, 2, 3, 4, 100, -50]})
    box = S.five_number(df, ["g"], "v").first()
    assert (box["n"], box["lower_whisker"], box["upper_whisker"], box["n_outliers"]) == (6, 1.0, 4.0, 2)
    assert rows(S.box_outliers(df, ["g"], "v")) == [("a", -50.0, 1), ("a", 100.0, 1)]
    assert S.five_number(df, ["g"], "v", limits=(0, 10)).first()["n"] == 4


def test_summary_counts_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert tuple(S.column_summary(df, "v").first()) == (1.0, 1.75, 2.5, 2.5, 3.25, 4.0, 1)


def test_histogram_fills_gaps_and_closes_right(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (3.0,), (None,)], "v double")
    assert rows(S.histogram(df, "v")) == [(0.0, 1), (1.0, 1), (2.0, 0), (3.0, 1)]


def test_density_integrates_and_handles_constants(spark):
    rng = np.random.default_rng(2)
    values = rng.normal(size=300)
    df = _frame(spark, {"n": values, "c": [0.25] * 5, "single": [0.1]})
    out = S.density(df, "v", ["g"]).toPandas()
    assert set(out["g"]) == {"n", "c"}
    normal = out[out["g"] == "n"].sort_values("x")
    q1, q3 = np.quantile(values, [0.25, 0.75])
    bw = 0.9 * min(values.std(ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2
    want = np.exp(-0.5 * ((normal["x"].values[:, None] - values) / bw) ** 2).sum(1) / np.sqrt(2 * np.pi) / (len(values) * bw)
    assert np.allclose(normal["density"], want, atol=1e-12)
    assert len(normal) == 512


def test_row_ids_are_consecutive(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = [(r["k"], r["id"]) for r in S.row_ids(df, ["k"]).orderBy("id").collect()]
    keys = sorted(k for k, _ in got)
    assert got == list(zip(keys, range(1, 1001)))


def test_vector_counts_missing_flag(spark):
    df = spark.createDataFrame([("t", "Yes"), ("t", None), ("u", "Yes"), ("u", "No")], "taxa string, flag string")
    assert rows(S.vector_counts(df, {"flag": "n"})) == [("t", "n", None), ("u", "n", 1)]
    assert rows(S.vector_counts(df, {"flag": "n"}, na_rm=True)) == [("t", "n", 1), ("u", "n", 1)]


def test_species_per_cell_counts_unnamed(spark):
    data = [("a", 1.0, 1.0, 2), ("a", 1.0, 1.0, 3), (None, 1.0, 1.0, 1), ("b", 2.0, 2.0, 0), ("c", 3.0, 3.0, None)]
    df = spark.createDataFrame(data, "species string, target_x double, target_y double, score int")
    assert rows(S.species_per_cell(df)) == [(1.0, 1.0, 2), (2.0, 2.0, None), (3.0, 3.0, None)]
