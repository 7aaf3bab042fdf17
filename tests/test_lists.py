"""NULL rules and list algebra on small hand-written frames."""

from pyspark.sql import functions as F

from biosieve import constants as K
from biosieve.functions.names import clean_headers, clean_name, fix_names
from biosieve.functions.scores import climate_band, n_distinct, strict_mean, yes_flag
from biosieve.operators import filters as P
from biosieve.operators import lists as L
from biosieve.operators import reshape as R
from biosieve.operators import stats as S
from tests.conftest import rows


def test_exclusion_keeps_missing_class(spark):
    df = spark.createDataFrame([("a", "Aves"), ("b", None), ("c", "Bivalvia"), ("d", "NA")], "name string, class string")
    assert [r[0] for r in rows(P.exclude_classes(df))] == ["b", "c"]
    assert [r[0] for r in rows(P.only_classes(df))] == ["a", "d"]
    assert len(K.EXCLUDED_CLASSES) == 22


def test_named_only(spark):
    df = spark.createDataFrame([("a",), (None,), ("NA",)], "n string")
    assert rows(P.named_only(df, "n")) == [("a",)]


def test_coordinate_quality_keeps_missing(spark):
    data = [(1, None, None), (2, 0.02, None), (3, 0.001, 301.0), (4, 0.001, 9999.0), (5, 0.001, 10000.0), (6, None, 50.0), (7, 0.01, 1.0)]
    df = spark.createDataFrame(data, "id int, coordinateprecision double, coordinateuncertaintyinmeters double")
    assert [r[0] for r in rows(P.coordinate_quality(df))] == [1, 6]


def test_zero_coordinates(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (None, None)], "lon double, lat double")
    assert rows(P.nonzero_coordinates(df)) == [(0.0, 5.0), (5.0, 0.0)]


def test_joins_match_missing_with_missing(spark):
    a = spark.createDataFrame([("x",), (None,), ("y",)], "n string")
    b = spark.createDataFrame([(None,), ("y",)], "m string")
    assert rows(L.anti_names(a, b, "n", "m")) == [("x",)]
    assert rows(P.species_of_interest(a, b, "n")) == [("y",), (None,)]
    assert rows(L.exclude_cascade(a, [(b, "m"), (a.filter("n = 'x'"), "n")], "n")) == []


def test_normalised_names_meet(spark):
    a = spark.createDataFrame([("Abramis brama",), ("Salmo trutta fario",)], "n string")
    b = spark.createDataFrame([("Salmo_trutta_fario",)], "m string")
    assert rows(L.anti_names(a, b, "n", "m", normalise=True)) == [("Abramis brama",)]


def test_clean_name_modes(spark):
    df = spark.createDataFrame([("a_b_c",), ("a b c",), (None,)], "n string")
    out = df.select(clean_name("n").alias("all"), clean_name("n", "first").alias("first"), clean_name("n", to="_").alias("joined"))
    assert rows(out) == [("a b c", "a b c", "a_b_c"), ("a b c", "a b_c", "a_b_c"), (None, None, None)]


def test_headers_and_fixes(spark):
    df = spark.createDataFrame([("Sander volgensis or Sander marinus", 1), (None, 2), ("ok", 3)], ["Scientific Name", "Qu.1"])
    out = clean_headers(df)
    assert out.columns == ["scientific_name", "qu_1"]
    assert rows(fix_names(out, "scientific_name", K.NAME_FIXES)) == [("Sander volgensis", 1), ("ok", 3), (None, 2)]


def test_missing_values_in_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), (None, 4.0)], "g string, v double")
    assert rows(df.groupBy("g").agg(strict_mean("v").alias("m"))) == [("a", None), ("b", 2.0), (None, 4.0)]
    assert df.agg(n_distinct("g")).first()[0] == 3
    assert S.duplicate_count(df, "g").first()[0] == 1


def test_bands_and_flags(spark):
    df = spark.createDataFrame([(1.0, "Yes"), (1.5, "yes"), (5.0, None), (6.0, "No"), (None, "Yes")], "s double, f string")
    assert [tuple(r) for r in df.select(climate_band("s"), yes_flag("f")).collect()] == [("Low", 1), ("Medium", 0), ("High", None), (None, 0), (None, 1)]


def test_risk_filters(spark):
    data = [("a", 6.0), ("b", 7.0), ("c", 12.0), ("d", 11.5), ("e", None), ("f", 13.0)]
    df = spark.createDataFrame(data, "species_latin string, global_environmental_risk double")
    assert [r[0] for r in rows(P.high_risk(df))] == ["b", "c"]
    looks = spark.createDataFrame([(v,) for v in (*K.SECOND_LOOK_FLAGS, "No", "YES", None)], "secondary_assessment string")
    assert P.needs_second_look(looks).count() == len(K.SECOND_LOOK_FLAGS)


def test_risk_tier_excludes_by_species(spark):
    data = [("a", 1, 5, None), ("a", 0, 5, None), ("b", 1, 5, "maybe"), ("c", 1, 8, None), ("d", 1, 5, None), ("e", 1, None, "No")]
    df = spark.createDataFrame(data, "species_latin string, qu_1 int, global_environmental_risk int, secondary_assessment string")
    df = df.withColumns({f"qu_{i}": F.lit(1) for i in (2, 3, 4)})
    assert [r[0] for r in rows(L.risk_tier(df))] == ["d", "e"]


def test_first_reason_wins(spark):
    cand = spark.createDataFrame([("A a",), ("B b",), ("C c",), ("D d",)], "n string")
    one = spark.createDataFrame([("A_a",), ("B_b",)], "s string")
    two = spark.createDataFrame([("B b",), ("C c",)], "s string")
    rules = [("first", [(one, "s")], True), ("absent", [(one, "s"), (two, "s")], False), ("second", [(two, "s")], True)]
    assert rows(L.classify_exclusion(cand, rules, "n")) == [("A a", "first"), ("B b", "first"), ("C c", "second"), ("D d", "absent")]


def test_merge_lists(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "n string, v int")
    b = spark.createDataFrame([("x",), ("z",), ("NA",)], "m string")
    assert rows(L.merge_lists(a, b, "n", "m")) == [("x", 1), ("z", None)]


def test_assessments_suffixes(spark):
    risk = spark.createDataFrame([("a", "ra", 3), ("b", "rb", None), ("c", "rc", 5)], "species_latin string, common string, global_environmental_risk int")
    intake = spark.createDataFrame([("a", "ia", "Yes")], "species_latin string, common string, vector string")
    out = L.assessments(risk, intake)
    assert out.columns == ["species_latin", "common_x", "global_environmental_risk", "common_y", "vector"]
    assert rows(out) == [("a", "ra", 3, "ia", "Yes"), ("c", "rc", 5, None, None)]


def test_scenarios_and_regions(spark):
    df = spark.createDataFrame([("a", "1981-2010"), ("a", "2011-2040"), ("b", "1981-2010"), ("c", "2011-2040"), ("d", "2011-2040")], "species string, climate string")
    rejected = spark.createDataFrame([("d",)], "species string")
    assert rows(L.scenario_partition(df, rejected)) == [("a", "both"), ("b", "baseline"), ("c", "future")]
    hist = spark.createDataFrame([("a", "X", 2), ("b", "X", 0), ("c", "Y", 3)], "species string, target string, score int")
    fut = spark.createDataFrame([("d", "X", 1), ("e", "Y", 1)], "species string, target string, score int")
    assert rows(L.region_species_list(hist, fut, ["X"])) == [("a",), ("d",)]
    assert rows(L.region_species_list(hist, fut, ["X"], filter_future=False)) == [("a",), ("d",), ("e",)]


def test_matrix_and_coverage(spark):
    df = spark.createDataFrame([("a", "now", "X"), ("a", "now", "Y"), ("b", "now", "Y")], "species string, climate string, target string")
    assert rows(R.presence_matrix(df, ["X", "Y", "Z"])) == [("a", "now", "Y", "Y", None), ("b", "now", None, "Y", None)]
    one = spark.createDataFrame([("p",), ("q",), ("q",)], "n string")
    two = spark.createDataFrame([("q",), ("r",)], "m string")
    assert rows(L.watchlist_coverage({"one": (one, "n"), "two": (two, "m")})) == [("p", "one"), ("r", "two")]


def test_min_occurrences_and_first(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "species string, v int")
    assert rows(S.min_occurrences(df)) == [("a", 1), ("a", 2), (None, 4), (None, 5)]
    assert rows(S.first_per_key(df, ["species"], ["v"])) == [("a", 1), ("b", 3), (None, 4)]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    one = (F.col("id") * 0.0).alias
    df = spark.range(10000).select(one("species"), one("target_x"), one("target_y"), (F.col("id") % 7).alias("score"))
    for out in (S.top_k_scores(df), S.first_per_key(df, ["species"], ["score"])):
        assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert [r["score"] for r in S.top_k_scores(df).collect()] == [6, 6]
