"""Files in and out."""

import os

from pyspark.sql import functions as F

from biosieve.sources import tables as T
from tests.conftest import rows


def test_header_with_byte_order_mark_and_na(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿ScientificName,lon,lat\nAbramis brama,1.5,NA\nNA,2.0,3.0\n", encoding="utf-8")
    df = T.read_table(spark, str(path), "name string, lon double, lat double")
    assert rows(df) == [("Abramis brama", 1.5, None), (None, 2.0, 3.0)]


def test_species_tree(spark, tmp_path):
    for name, n in (("Abramis_brama", 2), ("Salmo_trutta_fario", 1)):
        lines = "".join(f'"{i}","{name}",{i}.5,1.0\n' for i in range(n))
        (tmp_path / f"{name}.csv").write_text('"","species","lon","lat"\n' + lines)
    (tmp_path / "notes.txt").write_text("not a table")
    tree = T.read_species_tree(spark, str(tmp_path), "species string, lon double, lat double", row_numbers=True)
    out = T.species_from_path(tree, out="name").select("name", "lon")
    assert rows(out) == [("Abramis brama", 0.5), ("Abramis brama", 1.5), ("Salmo trutta fario", 0.5)]
    assert tree.columns == ["species", "lon", "lat", "source_file"]


def test_store_grows_only_by_new_species(spark, tmp_path):
    store = str(tmp_path / "store")
    calls = []

    def score(df):
        calls.append({r["species"] for r in df.select("species").distinct().collect()})
        return df.groupBy("species").agg(F.max("v").alias("score"))

    first = spark.createDataFrame([("a", 1), ("b", 2)], "species string, v int")
    T.append_climate_scores(first, store, score)
    T.append_climate_scores(first.union(spark.createDataFrame([("c", 3), ("a", 9)], "species string, v int")), store, score)
    assert calls == [{"a", "b"}, {"c"}]
    assert rows(spark.read.parquet(store).select("species", "score")) == [("a", 1), ("b", 2), ("c", 3)]
    assert {d for d in os.listdir(store) if d.startswith("species=")} == {"species=a", "species=b", "species=c"}


def test_pending_without_store(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "species string")
    assert T.finished_species(spark, str(tmp_path / "none")) is None
    assert T.pending_species(df, None).count() == 1


def test_species_are_written_by_all_tasks(spark, tmp_path):
    """Few bytes in many species are shared out; a species over ``rows_per_file`` becomes several files; nulls stay."""
    df = spark.range(2000).select("id", F.when(F.col("id") % 100 < 99, F.concat(F.lit("s"), F.col("id") % 100)).alias("species"))
    df = df.unionByName(spark.range(2000, 3000).select("id", F.lit("s1").alias("species")))
    tasks = {}
    for rows_per_file in (1_000_000, 300):
        store = str(tmp_path / str(rows_per_file))
        T.write_by_species(df, store, rows_per_file=rows_per_file)
        files = [(d, f) for d in os.listdir(store) if d.startswith("species=") for f in os.listdir(f"{store}/{d}") if f.startswith("part-")]
        tasks[rows_per_file] = {f.split("-")[1] for _, f in files}
        assert len(tasks[rows_per_file]) > 1
        many = [f for d, f in files if d == "species=s1"]
        assert len(many) > 1 if rows_per_file == 300 else len(many) == 1
        assert len([d for d, _ in files if d != "species=s1"]) == 99
        back = T.read_by_species(spark, store)
        assert rows(back.select("id", F.col("species").cast("string").alias("species"))) == rows(df.select("id", "species"))
