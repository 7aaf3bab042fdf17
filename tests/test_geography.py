"""Regions, sites, projections and grids against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from biosieve.functions.projection import EARTH_RADIUS, from_mollweide, to_mollweide
from biosieve.operators import grid as G
from biosieve.operators import spatial as X
from biosieve.sources.geography import Grid, polygon_edges
from tests.conftest import rows

SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]


def _edges(spark, rings):
    schema = "region string, ring_id int, pts array<struct<x:double,y:double>>"
    return polygon_edges(spark.createDataFrame(rings, schema))


def _brute(px, py, rings):
    odd, on = False, False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
            if (x2 - x1) * (py - y1) == (px - x1) * (y2 - y1) and min(x1, x2) <= px <= max(x1, x2) and min(y1, y2) <= py <= max(y1, y2):
                on = True
    return odd or on


def test_edges_holes_and_corners(spark):
    edges = _edges(spark, [("r", 0, SQUARE), ("r", 1, HOLE)])
    assert edges.count() == 8
    pts = [(1, 1.5, 1.5), (2, 0.5, 0.5), (3, 0.0, 0.0), (4, 4.0, 2.0), (5, 5.0, 2.0), (6, 1.0, 1.5), (7, 2.0, 4.0), (8, 3.0, 3.0), (9, -1.0, 0.0)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    for size in (0.3, 1.0, 50.0):
        assert [r[0] for r in rows(X.within_region(df, edges, size=size))] == [2, 3, 4, 6, 7, 8]


@pytest.mark.parametrize("size", [0.5, 3.0])
def test_random_polygons_match_brute_force(spark, size):
    rng = np.random.default_rng(11)
    rings = {}
    for k in range(6):
        cx, cy = rng.uniform(-15, 15, 2)
        angles = np.sort(rng.uniform(0, 2 * math.pi, 9))
        radius = rng.uniform(1, 8, 9)
        # some corners on the cell lattice, so that edges run through cell corners
        corners = [(round(cx + r * math.cos(a)), round(cy + r * math.sin(a))) if k % 2 else (cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(angles, radius)]
        rings[f"p{k}"] = [(float(x), float(y)) for x, y in corners]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.uniform(-25, 25, (600, 2)), rng.integers(-20, 20, (300, 2))]))]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    edges = _edges(spark, [(name, 0, ring) for name, ring in rings.items()])
    got = {(r["id"], r["region"]) for r in X.within_region(df, edges, size=size).collect()}
    want = {(i, name) for i, x, y in pts for name, ring in rings.items() if _brute(x, y, [ring])}
    assert got == want
    land = sorted(r["id"] for r in X.on_land(df, edges, size=size).collect())
    assert land == sorted({i for i, _ in want})


def test_crowded_place_keeps_every_record(spark):
    edges = _edges(spark, [("r", 0, SQUARE)])
    df = spark.range(5000).select("id", F.lit(4.0).alias("lon"), F.lit(2.0).alias("lat"))
    assert X.within_region(df, edges).count() == 5000


def test_species_present_anywhere_inside_are_dropped(spark):
    edges = _edges(spark, [("r", 0, SQUARE)])
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 9.0, 9.0), ("b", 9.0, 9.0), (None, 9.0, 9.0)], "specieskey string, lon double, lat double")
    assert rows(X.drop_species_present(df, edges)) == [("b", 9.0, 9.0), (None, 9.0, 9.0)]


def test_sites_match_brute_force_everywhere(spark):
    rng = np.random.default_rng(3)
    sites = [(179.999, 0.0), (-179.999, 45.0), (10.0, 89.995), (100.0, -90.0), (0.0, 0.0), (5.0, 80.0)]
    near = [(sx + dx, max(-90.0, min(90.0, sy + dy))) for sx, sy in sites for dx, dy in rng.normal(0, 0.02, (60, 2))]
    spread = [(float(x), float(y)) for x, y in zip(rng.uniform(-180, 180, 300), np.concatenate([rng.uniform(89.9, 90, 100), rng.uniform(-90, -89.9, 100), rng.uniform(-90, 90, 100)]))]
    pts = [(i, ((x + 180) % 360) - 180, y) for i, (x, y) in enumerate(near + spread + [(180.0, 0.0), (-180.0, 0.0), (180.0, 90.0)])]

    def metres(a, b):
        (lo1, la1), (lo2, la2) = [tuple(map(math.radians, p)) for p in (a, b)]
        h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return 2 * EARTH_RADIUS * math.asin(min(1.0, math.sqrt(h)))

    want = sorted(i for i, x, y in pts if all(metres((x, y), s) > 2000 for s in sites))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in pts], "id int, lon double, lat double")
    out = X.away_from_sites(df, spark.createDataFrame(sites, "lon double, lat double"))
    assert sorted(r["id"] for r in out.collect()) == want
    assert 0 < len(want) < len(pts)


def test_mollweide_round_trip(spark):
    lats = [0.0, 1.0, -45.0, 60.0, 89.0, 89.89, 89.91, 89.99, -89.9999, 90.0, -90.0]
    df = spark.createDataFrame([(float(lon), lat) for lon in (-180, -63, 0, 120, 180) for lat in lats], "lon double, lat double")
    out = from_mollweide(to_mollweide(df), lon="lon2", lat="lat2").toPandas()
    assert np.allclose(out["lat"], out["lat2"], atol=5e-6)
    inner = out[out["lat"].abs() < 89.9999]
    assert np.allclose(inner["lon"], inner["lon2"], atol=1e-4)


def test_mollweide_known_values_and_outside(spark):
    df = spark.createDataFrame([(0.0, 90.0), (180.0, 0.0)], "lon double, lat double")
    got = rows(to_mollweide(df).select("x", "y"))
    r = 6378137.0
    assert got[0][0] == pytest.approx(0.0, abs=1e-3) and got[0][1] == pytest.approx(r * math.sqrt(2))
    assert got[1][0] == pytest.approx(2 * math.sqrt(2) * r)
    far = spark.createDataFrame([(2.0e7, 0.0), (1.7e7, 8.0e6)], "x double, y double")
    assert all(r["lon"] is None and r["lat"] is None for r in from_mollweide(far).collect())


def _cells(spark, grid, value, missing=()):
    df = grid.template(spark).withColumn("v", value)
    for r, c in missing:
        df = df.filter(~((F.col("row") == r) & (F.col("col") == c)))
    return df


def test_grid_edges(spark):
    grid = Grid(0.0, 3.0, 1.0, 1.0, 3, 3)
    df = spark.createDataFrame([(0.0, 3.0), (3.0, 0.0), (3.01, 1.0), (1.0, 2.0)], "x double, y double")
    assert [tuple(r) for r in df.select(grid.row_of(F.col("y")), grid.col_of(F.col("x"))).collect()] == [(0, 0), (2, 2), (2, None), (1, 1)]


def test_regrid_reproduces_linear_and_constant_fields(spark):
    source, target = Grid(0.0, 40.0, 1.0, 1.0, 40, 40), Grid(3.0, 35.0, 0.37, 0.41, 60, 60)
    linear = _cells(spark, source, 2 * F.col("x") - 3 * F.col("y"))
    out = G.regrid(linear, source, target, ["v"]).toPandas()
    assert np.allclose(out["v"], 2 * out["x"] - 3 * out["y"], atol=1e-9)
    same = G.regrid(linear, source, source, ["v"]).toPandas()
    assert np.allclose(same["v"], 2 * same["x"] - 3 * same["y"]) and len(same) == 1600


def test_regrid_missing_neighbour(spark):
    source, target = Grid(0.0, 3.0, 1.0, 1.0, 3, 3), Grid(1.0, 2.0, 1.0, 1.0, 1, 1)
    shifted = Grid(0.75, 2.0, 1.0, 1.0, 1, 1)
    cells = _cells(spark, source, F.lit(5.0), missing=[(1, 0)])
    assert G.regrid(cells, source, target, ["v"]).first()["v"] == 5.0
    assert G.regrid(cells, source, shifted, ["v"]).first()["v"] is None
    assert G.regrid(cells, source, shifted, ["v"], na_rm=True).first()["v"] == 5.0
    assert G.regrid(cells, source, shifted, ["v"], method="nearest").first()["v"] == 5.0


def test_block_mean_keeps_partial_blocks(spark):
    cells = _cells(spark, Grid(0.0, 41.0, 1.0, 1.0, 41, 41), F.when(F.col("row") == 40, 7.0).otherwise(1.0), missing=[(0, 0)])
    out = {(r["row"], r["col"]): r["v"] for r in G.block_mean(cells, ["v"], 20).collect()}
    assert len(out) == 9 and out[(2, 2)] == 7.0 and out[(0, 0)] == 1.0


def test_constant_layer_is_null_after_standardising(spark):
    cells = _cells(spark, Grid(0.0, 3.0, 1.0, 1.0, 3, 3), F.lit(2.0)).withColumn("w", F.col("row").cast("double"))
    out = G.standardize(cells, ["v", "w"]).toPandas()
    assert out["v"].isna().all()
    assert out["w"].mean() == pytest.approx(0) and out["w"].std() == pytest.approx(1)


def test_mask_and_template(spark):
    grid = Grid(0.0, 3.0, 1.0, 1.0, 3, 3)
    cells = _cells(spark, grid, F.lit(1.0))
    edges = _edges(spark, [("r", 0, [(0.0, 0.0), (1.2, 0.0), (1.2, 3.0), (0.0, 3.0)])])
    assert sorted(r["col"] for r in X.mask(cells, edges, ["v"]).filter("v IS NOT NULL").collect()) == [0, 0, 0]
    results = spark.createDataFrame([(0, 0, 2), (0, 0, 5), (1, 1, None)], "row long, col long, score int")
    out = {(r["row"], r["col"]): r["score"] for r in G.results_to_grid(results, grid.template(spark)).collect()}
    assert len(out) == 9 and out[(0, 0)] == 5 and out[(1, 1)] is None


def test_comb_with_thousands_of_edges_in_a_row_of_cells(spark):
    teeth = 2000
    top = [(i * 0.02 + d, 0.9 if d else 0.1) for i in range(teeth) for d in (0.0, 0.01)]
    comb = [(0.0, 0.0), *top, (teeth * 0.02, 0.0)]
    rng = np.random.default_rng(8)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-1, 41, 400), rng.uniform(-0.1, 1.0, 400)))]
    edges = _edges(spark, [("comb", 0, comb)])
    index = X.region_index(edges, 0.5)
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = sorted(r["id"] for r in X.within_region(df, edges, index=index).collect())
    assert got == [i for i, x, y in pts if _brute(x, y, [comb])]
    # the row holds all edges, a cell only those that touch it
    assert index.edges.groupBy("_r", "_c").count().agg(F.max("count")).first()[0] < 60
    assert index.edges.filter("_r = 0").count() > teeth


def test_places_and_edges_meet_by_cell(spark):
    edges = _edges(spark, [("r", 0, SQUARE), ("r", 1, HOLE)])
    df = spark.createDataFrame([(1.5, 1.5), (None, 1.0), (1.0, None), (float("nan"), 1.0)], "lon double, lat double")
    plan = X.within_region(df, edges)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    # the listed edges meet the sums of their own cell by region, row and column; nothing meets by region and row alone
    assert joins and not any("region" in line and "_c#" not in line for line in joins)
    assert X.within_region(df, edges).count() == 0


def test_ring_across_the_meridian_equals_its_halves(spark):
    whole = [(170.0, -10.0), (-170.0, -12.0), (-165.0, 5.0), (180.0, 9.0), (172.0, 4.0)]
    hole = [(178.0, -2.0), (-178.0, -2.0), (-178.0, 2.0), (178.0, 2.0)]
    east = [(170.0, -10.0), (180.0, -11.0), (180.0, 9.0), (172.0, 4.0)]
    west = [(-180.0, -11.0), (-170.0, -12.0), (-165.0, 5.0), (-180.0, 9.0)]
    halves = [("p", 0, east), ("p", 1, west), ("p", 2, [(178.0, -2.0), (180.0, -2.0), (180.0, 2.0), (178.0, 2.0)]),
              ("p", 3, [(-180.0, -2.0), (-178.0, -2.0), (-178.0, 2.0), (-180.0, 2.0)])]
    rng = np.random.default_rng(2)
    xs = np.concatenate([rng.uniform(160, 180, 400), rng.uniform(-180, -160, 400), rng.uniform(-160, 160, 50)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(xs, rng.uniform(-15, 15, len(xs))))], "id int, lon double, lat double")
    ids = lambda rings: sorted(r["id"] for r in X.within_region(df, _edges(spark, rings)).collect())
    got = ids([("p", 0, whole), ("p", 1, hole)])
    assert got == ids(halves) and 100 < len(got) < 700


def test_ring_around_a_pole_is_an_error(spark):
    with pytest.raises(Exception, match="around a pole.*cap 3"):
        _edges(spark, [("cap", 3, [(0.0, -70.0), (120.0, -70.0), (-120.0, -70.0)])]).count()
    # a box that spans the whole map, drawn along its borders, is no such ring
    assert _edges(spark, [("map", 0, [(-180.0, -90.0), (180.0, -90.0), (180.0, 90.0), (-180.0, 90.0)])]).count() == 4
