"""Queries for regions, sites, gridded climate and climate matching."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from biosieve.bindings.base import load, query, r6, r6_sql, sql, table
from biosieve.functions.projection import EARTH_RADIUS, MAP_RADIUS, from_mollweide, to_mollweide
from biosieve.operators import grid as G
from biosieve.operators import matching as M
from biosieve.operators import spatial as X
from biosieve.operators import stats as S
from biosieve.sources.geography import Grid, load_cells, load_polygons, polygon_edges
from biosieve.session import durable, scratch_path

# ---- regions ----------------------------------------------------------------------------------

# a concave quadrilateral per supplier; a square with a square hole per nation
_QUAD = ((-6.0, -4.0), (6.0, -3.0), (1.5, 5.0), (0.0, 0.0))
_SQUARE = ((-8.0, -8.0), (8.0, -8.0), (8.0, 8.0), (-8.0, 8.0))
_HOLE = tuple((x / 4, y / 4) for x, y in _SQUARE)
_PLOTS = {"supplier": ("s", "s_suppkey", (_QUAD,)), "nation": ("n", "n_nationkey", (_SQUARE, _HOLE))}


def _centre(key):
    return f"CAST({key} * 37 % 340 AS DOUBLE) - 170", f"CAST({key} * 53 % 160 AS DOUBLE) - 80"


def _rings(spark, sf, sources):
    parts = []
    for source in sources:
        prefix, key, rings = _PLOTS[source]
        cx, cy = _centre(key)
        for i, ring in enumerate(rings):
            pts = ", ".join(f"named_struct('x', {cx} + {dx}D, 'y', {cy} + {dy}D)" for dx, dy in ring)
            parts.append(table(spark, sf, source).selectExpr(f"'{prefix}_' || CAST({key} AS STRING) AS region", f"{i} AS ring_id", f"array({pts}) AS pts"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(spark, sf, *sources):
    return polygon_edges(_rings(spark, sf, sources))


def _edges_sql(*sources):
    rows = []
    for source in sources:
        prefix, key, rings = _PLOTS[source]
        cx, cy = _centre(key)
        for i, ring in enumerate(rings):
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                rows.append(
                    f"SELECT '{prefix}_' || CAST({key} AS STRING) AS region, {i} AS ring_id, {cx} + {ax}::DOUBLE AS x1, {cy} + {ay}::DOUBLE AS y1, "
                    f"{cx} + {bx}::DOUBLE AS x2, {cy} + {by}::DOUBLE AS y2 FROM {source}"
                )
    return f"edges AS ({' UNION ALL '.join(rows)})"


def _inside_sql(points, key, x="lon", y="lat"):
    """(key, region) pairs by testing every point against every edge."""
    return f"""inside AS (SELECT {key}, region FROM {points}, edges WHERE {x} <= greatest(x1, x2) AND {y} BETWEEN least(y1, y2) AND greatest(y1, y2) GROUP BY {key}, region
      HAVING sum(CASE WHEN (y1 > {y}) <> (y2 > {y}) AND {x} < (x2 - x1) * ({y} - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1
      OR bool_or((x2 - x1) * ({y} - y1) = ({x} - x1) * (y2 - y1) AND {x} BETWEEN least(x1, x2) AND greatest(x1, x2)))"""


@query("load_polygons", sql("SELECT * FROM edges", ctes=_edges_sql("supplier", "nation")))
def _(spark, sf):
    path = scratch_path(spark, "rings")
    _rings(spark, sf, ("supplier", "nation")).write.parquet(path)
    return load_polygons(spark, path)


@query("within_region", sql("SELECT record_id, lon, lat, region FROM occ JOIN inside USING (record_id)", "occ", ctes=f"{_edges_sql('supplier', 'nation')}, {_inside_sql('occ', 'record_id')}"))
def _(spark, sf):
    points = load(spark, sf, "occ").select("record_id", "lon", "lat")
    return X.within_region(points, _edges(spark, sf, "supplier", "nation"))


@query("on_land", sql("SELECT record_id, lon, lat FROM occ WHERE record_id IN (SELECT record_id FROM inside)", "occ", ctes=f"{_edges_sql('supplier', 'nation')}, {_inside_sql('occ', 'record_id')}"))
def _(spark, sf):
    points = load(spark, sf, "occ").select("record_id", "lon", "lat")
    return X.on_land(points, _edges(spark, sf, "supplier", "nation"))


@query("drop_species_present", sql("""SELECT record_id, specieskey, lon, lat FROM tracks WHERE specieskey NOT IN
  (SELECT specieskey FROM tracks JOIN inside USING (record_id))""", "tracks", ctes=f"{_edges_sql('nation')}, {_inside_sql('tracks', 'record_id')}"))
def _(spark, sf):
    return X.drop_species_present(load(spark, sf, "tracks"), _edges(spark, sf, "nation"))


_RADIUS = 30000.0


@query("away_from_sites", sql(f"""SELECT record_id, lon, lat FROM occ o WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE 2 * {EARTH_RADIUS} * asin(least(1.0, sqrt(
  pow(sin(radians(s.lat - o.lat) / 2), 2) + cos(radians(o.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - o.lon) / 2), 2)))) <= {_RADIUS})""", "occ", "sites"))
def _(spark, sf):
    return X.away_from_sites(load(spark, sf, "occ").select("record_id", "lon", "lat"), load(spark, sf, "sites"), _RADIUS)


# ---- gridded climate --------------------------------------------------------------------------

LAYERS = ["bio01", "bio05", "bio06"]
WORLD = Grid(-180.0, 90.0, 1.8, 1.8, 100, 200)
_AVG = ", ".join(f"avg({v}) AS {v}" for v in LAYERS)
_CELLS = f"""cells AS (SELECT row * 200 + col AS cell_id, row, col, -180 + (col + 0.5::DOUBLE) * 1.8::DOUBLE AS x, 90 - (row + 0.5::DOUBLE) * 1.8::DOUBLE AS y, {_AVG} FROM gridded GROUP BY row, col)"""


def _cells(spark, sf, model=None):
    rows = load(spark, sf, "gridded")
    if model:
        rows = rows.filter(F.col("model") == model)
    means = rows.groupBy("row", "col").agg(*[F.avg(v).alias(v) for v in LAYERS])
    return means.select(
        (F.col("row") * 200 + F.col("col")).alias("cell_id"), "row", "col", WORLD.x_of(F.col("col")).alias("x"), WORLD.y_of(F.col("row")).alias("y"), *LAYERS
    )


_XY = ("x", "y")


@query("load_cells", sql(f"SELECT cell_id, row, col, {r6_sql('x', 'y', 'bio01', 'bio06')} FROM cells", "gridded", ctes=_CELLS))
def _(spark, sf):
    path = scratch_path(spark, "cells")
    _cells(spark, sf).write.parquet(path)
    return r6(load_cells(spark, path, ["bio01", "bio06"]), "x", "y", "bio01", "bio06")


@query("rescale", sql(f"SELECT cell_id, {r6_sql('bio01', 'bio05')} FROM (SELECT cell_id, bio01 / 10 AS bio01, bio05 / 100 AS bio05 FROM cells)", "gridded", ctes=_CELLS))
def _(spark, sf):
    return r6(G.rescale(_cells(spark, sf), {"bio01": 10, "bio05": 100}).select("cell_id", "bio01", "bio05"), "bio01", "bio05")


@query("block_mean", sql(f"SELECT row, col, {r6_sql(*LAYERS)} FROM (SELECT CAST(floor(row / 7) AS BIGINT) AS row, CAST(floor(col / 7) AS BIGINT) AS col, {_AVG} FROM cells GROUP BY 1, 2)", "gridded",
  ctes=_CELLS.replace("row * 200 + col AS cell_id, row, col", "row AS row, col AS col")))
def _(spark, sf):
    return r6(G.block_mean(_cells(spark, sf), LAYERS, 7), *LAYERS)


@query("layer_stats", sql("SELECT " + ", ".join(f"round(avg({v}), 6) AS {v}_mean, round(stddev_samp({v}), 6) AS {v}_sd" for v in LAYERS) + " FROM cells", "gridded", ctes=_CELLS))
def _(spark, sf):
    stats = G.layer_stats(_cells(spark, sf), LAYERS)
    return stats.select(*[F.round(f"{v}.{k}", 6).alias(f"{v}_{k}") for v in LAYERS for k in ("mean", "sd")])


_Z = ", ".join(f"({v} - avg({v}) OVER ()) / stddev_samp({v}) OVER () AS {v}" for v in LAYERS)


@query("standardize", sql(f"SELECT cell_id, {r6_sql(*LAYERS)} FROM (SELECT cell_id, {_Z} FROM cells)", "gridded", ctes=_CELLS))
def _(spark, sf):
    return r6(G.standardize(_cells(spark, sf), LAYERS), *LAYERS).select("cell_id", *LAYERS)


_BASE_Z = ", ".join(f"({v} - (SELECT avg({v}) FROM base)) / (SELECT stddev_samp({v}) FROM base) AS {v}" for v in LAYERS)
_MODEL_CELLS = ", ".join(f"{name} AS (SELECT row, col, {_AVG} FROM gridded WHERE model = '{m}' GROUP BY row, col)" for name, m in (("base", "F"), ("later", "O")))


@query("standardize_by_baseline", sql(f"SELECT row, col, {r6_sql(*LAYERS)} FROM (SELECT row, col, {_BASE_Z} FROM later)", "gridded", ctes=_MODEL_CELLS))
def _(spark, sf):
    stats = G.layer_stats(_cells(spark, sf, "F"), LAYERS)
    return r6(G.standardize(_cells(spark, sf, "O"), LAYERS, stats), *LAYERS).select("row", "col", *LAYERS)


@query("raster_difference", sql(f"SELECT row, col, {r6_sql(*LAYERS)} FROM (SELECT row, col, " + ", ".join(f"later.{v} - base.{v} AS {v}" for v in LAYERS) + " FROM later JOIN base USING (row, col))", "gridded", ctes=_MODEL_CELLS))
def _(spark, sf):
    return r6(G.raster_difference(_cells(spark, sf, "O"), _cells(spark, sf, "F"), LAYERS), *LAYERS)


def _mollweide_sql(source, keep):
    """Newton rounds as nested selects."""
    inner = f"SELECT *, radians(lat) AS t, pi() * sin(radians(lat)) AS rhs FROM {source}"
    for _ in range(12):
        inner = f"SELECT * EXCLUDE (t), CASE WHEN 2 + 2 * cos(2 * t) = 0 THEN t ELSE t - (2 * t + sin(2 * t) - rhs) / (2 + 2 * cos(2 * t)) END AS t FROM ({inner})"
    polar = f"SELECT * EXCLUDE (t), CASE WHEN abs(lat) > 89.9 THEN sign(lat) * pi() / 2 ELSE t END AS t FROM ({inner})"
    return f"SELECT {keep}, {MAP_RADIUS} * 2 * sqrt(2) / pi() * radians(lon) * cos(t) AS x, {MAP_RADIUS} * sqrt(2) * sin(t) AS y FROM ({polar})"


@query("to_mollweide", sql(f"SELECT record_id, round(x, 3) + 0.0 AS x, round(y, 3) + 0.0 AS y FROM ({_mollweide_sql('occ', 'record_id')})", "occ"))
def _(spark, sf):
    out = to_mollweide(load(spark, sf, "occ").select("record_id", "lon", "lat"))
    return out.select("record_id", (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round("y", 3) + F.lit(0.0)).alias("y"))


@query("from_mollweide", sql(f"""SELECT record_id, {r6_sql('lon', 'lat')} FROM (SELECT record_id, CASE WHEN ok THEN l END AS lon, CASE WHEN ok THEN degrees(asin((2 * t + sin(2 * t)) / pi())) END AS lat
  FROM (SELECT *, abs(l) <= 180 AS ok FROM (SELECT record_id, t, degrees(pi() * mx / (2 * {MAP_RADIUS} * sqrt(2) * cos(t))) AS l
  FROM (SELECT record_id, lon * 90000 AS mx, asin(lat * 85000 / ({MAP_RADIUS} * sqrt(2))) AS t FROM occ))))""", "occ"))
def _(spark, sf):
    metres = load(spark, sf, "occ").select("record_id", (F.col("lon") * 90000).alias("x"), (F.col("lat") * 85000).alias("y"))
    return r6(from_mollweide(metres).select("record_id", "lon", "lat"), "lon", "lat")


FINE = Grid(-150.0, 70.0, 0.9, 0.7, 180, 320)
_REGRID = f"""fine AS (SELECT r * 320 + c AS cell_id, -150 + (c + 0.5::DOUBLE) * 0.9::DOUBLE AS x, 70 - (r + 0.5::DOUBLE) * 0.7::DOUBLE AS y FROM (SELECT unnest(range(180)) AS r), (SELECT unnest(range(320)) AS c)),
  placed0 AS (SELECT cell_id, (x + 180) / 1.8::DOUBLE - 0.5 AS u0, (90 - y) / 1.8::DOUBLE - 0.5 AS v0 FROM fine),
  placed AS (SELECT cell_id, CASE WHEN abs(u0 - round(u0)) < 1e-9 THEN round(u0) ELSE u0 END AS u, CASE WHEN abs(v0 - round(v0)) < 1e-9 THEN round(v0) ELSE v0 END AS v FROM placed0),
  pieces AS (SELECT cell_id, floor(v) + dr AS row, floor(u) + dc AS col, (CASE dr WHEN 1 THEN v - floor(v) ELSE 1 - (v - floor(v)) END) * (CASE dc WHEN 1 THEN u - floor(u) ELSE 1 - (u - floor(u)) END) AS w
    FROM placed, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dr, dc))"""


def _regrid_sql(na_rm):
    value = (lambda v: f"sum(w * {v}) / sum(CASE WHEN {v} IS NOT NULL THEN w END)") if na_rm else (lambda v: f"CASE WHEN count({v}) = count(*) THEN sum(w * {v}) END")
    vals = ", ".join(f"{value(v)} AS {v}" for v in LAYERS)
    return f"SELECT cell_id, {r6_sql(*LAYERS, places=10)} FROM (SELECT p.cell_id, {vals} FROM pieces p LEFT JOIN cells c ON p.row = c.row AND p.col = c.col WHERE w > 0 GROUP BY p.cell_id)"


@query("regrid", sql(_regrid_sql(False), "gridded", ctes=f"{_CELLS}, {_REGRID}"))
def _(spark, sf):
    return r6(G.regrid(_cells(spark, sf), WORLD, FINE, LAYERS), *LAYERS, places=10).select("cell_id", *LAYERS)


@query("regrid_renormalised", sql(_regrid_sql(True), "gridded", ctes=f"{_CELLS}, {_REGRID}"))
def _(spark, sf):
    return r6(G.regrid(_cells(spark, sf), WORLD, FINE, LAYERS, na_rm=True), *LAYERS, places=10).select("cell_id", *LAYERS)


@query("target_cells", sql(f"SELECT region AS target, {r6_sql('target_x', 'target_y', *LAYERS)}, cell_id FROM (SELECT *, x AS target_x, y AS target_y FROM cells JOIN inside USING (cell_id))",
  "gridded", ctes=f"{_CELLS}, {_edges_sql('nation')}, {_inside_sql('cells', 'cell_id', 'x', 'y')}"))
def _(spark, sf):
    out = X.target_cells(_cells(spark, sf), _edges(spark, sf, "nation"))
    return r6(out, "target_x", "target_y", *LAYERS).select("target", "target_x", "target_y", *LAYERS, "cell_id")


@query("mask", sql(f"SELECT cell_id, {r6_sql(*LAYERS)} FROM (SELECT cell_id, " + ", ".join(f"CASE WHEN cell_id IN (SELECT cell_id FROM inside) THEN {v} END AS {v}" for v in LAYERS) + " FROM cells)",
  "gridded", ctes=f"{_CELLS}, {_edges_sql('nation')}, {_inside_sql('cells', 'cell_id', 'x', 'y')}"))
def _(spark, sf):
    return r6(X.mask(_cells(spark, sf), _edges(spark, sf, "nation"), LAYERS), *LAYERS).select("cell_id", *LAYERS)


@query("point_climate", sql(f"""SELECT record_id, cell_id, {r6_sql(*LAYERS)} FROM occ JOIN cells ON cells.col = least(floor((lon + 180) / 1.8::DOUBLE), 199) AND cells.row = least(floor((90 - lat) / 1.8::DOUBLE), 99)""", "occ", "gridded", ctes=_CELLS))
def _(spark, sf):
    out = M.point_climate(load(spark, sf, "occ").select("record_id", "lon", "lat"), _cells(spark, sf), WORLD, LAYERS, "lon", "lat")
    return r6(out, *LAYERS).select("record_id", "cell_id", *LAYERS)


_SCORED = "scored AS (SELECT l_suppkey % 100 AS row, l_partkey % 200 AS col, l_linenumber - 1 AS score FROM lineitem)"


def _scored(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_suppkey % 100 AS row", "l_partkey % 200 AS col", "l_linenumber - 1 AS score")


@query("results_to_grid", sql("SELECT r AS row, c AS col, max(score) AS score FROM (SELECT unnest(range(100)) AS r), (SELECT unnest(range(200)) AS c) LEFT JOIN scored ON row = r AND col = c GROUP BY r, c", ctes=_SCORED))
def _(spark, sf):
    return G.results_to_grid(_scored(spark, sf), WORLD.template(spark))


# ---- compositions -----------------------------------------------------------------------------


@query("standardize_climate", sql(f"SELECT cell_id, {r6_sql(*LAYERS)} FROM (SELECT cell_id, {_Z} FROM resampled)", "gridded", ctes=_CELLS + f""",
  blocks AS (SELECT CAST(floor(row / 4) AS BIGINT) AS row, CAST(floor(col / 4) AS BIGINT) AS col, {_AVG} FROM (SELECT row AS row, col AS col, bio01, bio05, bio06 FROM cells) GROUP BY 1, 2),
  {_REGRID.replace('/ 1.8::DOUBLE', '/ 7.2::DOUBLE')},
  resampled AS (SELECT p.cell_id, {', '.join(f'CASE WHEN count({v}) = count(*) THEN sum(w * {v}) END AS {v}' for v in LAYERS)} FROM pieces p LEFT JOIN blocks c ON p.row = c.row AND p.col = c.col WHERE w > 0 GROUP BY p.cell_id)"""))
def _(spark, sf):
    out = G.standardize_climate(_cells(spark, sf), WORLD, FINE, LAYERS, factor=4)
    return r6(out, *LAYERS).select("cell_id", *LAYERS)


_HOT = f"""hits AS (SELECT l_partkey AS species, l_linenumber - 1 AS score, l_suppkey % 100 AS row, l_partkey % 200 AS col FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)),
  counts AS (SELECT row, col, nullif(count(DISTINCT CASE WHEN score > 0 THEN species END), 0) AS n_species FROM hits GROUP BY row, col),
  {_REGRID},
  resampled AS (SELECT p.cell_id, CASE WHEN count(n_species) = count(*) THEN sum(w * n_species) END AS n_species FROM pieces p LEFT JOIN counts c ON p.row = c.row AND p.col = c.col WHERE w > 0 GROUP BY p.cell_id),
  {_edges_sql('nation')}, {_inside_sql('fine', 'cell_id', 'x', 'y')}"""


@query("hot_spots", sql("SELECT cell_id, CASE WHEN cell_id IN (SELECT cell_id FROM inside) THEN round(n_species, 6) END AS n_species FROM resampled", ctes=_HOT))
def _(spark, sf):
    results = table(spark, sf, "lineitem").select(
        F.concat(F.lit("sp_"), F.col("l_partkey").cast("string")).alias("species"),
        (F.col("l_linenumber") - 1).alias("score"),
        WORLD.x_of(F.col("l_partkey") % 200).alias("target_x"),
        WORLD.y_of(F.col("l_suppkey") % 100).alias("target_y"),
    )
    names = table(spark, sf, "part").filter("p_size > 10").select(F.concat(F.lit("SP "), F.col("p_partkey").cast("string")).alias("species_latin"))
    out = G.hot_spots(results, names, WORLD, FINE, _edges(spark, sf, "nation"))
    return out.select("cell_id", F.round("n_species", 6).alias("n_species"))


# ---- climate match ----------------------------------------------------------------------------

BIO = [f"bio{i:02d}" for i in range(1, 17)]


def climate_vectors(spark, sf):
    """Every embedding as a z-scored 16-layer climate vector, with its label as species and region."""
    vec = table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(b) for i, b in enumerate(BIO)])
    return G.standardize(vec, BIO)


def occurrences_and_targets(spark, sf):
    # standardised layers are stored once and read by everything that follows
    z = durable(climate_vectors(spark, sf))
    occ = z.select(F.concat(F.lit("sp_"), F.col("label").cast("string")).alias("species"), *BIO)
    # regions are cut across the species, so that a region meets its cells' own and other species
    targets = z.select(
        F.concat(F.lit("region_"), (F.col("vec_id") % 7).cast("string")).alias("target"),
        F.col("vec_id").cast("double").alias("target_x"), (F.col("vec_id") * 2).cast("double").alias("target_y"), *BIO,
    )
    return occ, targets


_VEC = "vec AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {b}" for i, b in enumerate(BIO)) + " FROM embeddings)"
_VZ = "z AS (SELECT vec_id, label, " + ", ".join(f"({b} - avg({b}) OVER ()) / stddev_samp({b}) OVER () AS {b}" for b in BIO) + " FROM vec)"
_D2 = " + ".join(f"(o.{b} - t.{b}) * (o.{b} - t.{b})" for b in BIO)
_PAIR = f"""pair AS (SELECT 'sp_' || CAST(o.label AS STRING) AS species, 'region_' || CAST(t.vec_id % 7 AS STRING) AS target, CAST(t.vec_id AS DOUBLE) AS target_x, CAST(t.vec_id * 2 AS DOUBLE) AS target_y,
  o.vec_id AS occ_id, greatest(0, CAST(floor(round(10 * (1 - round(sqrt(({_D2}) / 16), 9)), 8)) AS INT)) AS score FROM z o, z t)"""
MATCH_CTES = f"{_VEC}, {_VZ}, {_PAIR}"
BEST_MATCH = "best AS (SELECT species, target, target_x, target_y, max(score) AS score FROM pair GROUP BY ALL)"


@query("climate_match", sql("SELECT * FROM best WHERE score > 0", ctes=f"{MATCH_CTES}, {BEST_MATCH}"))
def _(spark, sf):
    occ, targets = occurrences_and_targets(spark, sf)
    return M.climate_match(occ, targets, BIO)


@query("climate_match_second_best", sql("""SELECT species, target, target_x, target_y, CAST(rn AS INT) AS rank, score FROM
  (SELECT *, row_number() OVER (PARTITION BY species, target, target_x, target_y ORDER BY score DESC) AS rn FROM pair) WHERE rn <= 2 AND score > 0""", ctes=MATCH_CTES))
def _(spark, sf):
    occ, targets = occurrences_and_targets(spark, sf)
    return M.climate_match(occ, targets, BIO, sensitivity=2)


@query("climate_match_with_zeros", sql("SELECT * FROM best", ctes=f"{MATCH_CTES}, {BEST_MATCH}"))
def _(spark, sf):
    occ, targets = occurrences_and_targets(spark, sf)
    return M.climate_match(occ, targets, BIO, fill_zero=True)


@query("region_climate_bands", sql("""SELECT species, round(avg_score, 6) AS avg_score, n, CASE WHEN avg_score <= 1 THEN 'Low' WHEN avg_score <= 2 THEN 'Medium' WHEN avg_score <= 5 THEN 'High' END AS clim_match
  FROM (SELECT species, avg(score) AS avg_score, count(*) AS n FROM best WHERE score <> 0 AND target IN ('region_1', 'region_2', 'region_3') GROUP BY species)""", ctes=f"{MATCH_CTES}, {BEST_MATCH}"))
def region_climate_bands(spark, sf):
    from biosieve.plans.climate import regional_bands

    occ, targets = occurrences_and_targets(spark, sf)
    return r6(regional_bands(occ, targets, BIO, ["region_1", "region_2", "region_3"]), "avg_score")
