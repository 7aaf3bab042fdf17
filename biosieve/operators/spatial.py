"""Point-in-region and proximity tests as equi-joins on grid keys.

Regions are edge tables (see ``sources.geography.polygon_edges``). A region is cut into square
cells: cells that no edge touches are wholly inside or outside and settle their points by a key
lookup; a point in a touched cell meets the edges of that cell alone, starting from an anchor of
the cell for which it is known whether it is inside. Tests are planar in the coordinates given; a
point on an edge counts as inside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from biosieve.functions.projection import EARTH_RADIUS, METRES_PER_DEGREE, haversine_m
from biosieve.session import durable

_PAD = 1e-9
_ANCHOR = (math.sqrt(5) - 1) / 2  # height of the anchors within a row; no usual coordinate falls on it


@dataclass
class RegionIndex:
    """Regions cut into cells of ``size``: the edges of each touched cell, and the cells wholly inside."""

    size: float
    edges: DataFrame
    inner: DataFrame


def region_index(edges: DataFrame, size: float = 1.0) -> RegionIndex:
    """Cut regions into cells. Choose ``size`` so that a cell holds few edges.

    Each edge is listed in the cells it touches. All anchors of a row of cells lie on one line, each
    on the left side of its cell, so an anchor is inside if an odd number of edges cross the line in
    its cell and those behind it: one running sum over the touched cells of a row. The same sum
    settles the cells between two touched ones. Listing and sums are stored. Build the index once and
    pass it on when several point tables meet the same regions.
    """
    cell = lambda v: F.floor(v / size).cast("long")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    ylo, yhi = F.least(y1, y2), F.greatest(y1, y2)
    by_row = edges.select("region", "x1", "y1", "x2", "y2").withColumn(
        "_r", F.explode(F.sequence(cell(ylo - _PAD), cell(yhi + _PAD)))
    )
    at = lambda y: x1 + F.try_divide((x2 - x1) * (y - y1), y2 - y1)
    line = (F.col("_r") + _ANCHOR) * size
    by_row = by_row.withColumn("_line", line).withColumn("_cross", F.when((y1 > line) != (y2 > line), cell(at(line))))
    # x range of the edge within its row, slightly widened, gives the cells it may touch
    flat = y1 == y2
    xa = F.when(flat, x1).otherwise(at(F.greatest(ylo, F.col("_r") * size - _PAD)))
    xb = F.when(flat, x2).otherwise(at(F.least(yhi, (F.col("_r") + 1) * size + _PAD)))
    pad = _PAD * (1 + F.greatest(F.abs(x1), F.abs(x2)))
    cells = F.sequence(F.least(cell(F.least(xa, xb) - pad), "_cross"), F.greatest(cell(F.greatest(xa, xb) + pad), "_cross"))
    listed = durable(by_row.withColumn("_c", F.explode(cells)))
    behind = Window.partitionBy("region", "_r").orderBy(F.desc("_c"))
    touched = durable(
        listed.groupBy("region", "_r", "_c")
        .agg(F.count_if(F.col("_cross") == F.col("_c")).alias("_n"))
        .select("region", "_r", "_c", (F.sum("_n").over(behind) % 2 == 1).alias("_in"), F.lead("_c").over(behind).alias("_before"))
    )
    gaps = touched.filter(F.col("_in") & (F.col("_c") - F.col("_before") > 1))
    inner = gaps.select("region", "_r", F.explode(F.sequence(F.col("_before") + 1, F.col("_c") - 1)).alias("_c"))
    return RegionIndex(size, listed.join(touched.drop("_before"), ["region", "_r", "_c"]), inner)


def _keyed(points: DataFrame, size: float, x: str, y: str) -> DataFrame:
    return points.withColumn("_r", F.floor(F.col(y) / size).cast("long")).withColumn("_c", F.floor(F.col(x) / size).cast("long"))


def _held_places(places: DataFrame, index: RegionIndex, x: str, y: str) -> DataFrame:
    """Distinct ``(region, _px, _py)`` of the keyed places that lie in touched cells, inside or on their region.

    From the anchor of the cell one goes along its line to below or above the place, then up or down
    to it; each edge crossed changes the side. The turning point is put on the same side of an edge
    for both legs (a tie counts as above, beside an upright edge as right), so rounding there cancels.
    Repeated places are met once.
    """
    px, py, line = F.col("_px"), F.col("_py"), F.col("_line")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    height = (x2 - x1) * (line - y1) - (px - x1) * (y2 - y1)
    rising = (x2 > x1) == (y2 > y1)
    above_turn = F.when(x2 > x1, height >= 0).otherwise(height <= 0)
    left_turn = F.when(x1 == x2, px < x1).otherwise(above_turn == rising)
    left = px < F.try_divide((x2 - x1) * (py - y1), y2 - y1) + x1
    above = F.when((y1 > py) != (y2 > py), left == rising).otherwise(py >= F.greatest(y1, y2))
    along = F.col("_cross").isNotNull() & ((F.col("_cross") >= F.col("_c")) != left_turn)
    upright = ((x1 > px) != (x2 > px)) & (above_turn != above)
    on_edge = (
        ((x2 - x1) * (py - y1) == (px - x1) * (y2 - y1))
        & px.between(F.least(x1, x2), F.greatest(x1, x2))
        & py.between(F.least(y1, y2), F.greatest(y1, y2))
    )
    return (
        places.select("_r", "_c", F.col(x).alias("_px"), F.col(y).alias("_py")).distinct()
        .join(index.edges, ["_r", "_c"])
        .groupBy("region", "_px", "_py")
        .agg(
            F.bit_xor(F.when(along, 1).otherwise(0).bitwiseXOR(F.when(upright, 1).otherwise(0))).alias("_odd"),
            F.bool_or(on_edge).alias("_on"),
            F.first("_in").alias("_in"),
        )
        .filter(F.col("_on") | ((F.col("_odd") == 1) != F.col("_in")))
        .select("region", "_px", "_py")
    )


def within_region(
    points: DataFrame, edges: DataFrame, x: str = "lon", y: str = "lat", size: float = 1.0, index: RegionIndex | None = None
) -> DataFrame:
    """Points inside (or on the edge of) a region, labelled ``region``; one row per region hit.

    Repeated rows are kept as often as they come.
    """
    index = index or region_index(edges, size)
    keyed = _keyed(points, index.size, x, y)
    sure = keyed.join(index.inner, ["_r", "_c"])
    held = _held_places(keyed, index, x, y)
    tested = points.join(held, (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py")))
    columns = [*points.columns, "region"]
    return sure.select(*columns).unionByName(tested.select(*columns))


def on_land(
    points: DataFrame, land: DataFrame, x: str = "lon", y: str = "lat", size: float = 1.0, index: RegionIndex | None = None
) -> DataFrame:
    """Points inside at least one land polygon, each kept once."""
    index = index or region_index(land, size)
    keyed = _keyed(points, index.size, x, y)
    inner = index.inner.select("_r", "_c", F.lit(True).alias("_sure")).distinct()
    held = _held_places(keyed, index, x, y).select("_px", "_py", F.lit(True).alias("_held")).distinct()
    return (
        keyed.join(inner, ["_r", "_c"], "left")
        .join(held, (F.col(x) == F.col("_px")) & (F.col(y) == F.col("_py")), "left")
        .filter(F.col("_sure") | F.col("_held"))
        .select(*points.columns)
    )


def drop_species_present(
    points: DataFrame, edges: DataFrame, species: str = "specieskey", x: str = "lon", y: str = "lat", size: float = 1.0
) -> DataFrame:
    """Records of species without any record inside the regions.

    Only the distinct (species, place) pairs are tested, so repeated records cost nothing.
    """
    places = points.select(species, x, y).distinct()
    present = on_land(places, edges, x, y, size).select(F.col(species).alias("_key")).distinct()
    return points.join(present, F.col(species).eqNullSafe(F.col("_key")), "left_anti")


def _columns_in_row(row: Column, step: float) -> Column:
    """Number of longitude cells in a latitude row, so that each is at least ``step`` degrees wide on the ground."""
    lowest = F.least(F.abs(row * step), F.abs((row + 1) * step))
    return F.greatest(F.lit(1), F.floor(360.0 * F.cos(F.radians(F.least(lowest, F.lit(90.0)))) / step)).cast("long")


def away_from_sites(
    points: DataFrame, sites: DataFrame, radius_m: float = 2000.0, lon: str = "lon", lat: str = "lat", site_lon: str = "lon", site_lat: str = "lat"
) -> DataFrame:
    """Points farther than ``radius_m`` from every site.

    Rows of the key grid are one radius high and hold fewer, wider cells towards the poles, so a
    site reaches a handful of cells anywhere, across the 180 degree meridian and around a pole.
    """
    step = radius_m / METRES_PER_DEGREE
    angle = radius_m / EARTH_RADIUS
    s_lon, s_lat = F.col("_s_lon"), F.col("_s_lat")
    polar = F.abs(F.radians(s_lat)) + angle >= math.pi / 2 - 1e-12
    half = F.when(polar, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), math.sin(angle) / F.cos(F.radians(s_lat))))) * (1 + 1e-9) + 1e-9
    )
    count = _columns_in_row(F.col("_r"), step)
    first = F.floor((s_lon - half + 180.0) / 360.0 * count).cast("long")
    last = F.least(F.floor((s_lon + half + 180.0) / 360.0 * count).cast("long"), first + count - 1)
    cells = (
        sites.select(F.col(site_lon).alias("_s_lon"), F.col(site_lat).alias("_s_lat"))
        .filter(s_lon.isNotNull() & s_lat.isNotNull())
        .distinct()
        .withColumn("_r", F.explode(F.sequence(F.floor((s_lat - step) / step - 1e-9).cast("long"), F.floor((s_lat + step) / step + 1e-9).cast("long"))))
        .withColumn("_m", F.explode(F.sequence(first, last)))
        .select("_s_lon", "_s_lat", "_r", F.pmod("_m", count).alias("_c"))
        .distinct()
    )
    row = F.floor(F.col(lat) / step).cast("long")
    keyed = points.withColumn("_pr", row)
    place = F.floor((F.col(lon) + 180.0) / 360.0 * _columns_in_row(F.col("_pr"), step)).cast("long")
    keyed = keyed.withColumn("_pc", F.pmod(place, _columns_in_row(F.col("_pr"), step)))
    near = (
        (F.col("_pr") == F.col("_r"))
        & (F.col("_pc") == F.col("_c"))
        & (haversine_m(F.col(lon), F.col(lat), s_lon, s_lat) <= radius_m)
    )
    return keyed.join(cells, near, "left_anti").drop("_pr", "_pc")


def target_cells(cells: DataFrame, edges: DataFrame, regions: list[str] | None = None, size: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """Climate cells whose centre lies in a region, as ``target, target_x, target_y`` and the other columns.

    The centres are tested on their own and the layers joined back by cell id.
    """
    wanted = edges if regions is None else edges.filter(F.col("region").isin(*regions))
    hits = within_region(cells.select("cell_id", x, y), wanted, x, y, size)
    return hits.select(F.col("region").alias("target"), F.col(x).alias("target_x"), F.col(y).alias("target_y"), "cell_id").join(
        cells.drop(x, y), "cell_id"
    )


def mask(cells: DataFrame, edges: DataFrame, layers: list[str], size: float = 1.0, x: str = "x", y: str = "y") -> DataFrame:
    """Cells with their layer values kept inside the regions and NULL elsewhere."""
    inside = on_land(cells.select("cell_id", x, y), edges, x, y, size).select("cell_id", F.lit(True).alias("_in"))
    return cells.join(inside, "cell_id", "left").withColumns({c: F.when(F.col("_in"), F.col(c)) for c in layers}).drop("_in")
