"""Map projection and distance as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sphere radii in metres (map projection, great-circle distance).
MAP_RADIUS = 6378137.0
EARTH_RADIUS = 6371008.8
METRES_PER_DEGREE = math.pi * EARTH_RADIUS / 180.0

POLE_LIMIT = 89.9


def to_mollweide(
    df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y", steps: int = 12
) -> DataFrame:
    """Add equal-area Mollweide metres ``x``, ``y`` for degrees ``lon``, ``lat``.

    The auxiliary angle t solves 2t + sin 2t = pi sin(lat). Newton converges in ``steps`` rounds up
    to ``POLE_LIMIT`` degrees; closer to a pole the expansion around it is exact to 1e-9.
    """
    phi = F.radians(F.col(lat))
    out = df.withColumn("_t", phi).withColumn("_rhs", math.pi * F.sin(phi))
    t = F.col("_t")
    for _ in range(steps):
        slope = 2 + 2 * F.cos(2 * t)
        out = out.withColumn("_t", t - F.when(slope == 0, 0.0).otherwise((2 * t + F.sin(2 * t) - F.col("_rhs")) / slope))
    gap = math.pi / 2 - F.abs(phi)
    # with e = pi - 2t the equation reads e - sin e = pi (1 - sin|lat|); solve it by its series
    e = F.pow(12 * math.pi * F.pow(F.sin(gap / 2), 2), 1 / 3)
    polar = math.pi / 2 - e * (1 + e * e / 60) / 2
    t = F.when(F.abs(F.col(lat)) > POLE_LIMIT, F.signum(phi) * polar).otherwise(t)
    return (
        out.withColumn("_t", t)
        .withColumn(x, MAP_RADIUS * 2 * math.sqrt(2) / math.pi * F.radians(F.col(lon)) * F.cos("_t"))
        .withColumn(y, MAP_RADIUS * math.sqrt(2) * F.sin("_t"))
        .drop("_t", "_rhs")
    )


def from_mollweide(
    df: DataFrame, x: str = "x", y: str = "y", lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Add degrees ``lon``, ``lat`` for Mollweide metres; NULL outside the map's ellipse.

    Points a rounding error beyond the edge are taken as on it; a pole gets longitude 0.
    """
    s = F.col(y) / (MAP_RADIUS * math.sqrt(2))
    flat = F.cos("_t") < 1e-9
    sine = (2 * F.col("_t") + F.sin(2 * F.col("_t"))) / math.pi
    clamp = lambda v, limit: F.greatest(F.lit(-limit), F.least(F.lit(limit), v))
    return (
        df.withColumn("_t", F.when(F.abs(s) <= 1 + 1e-12, F.asin(clamp(s, 1.0))))
        .withColumn("_lon", F.when(flat, 0.0).otherwise(math.pi * F.col(x) / (2 * MAP_RADIUS * math.sqrt(2) * F.cos("_t"))))
        .withColumn(lon, F.when(F.abs("_lon") <= math.pi + 1e-8, F.degrees(clamp(F.col("_lon"), math.pi))))
        .withColumn(lat, F.when(F.col(lon).isNotNull(), F.degrees(F.asin(clamp(sine, 1.0)))))
        .drop("_t", "_lon")
    )


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres on a sphere (within 0.6 % of the ellipsoid)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
