"""Climate cells and region polygons as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Regular grid with rows counted from the top edge and columns from the left edge."""

    xmin: float
    ymax: float
    dx: float
    dy: float
    nrow: int
    ncol: int

    def col_of(self, x: Column) -> Column:
        """Column holding ``x``; the right edge belongs to the last column, outside is NULL."""
        c = F.floor((x - self.xmin) / self.dx)
        c = F.when((c == self.ncol) & (x <= self.xmin + self.ncol * self.dx), F.lit(self.ncol - 1)).otherwise(c)
        return F.when((c >= 0) & (c < self.ncol), c).cast("long")

    def row_of(self, y: Column) -> Column:
        """Row holding ``y``; the bottom edge belongs to the last row, outside is NULL."""
        r = F.floor((self.ymax - y) / self.dy)
        r = F.when((r == self.nrow) & (y >= self.ymax - self.nrow * self.dy), F.lit(self.nrow - 1)).otherwise(r)
        return F.when((r >= 0) & (r < self.nrow), r).cast("long")

    def x_of(self, col: Column) -> Column:
        return self.xmin + (col.cast("double") + 0.5) * self.dx

    def y_of(self, row: Column) -> Column:
        return self.ymax - (row.cast("double") + 0.5) * self.dy

    def template(self, spark: SparkSession) -> DataFrame:
        """Every cell of the grid with its id, position and centre, generated on the executors."""
        r, c = F.floor(F.col("cell_id") / self.ncol), F.col("cell_id") % self.ncol
        return (
            spark.range(self.nrow * self.ncol)
            .select(F.col("id").alias("cell_id"))
            .select("cell_id", r.alias("row"), c.cast("long").alias("col"))
            .withColumn("x", self.x_of(F.col("col")))
            .withColumn("y", self.y_of(F.col("row")))
        )


def load_cells(spark: SparkSession, path: str, layers: list[str] | None = None) -> DataFrame:
    """Climate cells ``(cell_id, row, col, x, y, layers…)``; only the layers asked for are read."""
    cells = spark.read.parquet(path)
    return cells if layers is None else cells.select("cell_id", "row", "col", "x", "y", *layers)


def polygon_edges(rings: DataFrame) -> DataFrame:
    """Edges ``(region, ring_id, x1, y1, x2, y2)`` of rings ``(region, ring_id, pts)``.

    ``pts`` is an array of ``struct<x,y>`` in ring order; an open ring is closed. Rings of one
    region combine by the even-odd rule, so a ring inside another is a hole.

    Consecutive points more than 180 and less than 360 degrees apart are joined the short way, across
    the 180 degree meridian. Such a ring is unrolled beyond it and listed a second time, a full turn
    away, so that both sides of the meridian lie within one of the copies. A ring that goes around a
    pole is an error.
    """
    closed = rings.filter(F.size("pts") >= 3).withColumn("pts", F.concat("pts", F.slice("pts", 1, 1)))
    steps = "filter(transform(sequence(1, size(pts) - 1), i -> struct(i AS at, pts[i].x - pts[i - 1].x AS dx)), s -> abs(s.dx) > 180 AND abs(s.dx) < 360)"
    crossing = closed.withColumn("_jumps", F.expr(f"transform({steps}, s -> struct(s.at AS at, -360D * signum(s.dx) AS turn))"))
    turned = lambda upto: f"aggregate(filter(_jumps, j -> j.at <= {upto}), 0D, (sum, j) -> sum + j.turn)"
    around = F.expr("aggregate(_jumps, 0D, (sum, j) -> sum + j.turn) <> 0")
    message = F.concat_ws(" ", F.lit("ring around a pole, split it before:"), F.col("region").cast("string"), F.col("ring_id").cast("string"))
    # the generator keeps the optimiser from computing the jumps anew for every corner
    crossing = crossing.select("region", "ring_id", "pts", F.explode(F.array(F.when(around, F.raise_error(message)).otherwise(F.col("_jumps")))).alias("_jumps"))
    corner = lambda at, name: f"struct(pts[{at}].x + {turned(at)} AS x, pts[{at}].y AS y) AS {name}"
    unrolled = crossing.withColumn("e", F.expr(f"transform(sequence(1, size(pts) - 1), i -> struct({corner('i - 1', 'a')}, {corner('i', 'b')}))"))
    copies = F.expr("filter(array(0D, if(exists(e, s -> s.a.x > 180), -360D, NULL), if(exists(e, s -> s.a.x < -180), 360D, NULL)), s -> s IS NOT NULL)")
    copies = F.when(F.size("_jumps") > 0, copies).otherwise(F.array(F.lit(0.0)))
    return (
        unrolled.select("region", "ring_id", "e", F.explode(copies).alias("_by"))
        .select("region", "ring_id", "_by", F.explode("e").alias("e"))
        .select(
            "region", "ring_id", (F.col("e.a.x") + F.col("_by")).alias("x1"), F.col("e.a.y").alias("y1"),
            (F.col("e.b.x") + F.col("_by")).alias("x2"), F.col("e.b.y").alias("y2"),
        )
        .filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    )


def load_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Edge table of the region rings stored at ``path``."""
    return polygon_edges(spark.read.parquet(path))
