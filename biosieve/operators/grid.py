"""Gridded climate layers as tables: aggregation, regridding, standardisation, derived maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.operators.spatial import mask
from biosieve.operators.stats import best_score, species_per_cell
from biosieve.sources.geography import Grid


def rescale(cells: DataFrame, divisors: dict[str, float]) -> DataFrame:
    """Divide the named layers by a constant."""
    return cells.withColumns({layer: F.col(layer) / F.lit(float(d)) for layer, d in divisors.items()})


def block_mean(cells: DataFrame, layers: Sequence[str], factor: int = 20) -> DataFrame:
    """Mean of each ``factor`` by ``factor`` block per layer; missing cells ignored, partial edge blocks kept."""
    return cells.groupBy(
        F.floor(F.col("row") / factor).cast("long").alias("row"), F.floor(F.col("col") / factor).cast("long").alias("col")
    ).agg(*[F.avg(layer).alias(layer) for layer in layers])


def layer_stats(cells: DataFrame, layers: Sequence[str]) -> DataFrame:
    """One row with a struct (mean, sample sd) per layer, missing cells ignored."""
    return cells.agg(*[F.struct(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd")).alias(v) for v in layers])


def standardize(cells: DataFrame, layers: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """z-score per layer with the table's own statistics or those of ``stats`` (such as the baseline's).

    The single statistics row enters as a scalar subquery, so no join is planned. A constant layer
    becomes NULL.
    """
    stats = layer_stats(cells, layers) if stats is None else stats
    row = stats.select(F.struct(*layers).alias("s")).scalar()
    scored = cells.withColumn("_s", row)
    return scored.withColumns(
        {v: (F.col(v) - F.col(f"_s.{v}.mean")) / F.nullif(F.col(f"_s.{v}.sd"), F.lit(0.0)) for v in layers}
    ).drop("_s")


def regrid(
    cells: DataFrame,
    source: Grid,
    target: Grid,
    layers: Sequence[str],
    locate: Callable[[DataFrame], DataFrame] | None = None,
    method: str = "bilinear",
    na_rm: bool = False,
) -> DataFrame:
    """Resample layers from ``source`` to the cells of ``target``.

    ``locate`` turns the target columns ``x, y`` into source coordinates ``sx, sy`` (identity when
    omitted). Bilinear weights use the four surrounding cell centres; a neighbour of weight 0 is
    ignored. A missing neighbour makes the value NULL, or the weights are renormalised with
    ``na_rm``. Cells meet on integer row and column.
    """
    spark = cells.sparkSession
    grid = target.template(spark)
    placed = locate(grid) if locate else grid.withColumns({"sx": F.col("x"), "sy": F.col("y")})
    if method == "nearest":
        pieces = placed.select(
            "cell_id", source.row_of(F.col("sy")).alias("_r"), source.col_of(F.col("sx")).alias("_c"), F.lit(1.0).alias("_w")
        )
    elif method == "bilinear":
        u, v = F.col("_u"), F.col("_v")
        near = placed.withColumn("_u", (F.col("sx") - source.xmin) / source.dx - 0.5).withColumn("_v", (source.ymax - F.col("sy")) / source.dy - 0.5)
        # a centre computed a rounding error off its cell must not pull in a neighbour
        near = near.withColumn("_u", F.when(F.abs(u - F.round(u)) < 1e-9, F.round(u)).otherwise(u)).withColumn(
            "_v", F.when(F.abs(v - F.round(v)) < 1e-9, F.round(v)).otherwise(v)
        )
        fu, fv = u - F.floor(u), v - F.floor(v)
        corner = lambda dr, dc: F.struct(
            (F.floor(v) + dr).cast("long").alias("_r"),
            (F.floor(u) + dc).cast("long").alias("_c"),
            ((fv if dr else 1 - fv) * (fu if dc else 1 - fu)).alias("_w"),
        )
        pieces = near.select("cell_id", F.inline(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).filter(F.col("_w") > 0)
    else:
        raise ValueError(f"unknown method: {method}")
    values = cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), *layers)
    joined = pieces.join(values, ["_r", "_c"], "left")

    def combined(layer: str):
        total = F.sum(F.col("_w") * F.col(layer))
        if na_rm:
            return total / F.sum(F.when(F.col(layer).isNotNull(), F.col("_w")))
        return F.when(F.count(layer) == F.count(F.lit(1)), total)

    out = joined.groupBy("cell_id").agg(*[combined(layer).alias(layer) for layer in layers])
    return grid.join(out, "cell_id", "left")


def raster_difference(a: DataFrame, b: DataFrame, layers: Sequence[str], cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """``a - b`` for cells present in both."""
    right = b.select(*cell, *[F.col(v).alias(f"_{v}") for v in layers])
    return a.select(*cell, *layers).join(right, list(cell)).select(*cell, *[(F.col(v) - F.col(f"_{v}")).alias(v) for v in layers])


def results_to_grid(results: DataFrame, template: DataFrame, cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Best score on every cell of a template; cells without a result are NULL."""
    best = best_score(results, cell)
    return template.select(*cell).join(best, list(cell), "left")


def hot_spots(
    results: DataFrame, names: DataFrame, source: Grid, template: Grid, edges: DataFrame, locate=None, size: float = 1.0
) -> DataFrame:
    """Number of listed species matching each cell, resampled to ``template`` and cut to the regions."""
    from biosieve.operators.lists import semi_names

    listed = semi_names(results, names, "species", names.columns[0], normalise=True)
    cells = species_per_cell(
        listed.select("species", "score", source.row_of(F.col("target_y")).alias("row"), source.col_of(F.col("target_x")).alias("col")),
        ("row", "col"),
    )
    finer = regrid(cells.withColumn("n_species", F.col("n_species").cast("double")), source, template, ["n_species"], locate)
    return mask(finer, edges, ["n_species"], size)


def standardize_climate(
    cells: DataFrame, source: Grid, target: Grid, layers: Sequence[str], factor: int = 20, locate=None, stats: DataFrame | None = None
) -> DataFrame:
    """Block mean, resampling to the (equal-area) target grid and z-scores in one plan.

    ``source`` is the grid of the input cells; blocks form a grid ``factor`` times coarser.
    """
    blocks = Grid(source.xmin, source.ymax, source.dx * factor, source.dy * factor, -(-source.nrow // factor), -(-source.ncol // factor))
    coarse = block_mean(cells, layers, factor)
    return standardize(regrid(coarse, blocks, target, layers, locate), layers, stats)
