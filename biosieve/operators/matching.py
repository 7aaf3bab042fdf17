"""Climate matching: how well target cells resemble the climate where a species lives."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biosieve.session import spread, task_count
from biosieve.sources.geography import Grid

# Fixed value: the largest climate distance with a non-zero score.
MATCH_RADIUS = 0.9

TARGET = ("target", "target_x", "target_y")


def with_all_layers(df: DataFrame, layers: Sequence[str]) -> DataFrame:
    """Rows in which no layer is missing.

    One plain condition per layer: a single condition over all of them would be rewritten by the
    optimizer once per combination of renamed layers.
    """
    return df.filter(reduce(lambda a, b: a & b, [F.col(v).isNotNull() for v in layers]))


def match_score(squared: str | Column, n_layers: int) -> Column:
    """Score 0 to 10 of a summed squared difference over ``n_layers`` z-scored layers.

    With d = sqrt(sum / n_layers) the score is max(0, floor(10 (1 - d))), d rounded to 9 places.
    """
    s = F.col(squared) if isinstance(squared, str) else squared
    d = F.round(F.sqrt(s / n_layers), 9)
    return F.greatest(F.lit(0), F.floor(F.round(10 * (1 - d), 8))).cast("int")


def point_climate(
    points: DataFrame, cells: DataFrame, grid: Grid, layers: Sequence[str], x: str = "x", y: str = "y"
) -> DataFrame:
    """Points with the climate of the cell that holds them; points outside or without climate are dropped.

    ``x, y`` are in the grid's coordinates (project longitude and latitude first). A place with
    very many points meets one cell row, so adaptive execution can split the point side.
    """
    keyed = points.withColumn("_r", grid.row_of(F.col(y))).withColumn("_c", grid.col_of(F.col(x)))
    known = with_all_layers(cells, layers).select(F.col("row").alias("_r"), F.col("col").alias("_c"), "cell_id", *layers)
    return keyed.join(known, ["_r", "_c"]).drop("_r", "_c")


def principal_axes(cells: DataFrame, layers: Sequence[str], count: int = 2) -> list[list[float]]:
    """Orthonormal directions along which the z-scored layers spread most, for use as join keys.

    One aggregation yields the matrix of summed products (layers x layers numbers), whose size does
    not depend on the data. Any orthonormal axes give the same scores; good ones prune more pairs.
    """
    k = len(layers)
    upper = F.expr("flatten(transform(sequence(1, size(v)), i -> transform(slice(v, i, size(v)), w -> v[i - 1] * w)))")
    rows = (
        with_all_layers(cells, layers)
        .select(F.array(*layers).alias("v"))
        .select(F.posexplode(upper).alias("at", "product"))
        .groupBy("at")
        .agg(F.sum("product").alias("s"))
        .collect()
    )
    products = np.zeros((k, k))
    i, j = np.triu_indices(k)
    for row in rows:
        products[i[row["at"]], j[row["at"]]] = products[j[row["at"]], i[row["at"]]] = row["s"]
    return np.linalg.eigh(products)[1][:, ::-1].T[:count].tolist()


def _nearest(occ: pa.Table, tgt: pa.Table, layers: list[str], limit: float, sensitivity: int) -> pa.Table:
    """Smallest squared distances (up to ``sensitivity`` each) of every species to every target of a block.

    Distances are accumulated layer by layer over slices of targets, small enough to stay in cache.
    """
    matrix = lambda table, prefix="": np.column_stack([table.column(prefix + v).to_numpy() for v in layers])
    species = occ.column("species").combine_chunks().dictionary_encode()
    codes = species.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    if sensitivity > 1:
        order = np.repeat(order, np.minimum(occ.column("_n").to_numpy()[order], sensitivity))
    codes = codes[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    ends = np.append(starts[1:], len(codes))
    o, t = np.ascontiguousarray(matrix(occ)[order].T), np.ascontiguousarray(matrix(tgt, "t_").T)
    width = max(16, 500_000 // max(1, len(codes)))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for first in range(0, t.shape[1], width):
        part = t[:, first : first + width]
        d2 = np.zeros((o.shape[1], part.shape[1]))
        gap = np.empty_like(d2)
        for k in range(len(layers)):
            np.subtract(o[k, :, None], part[k, None, :], out=gap)
            np.multiply(gap, gap, out=gap)
            d2 += gap
        if sensitivity == 1:
            best = np.minimum.reduceat(d2, starts, axis=0)
            i, j = np.nonzero(best <= limit)
            found.append((codes[starts[i]], first + j, best[i, j]))
        else:
            for a, z in zip(starts, ends):
                best = np.partition(d2[a:z], min(sensitivity, z - a) - 1, axis=0)[:sensitivity]
                r, j = np.nonzero(best <= limit)
                found.append((np.full(len(r), codes[a]), first + j, best[r, j]))
    i, j, d = (np.concatenate(x) for x in zip(*found))
    hit = tgt.select([f"t_{c}" for c in TARGET]).take(pa.array(j))
    return pa.table({"species": species.dictionary.take(pa.array(i)), **{c: hit.column(f"t_{c}") for c in TARGET}, "_d2": d})


def climate_match(
    occurrences: DataFrame,
    targets: DataFrame,
    layers: Sequence[str],
    sensitivity: int = 1,
    axes: list[list[float]] | None = None,
    fill_zero: bool = False,
    rows_per_block: int = 4000,
) -> DataFrame:
    """Score of every target cell for every species, non-zero scores only unless ``fill_zero``.

    ``occurrences`` holds ``species`` and z-scored layers, optionally ``n`` copies per row; species
    with a single record should be removed before. ``targets`` holds ``target, target_x, target_y``
    and the same layers. Rows with a missing layer take no part. ``sensitivity=k`` returns the k
    best scores (column ``rank``), counting repeated occurrences.

    A pair scores only within ``MATCH_RADIUS``, and projecting on orthonormal axes never lengthens
    a distance. Both sides are therefore cut into bins one radius wide along the axes; an occurrence
    sits in one bin and a target visits the bins within reach, which finds every scoring pair
    exactly once. Crowded bins are divided on both sides into blocks of about ``rows_per_block``
    rows, a species staying together unless it alone exceeds a block, so the work per block is
    level under any skew. Each block yields the smallest distances per species and cell, computed
    on arrays: pair by pair in a relational join the same work took about ten times as long.
    """
    layers = list(layers)
    k = len(layers)
    radius = MATCH_RADIUS * math.sqrt(k) + 1e-6
    axes = axes if axes is not None else principal_axes(targets, layers)
    bins = [f"_b{i}" for i in range(len(axes))]

    # copies of a climate within a species add nothing but their number
    copies = F.sum("n") if "n" in occurrences.columns else F.count(F.lit(1))
    occ = with_all_layers(occurrences.filter(F.col("species").isNotNull()), layers).groupBy("species", *layers).agg(copies.alias("_n"))
    tgt = with_all_layers(targets, layers).select(*TARGET, *layers)

    # keys are never NULL and say so: the optimizer would otherwise push NULL tests over all layers
    # below their renaming and rewrite them for every combination of names (see with_all_layers)
    for b, axis in zip(bins, axes):
        p = F.expr(" + ".join(f"`{v}` * {float(w)!r}D" for v, w in zip(layers, axis)))
        occ = occ.withColumn(b, F.coalesce(F.floor(p / radius).cast("int"), F.lit(0)))
        reach = F.sequence(F.floor((p - radius) / radius).cast("int"), F.floor((p + radius) / radius).cast("int"))
        tgt = tgt.withColumn(b, F.explode_outer(reach))

    # blocks per bin, from the row counts of both sides; bins with one side only drop out
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / rows_per_block)).cast("int")
    per_species = occ.groupBy(*bins, "species").agg(F.count(F.lit(1)).alias("_sn"))
    sizes = (
        per_species.groupBy(*bins).agg(F.sum("_sn").alias("_on"))
        .join(tgt.groupBy(*bins).agg(F.count(F.lit(1)).alias("_tn")), bins)
        .select(*bins, blocks("_on").alias("_ob"), blocks("_tn").alias("_tb"))
    )
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = F.pmod(F.xxhash64(*layers), blocks("_sn"))
    left = (
        occ.join(per_species.join(sizes, bins), [*bins, "species"])
        .withColumn("_i", F.pmod(F.pmod(F.xxhash64("species"), F.col("_ob")) + share, F.col("_ob")).cast("int"))
        .withColumn("_j", upto("_tb"))
    )
    right = tgt.join(sizes, bins).withColumn("_j", F.pmod(F.xxhash64(*TARGET), F.col("_tb")).cast("int")).withColumn("_i", upto("_ob"))
    key = [*bins, "_i", "_j"]
    limit = radius * radius

    # both sides may stem from one table of cells, so the target's columns get names of their own
    own = [F.col(c).alias(f"t_{c}") for c in (*TARGET, *layers)]
    near = (
        spread(left.select(*key, "species", "_n", *layers), *key)
        .groupBy(*key)
        .cogroup(spread(right.select(*key, *own), *key).groupBy(*key))
        .applyInArrow(
            lambda o, t: _nearest(o, t, layers, limit, sensitivity),
            "species string, target string, target_x double, target_y double, _d2 double",
        )
    )
    if sensitivity == 1:
        best = near.groupBy("species", *TARGET).agg(F.min("_d2").alias("_d2"))
        scored = best.select("species", *TARGET, match_score("_d2", k).alias("score"))
    else:
        order = F.row_number().over(W.partitionBy("species", *TARGET).orderBy("_d2"))
        ranked = near.withColumn("rank", order).filter(F.col("rank") <= sensitivity)
        scored = ranked.select("species", *TARGET, "rank", match_score("_d2", k).alias("score"))
    scored = scored.filter(F.col("score") > 0)
    return complete_scores(scored, occ.groupBy("species").agg(F.sum("_n").alias("n")), tgt.select(*TARGET).distinct(), sensitivity) if fill_zero else scored


def complete_scores(scored: DataFrame, species: DataFrame, cells: DataFrame, sensitivity: int = 1) -> DataFrame:
    """Add a zero score for each species and cell without one (the size of the result, by definition).

    A species (``species, n`` occurrences) has as many ranks in a cell as occurrences, ``sensitivity`` at most.

    Species are spread over as many keys as tasks and the cell list visits each key, so the rows
    to produce are shared evenly without broadcasting either list.
    """
    parts = task_count(species.sparkSession)
    a = species.withColumn("_p", F.pmod(F.xxhash64("species"), F.lit(parts)).cast("int"))
    b = cells.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["species", *TARGET]
    full = a.join(b, "_p")
    if sensitivity > 1:
        full = full.withColumn("rank", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(sensitivity)).cast("int"))))
        keys.append("rank")
    return full.select(*keys).join(scored, keys, "left").withColumn("score", F.coalesce("score", F.lit(0)))


def scenario_change(current: DataFrame, future: DataFrame, key: Sequence[str] = ("species", "target_x", "target_y")) -> DataFrame:
    """Scores of two scenarios side by side per species and cell with ``diff = future - current``.

    Cells of one scenario only keep NULL on the other side. The target label is the current
    scenario's, or the future's where only that has the cell.
    """
    a = current.select(*key, F.col("target").alias("_ta"), F.col("score").alias("score_current"))
    b = future.select(*key, F.col("target").alias("_tb"), F.col("score").alias("score_future"))
    return (
        a.join(b, list(key), "full_outer")
        .withColumn("target", F.coalesce("_ta", "_tb"))
        .withColumn("diff", F.col("score_future") - F.col("score_current"))
        .select(*key, "target", "score_current", "score_future", "diff")
    )
