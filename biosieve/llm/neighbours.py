"""Approximate nearest neighbours by a kd-tree over a few stable projections.

Projecting on ``m`` Gaussian directions multiplies a squared distance by a chi-square variable of m
degrees. With d the distance of the k-th best neighbour so far, a point whose projection is farther than
d sqrt(x) is nearer than d with probability 1 - F(x) at most, F being that distribution; the search
over projected neighbours, nearest first, stops where F(x) reaches the wanted confidence.

Inner products become distances by one more coordinate that gives all vectors the norm of the longest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biosieve.llm.texts import per_batch, stored

LEAF = 128


def chi_square_quantile(p: float, m: int) -> float:
    """x with F(x) = p for an even number ``m`` of degrees of freedom."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - tail(mid) < p else (lo, mid)
    return hi


def split(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Indexes of kd-tree leaves of at most ``most`` points: halves along the widest axis, again and again."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            done.append(own)
            continue
        axis = int(np.argmax(np.ptp(points[own], axis=0)))
        order = own[np.argsort(points[own, axis], kind="stable")]
        todo += [order[len(order) // 2 :], order[: len(order) // 2]]
    return done


@dataclass
class Cells:
    """The upper kd-tree: for node i the axis and the cut, its sons being 2i + 1 and 2i + 2; leaves are cells."""

    depth: int
    axes: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, depth: int) -> "Cells":
        axes, cuts = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
        groups = {0: np.arange(len(sample))}
        for node in range(2**depth - 1):
            own = groups.pop(node)
            points = sample[own]
            axis = int(np.argmax(np.ptp(points, axis=0))) if len(own) else 0
            cut = float(np.median(points[:, axis])) if len(own) else 0.0
            axes[node], cuts[node] = axis, cut
            left = points[:, axis] < cut if len(own) else np.zeros(0, bool)
            groups[2 * node + 1], groups[2 * node + 2] = own[left], own[~left]
        return Cells(depth, axes, cuts)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axes[node]] >= self.cuts[node]
            node = 2 * node + 1 + right
        return node - (2**self.depth - 1)

    def within(self, point: np.ndarray, squared: float) -> list[int]:
        """Cells whose box comes within the distance of ``point``."""
        found, todo = [], [(0, np.zeros(len(point)))]
        while todo:
            node, gaps = todo.pop()
            if gaps.sum() > squared:
                continue
            if node >= len(self.axes):
                found.append(node - len(self.axes))
                continue
            axis, gap = self.axes[node], point[self.axes[node]] - self.cuts[node]
            far = gaps.copy()
            far[axis] = max(far[axis], gap * gap)
            todo += [(2 * node + 1, gaps if gap < 0 else far), (2 * node + 2, far if gap < 0 else gaps)]
        return found


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Distinct ``vec_id, v, hi, lo`` of vectors that are finite, not zero and of the commonest length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    rows = rows.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))

    def digest(batch):
        flat = batch.column(1).flatten().to_numpy()
        m = flat.reshape(batch.num_rows, -1)
        d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(r.tobytes()) for r in m), "<i8").reshape(-1, 2)
        return {"vec_id": batch.column(0), "v": batch.column(1), "hi": d[:, 0], "lo": d[:, 1]}

    return per_batch(rows, digest, "vec_id long, v array<double>, hi long, lo long")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.vstack([c.flatten().to_numpy().reshape(len(c), -1) for c in column.chunks if len(c)])


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``i`` of ``q`` and ``j`` of ``x``, summed alike wherever a pair is met."""
    parts = [(q[i[a : a + 8192]] * x[j[a : a + 8192]]).sum(axis=1) for a in range(0, len(i), 8192)]
    return np.concatenate(parts) if parts else np.zeros(0)


def search_cell(points: pa.Table, queries: pa.Table, k: int, longest: float, stretch: float) -> pa.Table:
    """``query_id, cid, score``: up to ``k`` best points of a part of a cell for each query, not below the query's bound.

    Matrix products pick the pairs that can matter, with slack for their rounding; exact scores decide,
    ties going to the smaller ``cid``.
    """
    empty = pa.table({"query_id": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not points.num_rows or not queries.num_rows:
        return empty
    points = points.sort_by("cid")
    x, xp, cid = _matrix(points.column("v")), _matrix(points.column("p")), points.column("cid").to_numpy()
    q, qp, query = _matrix(queries.column("v")), _matrix(queries.column("p")), queries.column("query_id").to_numpy()
    bound = queries.column("bound").to_numpy()
    norm = np.linalg.norm(q, axis=1)
    slack = 1e-12 * norm * longest
    leaves = split(xp, LEAF)
    low = np.array([xp[leaf].min(axis=0) for leaf in leaves])
    high = np.array([xp[leaf].max(axis=0) for leaf in leaves])
    outside = np.zeros((len(q), len(leaves)))
    for axis in range(xp.shape[1]):
        gap = np.maximum(np.maximum(low[:, axis] - qp[:, axis, None], qp[:, axis, None] - high[:, axis]), 0)
        outside += gap * gap
    order = np.argsort(outside, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), -1, np.int64)
    for turn in range(len(leaves)):
        leaf = order[:, turn]
        kth = np.maximum(best[:, -1], bound)
        reach = np.where(np.isfinite(kth), np.maximum(2 * longest**2 - 2 * longest * (kth - slack) / norm, 0), np.inf)
        active = np.flatnonzero(outside[np.arange(len(q)), leaf] <= stretch * reach)
        if not len(active):
            break
        active = active[np.argsort(leaf[active], kind="stable")]
        cuts = np.flatnonzero(np.diff(leaf[active])) + 1
        for own in np.split(active, cuts):
            inside = leaves[leaf[own[0]]]
            rough = q[own] @ x[inside].T
            least = kth[own]
            if len(inside) > k:
                least = np.maximum(least, np.partition(rough, len(inside) - k, axis=1)[:, len(inside) - k])
            row, column = np.nonzero(rough >= (least - 2 * slack[own])[:, None])
            if not len(row):
                continue
            new = inside[column]
            held_row, held = np.nonzero(who[own] >= 0)
            rows = np.concatenate([held_row, row])
            ids = np.concatenate([who[own][held_row, held], new])
            scores = np.concatenate([best[own][held_row, held], _exact(q[own], x, row, new)])
            sort = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[sort], ids[sort], scores[sort]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < k
            best[own[rows[kept]], place[kept]], who[own[rows[kept]], place[kept]] = scores[kept], ids[kept]
    i, j = np.nonzero((who >= 0) & (best >= bound[:, None]))
    return pa.table({"query_id": query[i], "cid": cid[who[i, j]], "score": best[i, j]}) if len(i) else empty


def nearest(
    vectors: DataFrame, k: int = 20, is_query=None, id_col: str = "vec_id", vector: str = "embedding",
    projections: int = 8, confidence: float = 0.98, cell_rows: int = 8192, sample_rows: int = 50_000, seed: int = 3,
) -> DataFrame:
    """The ``k`` vectors with the largest inner product for each query, nearest first.

    Returns ``query_id, rank, vec_id, score``. Queries are the rows that the condition ``is_query`` picks
    (all by default); candidates are all rows but the query's own id; among the rows found, ties of exact
    scores go to the smaller vec_id, also where they cross the k-th place.
    Scores are inner products of the original vectors in double precision. Recall is at least
    ``confidence`` in expectation.

    Equal vectors form a class that is searched once; as ties go to the smaller id, its ``k`` + 1 smallest
    ids hold all that any query can need. The upper kd-tree is fitted on about ``sample_rows`` projected
    vectors and cuts the space into cells of about ``cell_rows`` (4096 cells at most, which then hold more);
    every vector is put into its cell.
    A query searches its own cell, then all cells within the stopping radius. A cell in which many
    vectors or queries meet is cut into parts on both sides.

    Vectors that are null, zero, of another length than most, or hold null or non-finite components take
    no part, nor do rows without an id. Repeated rows count once. Fewer candidates than ``k`` give all of
    them; no vectors or no queries give no rows; other columns serve ``is_query`` only.
    """
    rows = stored(usable(vectors, id_col, vector), "vectors")
    first = W.partitionBy("hi", "lo").orderBy("vec_id")
    few = rows.select("hi", "lo", "vec_id").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    groups = few.groupBy("hi", "lo").agg(F.min("vec_id").alias("cid"), F.collect_list("vec_id").alias("ids"))  # k + 1 ids at most
    one = rows.join(groups, (rows.hi == groups.hi) & (rows.lo == groups.lo) & (rows.vec_id == groups.cid)).select("cid", "v", "ids").dropDuplicates(["cid", "ids"])

    stats = rows.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + x * x)")).alias("m"), F.max(F.size("v")).alias("d")).first()
    longest, dim = math.sqrt(stats["m"] or 1.0), stats["d"] or 1
    rng = np.random.Generator(np.random.Philox(seed))
    directions = rng.standard_normal((dim + 1, projections))
    stretch = chi_square_quantile(confidence, projections)

    def project(v: np.ndarray, query: bool) -> np.ndarray:
        squared = np.einsum("ij,ij->i", v, v)
        if query:
            return (v * (longest / np.sqrt(squared))[:, None]) @ directions[:-1]
        return v @ directions[:-1] + np.sqrt(np.maximum(longest**2 - squared, 0))[:, None] * directions[-1]

    def placed(batch):
        v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        return {"cid": batch.column(0), "v": batch.column(1), "ids": batch.column(2), "p": list(project(v, False))}

    points = stored(per_batch(one, placed, "cid long, v array<double>, ids array<long>, p array<double>"), "projected")
    n = points.count()
    part = min(1.0, sample_rows / max(n, 1))
    draw = F.shiftrightunsigned(F.xxhash64("cid", F.lit(seed)), 11) / F.lit(float(1 << 53))
    sample = np.array([r["p"] for r in points.filter(draw < part).select("p").collect()], dtype=np.float64).reshape(-1, projections)
    cells = Cells.fit(sample, max(0, min(12, math.ceil(math.log2(max(n, 1) / cell_rows)))) if n > cell_rows else 0)

    def into_cell(batch):
        p = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
        return {"cid": batch.column(0), "v": batch.column(1), "p": batch.column(2), "cell": cells.of(p).astype(np.int32)}

    point_cells = stored(per_batch(points.select("cid", "v", "p"), into_cell, "cid long, v array<double>, p array<double>, cell int"), "cells")
    chosen = vectors if is_query is None else vectors.filter(is_query)
    wanted = chosen.select(F.col(id_col).cast("long").alias("vec_id")).distinct()

    def ask(batch):
        v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
        p = project(v, True)
        return {"query_id": batch.column(0), "v": batch.column(1), "p": list(p), "cell": cells.of(p).astype(np.int32)}

    asked = rows.join(wanted, "vec_id", "left_semi").dropDuplicates(["vec_id", "hi", "lo"]).select("vec_id", "v")
    queries = stored(per_batch(asked, ask, "query_id long, v array<double>, p array<double>, cell int"), "queries")

    def searched(visits: DataFrame) -> DataFrame:
        """Best points for ``query_id, v, p, bound, cell``, the cells being divided on both sides where crowded."""
        blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / cell_rows)).cast("int")
        sizes = point_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("np")).join(visits.groupBy("cell").agg(F.count(F.lit(1)).alias("nq")), "cell")
        sizes = sizes.select("cell", blocks("np").alias("np"), blocks("nq").alias("nq"))
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
        left = point_cells.join(sizes, "cell").withColumn("i", F.pmod(F.xxhash64("cid"), F.col("np"))).withColumn("j", upto("nq"))
        right = visits.join(sizes, "cell").withColumn("j", F.pmod(F.xxhash64("query_id"), F.col("nq"))).withColumn("i", upto("np"))
        left, right = left.select("cell", "i", "j", "cid", "v", "p"), right.select("cell", "i", "j", "query_id", "v", "p", "bound")
        key = ["cell", "i", "j"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
            lambda a, b: search_cell(a, b, k + 1, longest, stretch), "query_id long, cid long, score double"
        )

    home = stored(searched(queries.withColumn("bound", F.lit(float("-inf")))), "home-hits")
    # with k + 1 classes found, the worst of them bounds the k-th best neighbour, whichever is the query itself
    bounds = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bounded = queries.join(bounds, "query_id", "left").withColumn("bound", F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(float("-inf"))))

    def visit(batch):
        v, p = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (1, 2))
        norm = np.linalg.norm(v, axis=1)
        out = []
        for point, length, own, bound in zip(p, norm, batch.column(3).to_numpy(), batch.column(4).to_numpy()):
            squared = stretch * max(2 * longest**2 - 2 * longest * bound / length, 0.0) if np.isfinite(bound) else math.inf
            out.append([c for c in cells.within(point, squared) if c != own])
        return {"query_id": batch.column(0), "v": batch.column(1), "p": batch.column(2), "bound": batch.column(4), "cells": out}

    schema = "query_id long, v array<double>, p array<double>, bound double, cells array<int>"
    visits = per_batch(bounded.select("query_id", "v", "p", "cell", "bound"), visit, schema).withColumn("cell", F.explode("cells")).drop("cells")
    hits = home.unionByName(searched(stored(visits, "visits")))
    named = hits.join(points.select("cid", "ids"), "cid").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    best = named.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
