import math

import numpy as np

import __spark_entry__ as E
from pyspark.sql import functions as F
from biosieve.llm.neighbours import Cells, chi_square_quantile, nearest, split


def brute(rows, queries, k):
    out = {}
    for q, v in rows:
        if q in queries:
            scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)[:k]
            out[q] = [(i, -s) for s, i in scored]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for hits in out.values():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
    return {q: [(i, s) for _, i, s in hits] for q, hits in out.items()}


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in hits}) for q, hits in want.items()) / max(1, sum(map(len, want.values())))


def test_query(spark, sf_dir):
    rows = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    got = found(E.queries()["op1_projected_neighbours"](spark, sf_dir))
    assert set(got) == set(want) and all(len(h) == 20 for h in got.values()) and recall(got, want) >= 0.9


def test_many_cells(spark):
    """Norms differ, cells and blocks are small: the search prunes, and still finds nearly all."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.1 * rng.standard_normal(16)) * rng.uniform(0.5, 2)) for i in range(1500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = found(nearest(df, 10, F.col("vec_id") % 20 == 0, cell_rows=100, sample_rows=400))
    want = brute(rows, set(range(0, 1500, 20)), 10)
    assert recall(got, want) >= 0.9
    for q, hits in got.items():
        assert all(math.isclose(s, float(np.dot(rows[q][1], rows[i][1])), rel_tol=1e-12) for i, s in hits)


def test_ties_copies_and_odd_vectors(spark):
    same = [1.0, 2.0, 0.5]
    rows = [(i, same) for i in range(60)] + [(100, [3.0, 0.0, 0.0]), (101, None), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0]), (104, [1.0, float("nan"), 0.0])]
    rows += [(105, [float("inf"), 1.0, 1.0]), (106, [1.0, 1.0]), (None, same), (5, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS hi", "2 AS cid", "3 AS query_id")
    got = found(nearest(df, 4))
    usable = [(i, np.array(v)) for i, v in {(i, tuple(v)) for i, v in rows[:61]}]
    want = brute(usable, {i for i, _ in usable}, 4)
    assert got == want
    assert found(nearest(df.limit(0), 4)) == {}
    assert found(nearest(df.filter("vec_id IN (1, 100)"), 4)) == {1: [(100, 3.0)], 100: [(1, 3.0)]}


def test_tree():
    points = np.random.default_rng(1).standard_normal((500, 4))
    leaves = split(points, 30)
    assert sorted(np.concatenate(leaves).tolist()) == list(range(500)) and max(map(len, leaves)) <= 30
    cells = Cells.fit(points, 4)
    own = cells.of(points)
    for q in points[:20]:
        inside = set(cells.within(q, 0.5))
        assert set(own[((points - q) ** 2).sum(axis=1) <= 0.5].tolist()) <= inside


def test_quantile():
    assert abs(chi_square_quantile(0.95, 8) - 15.507) < 1e-3


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, float(a), float(b)]) for i, (a, b) in enumerate(rng.normal(size=(300, 2)), 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for cell_rows in (8192, 64):
        got = found(nearest(vectors, 20, F.col("vec_id") == 0, cell_rows=cell_rows, confidence=1 - 1e-9))
        assert got == {0: [(i, 1.0) for i in range(1, 21)]}


def test_ties_within_a_cell():
    import pyarrow as pa

    from biosieve.llm.neighbours import search_cell

    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (1000, 4)).astype(float)
    cid = rng.permutation(1000)
    q = rng.integers(-2, 3, (30, 4)).astype(float)
    q[~q.any(axis=1)] = 1
    table = lambda name, ids, m, **more: pa.table({name: ids, "v": list(m), "p": list(m[:, :2]), **more})
    out = search_cell(table("cid", cid, x), table("query_id", np.arange(30), q, bound=np.full(30, -np.inf)), 21, 4.0, 1e6)
    got = {}
    for r in out.to_pylist():
        got.setdefault(r["query_id"], []).append((-r["score"], r["cid"]))
    for i in range(30):
        assert sorted(got[i]) == sorted(zip((-(x @ q[i])).tolist(), cid.tolist()))[:21]
