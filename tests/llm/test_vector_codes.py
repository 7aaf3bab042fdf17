import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from biosieve.llm.vector_codes import codable, compress, decode, digest, equal_average_search, first_codebooks, refined


def nearest(x, entries):
    return min(range(len(entries)), key=lambda i: (sum((a - b) ** 2 for a, b in zip(x, entries[i])), i))


def brute_force(rows, parts=16, size=64, rounds=2):
    """``rows`` are (id, label, integer vector); everything in plain integers."""
    firsts = {}
    for i, _, v in rows:
        if i is not None:
            firsts[i] = min(firsts.get(i, v), v)
    k = len(rows[0][2]) // parts
    cut = lambda v: [v[p * k : p * k + k] for p in range(parts)]
    books = [[cut(firsts[i])[p] for i in sorted(firsts)[:size]] for p in range(parts)]
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for _, _, v in rows:
                own[nearest(cut(v)[p], book)].append(cut(v)[p])
            new.append([[sum(c) // len(x) for c in zip(*x)] if x else e for x, e in zip(own, book)])
        books = new
    out = []
    for i, label, v in rows:
        at = [nearest(x, book) for x, book in zip(cut(v), books)]
        error = sum((a - b) ** 2 for x, book, j in zip(cut(v), books, at) for a, b in zip(x, book[j]))
        out.append((i, "".join(f"{j:02x}" for j in at), error, label))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    per_label = {}
    for r in out:
        per_label[r[3]] = per_label.get(r[3], 0) + r[2]
    return sorted(((i, code, e, per_label[label], sha) for i, code, e, label in out), key=str)


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(4)
    for k, spread, m in ((4, 3, 64), (1, 5, 9), (4, 1000, 64), (3, 1, 1)):
        entries = rng.integers(-spread, spread + 1, (m, k))
        x = rng.integers(-spread, spread + 1, (400, k))
        who, distance = equal_average_search(x, entries)
        want = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (who == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_search_of_nothing():
    who, distance = equal_average_search(np.zeros((0, 4), np.int64), np.zeros((3, 4), np.int64))
    assert len(who) == len(distance) == 0


def test_query(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150)
    rows = [(r.vec_id, r.label, [int(np.floor(256 * float(x))) for x in r.embedding]) for r in vectors.collect()]
    ids = [r[0] for r in rows]
    got = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("vec_id").isin(ids)))
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows)
    assert "op13_equal_average_codes" in E.oracle_sql()


ODD = [
    (1, [0.5, -0.25, 3.0, 1e-9], 1), (1, [0.25, -0.25, 3.0, 1e-9], 1), (2, [0.0, 0.0, 0.0, 0.0], None), (2, [0.0, 0.0, 0.0, 0.0], None),
    (3, None, 1), (4, [float("nan"), 0.0, 0.0, 0.0], 1), (5, [float("inf"), 0.0, 0.0, 0.0], 1), (6, [None, 0.0, 0.0, 0.0], 1), (7, [1.0, 1.0], 1),
    (None, [0.5, 0.25, -7.0, 2.0], None), (9, [-0.001, 900.0, -900.0, 0.0], 2),
]


def test_odd(spark):
    df = spark.createDataFrame(ODD, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS code", "1 AS error", "2 AS v").repartition(3)
    kept = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in ODD if v and len(v) == 4 and None not in v and np.isfinite(v).all()]
    for size in (64, 2):
        got = compress(df, parts=2, size=size)
        assert sorted(map(tuple, got.collect()), key=str) == brute_force(kept, 2, size)
    assert compress(df.limit(0)).collect() == [] and compress(df.filter("vec_id IS NULL"), parts=2).collect() == []
    with pytest.raises(ValueError):
        compress(df, parts=3)


def test_many_equal_vectors_and_one_label(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 2.0] if i % 3 else [rng.uniform(-1, 1), rng.uniform(-1, 1)], 5 if i % 7 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    want = brute_force([(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows], 2, 16)
    assert sorted(map(tuple, compress(df, parts=2, size=16).collect()), key=str) == want


def test_decode_is_near(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows, _ = codable(vectors, "vec_id", "embedding", "label", 16)
    books = first_codebooks(rows, 64, 16)
    for _ in range(2):
        books = refined(rows, books)
    codes = compress(vectors)
    assert codes.first()["codebooks_sha256"] == digest(books)
    errors = decode(codes, books).join(vectors, "vec_id").select("error", "decoded", "embedding").limit(50).collect()
    for r in errors:
        exact = sum((a - b) ** 2 for a, b in zip(r["decoded"], r["embedding"]))
        # half a step is lost in each component on both sides at most
        assert abs(exact**0.5 - r["error"] ** 0.5 / 256) <= len(r["decoded"]) ** 0.5 / 512 + 1e-9
