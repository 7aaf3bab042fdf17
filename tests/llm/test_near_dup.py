import random
from collections import defaultdict

import pytest

import __spark_entry__ as E
from biosieve.llm import graph, near_dup
from biosieve.llm.graph import components
from biosieve.llm.near_dup import drop_near_duplicates, near_duplicates, table_width


def shingles(text, size):
    words = ((text or "").encode().lower()).split()
    size = min(size, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def brute(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and None not in (a, b) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(((d, len(x), root(d) if d is not None else None, d is None or root(d) == d) for d, x in sets), key=str)


def result(docs, size, percent):
    return sorted(map(tuple, near_duplicates(docs, size, percent).collect()), key=str)


def test_query(spark, documents, sf_dir):
    got = sorted(map(tuple, E.queries()["op5_tensored_minhash"](spark, sf_dir).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in documents.collect()], 3, 85)


def test_odd(odd, odd_rows, empty):
    got = {r[0]: r for r in result(odd, 5, 80)}
    assert got[1][2:] == (1, True) and got[6][2:] == (1, False)
    assert got[2] == (2, 0, 2, True) and got[4] == (4, 0, 4, True)
    assert got[None][2:] == (None, True)
    assert len(result(odd, 5, 80)) == len(odd_rows)
    assert result(empty, 5, 80) == []
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 8]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_chains_and_shared_passages(spark, size, percent):
    """Copies drifting word by word (linked only over chains), and different texts around one passage."""
    rng = random.Random(percent)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, text = [], [word() for _ in range(90)]
    for i in range(60):
        text = list(text)
        text[rng.randrange(90)] = word()
        rows.append((i, " ".join(text)))
    passage = [word() for _ in range(60)]
    for i in range(60, 140):
        rows.append((i, " ".join([word() for _ in range(rng.randrange(3, 12))] + passage + [word() for _ in range(rng.randrange(3, 12))])))
    rng.shuffle(rows)
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), size, percent) == brute(rows, size, percent)


def test_crossing_blocks(spark):
    """A bucket in blocks gives the pairs that bounds allow, whatever the block size."""
    rng = random.Random(1)
    rows = []
    for cid in range(40):
        s = near_dup.word_shingles(" ".join(f"x{(cid // 4) * 100 + i}" if i % 50 else f"y{rng.randrange(9)}" for i in range(100)).encode(), 3)
        rows.append((7, 40, cid, 0, cid, len(s), near_dup.parity_bits(s)))
    df = spark.createDataFrame(rows, "key long, size long, cid long, rep long, component long, n long, bits binary")
    whole, cut = (sorted(map(tuple, near_dup._crossing(df, 85, block).collect())) for block in (4096, 7))
    assert whole == cut and whole and all(a // 4 == b // 4 for a, b in whole)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items() if x in linked}


def test_width():
    assert table_width(85, 1e-4) == 8 and table_width(80, 1e-4) == 10


def test_components_write_few_files(spark, monkeypatch):
    """Links of a small input are not dealt over a file for each shuffle partition, round after round."""
    parts, real = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: parts.append((out := real(df)).rdd.getNumPartitions()) or out)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "a long, b long")).collect()}
        assert got == {i: 1 for i in range(1, 41)}
        assert len(parts) > 2 and set(parts[1:]) == {1}
        parts.clear()
        monkeypatch.setattr(graph, "_EDGES", 10)  # more links, more files
        components(spark.createDataFrame([(1, i) for i in range(2, 33)], "a long, b long"))
        assert set(parts[1:]) == {4}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
