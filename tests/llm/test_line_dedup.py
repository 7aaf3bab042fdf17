import hashlib
import random

import __spark_entry__ as E
from biosieve.llm.line_dedup import LineRuns, dedup_lines, kept_digest
from tests.oracle import compare, connect


def brute(rows):
    owner = {}
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 10:
                owner[key(line)] = min(doc, owner.get(key(line), doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if doc is None or owner.get(key(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def result(docs, **how):
    return sorted(map(tuple, kept_digest(dedup_lines(docs, **how)).collect()), key=str)


def test_query(spark, sf_dir):
    assert compare(spark, connect(sf_dir), sf_dir, E.queries()["op2_line_runs"], E.oracle_sql()["op2_line_runs"]) is None


def test_odd(odd, odd_rows, empty):
    assert result(odd) == brute([r[:2] for r in odd_rows])
    assert result(empty) == []


def test_batches_do_not_matter(spark):
    rng = random.Random(4)
    lines = [f"a line with number {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(lines, k=4))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, fanout in ((1, 2), (5, 2), (7, 3)):
        assert result(docs, batches=batches, fanout=fanout) == brute(rows)


def test_levels(spark):
    index = LineRuns(spark, fanout=2, buckets=2)
    for i in range(5):
        index.add(spark.createDataFrame([(10 * i + j, 0, (i + j) % 7) for j in range(3)], "doc_id long, hi long, lo long"))
    assert [len(level) for level in index.levels] == [1, 0, 1]
    owners = {(r.hi, r.lo): r.owner for r in index.owners().collect()}
    assert owners == {(0, k): min(10 * i + j for i in range(5) for j in range(3) if (i + j) % 7 == k) for k in range(7)}
    index.clear()
