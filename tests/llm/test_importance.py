import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

import __spark_entry__ as E
from biosieve.llm.importance import normal_words, resample, run_checksums

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall((text or "").encode().lower())
    return [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def brute_force(docs, target, percent=5, least=20):
    """``(doc_id, n_features, weight, score, rank)`` straight from the definition."""
    found = [features(text) for _, text in docs]
    raw, wanted = Counter(), Counter()
    for runs, _ in found:
        raw.update(zlib.crc32(r) % 10000 for r in runs)
    for text in target:
        wanted.update(zlib.crc32(r) % 10000 for r in features(text)[0])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    out = []
    for (doc, _), (runs, n) in zip(docs, found):
        weight = sum(gain[zlib.crc32(r) % 10000] for r in runs)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(runs), weight, score, None, n])
    open_ = sorted((r for r in out if r[5] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(open_[: percent * len(open_) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("text", ["", "one", "one two", "A b,c  D\n\ne", "x--y_z 12é ÉÀあ end.", " ", "\0a\0", "a" * 5000 + " b"])
def test_runs(text):
    want, n = features(text)
    words = normal_words(text.encode())
    assert sorted(run_checksums(words)) == sorted(map(zlib.crc32, want)) and (words.count(b" ") + 1 if words else 0) == n


def test_query(spark, documents, sf_dir):
    got = E.queries()["op12_overlapped_resampling"](spark, sf_dir).collect()
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert sorted(map(tuple, got), key=str) == brute_force([(r.doc_id, r.text) for r in documents.collect()], target)
    assert sum(r["rank"] is not None for r in got) > 0


def test_odd(spark, odd, odd_rows, empty):
    got = resample(odd, empty, percent=60, least_words=6)
    assert sorted(map(tuple, got.collect()), key=str) == brute_force([r[:2] for r in odd_rows], [], 60, 6)
    assert resample(empty, odd).collect() == []
    ranks = [r["rank"] for r in got.collect() if r["rank"] is not None]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))
    # the repeated row of document 6 is drawn twice, side by side
    twice = sorted(r["rank"] for r in resample(odd, empty, percent=100, least_words=1).collect() if r["doc_id"] == 6)
    assert len(twice) == 2 and twice[1] == twice[0] + 1


def test_ties_go_to_the_smaller_id(spark):
    """Equal scores, forced by equal noise of equal ids, do not hide rows; among equal texts the noise decides."""
    docs = spark.createDataFrame([(d, "same words again " * 10) for d in range(200)], "doc_id long, text string")
    drawn = [r for r in resample(docs, docs).collect() if r["rank"]]
    assert [r["doc_id"] for r in sorted(drawn, key=lambda r: r["rank"])] == [r["doc_id"] for r in sorted(drawn, key=lambda r: (-r["score"], r["doc_id"]))]
    assert len(drawn) == 10
