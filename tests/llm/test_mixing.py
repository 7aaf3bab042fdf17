import warnings
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as E
from biosieve.llm.mixing import ALPHA, MARGINS, mixing_weights, raked, sample_mix


def margins(rows, mass):
    out = defaultdict(float)
    for r in rows:
        for m in MARGINS:
            out[m, r[m]] += mass(r)
    return out


def fit(cells, target, rounds=500):
    """Raking by hand on a dictionary of cells."""
    mass = {k: float(n) for k, n in cells.items()}
    for _ in range(rounds):
        for i in range(3):
            sums = defaultdict(float)
            for k, x in mass.items():
                sums[k[i]] += x
            mass = {k: x * target[i][k[i]] / sums[k[i]] if sums[k[i]] else 0.0 for k, x in mass.items()}
    return mass


def test_query(spark, documents, sf_dir):
    rows = E.queries()["op7_raked_mix"](spark, sf_dir).collect()
    texts = {r.doc_id: r for r in documents.collect()}
    assert len(rows) == len(texts)
    assert all(r.n_tokens == len(texts[r.doc_id].text.encode().split()) for r in rows)
    cells = defaultdict(int)
    for r in rows:
        cells[r.source, r.lang, r.topic] += r.n_tokens
    target = []
    for i, m in enumerate(MARGINS):
        sums = defaultdict(int)
        for k, n in cells.items():
            sums[k[i]] += n
        powers = {g: n ** ALPHA[m] for g, n in sums.items()}
        target.append({g: x / sum(powers.values()) for g, x in powers.items()})
    want, total = fit(cells, target), sum(cells.values())
    for r in rows:
        k = r.source, r.lang, r.topic
        assert np.isclose(r.weight, want[k] * total / cells[k], rtol=5e-3)
    top = max(r.weight for r in rows)
    assert all(np.isclose(r.probability, r.weight / top) for r in rows)
    got = margins(rows, lambda r: r.n_tokens * r.probability)
    whole = sum(r.n_tokens * r.probability for r in rows)
    for i, m in enumerate(MARGINS):
        for g, share in target[i].items():
            assert np.isclose(got[m, g] / whole, share, rtol=5e-3, atol=1e-5)


def test_given_weights(spark):
    cells = spark.createDataFrame([("a", "x", "p", 100), ("a", "y", "p", 300), ("b", "x", "p", 50), ("b", "y", "q", 1)], "source string, lang string, topic string, n long")
    weights = {"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}, "topic": {"p": 0.9, "q": 0.1}}
    got = {(r.source, r.lang, r.topic): r.mass for r in raked(cells, weights=weights, tolerance=1e-3, rounds=12).collect()}
    want = fit({k: v for k, v in zip(got, [0] * 4)} | {("a", "x", "p"): 100, ("a", "y", "p"): 300, ("b", "x", "p"): 50, ("b", "y", "q"): 1}, [{"a": 0.5, "b": 0.5}, {"x": 0.75, "y": 0.25}, {"p": 0.9, "q": 0.1}])
    assert all(np.isclose(got[k], want[k], rtol=1e-2) for k in want)


def test_slow_targets_are_met(spark):
    """Nearly monolingual sources: rounds gain little each, but the tempered targets can be met."""
    main, foreign = {"a": ("x", 1e9), "b": ("y", 3e8), "c": ("z", 1e7)}, 1e-2
    cells = {(s, l, "p"): n * (1 - foreign if l == own else foreign / 2) for s, (own, n) in main.items() for l in "xyz"}
    df = spark.createDataFrame([(*k, int(n)) for k, n in cells.items()], "source string, lang string, topic string, n long")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        got = {(r.source, r.lang, r.topic): r.mass for r in raked(df, tolerance=1e-3).collect()}
    for i, m in enumerate(MARGINS):
        sums, mass = defaultdict(float), defaultdict(float)
        for k, n in cells.items():
            sums[k[i]] += int(n)
            mass[k[i]] += got[k]
        whole = sum(n ** ALPHA[m] for n in sums.values())
        assert all(abs(mass[g] / (n ** ALPHA[m] / whole) - 1) < 1.1e-3 for g, n in sums.items())


def test_impossible_targets_are_named(spark):
    """Language x occurs in source a only, which may have no more than a half."""
    df = spark.createDataFrame([("a", "x", "p", 5), ("a", "y", "p", 2), ("b", "y", "p", 9)], "source string, lang string, topic string, n long")
    with pytest.warns(UserWarning, match="lang|source"):
        got = raked(df, weights={"source": {"a": 1, "b": 1}, "lang": {"x": 3, "y": 1}}).collect()
    assert len(got) == 3 and np.isclose(sum(r.mass for r in got), 1)


def test_sampling_follows_probability(spark):
    rows = [(i, "some words of a text", "en", "big" if i % 10 else "small") for i in range(4000)]
    out = mixing_weights(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    for source in ("big", "small"):
        own = [r for r in out if r.source == source]
        assert abs(np.mean([r.sampled for r in own]) - own[0].probability) < 0.05
    assert next(r.probability for r in out if r.source == "small") == 1.0


def test_odd(odd, odd_rows, empty):
    rows = mixing_weights(odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.probability <= 1 for r in rows)
    assert all(r.source is not None and r.lang is not None for r in rows)
    assert mixing_weights(empty).collect() == []
    kept = sample_mix(odd)
    assert kept.columns == odd.columns and None in {r.doc_id for r in kept.collect()}
