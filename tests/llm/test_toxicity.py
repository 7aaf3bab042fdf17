import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from biosieve.llm.toxicity import ALPHABET, INSULT, NEGATION, OTHER, QUOTE, REPORT, STOP, TARGET, Lexicon, Reader, fit, grammar, learn_lexicon, toxicity_scores
from biosieve.llm.transducers import Transducer, compose, tables, window


def test_composition_runs_one_after_the_other():
    rng = random.Random(3)
    letters = "abcd"
    for _ in range(40):
        first, second = Transducer(), Transducer()
        for t in (first, second):
            for state in range(3):
                for s in letters:
                    if rng.random() < 0.7:
                        t.arc(state, s, rng.randrange(3), rng.choice(letters), rng.randrange(-3, 4))
        both = compose(first, second, letters)
        go, out, weight = tables(both, list(letters), list(letters))
        for _ in range(20):
            word = rng.choices(letters, k=rng.randrange(12))
            middle, w1 = first.run(word)
            want, w2 = second.run(middle)
            assert both.run(word) == (want, w1 + w2)
            state, written, total = 0, [], 0.0
            for s in word:
                i = letters.index(s)
                written.append(letters[out[state, i]])
                total += weight[state, i]
                state = go[state, i]
            assert (written, total) == (want, w1 + w2)


def test_window_reaches_over_words_not_clauses():
    t = window(["n"], ["."], {"x": "X"}, 2, ["o"])
    assert "".join(t.run("nox")[0]) == "noX" and "".join(t.run("noox")[0]) == "noox" and "".join(t.run("n.x")[0]) == "n.x"
    assert "".join(t.run("nxx")[0]) == "nXX" and "".join(t.run("xnx")[0]) == "xnX"


@pytest.mark.parametrize("clause, reading", [
    ([INSULT], "insult"), ([TARGET, OTHER, INSULT], "insult aimed"), ([NEGATION, OTHER, INSULT], "insult negated"), ([REPORT] + [OTHER] * 9 + [INSULT], "insult reported"),
    ([QUOTE, OTHER, INSULT, QUOTE], "insult reported"), ([QUOTE, OTHER, QUOTE, INSULT], "insult"), ([REPORT, STOP, INSULT], "insult"), ([NEGATION, STOP, INSULT], "insult"),
    ([REPORT, NEGATION, TARGET, INSULT], "insult reported"), ([TARGET, NEGATION, INSULT], "insult negated"), ([TARGET] + [OTHER] * 5 + [INSULT], "insult"),
])
def test_readings(clause, reading):
    written, weight = grammar().run(clause)
    assert [w for w in written if w not in ALPHABET or w == INSULT] == [reading]
    assert weight == {"insult": 0, "insult aimed": 0.3, "insult negated": -1.0, "insult reported": -0.7}[reading]


def test_a_target_behind_aims_too():
    assert grammar().run([INSULT, TARGET])[1] == 0.3 and grammar().run([INSULT, OTHER, TARGET])[1] == 0


def test_clauses_are_scored():
    reader = Reader(Lexicon({"blark$": 2.0, "zug": 1.5, "zugnett$": -1.0}, 3.0))
    total = lambda text: round(sum(reader.read(text)[0]), 6)
    assert total("You are a blark.") == 2.3 and total("A blark") == 2.0 and total("not a blark") == 1.0 and total('they said "blark" and') == 1.3
    assert total("zugly zugs") == 3.0 and total("zugnett zu") == 0 and total("I will kill you") == 3.3 and total("idiot") == 3.0
    assert reader.read("blark here. Not there\nblark blark")[1:] == (2, 6)
    assert reader.read("") == ([0.0] * 8, 0, 0)
    # a match is never worth less than nothing
    assert total("not a zug") == 0.5 and Reader(Lexicon({"zug$": 0.5}, 3.0)).read("not a zug")[0] == [0.0] * 8


def test_lexicon_by_hand():
    nodes = [("bad$", 20, 0), ("mal", 40, 4), ("mala$", 12, 0), ("malo$", 3, 3), ("the$", 30, 90), ("rare$", 1, 0)]
    learnt = learn_lexicon(nodes, 100, 300)
    assert set(learnt) == {"bad$", "mal", "mala$", "malo$"}
    rate, share = 1 / 3, 0.25
    assert learnt["bad$"] == pytest.approx(math.log((20 + 2 * share) / (2 * (1 - share)) / rate))
    above = math.exp(learnt["mal"]) * rate
    share = above / (1 + above)
    assert learnt["malo$"] == pytest.approx(math.log((3 + 2 * share) / (3 + 2 * (1 - share)) / rate))
    assert learn_lexicon(nodes, 0, 5) == {}


def test_fit_is_the_optimum():
    rng = np.random.default_rng(1)
    x = np.hstack([np.ones((300, 1)), rng.normal(size=(300, 4))])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [-1, 2, 0, 1, 0])))).astype(float)
    loss = lambda w: np.sum(np.logaddexp(0, x @ w) - y * (x @ w)) + 0.25 * ((w - [-3, 1, 0.5, 1, 0]) ** 2).sum()
    best = fit(x, y)
    assert all(loss(best) <= loss(best + step) for step in 0.01 * rng.normal(size=(50, 5)))


def test_held_out_accuracy(spark):
    """On labels never learnt from: nine of ten toxic texts are found, hardly any clean one is taken."""
    sf = "/root/testdata/sf0.1"
    got = E.queries()["op11_clause_grammar"](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = got.join(labels, "doc_id").filter("held_out").select("predicted", "toxic", "score").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.9 * len(toxic) and sum(r.predicted for r in clean) < 0.02 * len(clean)
    assert got.filter("(predicted = 1) <> (score >= 0.3) OR score NOT BETWEEN 0 AND 1 OR score IS NULL").count() == 0
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_held_out_labels_other_columns_and_ids_do_not_matter(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    ids = [r.doc_id for r in labels.collect() if held(r.doc_id)]
    turned = labels.withColumn("toxic", F.when(F.col("doc_id").isin(ids), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    show = lambda df: sorted((r.doc_id, round(r.score, 9), r.predicted) for r in df.collect())
    plain = show(toxicity_scores(documents, labels))
    assert show(toxicity_scores(documents, turned)) == plain
    assert show(toxicity_scores(documents.withColumn("lang", F.lit(None)).withColumn("source", F.lit("x")), labels)) == plain


def test_odd(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (2, None, 1), (None, 1, 1), (3, 1, 0), (4, 1, None), (5, 1, 0), (6, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(odd, labels).collect()
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(d), d is not None and zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    twice = [r.score for r in got if r.doc_id == 6]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert toxicity_scores(empty, labels).collect() == []
    # without labels the listed words decide
    texts = spark.createDataFrame([(1, "you are an idiot, you moron. pathetic!"), (2, "a quiet day"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r.predicted for r in toxicity_scores(texts, labels.limit(0)).collect()}
    assert found == {1: 1, 2: 0, 3: 0}
