import math
import zlib
from collections import Counter

import numpy as np
import xxhash

import __spark_entry__ as E
from biosieve.llm import class_lm
from biosieve.llm.class_lm import best_class, class_scores, exchange_classes, fit_classes, likelihood, shape


def brute(rows):
    """The base columns."""
    split = [(d, t) for d, t in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    c = Counter(w for d, t in split if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    out = []
    for d, t in split:
        own = words(t)
        out.append((d, held(d), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)))
    return sorted(out, key=str)


def check(rows, texts):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows), key=str)
    want = brute(texts)
    assert [g[:5] for g in got] == [w[:5] for w in want] or sorted(g[:5] for g in got if g[0] is not None) == sorted(w[:5] for w in want if w[0] is not None)
    assert np.allclose(sorted(g[5] for g in got), sorted(w[5] for w in want), rtol=1e-9)


def test_query(spark, documents, sf_dir):
    rows = E.queries()["op9_class_bigrams"](spark, sf_dir).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()])
    # held-out texts are likelier under the class model
    new = [r for r in rows if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_structure_is_learnt(spark):
    """Nouns follow articles and verbs follow nouns: texts in that order are likelier than shuffled ones."""
    nouns, verbs = [f"noun{i}a" for i in range(8)], [f"verb{i}b" for i in range(8)]
    rng = np.random.default_rng(2)
    sentence = lambda: " ".join(f"the {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(6))
    rows = [(i, sentence()) for i in range(400)]
    test = [d for d in range(1000, 1100) if zlib.crc32(str(d).encode()) % 7 == 2][:8]
    rows += [(d, sentence()) for d in test[:4]] + [(d, " ".join(rng.permutation(sentence().split()))) for d in test[4:]]
    rows = [r for r in rows if r[0] < 1000 or r[0] in test]
    got = {r.doc_id: r for r in class_scores(spark.createDataFrame(rows, "doc_id long, text string"), classes=4, rounds=8).collect()}
    assert min(got[d].score for d in test[:4]) > max(got[d].score for d in test[4:])
    assert all(got[d].score > got[d].base_score for d in test[:4])


def test_best_class():
    """The gain of a move equals the difference of the likelihoods computed from scratch."""
    rng = np.random.default_rng(0)
    types, classes = 12, 3
    bigrams = rng.integers(0, 9, (types, types)).astype(float)

    def value(assigned):
        m = np.zeros((classes, classes))
        for a in range(types):
            for b in range(types):
                m[assigned[a], assigned[b]] += bigrams[a, b]
        return likelihood(m), m

    for _ in range(20):
        assigned = rng.integers(0, classes, types)
        t = int(rng.integers(types))
        matrix = value(assigned)[1]
        left, right = (np.bincount(assigned, weights=w, minlength=classes) for w in (bigrams[:, t], bigrams[t]))
        options = []
        for c in range(classes):
            moved = assigned.copy()
            moved[t] = c
            options.append(value(moved)[0])
        assert math.isclose(options[best_class(int(assigned[t]), left, right, bigrams[t, t], matrix)], max(options), rel_tol=1e-12)


def test_odd(odd, odd_rows, empty):
    rows = class_scores(odd).collect()
    check(rows, [r[:2] for r in odd_rows])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert class_scores(empty).collect() == []


def test_nothing_to_learn_from(spark):
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    rows = class_scores(spark.createDataFrame([(held, "some words")], "doc_id long, text string")).collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0 and math.isfinite(rows[0].score)


def sentences(n, seed=5):
    """Texts of articles, nouns and verbs; most nouns and verbs are seen a few dozen times only."""
    rng = np.random.default_rng(seed)
    nouns, verbs = [f"n{i}" for i in rng.permutation(300)], [f"v{i}" for i in rng.permutation(300)]
    return [(i, " ".join(f"the {nouns[rng.integers(300)]} {verbs[rng.integers(300)]}" for _ in range(20))) for i in range(n)]


def test_exchange_never_lowers_the_likelihood(spark):
    rng = np.random.default_rng(4)
    counts = {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, 60, 900), rng.integers(0, 60, 900), rng.integers(1, 50, 900))}
    of, matrix, path = exchange_classes(spark.createDataFrame([(*k, n) for k, n in counts.items()], "t1 int, t2 int, n long"), 6, 10)
    again = np.zeros((6, 6))
    for (a, b), n in counts.items():
        again[of[a], of[b]] += n
    assert (again == matrix).all() and math.isclose(likelihood(matrix), path[-1])
    assert all(b >= a for a, b in zip(path, path[1:])) and path[-1] > path[0] and len(path) > 2


def test_words_beyond_the_core(spark):
    """Words under the share are clustered too; the likelihood and the held-out scores rise; scores equal a recount."""
    rows = sentences(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    options = {"classes": 4, "least_share": 0.05}
    plain, model = fit_classes(docs, least=10**9, **options), fit_classes(docs, least=10, **options)
    assert likelihood(model.matrix) > likelihood(plain.matrix)
    of = {r["word"]: r["class"] for r in model.assigned.collect()}
    assert len(of) == 602 > plain.assigned.count()

    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    split = {d: [*t.encode().split(), b"\n"] for d, t in rows}
    number = lambda w: of.get(int(np.array(xxhash.xxh3_64_intdigest(w), np.uint64).view(np.int64)), int(model.shape_class[shape(w)]))
    c = Counter(w for d, ws in split.items() if not held(d) for w in ws)
    m, words = np.zeros((4, 4)), np.zeros(4)
    for w in c:
        words[number(w)] += 1
    for d, ws in split.items():
        for a, b in zip([ws[-1], *ws], ws):
            m[number(a), number(b)] += not held(d)
    assert (m == model.matrix).all() and (words == model.words).all()

    def score(ws):
        total, classes = 0.0, [number(w) for w in ws]
        for w, a, b in zip(ws, [classes[-1], *classes], classes):
            n, kinds = m[a].sum(), (m[a] > 0).sum()
            share = n / (n + kinds) if n else 0
            step = share * m[a, b] / max(n, 1) + (1 - share) * (m[:, b].sum() + 1) / (m.sum() + 4)
            total += math.log10(step) + math.log10((c[w] + 1) / (m[:, b].sum() + words[b] + 1))
        return total

    got = {r.doc_id: r.score for r in class_scores(docs, least=10, **options).collect()}
    assert all(math.isclose(got[d], score(ws), rel_tol=1e-9) for d, ws in split.items())
    before = {r.doc_id: r.score for r in class_scores(docs, least=10**9, **options).collect()}
    assert sum(got[d] for d in split if held(d)) > sum(before[d] for d in split if held(d))


def test_clustered_share_grows_with_the_input(spark):
    share = []
    for n in (120, 350, 600):
        model = fit_classes(spark.createDataFrame(sentences(n), "doc_id long, text string"), classes=4, least_share=0.05, least=20)
        share.append(model.assigned.count() / model.distinct)
    assert share[0] < 0.1 < share[1] < share[2] and share[2] > 0.95


def texts_of_frequent_words(spark):
    """24 words of 80 places, 200 of 5, dealt over three batches."""
    rng = np.random.default_rng(5)
    words = [f"often{i}x" for i in range(24)] * 80 + [f"seldom{i}y" for i in range(200)] * 5
    words = rng.permutation(words)
    rows = [(i, " ".join(words[k : k + 20])) for i, k in enumerate(range(0, len(words), 20))]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")


def test_blocks_send_a_row_for_each_share(spark, monkeypatch):
    """What a block sends does not grow with its words, and the number of shares changes no class."""
    docs, sent = texts_of_frequent_words(spark), []

    def spread(rows, *keys):
        sent.append((rows.count(), rows.select("share").distinct().count()))
        return rows

    monkeypatch.setattr(class_lm, "spread", spread)
    fit = lambda: {r["word"]: r["class"] for r in fit_classes(docs, classes=4, rounds=4, least_share=0.2, least=50).assigned.collect()}
    monkeypatch.setattr(class_lm, "class_transitions", lambda *_: np.zeros((4, 4)))  # its likelihood is 0: all moves are taken
    whole = fit()
    monkeypatch.setattr(class_lm, "_SHARE", 5)
    assert fit() == whole and len(whole) == 25  # the end too
    assert sent[0] == (3, 1)
    assert 3 <= sent[1][1] <= 6 and sent[1][0] <= 3 * sent[1][1]


def test_texts_pass_once_where_the_moves_are_taken_back(spark, monkeypatch):
    docs, calls, real = texts_of_frequent_words(spark), [], class_lm.class_sequences
    scores = lambda least: sorted((r.doc_id, r.score, r.base_score) for r in class_scores(docs, classes=4, rounds=4, least_share=0.05, least=least).collect())
    plain = scores(10**9)
    monkeypatch.setattr(class_lm, "class_sequences", lambda *a: calls.append(1) or real(*a))
    monkeypatch.setattr(class_lm, "class_transitions", lambda *_: np.full((4, 4), 1e9))  # far from likely
    assert np.allclose(scores(50), plain, rtol=1e-12)
    assert len(calls) == 1
