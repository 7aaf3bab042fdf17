import random

import __spark_entry__ as E
from biosieve.llm.decontaminate import PieceIndex, benchmark_hits, best_match, budget, drop_contaminated, normal_form, pieces


def distance(pattern, text):
    """Smallest edit distance of the pattern to any stretch of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return min(row)


def test_best_match():
    rng = random.Random(5)
    for _ in range(300):
        pattern, text = ("".join(rng.choices("abc", k=n)) for n in (rng.randrange(1, 80), rng.randrange(0, 90)))
        assert best_match(pattern, text)[0] == distance(pattern, text)


def test_pieces():
    for n in range(1, 40):
        for k in range(1, n + 1):
            found = pieces("x" * n, k)
            assert len(found) == k and all(p for _, p in found) and sum(len(p) for _, p in found) == n


def test_query(spark, documents, sf_dir):
    """Every pair whose distance is within the budget is found; the table is computed where they share a long stretch."""
    got = {(r.doc_id, r.item_id) for r in E.queries()["op6_pigeonhole_benchmark"](spark, sf_dir).collect()}
    texts = [(r.doc_id, normal_form(r.text)) for r in documents.collect()]
    items = [(r.item_id, normal_form(r.text)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = set()
    for item, pattern in items:
        k = budget(pattern, 0.05)
        for doc, text in texts:
            # a shared piece is necessary, whatever its place
            if any(p in text for _, p in pieces(pattern, k + 1)) and best_match(pattern, text)[0] <= k:
                want.add((doc, item))
    assert got == want and got


def test_edits(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew coffee in the old tower by the lake"
    k = budget(normal_form(item), 0.05)
    changed = item.replace("quick", "quack").replace("wizards", "wizard").replace("tower", "towers").replace("lazy", "laxy")
    texts = [
        (1, f"before it. {item.upper()}! after it"), (2, f"x {changed} y"), (3, changed.replace("brown", "black").replace("coffee", "tea")),
        (4, "the quick brown fox jumps over the lazy dog"), (5, item.replace(" ", "\n  ")), (6, f"{item} {item}"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, " .. ")], "item_id long, text string")
    hits = benchmark_hits(docs, bench).collect()
    assert [r.distance for r in hits if r.doc_id == 6] == [0, 0]
    got = {r.doc_id: r.distance for r in hits}
    want = {d: x for d, t in texts if (x := distance(normal_form(item), normal_form(t))) <= k}
    assert k >= 4 and got == want and {1, 2, 5, 6} <= set(got)
    # blocks of items make no difference
    cut = {r.doc_id: r.distance for r in benchmark_hits(docs, bench, block_chars=1).collect()}
    assert cut == got


def full_distance(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != t))
    return row[-1]


def test_every_stretch_with_its_place_and_distance():
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(60)]
    for _ in range(40):
        item = normal_form(" ".join(rng.choices(words, k=25)))
        errors = budget(item, 0.05)
        text, planted = " ", []
        for _ in range(rng.randrange(1, 7)):
            if rng.random() < 0.5:  # else the next copy follows at once
                text += " ".join(rng.choices(words, k=rng.randrange(1, 30))) + " "
            copy = list(item[1:-1])
            for _ in range(rng.randrange(0, errors + 1)):
                at = rng.randrange(1, len(copy) - 1)
                copy[at] = rng.choice("xyz")
            planted.append((len(text) - 1, len(text) + len(copy) + 1))
            text += "".join(copy) + " "
        got = PieceIndex([(1, item)], 0.05).hits(text)
        assert len(got) == len(planted)
        for (_, start, end, found), (a, z) in zip(got, planted):
            assert abs(start - a) <= errors and abs(end - z) <= errors
            assert found == full_distance(item, text[start:end]) <= full_distance(item, text[a:z])
            # no end nearby does better
            assert found == min(distance(item, text[max(0, start - errors) : e]) for e in range(end - 2, min(len(text), end + 2) + 1))


def test_odd(odd, empty, spark):
    bench = spark.createDataFrame([(1, "shared line of text"), (2, None)], "item_id long, text string")
    kept = drop_contaminated(odd, bench)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 4, 5, 8, 8]
    assert benchmark_hits(empty, bench).collect() == [] and drop_contaminated(odd, bench.limit(0)).count() == odd.count()
