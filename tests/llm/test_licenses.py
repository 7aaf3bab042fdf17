import re

import __spark_entry__ as E
from biosieve.llm.licenses import TEMPLATES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def brute(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    hits, labels = [], set()
    for phrase, label in BASE.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        hits += found
        labels |= {label} if found else set()
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def check(rows, texts):
    for r in rows:
        assert base(r) in [brute(t) for d, t in texts if d == r.doc_id]
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_query(spark, documents, sf_dir):
    check(E.queries()["op3_rare_token_licenses"](spark, sf_dir).collect(), [(r.doc_id, r.text) for r in documents.collect()])


def test_labels(spark):
    texts = [
        (1, "Some prose.\nThis work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        (2, "Released under the MIT License. All rights reserved.", "mit,proprietary,reserved"),
        (3, "Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        (4, "Licensed under CC BY-NC 4.0. CC by cc by", "cc-by,cc-by-nc-4.0"),
        (5, "the license of the public was general and all the rights were reserved by version 3", ""),
        (6, "no such words here", ""),
        (7, "x " * 5000 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software" + " y" * 5000, "mit"),
    ]
    rows = license_scan(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in rows} == {d: labels for d, _, labels in texts}
    check(rows, [t[:2] for t in texts])
    assert all((r.score > 0) == bool(set(r.labels.split(",")) & {t.label for t in TEMPLATES}) for r in rows)


def test_odd(odd, odd_rows, empty):
    rows = license_scan(odd).collect()
    assert len(rows) == len(odd_rows)
    check(rows, [r[:2] for r in odd_rows])
    assert license_scan(empty).collect() == []
