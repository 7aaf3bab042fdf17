import hashlib
import re

import __spark_entry__ as E
from biosieve.llm.pii import base_spans, personal_data, sanitise, span_digest

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += (d * 2 - 9 if d > 4 else d * 2) if i % 2 else d
    return total % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(spans)


HARD = [
    "a@b@c.de x@y.z.w. .a@-.-", "@a.b a@ a@b a@b.c@d.e f@g.h", "1.2.3.4.5.6.7.8.9 0256.1.1.1 256.1.1.1 001.02.3.255",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (724) 555-7058, +12 +1 1 +1)))2 ++123456789", "12345678901234567890123 4 5",
    "ünï@cødé.com é@a.b", "x@1.2.3.4 +1.2.3.4.567890", "1.2.3.4@5.6 a.b@c.d-e.f_g", "a@b.c\nd@e.f 1.1.1.1\n2.2.2.2",
]


def test_base_patterns(documents):
    for text in HARD + [r.text for r in documents.collect()]:
        assert base_spans(text) == brute(text), text[:80]


def test_query(spark, documents, sf_dir):
    got = {r.doc_id: r for r in E.queries()["op10_disclosure_spans"](spark, sf_dir).collect()}
    for row in documents.collect():
        spans = brute(row.text)
        r = got[row.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        said = [f"{('email', 'ip', 'card', 'phone')[k]}:{s}:{e}" for s, k, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("term")] == said


def test_disclosure(spark):
    """The name that only goes with the address is found; common words, and names seen once, are not."""
    rows = [(i, f"the report number {i} is there for all of the people number {i + 1}") for i in range(40)]
    rows += [(100 + i, f"write to Zebediah at zeb@site.example.org for the report number {i}") for i in range(3)]
    rows += [(200, "write to Solomon at other@site.example.org for the report")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal_data(docs)
    terms = {r.doc_id: r.spans for r in span_digest(found).collect() if "term" in r.spans}
    assert set(terms) == {100, 101, 102}
    text = rows[40][1]
    names = [text[int(s) : int(e)] for k, s, e in (x.split(":") for x in terms[100].split(",")) if k == "term"]
    assert "Zebediah" in names and not {"the", "report", "number"} & set(names)
    clean = {r.doc_id: r.text for r in sanitise(docs, found).collect()}
    assert "Zebediah" not in clean[100] and "[EMAIL]" in clean[100] and "zeb@" not in clean[100]
    assert "Solomon" in clean[200] and "[EMAIL]" in clean[200] and clean[0] == rows[0][1]


def test_odd(odd, odd_rows, empty):
    got = span_digest(personal_data(odd)).collect()
    assert sorted((r.doc_id or 0, r.n_email) for r in got) == sorted((d or 0, len(EMAIL.findall(t or ""))) for d, t, *_ in odd_rows)
    assert span_digest(personal_data(empty)).collect() == []
    assert len(sanitise(odd).collect()) == len(odd_rows)


def test_disclosure_anywhere(spark):
    """A far name, a staff number and a short name are found, at every place in the text."""
    plain = "the report is there for all of the people who read it and then send it on "
    rows = [(i, plain) for i in range(40)]
    rows += [(100 + i, f"Zebediah 48213 Xu {plain}zeb@site.example.org {plain}Zebediah again") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in sanitise(docs, personal_data(docs)).collect()}
    assert not [w for w in ("Zebediah", "48213", "Xu", "zeb@") for i in range(3) if w in clean[100 + i]]
    assert clean[0] == plain and clean[100].count("people") == 2
