"""Personal data: fixed patterns, and terms whose co-occurrence gives a protected value away.

A term t in a text with a protected value e discloses the share PMI(t; e) / IC(e) of the information of e, both
estimated from document counts: IC(e) = -log2(n_e / N), PMI = log2(n_te N / (n_t n_e)). A term found
only with e discloses all of it, a common word next to nothing. Terms above a threshold are
generalised, those above a higher one removed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.llm.texts import id_and_text, per_batch, stored

KINDS = ("email", "ip", "card", "phone", "term")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits starts: from inside the run the rest fails in the same way
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
# bytes that are part of a term, lower-cased; all others become blanks
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Addresses found from their @: the local part is the run before it, cut at the previous match."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind (index), end`` of the pattern matches, sorted."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def _hashed(value: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(value) - (1 << 63)


def _entities(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    return sorted({_hashed(f"{kind}:{text[start:end].lower()}") for start, kind, end in spans})


def _terms(text: str) -> list[tuple[int, int, int]]:
    """``term, start, end`` of every term of the text outside all pattern matches."""
    covered: list[list[int]] = []
    for start, _, end in base_spans(text):
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out = []
    for m in _TERM.finditer(text):
        i = bisect_left(covered, [m.end()])
        if not i or covered[i - 1][1] <= m.start():
            out.append((_hashed(m[0].encode().translate(_FOLD)), m.start(), m.end()))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, row`` (digest of id and text), ``base`` spans and the distinct ``entities``."""

    def find(batch):
        out = {c: [] for c in ("doc_id", "row", "base", "entities")}
        out["doc_id"] = batch.column(0)
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = raw.decode("utf-8", "replace")
            spans = base_spans(text)
            out["row"].append(xxhash.xxh3_128_digest(b"%r:" % doc + raw))
            out["base"].append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            out["entities"].append(_entities(text, spans))
        return out

    return per_batch(id_and_text(docs), find, "doc_id long, row binary, base array<struct<start: int, kind: int, end: int>>, entities array<long>")


def texts_of(docs: DataFrame, held: DataFrame) -> DataFrame:
    """``row, text, entities`` of the rows of ``docs`` that ``held`` (row, entity) lists; repeated rows are repeated."""

    def digests(batch):
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        # only texts with a pattern match can be listed
        pairs = [(d, t) for d, t in pairs if base_spans(t.decode("utf-8", "replace"))]
        return {"row": [xxhash.xxh3_128_digest(b"%r:" % d + t) for d, t in pairs], "text": [t for _, t in pairs]}

    listed = held.groupBy("row").agg(F.collect_list("entity").alias("entities"))
    return per_batch(id_and_text(docs), digests, "row binary, text binary").join(listed, "row")


def pair_counts(texts: DataFrame) -> DataFrame:
    """``entity, term, n_te``: number of rows of ``texts_of`` that hold both."""

    def count(batch):
        found: Counter = Counter()
        for raw, entities in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            terms = {t for t, _, _ in _terms(raw.decode("utf-8", "replace"))}
            found.update((e, t) for e in entities for t in terms)
        return {"entity": [e for e, _ in found], "term": [t for _, t in found], "n": list(found.values())}

    counted = per_batch(texts.select("text", "entities"), count, "entity long, term long, n long", rows=256)
    return counted.groupBy("entity", "term").agg(F.sum("n").alias("n_te"))


def term_places(texts: DataFrame) -> DataFrame:
    """``row, terms`` from ``row, text, wanted``: all places of the wanted terms (``term, kind``) in the text."""

    def mark(batch):
        out = []
        for raw, wanted in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kinds = {w["term"]: w["kind"] for w in wanted}
            out.append([{"start": s, "kind": kinds[t], "end": e} for t, s, e in _terms(raw.decode("utf-8", "replace")) if t in kinds])
        return {"row": batch.column(0), "terms": out}

    return per_batch(texts.select("row", "text", "wanted"), mark, "row binary, terms array<struct<start: int, kind: int, end: int>>")


def term_counts(docs: DataFrame) -> DataFrame:
    """``term, n``: number of rows that hold each term, over all rows."""

    def count(batch):
        found: Counter = Counter()
        for raw in batch.column(0).to_pylist():
            found.update(set(raw.translate(_FOLD).split()))
        return {"term": [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in found], "n": list(found.values())}

    return per_batch(id_and_text(docs).select("text"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def personal_data(docs: DataFrame, support: int = 2, generalise: float = 0.75, remove: float = 0.95) -> DataFrame:
    """Spans of personal data in every text.

    Returns ``doc_id, row, spans`` per row of ``docs``; ``spans`` is an array of ``start, kind, end``
    sorted by start and kind, in code points with an exclusive end; ``kind`` indexes ``KINDS``. Kind
    term marks every place of the words, numbers among them, in a text with a protected value that disclose
    a share of at least ``generalise`` of it, seen in at least ``support`` texts with it; ``remove`` tells
    5 (remove) from 4 (generalise) in ``sanitise``.

    Entities of one spelling are one protected value over the whole corpus. A null or empty text has
    no spans. Repeated rows count as separate texts and get equal spans; a null id is carried along.
    An empty table gives no rows; other columns are ignored; texts are searched whole.
    """
    found = stored(scan(docs), "pii-scan")
    total = found.count()
    n_e = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    # no term is in more texts with a value than the value itself
    n_e = stored(n_e.filter((F.col("n_e") >= support) & (F.col("n_e") < total)), "pii-values")
    held = found.select("row", F.explode("entities").alias("entity")).distinct().join(n_e.select("entity"), "entity")
    held = stored(held.select("row", "entity"), "pii-held")
    texts = stored(texts_of(docs, held), "pii-texts")
    together = stored(pair_counts(texts).filter(F.col("n_te") >= support), "pii-pairs")
    n_t = term_counts(docs).join(together.select("term").distinct(), "term", "left_semi").withColumnRenamed("n", "n_t")
    share = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e"))) / -F.log2(F.col("n_e") / total)
    revealing = together.join(n_e, "entity").join(n_t, "term").withColumn("share", share)
    revealing = revealing.filter(F.col("share") >= generalise).select("entity", "term", F.when(F.col("share") >= remove, 5).otherwise(4).alias("kind"))
    wanted = held.join(revealing, "entity").groupBy("row", "term").agg(F.max("kind").alias("kind"))
    wanted = wanted.groupBy("row").agg(F.collect_list(F.struct("term", "kind")).alias("wanted"))
    terms = term_places(texts.select("row", "text").dropDuplicates(["row"]).join(wanted, "row"))
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "terms")))
    return found.join(terms, "row", "left").select("doc_id", "row", spans.alias("spans"))


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans and the text of all spans of ``personal_data``."""

    def digest(batch):
        import hashlib

        out = {c: [] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term")}
        out["doc_id"] = batch.column(0)
        for spans in batch.column(1).to_pylist():
            kinds = Counter(min(s["kind"], 4) for s in spans)
            said = [(f"{KINDS[min(s['kind'], 4)]}:{s['start']}:{s['end']}", s["kind"]) for s in spans]
            for i, c in enumerate(("n_email", "n_ip", "n_card", "n_phone", "n_term")):
                out[c].append(kinds[i])
            out["base_sha256"].append(hashlib.sha256(",".join(x for x, k in said if k < 4).encode()).hexdigest())
            out["spans"].append(",".join(x for x, _ in said))
        return out

    return per_batch(
        found.select("doc_id", "spans"), digest,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long",
    )


def shape(word: str) -> str:
    """What a generalised term still says."""
    return "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]"


def sanitise(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``doc_id, text`` with pattern matches replaced by their kind and revealing terms generalised or removed.

    ``found`` is the result of ``personal_data`` for the same rows; overlapping spans are replaced as one.
    """
    found = personal_data(docs) if found is None else found

    def digests(batch):
        rows = [xxhash.xxh3_128_digest(b"%r:" % d + t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        return {"doc_id": batch.column(0), "text": batch.column(1), "row": rows}

    def rewrite(batch):
        out = []
        for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            text, parts, at = raw.decode("utf-8", "replace"), [], 0
            for s in spans or ():
                if s["end"] <= at:
                    continue
                start = max(at, s["start"])
                parts.append(text[at:start])
                if s["kind"] < 4:
                    parts.append(f"[{KINDS[s['kind']].upper()}]")
                elif s["kind"] == 4:
                    parts.append(shape(text[start : s["end"]]))
                at = s["end"]
            out.append("".join(parts) + text[at:])
        return {"doc_id": batch.column(0), "text": out}

    keyed = per_batch(id_and_text(docs), digests, "doc_id long, text binary, row binary")
    once = found.filter(F.size("spans") > 0).select("row", "spans").dropDuplicates(["row"])
    return per_batch(keyed.join(once, "row", "left").select("doc_id", "text", "spans"), rewrite, "doc_id long, text string")
