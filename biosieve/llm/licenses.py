"""License scans with a positional index of rare tokens.

Templates are word sequences with mandatory key phrases. The index holds, for each template, the
places of its rarest words, rarity being the inverse document frequency over the corpus. A file's
words are looked up there; every hit proposes a place of the template in the file, hits that agree
on it are one proposal, and the proposal stands if the key phrases are there.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.llm.texts import id_and_text, per_batch

# bytes of a word, A-Z lower-cased; all others become blanks
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Template:
    """``words`` as they stand in a notice; ``keys`` are phrases of it that must be present."""

    label: str
    words: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "are permitted")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify",)),
    Template("unlicense", "free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0", ("cc0",)),
    Template("proprietary", "all rights reserved", ("all rights reserved",)),
)


def file_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def places(words: list[bytes], at: list[int], phrase: list[bytes], anchor: int) -> list[int]:
    """Starts of ``phrase`` given the places ``at`` of its word number ``anchor``."""
    k = len(phrase)
    return [i - anchor for i in at if i >= anchor and words[i - anchor : i - anchor + k] == phrase]


def word_rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, float]:
    """Inverse document frequency over all rows; the result is as large as the vocabulary of the templates."""
    known = frozenset(vocabulary)

    def count(batch):
        found: Counter = Counter()
        for text in batch.column(0).to_pylist():
            found.update(known.intersection(file_words(text)))
        found[b""] = batch.num_rows
        return {"word": [w.decode() for w in found], "n": list(found.values())}

    counted = per_batch(id_and_text(docs).select("text"), count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"].encode(): r["n"] for r in counted}
    return {w: math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) for w in known}


class RareTokenIndex:
    """Places of each template's ``rare`` rarest words, and of the base phrases' rarest word."""

    def __init__(self, templates: tuple[Template, ...], rarity: dict[bytes, float], rare: int):
        self.rarity = rarity
        self.templates = [(t.label, t.words.encode().split(), [k.encode().split() for k in t.keys]) for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, words, keys) in enumerate(self.templates):
            order = sorted({w for k in keys for w in k}, key=lambda w: (-rarity[w], w))
            for w in order[:rare]:
                self.postings[w] += [(i, j) for j, x in enumerate(words) if x == w]
        self.base = []
        for phrase, label in BASE.items():
            words = phrase.encode().split()
            anchor = max(range(len(words)), key=lambda j: (rarity[words[j]], -j))
            self.base.append((label, words, anchor))
        self.anchors = frozenset(self.postings) | {words[anchor] for _, words, anchor in self.base}

    def look_up(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Places of base phrases, base labels, all labels and the best share of a template's rarity found."""
        present = self.anchors.intersection(words)
        if not present:
            return [], set(), set(), 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                at[w].append(i)
        base, base_labels = [], set()
        for label, phrase, anchor in self.base:
            if hits := places(words, at[phrase[anchor]], phrase, anchor):
                base += hits
                base_labels.add(label)
        proposals = {(t, i - j) for w in present for t, j in self.postings.get(w, ()) for i in at[w]}
        labels, best = set(base_labels), 0.0
        for t, start in proposals:
            label, template, keys = self.templates[t]
            lo, hi = max(0, start - len(template)), start + 2 * len(template)
            near = words[lo : max(0, hi)]
            if all(any(near[i : i + len(k)] == k for i in range(len(near) - len(k) + 1)) for k in keys):
                weight = [self.rarity[w] + 1e-9 for w in template]
                same = [x for j, x in enumerate(weight) if 0 <= start + j < len(words) and words[start + j] == template[j]]
                share = sum(same) / sum(weight)
                if share >= 0.5:
                    labels.add(label)
                    best = max(best, min(1.0, share))
        return base, base_labels, labels, best


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = 2) -> DataFrame:
    """License notices in every text.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row of
    ``docs``. Base phrases are counted at all places where their words stand consecutively;
    first_word and last_word are the smallest and largest start. A template is found where its
    key phrases stand near a proposed place and at least half of its rarity stands at that place;
    score is the largest such share. Labels are distinct, sorted and comma-joined.

    The index looks up a template's ``rare`` rarest key words at all their places in a file, so no
    template whose key phrases are present is passed over. A null or empty text has no words, no
    labels and score 0. Repeated rows are scanned each, null ids carried along, other columns
    ignored. An empty table gives no rows. Texts are scanned whole.
    """
    vocabulary = {w for t in templates for w in t.words.encode().split()} | {w for p in BASE for w in p.encode().split()}
    vocabulary |= {w for t in templates for k in t.keys for w in k.encode().split()}
    index = RareTokenIndex(templates, word_rarity(docs, vocabulary), rare)

    def scan(batch):
        out = {c: [] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            words = file_words(text)
            base, base_labels, labels, score = index.look_up(words)
            out["n_words"].append(len(words))
            out["n_base"].append(len(base))
            out["first_word"].append(min(base, default=None))
            out["last_word"].append(max(base, default=None))
            out["base_labels"].append(",".join(sorted(base_labels)))
            out["labels"].append(",".join(sorted(labels)))
            out["score"].append(score)
        return out

    return per_batch(
        id_and_text(docs), scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
