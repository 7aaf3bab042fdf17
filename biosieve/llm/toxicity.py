"""Toxicity by a weighted grammar of insults and threats in their clauses.

A lexical transducer reads words and writes classes: insult, threat, target, negation, report, or other. Insults
carry weights that are learnt from labelled texts, for words and for stems with many endings. Five further
transducers read classes clause by clause: reported speech, negation, targets before and after an insult, and
threats at a target. Their composition gives each insult or threat one reading, and a clause the weight of
its path; what a document's clauses weigh, against its length, gives its score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.llm.texts import per_batch, raw_text, stored
from biosieve.llm.transducers import Transducer, compose, tables, window

# Words of the closed classes, and openly hostile ones that count before anything is learnt.
TARGETS = "you your yours yourself u ur he him his she her they them their those these people everyone du dich dir dein deine ihr euch euer sie tu toi te ton ta vous votre vos ils elles tú ti tus usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never none nobody neither nor isn't aren't wasn't don't doesn't didn't won't cannot can't nicht kein keine keinen nie niemals niemand pas jamais aucun aucune personne nunca jamás ningún ninguna tampoco".split()
REPORTS = "said says say saying told tells wrote writes called calls claimed claims reported quoted according sagte sagt schrieb nannte behauptet laut dit disait écrit appelle selon dijo dice escribió llamó según".split()
THREATS = "kill murder hurt shoot stab hang burn beat punish destroy strangle umbringen töten schlagen erschießen tuer frapper brûler égorger matar golpear quemar disparar".split()
INSULTS = "idiot moron stupid scum trash pathetic disgusting worthless loser clown dumb imbecile fool bastard idioten dumm dummkopf abschaum idiote stupide imbécile crétin connard estúpido estúpida idiota imbécil basura".split()

OTHER, TARGET, NEGATION, REPORT, QUOTE, INSULT, THREAT, STOP = ALPHABET = ["other", "target", "negation", "report", "quote", "insult", "threat", "stop"]
# readings of an insult or a threat
READINGS = ["insult", "insult aimed", "insult negated", "insult reported", "threat", "threat aimed", "threat negated", "threat reported"]
_MARKS = {"aimed": 0.3, "negated": -1.0, "reported": -0.7}  # weights of the arcs that mark
_OUTPUTS = [OTHER, TARGET, NEGATION, REPORT, QUOTE, STOP, *READINGS]
_AFTER = "aim"  # a target behind an insult

# longer words are read by their first letters; stems have these lengths
_WORD = 40
_STEMS = range(3, 10)
# words with apostrophes inside, and the signs that end a clause or quote
_TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n\"“”„«»|]")
_SIGN = {s: STOP for s in ".!?;:\n|"} | {s: QUOTE for s in "\"“”„«»"}


def grammar(reach: int = 3) -> Transducer:
    """The composed transducer from classes to readings.

    A reading is marked once, and the first of these rules that holds gives the mark: within reported speech (from a report to
    the end of its clause, or inside quotation marks), within ``reach`` words after a negation, or after a target.
    """
    reported, sources = Transducer(), (INSULT, THREAT)
    for s in sources:  # state 1: after a report; 2: inside quotation marks
        reported.arc(1, s, 1, f"{s} reported", _MARKS["reported"]).arc(2, s, 2, f"{s} reported", _MARKS["reported"])
    reported.arc(0, REPORT, 1).arc(0, QUOTE, 2).arc(1, QUOTE, 2).arc(2, QUOTE, 0).arc(1, STOP, 0)
    # a quotation that never ends is left with the line's end, which a second stop in a row stands for
    reported.arc(2, STOP, 3).arc(3, STOP, 0).arc(3, QUOTE, 0)
    for s in (OTHER, TARGET, NEGATION, REPORT):
        reported.arc(3, s, 2)
    for s in sources:
        reported.arc(3, s, 2, f"{s} reported", _MARKS["reported"])
    settled = [f"{s} {m}" for s in sources for m in ("reported", "negated", "aimed")]
    plain = [OTHER, REPORT, QUOTE]
    negated = window([NEGATION], [STOP], {s: f"{s} negated" for s in sources}, reach, [*plain, TARGET, *settled], _MARKS["negated"])
    aimed = window([TARGET], [STOP], {s: f"{s} aimed" for s in sources}, reach, [*plain, NEGATION, *settled], _MARKS["aimed"])
    after = Transducer()  # a target right behind an insult aims it as well: weight without a change of the reading
    for s in ("insult", "threat"):
        after.arc(0, s, 1).arc(1, s, 1)
    for s in [*plain, NEGATION, STOP, *settled]:
        after.arc(1, s, 0)
    after.arc(1, TARGET, 0, TARGET, _MARKS["aimed"])
    return reduce(lambda a, b: compose(a, b, ALPHABET), [reported, negated, aimed, after])


class Lexicon:
    """Class and weight of words: closed classes, then the longest of the learnt words and stems, then listed insults."""

    def __init__(self, learnt: dict[str, float], listed: float):
        self.learnt = learnt
        closed = {}
        for words, kind, weight in ((INSULTS, INSULT, listed), (THREATS, THREAT, listed), (REPORTS, REPORT, 0.0), (NEGATIONS, NEGATION, 0.0), (TARGETS, TARGET, 0.0)):
            closed |= {w: (ALPHABET.index(kind), weight) for w in words}
        self.closed = closed
        self.signs = {s: (ALPHABET.index(k), 0.0) for s, k in _SIGN.items()}
        self.known: dict[str, tuple[int, float]] = dict(self.signs)

    def lookup(self, word: str) -> tuple[int, float]:
        """Of the lower-case ``word``; the answers are remembered, up to a bound."""
        found = self.known.get(word)
        if found is None:
            found = self._find(word)
            if len(self.known) > 400_000:
                self.known = dict(self.signs)
            self.known[word] = found
        return found

    def _find(self, word: str) -> tuple[int, float]:
        w = word[:_WORD]
        learnt = self.learnt.get(w + "$")
        if learnt is None:
            if w in self.closed:
                return self.closed[w]
            for n in reversed(_STEMS):
                if len(w) >= n and (learnt := self.learnt.get(w[:n])) is not None:
                    break
        return (ALPHABET.index(INSULT), learnt) if learnt is not None and learnt > 0 else (0, 0.0)


class Reader:
    """Sums of a text's clause weights by reading, under a lexicon and the grammar."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.go, self.out, self.weight = (t.tolist() for t in tables(grammar(), ALPHABET, _OUTPUTS))
        self.first = len(_OUTPUTS) - len(READINGS)

    def read(self, text: str) -> tuple[list[float], int, int]:
        """Weight by reading, number of clauses that match, number of words.

        A match weighs its word and the arcs it takes, and never less than nothing.
        """
        sums, matched, n_words = [0.0] * len(READINGS), 0, 0
        tokens = _TOKENS.findall(text.lower())
        known = self.lexicon.known
        found = [known.get(t) or self.lexicon.lookup(t) for t in tokens]
        go, out, weight, first = self.go, self.out, self.weight, self.first
        state, in_clause, last = 0, False, -1
        stop, insult, threat = ALPHABET.index(STOP), ALPHABET.index(INSULT), ALPHABET.index(THREAT)
        signs = stop, ALPHABET.index(QUOTE)
        if not any(kind == insult or kind == threat for kind, _ in found):
            return sums, 0, sum(kind not in signs for kind, _ in found)
        for kind, own in found:
            arc, reading = weight[state][kind], out[state][kind] - first
            state = go[state][kind]
            if reading >= 0:
                sums[reading] += max(0.0, own + arc)
                last, in_clause = reading, True
            elif arc and last >= 0:
                sums[last] += arc
            if kind == stop:
                matched += in_clause
                in_clause, last = False, -1
            n_words += kind not in signs
        return sums, matched + in_clause, n_words


def held_out(doc_id: int | None) -> bool:
    """Whether the label of a document is never learnt from."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def labelled_sample(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """``text, toxic, fold`` of about ``max_docs`` labelled rows that may be learnt from; equal texts once, by their worst label."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2), "toxic-labels")
    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11)), 11) / F.lit(float(1 << 53))
    chosen = known.filter(draw < max_docs / max(n, 1)).select(F.col("doc_id").alias("_labelled"), "toxic")
    # about max_docs ids, whatever the corpus
    rows = docs.select("doc_id", raw_text()).join(F.broadcast(chosen), F.col("doc_id") == F.col("_labelled")).select("text", "toxic")
    once = rows.groupBy("text").agg(F.max("toxic").alias("toxic"))
    return stored(once.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "toxic-sample")


def word_counts(sample: DataFrame) -> DataFrame:
    """``node, t0, c0, t1, c1, f``: texts that hold a word (``word$``) or stem, toxic or clean, by fold.

    ``f`` counts the toxic texts' words with a stem, each text counting its own distinct ones; above the count of texts it shows
    a stem with several endings.
    """

    def count(batch):
        found: dict[str, list[int]] = {}
        for text, toxic, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = {w[:_WORD] for w in _TOKENS.findall(text.decode("utf-8", "replace").lower()) if w not in _SIGN}
            stems = Counter(w[:n] for w in words for n in _STEMS if len(w) >= n)
            place = 2 * fold + (not toxic)
            for node, n in [*((w + "$", 1) for w in words), *stems.items()]:
                c = found.get(node)
                if c is None:
                    c = found[node] = [0, 0, 0, 0, 0]
                c[place] += 1
                if toxic:
                    c[4] += n
        columns = list(zip(*found.values())) if found else [()] * 5
        return {"node": list(found), **{c: v for c, v in zip(("t0", "c0", "t1", "c1", "f"), columns)}}

    counted = per_batch(sample.select("text", "toxic", "fold"), count, "node string, t0 long, c0 long, t1 long, c1 long, f long")
    sums = counted.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1", "f")])
    return sums.filter("t0 + t1 >= 2")


def learn_lexicon(nodes: list[tuple[str, int, int]], n_toxic: int, n_clean: int, least: float = 1.5) -> dict[str, float]:
    """Weights of words and stems from the toxic and clean texts that hold them: logarithms of their odds.

    An entry's share of toxic texts is smoothed by that of all texts, for a word or a longer stem by that of the stem above it.
    Entries that weigh over ``least`` and whose likelihood ratio so few as one of all would reach by chance start a
    family; the words and longer stems of a family are listed with it, with whatever weight.
    """
    if not n_toxic or not n_clean:
        return {}
    counts = {node: (t, c) for node, t, c in nodes}
    weights: dict[str, float] = {}
    family: set[str] = set()
    rate, all_toxic = n_toxic / n_clean, n_toxic / (n_toxic + n_clean)
    chance = math.log(max(len(counts), 2))

    def parent(node: str) -> str | None:
        word = node.removesuffix("$")
        for n in range(min(len(word) - (not node.endswith("$")), _STEMS[-1]), _STEMS[0] - 1, -1):
            if word[:n] in family:
                return word[:n]
        return None

    for node in sorted(counts, key=lambda s: (len(s.removesuffix("$")), s)):
        t, c = counts[node]
        above = parent(node)
        prior = rate * math.exp(weights[above]) if above else rate
        share = prior / (1 + prior)
        t_s, c_s = t + 2 * share, c + 2 * (1 - share)
        weight = math.log(t_s / c_s / rate)
        if above or (weight > least and t * math.log(t / (t + c) / all_toxic) + (c and c * math.log(c / (t + c) / (1 - all_toxic))) > chance):
            weights[node] = weight
            if not node.endswith("$"):
                family.add(node)
    return weights


def _nodes(rows: list, folds: tuple[int, ...]) -> list[tuple[str, int, int]]:
    """Counts over ``folds``; a stem is listed only where its toxic texts use several endings of it."""
    out = []
    for r in rows:
        t, c = sum(r[f"t{f}"] for f in folds), sum(r[f"c{f}"] for f in folds)
        if t >= 2 and (r["node"].endswith("$") or r["f"] >= 1.5 * (r["t0"] + r["t1"])):
            out.append((r["node"], t, c))
    return out


def features(sums: np.ndarray, matched: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Columns of the logistic model: what the readings weigh together, per clause and per word, and the length."""
    total = sums.sum(axis=1)
    words = np.maximum(n_words, 1)
    return np.stack([np.ones(len(total)), np.log1p(total), np.log1p(matched), np.log1p(100 * total / words), np.log(words) / 5], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic model by Newton's method, drawn towards a plain reading of the grammar."""
    start = np.array([-3.0, 1.0, 0.5, 1.0, 0.0])

    def loss(w):
        z = x @ w
        return (np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - start) ** 2).sum()

    w = start.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), slope)
        # the loss is convex, so a short enough step lessens it
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-12:
            step /= 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _read_all(texts: DataFrame, lexicons: dict[int, dict[str, float]], listed: float, carried: str) -> DataFrame:
    """``carried`` columns, and sums, clauses and words of each text; its fold chooses the lexicon (-1: the only one)."""
    names = [c.split()[0] for c in carried.split(", ")]

    def score(batch):
        if not readers:
            readers.update({f: Reader(Lexicon(own, listed)) for f, own in lexicons.items()})
        folds = batch.column(batch.schema.get_field_index("fold")).to_pylist() if -1 not in lexicons else None
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        got = [readers[-1 if folds is None else folds[i]].read(t.decode("utf-8", "replace")) for i, t in enumerate(texts)]
        columns = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
        return columns | {"sums": [g[0] for g in got], "matched": [g[1] for g in got], "n_words": [g[2] for g in got]}

    readers: dict[int, Reader] = {}
    return per_batch(texts, score, f"{carried}, sums array<double>, matched long, n_words long", rows=256)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_docs: int = 12_000, listed: float = 3.0) -> DataFrame:
    """Probability that a text is toxic, for every document.

    Returns ``doc_id, held_out, score, predicted, n_clauses, readings`` per row of ``docs``: ``predicted`` is 1 from
    ``threshold`` on, ``n_clauses`` counts the clauses in which the grammar matches, ``readings`` maps readings that
    occur to their weights. Labels are learnt only from rows with crc32(doc_id) mod 4 other than 2; about ``max_docs`` of these,
    drawn by a hash, train the model, equal texts counting once. Only the text is looked at.

    Words and stems are learnt on each half of the sample for the other, so that the final logistic model is fitted on weights that did
    not see its texts; the lexicon used for scoring is that of the whole sample. ``listed`` is the weight of the words listed
    in this module until something is learnt of them. All of the model comes from the bounded sample and goes to the tasks whole.

    Null and empty texts, and texts without a match, have the score of their length alone. Rows without an id are
    scored, never learnt from. A document with several labels has the worst; repeated rows are scored each. Without labels,
    or without both kinds of them, the listed words and fixed weights decide. No rows give no rows; other columns are ignored; texts
    are read whole. Nothing is ranked, so ties need no order.
    """
    sample = labelled_sample(docs, labels, max_docs)
    counts = {(r["toxic"] > 0, r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = lambda toxic, folds: sum(counts.get((toxic, f), 0) for f in folds)
    rows = word_counts(sample.withColumn("toxic", (F.col("toxic") > 0).cast("int"))).collect()  # bounded by the sample
    learn = lambda *folds: learn_lexicon(_nodes(rows, folds), size(True, folds), size(False, folds))
    crossed = _read_all(sample, {0: learn(1), 1: learn(0)}, listed, "toxic int").collect()
    x = features(*(np.array([r[c] for r in crossed], np.float64).reshape(len(crossed), *shape) for c, shape in (("sums", (len(READINGS),)), ("matched", ()), ("n_words", ()))))
    weights = fit(x, np.array([r["toxic"] > 0 for r in crossed], np.float64))
    read = _read_all(docs.select("doc_id", raw_text()), {-1: learn(0, 1)}, listed, "doc_id long")

    def finish(batch):
        sums = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, len(READINGS))
        score = 1 / (1 + np.exp(-features(sums, batch.column(2).to_numpy(), batch.column(3).to_numpy()) @ weights))
        ids = batch.column(0).to_pylist()
        return {
            "doc_id": batch.column(0), "held_out": [held_out(d) for d in ids], "score": score, "predicted": (score >= threshold).astype(np.int32),
            "n_clauses": batch.column(2), "readings": [[(r, float(w)) for r, w in zip(READINGS, row) if w] for row in sums],
        }

    return per_batch(read, finish, "doc_id long, held_out boolean, score double, predicted int, n_clauses long, readings map<string, double>")
