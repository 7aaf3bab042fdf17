"""Benchmark decontamination by the pigeonhole principle and bit-parallel edit distance.

With an error budget of k edits, an item cut into k + 1 pieces keeps at least one piece untouched. The
pieces of all items are looked for exactly, in one pass over a text; around each hit the edit distance
of the whole item is computed with Myers' bit vectors.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biosieve.llm.texts import id_and_text, per_batch, without

# ASCII characters other than digits and lower-case letters separate words
_FOLD = {c: " " for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122)}


def normal_form(text: str) -> str:
    """Lower-cased words (digits, letters, characters beyond ASCII) with one blank before and after each; none gives ''."""
    words = text.lower().translate(_FOLD).split(" ")
    kept = [w for w in words if w]
    return f" {' '.join(kept)} " if kept else ""


def budget(item: str, rate: float) -> int:
    """Edits allowed for an item in normal form."""
    return int(rate * (len(item) - 2))


def pieces(item: str, count: int) -> list[tuple[int, str]]:
    """``item`` cut into ``count`` consecutive pieces of nearly equal length, with their places."""
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:z]) for a, z in zip(cuts, cuts[1:])]


def near_ends(pattern: str, text: str, most: int) -> list[tuple[int, int]]:
    """``(end, distance)`` for each place of ``text`` where a stretch with at most ``most`` edits to ``pattern`` ends.

    Myers' algorithm: the differences along a column of the distance table are two bit vectors, so a
    character costs a few operations on integers of the pattern's length.
    """
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        at[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    found = []
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score <= most:
            found.append((j, score))
    return found


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any stretch of ``text``, and the first place where such a stretch ends."""
    return min(((score, end) for end, score in near_ends(pattern, text, len(pattern) - 1)), default=(len(pattern), 0))


def exact_stretches(pattern: str, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Places of ``pattern`` in ``text[lo:hi]`` from left to right, each beginning at the last one's final blank or behind it."""
    out = []
    at = text.find(pattern, lo, hi)
    while at >= 0:
        out.append((at, at + len(pattern)))
        at = text.find(pattern, at + len(pattern) - 1, hi)
    return out


def near_stretches(pattern: str, text: str, lo: int, hi: int, errors: int) -> list[tuple[int, int, int]]:
    """``start, end, distance`` of stretches of ``text[lo:hi]`` near ``pattern``, from left to right.

    The ends that belong to one copy lie within twice the budget; the first best of them is taken and
    its start found backwards. The search goes on behind it, a blank between two stretches serving both.
    """
    out, free = [], lo
    ends = [(lo + end, score) for end, score in near_ends(pattern, text[lo:hi], errors)]
    i = 0
    while i < len(ends):
        if ends[i][0] - free < len(pattern) - errors:
            i += 1
            continue
        j = i
        while j < len(ends) and ends[j][0] <= ends[i][0] + 2 * errors:
            j += 1
        end, _ = min(ends[i:j], key=lambda e: (e[1], e[0]))
        back = text[max(free, end - len(pattern) - errors) : end][::-1]
        distance, length = best_match(pattern[::-1], back)
        if distance > errors:  # its start lies in the stretch before
            i += 1
            continue
        out.append((end - length, end, distance))
        free = end - 1 if text[end - 1] == " " else end
        while i < len(ends) and ends[i][0] <= end:
            i += 1
    return out


class PieceIndex:
    """Exact search for the pieces of a bounded number of items, and verification of the hits."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, text, budget(text, rate)) for i, text in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors + 1):
                found[piece].append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item, start, end, distance`` for each stretch of ``text`` (in normal form) near an item.

        Windows around hits of one item that overlap are searched together from end to end: first for exact
        copies, then what lies between these for near ones. Stretches of one item share no more than a blank.
        """
        if self.empty or not text:
            return []
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for last, (size, where) in self.automaton.iter(text):
            for number, at in where:
                start = last + 1 - size - at
                errors, length = self.items[number][2], len(self.items[number][1])
                lo, hi = max(0, start - errors), min(len(text), start + length + errors)
                own = windows[number]
                if own and lo < own[-1][1]:
                    own[-1][0], own[-1][1] = min(lo, own[-1][0]), max(hi, own[-1][1])
                else:
                    own.append([lo, hi])
        out = []
        for number, own in windows.items():
            item, pattern, errors = self.items[number]
            for lo, hi in own:
                free = lo
                for start, end in [*exact_stretches(pattern, text, lo, hi), (hi, hi)]:
                    upto = min(start + 1, hi)
                    if upto - free >= len(pattern) - errors:
                        out += [(item, *found) for found in near_stretches(pattern, text, free, upto, errors)]
                    if end > start:
                        out.append((item, start, end, 0))
                        free = end - 1
        return sorted(set(out))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """Documents that hold a benchmark item with at most ``rate`` edits per character.

    Returns ``doc_id, item_id, start, end, distance``: a row per stretch of a document near an item,
    in code points of the document's normal form (lower-cased words with single blanks). The items
    are taken in blocks of about ``block_chars`` characters, each searched in a pass of its own, so a
    task holds a bounded index however large the benchmark is.

    Null, empty and blank texts and items match nothing. Repeated rows give repeated hits, equal
    items a hit each; null ids are carried along. No items or documents give no rows. Other columns
    are ignored; long texts are searched whole.
    """
    items = benchmark.select("item_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    by_id = W.orderBy("block_no")
    # blocks from sizes summed by a coarse key, so that no task sees all items in order
    parts = items.withColumn("block_no", F.pmod(F.xxhash64("item_id", "text"), F.lit(1024)))
    sizes = parts.groupBy("block_no").agg(F.sum(F.length("text")).alias("n"))
    upto = sizes.withColumn("block", F.floor(F.sum("n").over(by_id) / block_chars)).select("block_no", "block").collect()  # 1024 rows
    groups: dict[int, list[int]] = defaultdict(list)
    for r in upto:
        groups[r["block"]].append(r["block_no"])

    def searched(numbers: list[int]) -> DataFrame:
        chosen = [(r["item_id"], normal_form(r["text"])) for r in parts.filter(F.col("block_no").isin(numbers)).select("item_id", "text").collect()]
        chosen = [(i, t) for i, t in chosen if t]
        indexes: list[PieceIndex] = []

        def search(batch):
            if not indexes:
                indexes.append(PieceIndex(chosen, rate))
            out = {c: [] for c in ("doc_id", "item_id", "start", "end", "distance")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for hit in indexes[0].hits(normal_form(text.decode("utf-8", "replace"))):
                    for c, v in zip(out, (doc, *hit)):
                        out[c].append(v)
            return out

        return per_batch(id_and_text(docs), search, "doc_id long, item_id long, start long, end long, distance long")

    blocks = [searched(numbers) for _, numbers in sorted(groups.items())]
    return reduce(DataFrame.unionByName, blocks) if blocks else searched([])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns stay, and so do rows without an id."""
    return without(docs, benchmark_hits(docs, benchmark, rate))
