"""Matching names to reference lists: exactly, by pattern and by small spelling differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosieve.constants import MIN_NAME_SCORE
from biosieve.functions.names import canonical_key
from biosieve.session import spread, task_count

# lengths of the text pieces used as join keys, longest first
_PIECES = (12, 3)
# depth of groups within groups that is looked through
_NESTED = 3


def match_backbone(names: DataFrame, backbone: DataFrame, name: str = "scientific_name") -> DataFrame:
    """Names with the taxon key of the backbone entry of the same canonical form; others are dropped.

    ``backbone`` holds ``canonical_name, usage_key``.
    """
    entries = backbone.filter(F.col("usage_key").isNotNull()).select(canonical_key("canonical_name").alias("_key"), "usage_key").distinct()
    return names.withColumn("_key", canonical_key(name)).join(entries, "_key").drop("_key")


def _required_text(pattern: Column) -> Column:
    """Longest run of plain text outside brackets that every match of a regular expression must contain.

    Classes and then groups, innermost first, are taken out whole, and so is whatever a quantifier
    makes optional. Empty when alternatives or unusual brackets remain, or an escape is used, whose
    required text is not judged here.
    """
    mark = "\u0001"
    bare = F.regexp_replace(pattern, r"\[\^?\]?[^\]\[]*\]", mark)
    for _ in range(_NESTED):
        bare = F.regexp_replace(bare, r"\([^()]*\)", mark)
    plain = F.regexp_replace(F.regexp_replace(bare, r"(?s).(?:[*?]|\{[0-9,]*\})[*?+]*", mark), "[+][?+]*|[.^$]", mark)
    runs = F.array_sort(F.transform(F.split(plain, mark), lambda r: F.struct((-F.length(r)).alias("l"), r.alias("r"))))
    flagged = pattern.contains("\\") | pattern.rlike(r"\(\?[a-zA-Z-]+[:)]")  # escapes; flags that may ignore case
    return F.when(flagged | bare.rlike(r"[|()\[\]]") | plain.rlike("[{}]"), "").otherwise(F.element_at(runs, 1).getField("r"))


def _piece(text: Column) -> Column:
    """End of the text in the longest piece length it fills (the end tells names of a genus apart)."""
    piece = F
    for n in _PIECES:
        piece = piece.when(F.length(text) >= n, F.right(text, F.lit(n)))
    return piece


def _pieces(name: Column) -> Column:
    """All distinct pieces of a name, of every piece length."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(name) - (n - 1))
        return F.when(F.length(name) >= n, F.transform(starts, lambda i: F.substring(name, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in _PIECES]))


def _pattern_hits(names: DataFrame, patterns: DataFrame, literal: bool) -> DataFrame:
    """Distinct (``_name``, ``_pattern``) pairs where the pattern occurs in the name.

    Patterns with required text meet only names that contain a piece of it. For the rest the names
    are spread over keys that each hold the patterns: such a pattern has to be tried on every
    distinct name, and this shares the work evenly without broadcasting.
    """
    parts = task_count(names.sparkSession)
    test = F.contains(F.col("_name"), F.col("_pattern")) if literal else F.expr("_name RLIKE _pattern")
    text = F.col("_pattern") if literal else _required_text(F.col("_pattern"))
    keyed = patterns.withColumn("_piece", _piece(text))
    by_piece = names.withColumn("_piece", F.explode(_pieces(F.col("_name")))).join(keyed.filter(F.col("_piece").isNotNull()), "_piece")
    rest = keyed.filter(F.col("_piece").isNull()).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    by_part = names.withColumn("_part", F.pmod(F.xxhash64("_name"), F.lit(parts)).cast("int"))
    by_part = spread(by_part, "_part").join(spread(rest, "_part"), "_part")
    return by_piece.select("_name", "_pattern").unionByName(by_part.select("_name", "_pattern")).filter(test)


def regex_match(
    names: DataFrame, patterns: DataFrame, name: str, pattern: str, literal: bool = False, how: str = "inner"
) -> DataFrame:
    """Names joined with every pattern that occurs in them (case-sensitive).

    ``literal`` reads the pattern as plain text. ``how="left"`` keeps names without a hit.
    """
    left = names.select(F.col(name).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    right = patterns.select(F.col(pattern).alias("_pattern")).filter(F.col("_pattern").isNotNull()).distinct()
    hits = _pattern_hits(left, right, literal)
    listed = hits.join(patterns, F.col("_pattern") == F.col(pattern)).drop("_pattern")
    return names.join(listed, F.col(name) == F.col("_name"), how).drop("_name")


def remove_regulated(names: DataFrame, patterns: DataFrame, name: str, pattern: str, literal: bool = False) -> DataFrame:
    """Names in which no pattern occurs."""
    left = names.select(F.col(name).alias("_name")).filter(F.col("_name").isNotNull()).distinct()
    right = patterns.select(F.col(pattern).alias("_pattern")).filter(F.col("_pattern").isNotNull()).distinct()
    hit = _pattern_hits(left, right, literal).select("_name").distinct()
    return names.join(hit, F.col(name) == F.col("_name"), "left_anti")


# letters with the number of their copies a signature tells apart: 62 bits
_COUNTED = {c: 3 if c in "aeio" else 4 if c == " " else 2 for c in "abcdefghijklmnopqrstuvwxyz 0123"}


def _signature(text: Column) -> Column:
    """Bits for the first, second, … copy of common letters; an edit changes at most two of them."""
    bits, at = F.lit(0).cast("long"), 0
    for letter, most in _COUNTED.items():
        copies = F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))
        # n copies set the n lowest of the letter's bits
        ones = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(copies, F.lit(most))) - 1
        bits = bits.bitwiseOR(F.shiftleft(ones, at))
        at += most
    return bits


def _budget(longer: Column, min_score: float) -> Column:
    """Most edits with which two names, the longer one of this length, keep the score."""
    return F.floor((1 - min_score) * longer + 1e-9).cast("int")


def _segment(length: Column, budget: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of a name in ``budget`` + 1 segments, the later ones longer where they differ."""
    base, longer = F.floor(length / (budget + 1)).cast("int"), length % (budget + 1)
    first_long = budget + 1 - longer
    return (i * base + F.greatest(F.lit(0), i - first_long)).cast("int"), base + (i >= first_long).cast("int")


def _index(names: DataFrame, name: str, min_score: float) -> DataFrame:
    """``name, _sig, _start, _size, _key`` for each segment of each name, under every budget that a partner's length may call for."""
    n = F.length(name)
    rows = spread(names, name).select(name, _signature(F.col(name)).alias("_sig"), n.alias("_n"))
    rows = rows.withColumn("_t", F.explode(F.sequence(_budget(F.col("_n"), min_score), _budget(F.floor(F.col("_n") / min_score + 1e-9), min_score))))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_t"))))
    start, size = _segment(F.col("_n"), F.col("_t"), F.col("_i"))
    return rows.select(name, "_sig", start.alias("_start"), size.alias("_size"), F.xxhash64("_n", "_t", "_i", F.substring(F.col(name), start + 1, size)).alias("_key"))


def _probes(names: DataFrame, name: str, min_score: float) -> DataFrame:
    """``name, _sig, _t, _i, _at, _key``: the pieces of each name at which a partner of any possible length can have kept a segment.

    Of the segments that stay whole, one has at most i edits before and budget - i behind it, i being its number; so it
    is moved by so much at most, seen from the start and from the end.
    """
    n = F.length(name)
    rows = spread(names, name).select(name, _signature(F.col(name)).alias("_sig"), n.alias("_len"))
    shortest, longest = F.ceil(F.col("_len") * min_score - 1e-9), F.floor(F.col("_len") / min_score + 1e-9)
    rows = rows.withColumn("_n", F.explode(F.sequence(shortest.cast("int"), longest.cast("int"))))
    rows = rows.withColumn("_t", _budget(F.greatest("_len", "_n"), min_score)).filter(F.abs(F.col("_len") - F.col("_n")) <= F.col("_t"))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_t"))))
    start, size = _segment(F.col("_n"), F.col("_t"), F.col("_i"))
    shift, behind = F.col("_len") - F.col("_n"), F.col("_t") - F.col("_i")
    first = F.greatest(start - F.col("_i"), start + shift - behind, F.lit(0))
    last = F.least(start + F.col("_i"), start + shift + behind, F.col("_len") - size)
    rows = rows.withColumn("_size", size).withColumn("_first", first).filter(F.col("_first") <= last).withColumn("_at", F.explode(F.sequence(F.col("_first"), last)))
    return rows.select(name, "_sig", "_t", "_i", "_at", F.xxhash64("_n", "_t", "_i", F.substring(F.col(name), F.col("_at") + 1, F.col("_size"))).alias("_key"))


def _close_pairs(a: DataFrame, b: DataFrame, min_score: float, group: int = 256) -> DataFrame:
    """Distinct ``_a, _b`` within the edits that ``min_score`` leaves, from names ``_a`` and ``_b``.

    A segment common to many names is divided into blocks of about ``group`` names on both sides. In the join, letter counts are
    compared first, then the parts before and behind the shared segment, each with its own budget; so
    next to nothing but pairs that are close is shuffled further.

    Probes and index hold many rows for each name, while Spark's size estimates see the names alone and would
    collect and broadcast either side through the driver. Each join on them is therefore named a merge join.
    """
    probes = _probes(a, "_a", min_score).withColumnRenamed("_sig", "_sa")
    index = _index(b, "_b", min_score).withColumnRenamed("_sig", "_sb")
    blocks = lambda c: F.ceil(F.col(c) / group).cast("int")
    sizes = probes.groupBy("_key").agg(F.count(F.lit(1)).alias("_pn")).hint("merge").join(index.groupBy("_key").agg(F.count(F.lit(1)).alias("_in")), "_key")
    sizes = sizes.select(F.col("_key").alias("_k"), blocks("_pn").alias("_pb"), blocks("_in").alias("_ib"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda name, c: F.pmod(F.xxhash64(F.col(name), F.lit(1)), F.col(c)).cast("int")
    key = ["_k", "_x", "_y"]
    left = probes.hint("merge").join(sizes, F.col("_key") == F.col("_k")).withColumn("_x", own("_a", "_pb")).withColumn("_y", upto("_ib"))
    right = index.hint("merge").join(sizes, F.col("_key") == F.col("_k")).withColumn("_y", own("_b", "_ib")).withColumn("_x", upto("_pb"))
    left, right = left.select(*key, "_a", "_sa", "_t", "_i", "_at"), right.select(*key, "_b", "_sb", "_start", "_size")
    # an edit takes one letter away at most, and adds one at most
    alike = "bit_count(_sa & ~_sb) <= _t AND bit_count(_sb & ~_sa) <= _t"
    before = "levenshtein(substring(_a, 1, _at), substring(_b, 1, _start), _i) >= 0"
    behind = "levenshtein(substring(_a, _at + _size + 1), substring(_b, _start + _size + 1), _t - _i) >= 0"
    met = spread(left, *key).hint("merge").join(spread(right, *key), key)
    return met.filter(F.expr(f"{alike} AND {before} AND {behind}")).select("_a", "_b").distinct()


def resolve_names(names: DataFrame, reference: DataFrame, name: str = "submitted_name", min_score: float = MIN_NAME_SCORE) -> DataFrame:
    """Reference names that score at least ``min_score`` for a submitted name.

    ``reference`` holds ``matched_name, data_source_title``. Returns ``submitted_name, matched_name,
    score, data_source_title`` with score = 1 - edits / longer length over canonical forms. The score alone
    decides: the number of edits it leaves follows from the lengths of both names.

    A pair within d edits shares one of d + 1 segments of the reference name, moved by few letters, so candidates
    come from an equi-join on (length, budget, segment number, text); see ``_close_pairs``. Names are made distinct first. A name has
    about (1 - ``min_score``)^3 length^3 probes, so names are expected to be short (a hundred letters or so).

    ``min_score`` must exceed 0.5, below which no segment need be shared. Missing names match nothing.
    """
    if not 0.5 < min_score <= 1:
        raise ValueError("min_score must be over 0.5 and at most 1")
    left = names.select(F.col(name).alias("submitted_name")).filter(F.col("submitted_name").isNotNull()).distinct().withColumn("_a", canonical_key("submitted_name"))
    right = reference.select("matched_name", "data_source_title").filter(F.col("matched_name").isNotNull()).distinct().withColumn("_b", canonical_key("matched_name"))
    pairs = _close_pairs(left.select("_a").distinct(), right.select("_b").distinct(), min_score)
    # as a generated column the distance is not evaluated again by the filter on it
    longer = F.greatest(F.length("_a"), F.length("_b"))
    edits = F.explode_outer(F.array(F.expr(f"levenshtein(_a, _b, CAST(floor({1 - min_score!r} * greatest(length(_a), length(_b)) + 1e-9) AS INT))")))
    pairs = spread(pairs, "_a", "_b").withColumn("_d", edits).filter(F.col("_d") >= 0)
    score = 1 - F.col("_d") / F.greatest(longer, F.lit(1))
    return (
        left.join(pairs.hint("merge"), "_a")
        .join(right, "_b")
        .select("submitted_name", "matched_name", score.alias("score"), "data_source_title")
        .filter(F.col("score") >= min_score)
    )
