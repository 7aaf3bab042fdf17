"""Mixing sources to target weights by iterative proportional fitting.

The token mass of each cell (source, language, topic) is scaled margin by margin until all margins
have their target shares. A document is then sampled with a probability in proportion to the scale
of its cell, so the expected mix has the target weights.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biosieve.llm.texts import per_batch, raw_text, stored, without

MARGINS = ("source", "lang", "topic")
# default targets: token counts to this power, so large sources and languages are damped and topics keep their share
ALPHA = {"source": 0.7, "lang": 0.85, "topic": 1.0}


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, n_tokens, topic`` per row; a missing source or language is the group ''.

    Tokens are words between white space. The topic is the register of the writing: ``table``
    (bars between words), ``symbols`` (other signs), ``caps`` (capitals), ``digits`` or ``prose``, the first
    that fits a fifth of the words (for capitals: half of the letters).
    """

    def count(batch):
        n, topic = [], []
        for text in batch.column(3).to_pylist():
            words = len(text.split())
            n.append(words)
            upper, lower = len(text) - len(text.translate(None, _UPPER)), len(text) - len(text.translate(None, _LOWER))
            share = lambda chars: len(text) - len(text.translate(None, chars))
            topic.append(
                "table" if 5 * text.count(b"|") > words
                else "symbols" if 5 * share(b"#$%&*@^~<>{}") > words
                else "caps" if upper > lower
                else "digits" if share(b"0123456789") > words
                else "prose"
            )
        return {"doc_id": batch.column(0), "source": batch.column(1), "lang": batch.column(2), "n_tokens": n, "topic": topic}

    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select("doc_id", known("source"), known("lang"), raw_text())
    return per_batch(rows, count, "doc_id long, source string, lang string, n_tokens long, topic string")


_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))


def tempered(alpha: float) -> Column:
    """Target mass of a group that has mass ``n``: large groups are damped by the exponent."""
    return F.pow(F.col("n").cast("double"), F.lit(alpha))


def targets_of(cells: DataFrame, margin: str, alpha: float, weights: Mapping[str, float] | None) -> DataFrame:
    """``margin, target``: the share of each group, from ``weights`` where given, else by ``tempered``.

    Groups that ``weights`` leaves out have weight 0; groups without tokens take no part.
    """
    groups = cells.groupBy(margin).agg(F.sum("n").alias("n"))
    if weights is None:
        wanted = groups.withColumn("w", tempered(alpha))
    else:
        listed = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], f"{margin} string, w double")
        wanted = groups.join(listed, margin, "left").na.fill(0.0, ["w"])
    total = wanted.agg(F.sum("w")).first()[0] or 1.0
    return wanted.select(margin, (F.col("w") / total).alias("target"))


def raked(
    cells: DataFrame,
    alpha: Mapping[str, float] = ALPHA,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    tolerance: float = 1e-4,
    rounds: int | None = None,
) -> DataFrame:
    """``cells`` (source, lang, topic, n) with ``mass``: the share of each cell after raking.

    A round scales the masses to each margin in turn; rounds go on until no group is off its target by
    more than ``tolerance`` of it. They end before that after ``rounds``, if given, or when the targets are
    shown to have no solution on the cells. Either way a warning then names the groups that are off and
    the last round's masses are kept. The cells, not the rows, are what is iterated.

    The proof: with f the factors of a round, any masses on these cells that meet the targets have the
    mean of log f over the cells equal to the sum of target x log f over all groups. If that sum is above
    the largest log f of any cell, there are no such masses. Without a solution the rounds settle into a
    cycle in which the sum stays positive and the largest log f goes to 0, so the proof is found.

    Targets that are hard to meet need hundreds of rounds, so the cells are iterated as arrays on the
    driver, about 100 bytes for each combination of source, language and topic that occurs.
    """
    spark, weights = cells.sparkSession, weights or {}
    table = cells.select(*MARGINS, F.col("n").cast("double").alias("n")).toArrow()
    n = table.column("n").to_numpy()
    if not n.sum() > 0:
        return cells.withColumn("mass", F.lit(0.0))
    names, codes, targets = [], [], []
    for m in MARGINS:
        groups = table.column(m).combine_chunks().dictionary_encode()
        names.append(groups.dictionary.to_pylist())
        codes.append(groups.indices.to_numpy())
        wanted = targets_of(cells, m, alpha[m], weights.get(m)).toArrow()
        wanted = dict(zip(wanted.column(m).to_pylist(), wanted.column("target").to_pylist()))
        targets.append(np.array([wanted[g] for g in names[-1]]))
    sums = lambda i: np.bincount(codes[i], weights=mass, minlength=len(names[i]))
    off = lambda i: np.where(targets[i] > 0, np.abs(sums(i) / np.where(targets[i] > 0, targets[i], 1.0) - 1), 0.0)
    mass, done = n / n.sum(), 0
    while rounds is None or done < rounds:
        done += 1
        change, gain = np.zeros(len(mass)), 0.0
        for i in range(len(MARGINS)):
            s = sums(i)
            log = np.log(targets[i], out=np.zeros(len(s)), where=targets[i] > 0) - np.log(s, out=np.zeros(len(s)), where=s > 0)
            mass = mass * np.where(s > 0, targets[i] / np.where(s > 0, s, 1.0), 0.0)[codes[i]]
            change += log[codes[i]]
            gain += float(targets[i] @ log)
        # the last margin can be off only where a group has no mass left
        if max(off(i).max() for i in range(len(MARGINS))) <= tolerance:
            break
        # a wanted group without mass, or the proof above; the difference is for rounding
        if any((sums(i)[targets[i] > 0] == 0).any() for i in range(len(MARGINS))) or gain > change[mass > 0].max() + 1e-9:
            break
    left = sorted(((float(x), m, g) for i, m in enumerate(MARGINS) for x, g in zip(off(i), names[i]) if x > tolerance), reverse=True)
    if left:
        warnings.warn(f"after {done} rounds {len(left)} groups are off their targets: " + ", ".join(f"{m} {g!r} by {x:.2g}" for x, m, g in left[:10]), stacklevel=2)
    out = table.select(list(MARGINS)).append_column("n", table.column("n").cast(pa.int64())).append_column("mass", pa.array(mass))
    return spark.createDataFrame(out)


def uniform(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the columns and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)).cast("double") / F.lit(float(1 << 53))


def mixing_weights(
    docs: DataFrame, alpha: Mapping[str, float] = ALPHA, keep: float = 1.0, weights: Mapping[str, Mapping[str, float]] | None = None, seed: int = 11
) -> DataFrame:
    """Sampling decisions that bring the token mix to the target weights.

    Returns ``doc_id, source, lang, topic, n_tokens, weight, probability, sampled`` per row of ``docs``.
    ``weight`` is the raked mass of the document's cell over its own; probabilities are in proportion
    to it, the largest being ``keep``, so that no document is needed more than once. The decision
    compares the probability with a hash of seed and id: it is the same in every run.

    Targets are ``weights[margin]`` where given, else the groups' token counts to the power ``alpha[margin]``.
    A null or empty text has no tokens and adds to no margin; it is sampled like its cell, or with
    probability ``keep`` where its cell has no tokens at all. Missing sources or languages form the
    group ''. Rows without an id share one draw per source and language. Repeated rows count each.
    An empty table gives no rows; other columns are ignored.
    """
    counts = stored(token_counts(docs), "token-counts")
    cells = stored(counts.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n")).filter("n > 0"), "cells")
    fitted = raked(cells, alpha, weights)
    total = fitted.agg(F.sum("n")).first()[0] or 1
    fitted = fitted.select(*MARGINS, (F.col("mass") * float(total) / F.col("n")).alias("weight"))
    largest = fitted.agg(F.max("weight")).first()[0] or 1.0
    probability = F.when(F.col("weight").isNull(), keep).otherwise(keep * F.col("weight") / largest)
    rows = counts.join(fitted, list(MARGINS), "left").withColumn("probability", probability)
    rows = rows.withColumn("sampled", uniform(seed, "doc_id", "source", "lang") < F.col("probability"))
    return rows.select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "probability", "sampled")


def sample_mix(docs: DataFrame, alpha: Mapping[str, float] = ALPHA, keep: float = 1.0, weights: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """The sampled documents with all their columns; rows without an id are kept.

    Rows that repeat an id are decided together: all go if one of them is not sampled.
    """
    return without(docs, mixing_weights(docs, alpha, keep, weights).filter("NOT sampled"))
