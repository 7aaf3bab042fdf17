"""Importance resampling towards a target distribution, on hashed n-grams.

Words are normalised to single blanks, so one overlapped regular expression finds at every word the runs of one
to three words that start there, each group continuing the one before. A CRC can be continued too:
the checksum of a run goes on from that of the run one word shorter.
"""

from __future__ import annotations

import hashlib
import math
import re
from zlib import crc32

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.llm.texts import id_and_text, per_batch, raw_text, stored

# what is not a word of a lower-cased text: ASCII other than digits and small letters
_SEPARATORS = re.compile(rb"[^0-9a-z\x80-\xff]+")
# a word between boundaries, and up to two more; matches overlap, so every word starts one
_RUNS = regex.compile(rb"(?<![^ ])([^ ]++)(?:( [^ ]++)( [^ ]++)?+)?+(?![^ ])")


def normal_words(text: bytes) -> bytes:
    """The words of a text in lower case (A-Z only), one blank between them."""
    return _SEPARATORS.sub(b" ", text.lower()).strip(b" ")


def run_checksums(words: bytes) -> list[int]:
    """CRC-32 of every run of one to three words of a ``normal_words`` text, repeats included."""
    found: list[int] = []
    add = found.append
    for match in _RUNS.finditer(words, overlapped=True):
        one, two, three = match.groups()
        c = crc32(one)
        add(c)
        if two is not None:
            c = crc32(two, c)
            add(c)
            if three is not None:
                add(crc32(three, c))
    return found


def hashed_runs(texts: DataFrame, buckets: int) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` of each row of ``doc_id, text`` (bytes); buckets are 16-bit numbers."""

    def scan(batch):
        n_words, n_features, found = [], [], []
        for text in batch.column(1).to_pylist():
            words = normal_words(text)
            numbers = np.array(run_checksums(words), np.uint32) % np.uint32(buckets)
            n_words.append(words.count(b" ") + 1 if words else 0)
            n_features.append(len(numbers))
            found.append(numbers.astype("<u2").tobytes())
        return {"doc_id": batch.column(0), "n_words": n_words, "n_features": n_features, "buckets": found}

    return per_batch(texts, scan, "doc_id long, n_words long, n_features long, buckets binary", rows=256)


def bucket_counts(runs: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: summed in each batch, then over all; ``buckets`` numbers reach the driver."""

    def count(batch):
        n = np.zeros(buckets, np.int64)
        for found in batch.column(0).to_pylist():
            n += np.bincount(np.frombuffer(found, "<u2"), minlength=buckets)
        own = np.flatnonzero(n)
        return {"b": own.astype(np.int32), "n": n[own]}

    total = np.zeros(buckets, np.int64)
    for r in per_batch(runs.select("buckets"), count, "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        total[r["b"]] = r["n"]
    return total


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket: 1000 times the log of its smoothed frequency in the target over that in the raw text, rounded down."""
    k, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((b + 1) * (s + k)) / float((a + 1) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int, seed: int) -> int:
    """Gumbel noise of a document, from a hash of its id, in thousandths rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``rank`` from 1 by falling score and rising doc_id up to ``most``, else null.

    The order is a range sort written once; only the sizes of its partitions are added up.
    """
    ordered = rows.orderBy(F.desc("score"), "doc_id").withColumn("_at", F.monotonically_increasing_id())
    ordered = stored(ordered, "importance-order").withColumn("_part", F.shiftright("_at", 33))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # as many rows as partitions
    before, starts = 0, []
    for r in sizes:
        starts.append((r["_part"], before))
        before += r["n"]
    starts = rows.sparkSession.createDataFrame(starts, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    placed = ordered.join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= most, rank))
    return placed.select(*rows.columns, "rank")


def importance_weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs``.

    A weight is the sum of the gains of the row's features (see ``gains``), counted over all texts
    of ``docs`` and of ``target``; the score adds the row's noise, so that the highest scores are a sample without
    replacement in proportion to the weights. Texts are read once: their bucket numbers are written and read again.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("bucket numbers are kept in 16 bits")
    runs = stored(hashed_runs(id_and_text(docs), buckets), "importance-runs", compression="uncompressed")
    wanted = hashed_runs(target.select(F.lit(None).cast("long").alias("doc_id"), raw_text()), buckets)
    gain = gains(bucket_counts(runs, buckets), bucket_counts(wanted, buckets))

    def weigh(batch):
        ids = batch.column(0).to_pylist()
        weights = [int(gain[np.frombuffer(found, "<u2")].sum()) for found in batch.column(3).to_pylist()]
        scores = [None if d is None else w + gumbel(d, seed) for d, w in zip(ids, weights)]
        return {"doc_id": batch.column(0), "n_words": batch.column(1), "n_features": batch.column(2), "weight": weights, "score": scores}

    return per_batch(runs, weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Every document's importance for the target, and the rank of those drawn.

    Returns ``doc_id, n_features, weight, score, rank`` per row of ``docs``. Of the N rows with an id and at
    least ``least_words`` words, floor(``percent`` N / 100) with the highest scores are drawn, ties going to
    the smaller doc_id; ``rank`` counts them from 1 and is null for the rest.

    Null and empty texts have no features and weight 0. Rows without ``doc_id`` are counted and
    weighed, but have no score and are not drawn. Repeated rows are counted and drawn each, with neighbouring ranks. An
    empty table gives no rows; an empty target only moves all weights. Other columns are ignored; texts are read whole.
    """
    weighed = stored(importance_weights(docs, target, buckets, seed), "importance")
    open_ = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    n = weighed.filter(open_).count()
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = _ranked(weighed.filter(open_).select(*columns), percent * n // 100)
    rest = weighed.filter(~open_).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
