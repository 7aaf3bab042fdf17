"""Line deduplication over levelled sorted runs of line hashes.

Documents arrive in batches. The keys of a batch are anti-joined with the runs that earlier batches
left; what remains is new, and becomes a run of its own. Once a level holds ``fanout`` runs they
are merged into one run of the next level, so a key is rewritten only a logarithmic number of times
and a batch meets few runs. All runs are bucketed and sorted by key: a run is never shuffled again.
"""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biosieve.llm.texts import id_and_text, per_batch, raw_text, stored

KEY = ["hi", "lo"]


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Distinct ``doc_id, hi, lo`` of the lines' keys: 128-bit hashes of stripped, A-Z lower-cased lines.

    Keys under ``min_chars`` code points are left out, and so are documents without an id.
    """

    def keys(batch):
        ids, digests = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = {key_hash(k) for k in map(line_key, text.split(b"\n")) if long_enough(k, min_chars)}
            ids.extend([doc] * len(own))
            digests.extend(own)
        pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
        return {"doc_id": ids, "hi": pairs[:, 0], "lo": pairs[:, 1]}

    return per_batch(id_and_text(docs).filter(F.col("doc_id").isNotNull()), keys, "doc_id long, hi long, lo long")


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class LineRuns:
    """The lines seen so far: levels of runs, each a table ``hi, lo, owner`` bucketed and sorted by key.

    ``owner`` is the document that keeps the line. ``buckets`` is fixed for the life of the index;
    choose it so that a bucket of the largest run fits a task.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (
            rows.repartition(self.buckets, *KEY)
            .write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").saveAsTable(name)
        )
        return name

    def _put(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            # a key is new in one batch only, so the runs are disjoint and merging needs no aggregation
            merged = self.spark.table(full[0])
            for other in full[1:]:
                merged = merged.unionByName(self.spark.table(other))
            self._put(level + 1, self._write(merged))
            self._drop(full)

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> None:
        """Record the lines (``doc_id, hi, lo``) of a batch whose ids lie above those of earlier batches."""
        fresh = lines.groupBy(*KEY).agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run).select(*KEY), KEY, "left_anti")
        self._put(0, self._write(fresh))

    def owners(self) -> DataFrame:
        """Every line seen with its owner."""
        found = [self.spark.table(run) for run in self.runs()]
        total = found[0]
        for other in found[1:]:
            total = total.unionByName(other)
        return total

    def clear(self) -> None:
        self._drop(self.runs())
        self.levels = []


def repeated_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """``doc_id, drop``: the key hashes (16 bytes each, joined) of the lines a document loses.

    A line is lost where its key occurs in a document with a smaller id. Batches are ranges of ids,
    cut at estimated quantiles; where the cuts fall does not change the result.
    """
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = (docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or []) if shares else []
    batch = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
    lines = stored(line_keys(docs, min_chars).withColumn("batch", batch.cast("int")), "line-keys", "batch")
    index = LineRuns(spark, fanout)
    for i in range(batches):
        index.add(lines.filter(F.col("batch") == i).select("doc_id", *KEY))
    lost = lines.join(index.owners(), KEY).filter(F.col("doc_id") != F.col("owner"))
    pad = lambda c: F.lpad(F.hex(c), 16, "0")
    packed = F.concat(pad("hi"), pad("lo"))
    drops = stored(lost.groupBy("doc_id").agg(F.concat_ws("", F.collect_list(packed)).alias("drop")), "line-drops")
    index.clear()
    return drops


def _hex_keys(drop: str) -> set[bytes]:
    """The digests behind ``drop`` (two big-endian 64-bit numbers each) in the byte order of ``key_hash``."""
    numbers = np.frombuffer(bytes.fromhex(drop), dtype=">i8").astype("<i8").tobytes()
    return {numbers[i : i + 16] for i in range(0, len(numbers), 16)}


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """Documents without the lines that a document with a smaller id has already.

    Returns ``doc_id, n_lines, n_dropped, kept`` per row of ``docs``, ``kept`` being the remaining
    lines joined by a line feed. A document's own repeats stay in the document that keeps the line.

    A null or empty text has one empty line. Rows without ``doc_id`` keep all lines and make no others
    go. Rows with the same id count as one document: none takes lines from the other. An empty table
    gives no rows; other columns are ignored. Very long texts are split whole.
    """
    drops = repeated_lines(docs, min_chars, batches, fanout)
    rows = docs.select("doc_id", raw_text()).join(drops, "doc_id", "left")

    def kept(batch):
        out = {"doc_id": batch.column(0), "n_lines": [], "n_dropped": [], "kept": []}
        for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            n, lost = text.count(b"\n") + 1, 0
            if drop:
                gone = _hex_keys(drop)
                lines = text.split(b"\n")
                stay = [x for x in lines if not long_enough(k := line_key(x), min_chars) or key_hash(k) not in gone]
                lost, text = n - len(stay), b"\n".join(stay)
            out["n_lines"].append(n)
            out["n_dropped"].append(lost)
            out["kept"].append(text)
        return out

    return per_batch(rows.select("doc_id", "text", "drop"), kept, "doc_id long, n_lines long, n_dropped long, kept binary")


def kept_digest(deduped: DataFrame) -> DataFrame:
    """Digest columns of ``dedup_lines``."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
