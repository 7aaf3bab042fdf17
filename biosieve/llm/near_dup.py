"""Near-duplicate documents: MinHash with tensored banding, verified on full sets of word shingles.

The table keys of locality-sensitive hashing are usually drawn independently. Here two collections
of ``width`` hash tuples each are drawn, and every pair of a tuple of the first with one of the second
is a key: ``width``^2 tables of keys twice as long for the MinHash work of 2 ``width`` tuples.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.llm.graph import components
from biosieve.llm.texts import id_and_text, per_batch, stored, without

TUPLE = 2  # MinHash values in a tuple; a key has twice as many
_BITS = 1024
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of the whole sequence where it is shorter."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    w = np.fromiter(map(h, words), np.uint64, len(words))
    size = min(size, len(w))
    n = len(w) - size + 1
    acc = np.full(n, size, np.uint64)
    for j in range(size):
        acc = _mix(acc + _MUL) + w[j : j + n]
    return np.unique(_mix(acc))


def tuple_hashes(shingles: np.ndarray, count: int) -> np.ndarray:
    """``count`` hashes, each of ``TUPLE`` MinHash values."""
    seeds = _mix(np.arange(1, 2 * TUPLE * count + 1, dtype=np.uint64) * _MUL)
    factors, offsets = seeds[: TUPLE * count, None] | np.uint64(1), seeds[TUPLE * count :, None]
    least = np.full(TUPLE * count, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[None, at : at + 4096] * factors + offsets).min(axis=1), out=least)
    return _mix(_mix(least[::2]) + least[1::2])


def parity_bits(shingles: np.ndarray) -> bytes:
    """For each of ``_BITS`` residues whether an odd number of hashes has it.

    Two sets differ in at least as many elements as their bits differ, which bounds their overlap.
    """
    return np.packbits(np.bincount((shingles % np.uint64(_BITS)).astype(np.int64), minlength=_BITS) & 1).tobytes()


def table_width(percent: int, miss: float) -> int:
    """Tuples per collection such that a pair at ``percent`` similarity shares no key with probability ``miss`` at most.

    Both collections must agree in a tuple: the pair is missed if either of them does not.
    """
    agree = (percent / 100) ** TUPLE
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - agree))) if percent < 100 else 1


def sketches(docs: DataFrame, size: int, width: int) -> DataFrame:
    """``doc_id, n, hi, lo, tuples, bits`` per row: number of shingles, digest of the set, hashes, parities."""

    def sketch(batch):
        out = {c: [] for c in ("doc_id", "n", "hi", "lo", "tuples", "bits")}
        out["doc_id"] = batch.column(0)
        for text in batch.column(1).to_pylist():
            s = word_shingles(text, size)
            hi, lo = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") if len(s) else (None, None)
            out["n"].append(len(s))
            out["hi"].append(hi)
            out["lo"].append(lo)
            out["tuples"].append(tuple_hashes(s, 2 * width).view(np.int64) if len(s) else None)
            out["bits"].append(parity_bits(s) if len(s) else None)
        return out

    return per_batch(id_and_text(docs), sketch, "doc_id long, n long, hi long, lo long, tuples array<long>, bits binary", rows=256)


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The ``pairs`` (ids ``a, b``) whose full shingle sets are similar enough.

    Texts meet the ids by a merge join at any size: a list short enough to be sent around on a small
    input is not on a large one.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().hint("merge")

    def full(batch):
        sets = [word_shingles(t, size) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "shingles": [s.tobytes() for s in sets]}

    sets = stored(per_batch(id_and_text(docs).join(ids, "doc_id", "left_semi"), full, "doc_id long, shingles binary", rows=256), "shingle-sets")
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("shingles").alias(f"{c}_set"))

    def test(batch):
        yes = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            union = len(np.union1d(x, y))
            yes.append(100 * (len(x) + len(y) - union) >= percent * union)
        return {"a": batch.column(0), "b": batch.column(1), "yes": yes}

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set")
    return per_batch(both, test, "a long, b long, yes boolean").filter("yes").select("a", "b").distinct()


def _fits(n: str, m: str, percent: int):
    """Sizes at which two sets can reach the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _crossing(rows: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """Pairs ``a, b`` of rows (``key, size, cid, rep, component, n, bits``) of a bucket in different components.

    Pairs whose sizes or parities rule the similarity out are left out, and so are those with ``rep``,
    which were tested before. Large buckets are cut into blocks, each pair of blocks being a group.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"p": F.least("i", "j"), "q": F.greatest("i", "j")})

    def pairs(table):
        import pyarrow as pa

        cid, rep, comp, n, own, p, q = (table.column(c).to_numpy() for c in ("cid", "rep", "component", "n", "i", "p", "q"))
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(cid), -1)
        left = np.flatnonzero((own == p) & (cid != rep))
        right = np.flatnonzero((own == q) & (cid != rep))
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for at in range(0, len(left), 64):
            l = left[at : at + 64]
            total = n[l][:, None] + n[right][None, :]
            apart = np.bitwise_count(bits[l][:, None, :] ^ bits[right][None, :, :]).sum(axis=2, dtype=np.int64)
            # overlap <= (total - apart) / 2, and union = total - overlap
            fit = (100 + percent) * (total - apart) >= 2 * percent * total
            fit &= 100 * np.minimum(n[l][:, None], n[right][None, :]) >= percent * np.maximum(n[l][:, None], n[right][None, :])
            fit &= comp[l][:, None] != comp[right][None, :]
            x, y = np.nonzero(fit)
            found.append((cid[l[x]], cid[right[y]]))
        a, b = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    columns = ["key", "p", "q", "i", "cid", "rep", "component", "n", "bits"]
    return placed.select(*columns).groupBy("key", "p", "q").applyInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, miss: float = 1e-4) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least ``percent`` / 100 on ``size``-word shingles.

    Returns ``doc_id, n_shingles, component_id, kept`` per row of ``docs``. Links are confirmed on the
    full sets; component_id is the smallest doc_id reachable over links, ``kept`` marks that document.

    1. Documents with equal sets form a class, represented by its smallest id.
    2. Classes are put into the buckets of the tensored tables. In each bucket every class is tested
       against the smallest one, so a bucket costs as many tests as it has members.
    3. Only buckets that hold several components after that are looked at again, and only for pairs
       across components that sizes and parities (exact bounds) do not rule out.
    A linked pair is missed only if it shares no bucket and no chain of links replaces it: ``miss`` is
    the probability at the threshold, falling quickly above it.

    Null, empty and blank texts have no shingles and are linked with nothing. Rows without ``doc_id``
    take no part: no component, kept. Rows that repeat an id share its links. No rows give no rows;
    other columns are ignored; very long texts enter whole.
    """
    width = table_width(percent, miss)
    sketch = stored(sketches(docs, size, width), "sketches")
    classes = stored(
        sketch.filter("n > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo").agg(
            F.min("doc_id").alias("cid"), F.first("n").alias("n"), F.first("tuples").alias("tuples"), F.first("bits").alias("bits")
        ),
        "set-classes",
    )
    keys = F.expr(f"transform(sequence(0, {width * width - 1}), k -> xxhash64(k, tuples[int(k div {width})], tuples[{width} + k % {width}]))")
    keyed = classes.select("cid", F.explode(keys).alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("cid").alias("rep"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(keyed.join(buckets, "key"), "bucket-members")

    sizes = classes.select("cid", "n")
    named = lambda c: sizes.select(F.col("cid").alias(c), F.col("n").alias(f"{c}_n"))
    stars = members.filter("cid <> rep").select(F.col("rep").alias("a"), F.col("cid").alias("b")).distinct()
    stars = stars.join(named("a"), "a").join(named("b"), "b").filter(_fits("a_n", "b_n", percent)).select("a", "b")
    links = stored(verified(stored(stars, "star-pairs"), docs, size, percent), "links")
    found = components(links)

    crowded = members.filter("size > 2").join(found.withColumnRenamed("id", "cid"), "cid", "left")
    crowded = crowded.withColumn("component", F.coalesce("component", "cid"))
    mixed = crowded.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    rest = crowded.join(mixed, "key", "left_semi").join(classes.select("cid", "n", "bits"), "cid")
    more = stored(_crossing(rest, percent), "crossing-pairs")
    if not more.isEmpty():
        found = components(links.unionByName(verified(more, docs, size, percent)))

    label = classes.select("hi", "lo", "cid").join(found.withColumnRenamed("id", "cid"), "cid", "left")
    label = label.select("hi", "lo", F.coalesce("component", "cid").alias("component_id"))
    rows = sketch.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(label, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    rows = rows.withColumn("component_id", component)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the first of their group; all columns stay."""
    return without(docs, near_duplicates(docs, size, percent).filter("NOT kept"))
