"""Product codes of vectors; the nearest codebook entry is found by equal-average search.

For a part x and an entry c of k components, (sum x - sum c)^2 <= k |x - c|^2. Entries sorted by their sums
are therefore met outwards from the part's own sum, until the squared gap over k exceeds the best distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.llm.texts import per_batch, stored

LIMIT = 1 << 27  # components stay below, so that squared distances and their sums are exact in 64 bits


def equal_average_search(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row of ``x`` and its squared distance; ties go to the lower index."""
    n, k = x.shape
    m = len(entries)
    totals = entries.sum(axis=1)
    order = np.argsort(totals, kind="stable")
    sums = totals[order]
    own = x.sum(axis=1)
    up = np.searchsorted(sums, own)  # next entry above and below
    down = up - 1
    best = np.full(n, np.iinfo(np.int64).max)
    who = np.full(n, m, np.int64)
    active = np.arange(n)
    far = np.iinfo(np.int64).max
    while len(active):
        u, d, s = up[active], down[active], own[active]
        gap_up = np.where(u < m, sums[np.minimum(u, m - 1)] - s, far)
        gap_down = np.where(d >= 0, s - sums[np.maximum(d, 0)], far)
        above = gap_up <= gap_down
        gap = np.where(above, gap_up, gap_down)
        # the gap only grows from here: with it over the bound on both sides a row is done
        inside = gap < far
        square = np.where(inside, gap, 0) ** 2
        inside &= (best[active] == far) | (square // k < best[active]) | ((square // k == best[active]) & (square % k == 0))
        active, above = active[inside], above[inside]
        if not len(active):
            break
        met = order[np.where(above, up[active], down[active])]
        difference = x[active] - entries[met]
        distance = np.einsum("ij,ij->i", difference, difference)
        nearer = (distance < best[active]) | ((distance == best[active]) & (met < who[active]))
        best[active[nearer]], who[active[nearer]] = distance[nearer], met[nearer]
        up[active] += above
        down[active] -= ~above
    return who, best


def codable(vectors: DataFrame, id_col: str, vector: str, label: str | None, parts: int) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` with integer components floor(256 x) of the usable vectors, and their length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if label else F.lit(None)).cast("string").alias("label"), v.alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", finite))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    if d % parts:
        raise ValueError(f"vectors of {d} components cannot be cut into {parts} equal parts")

    def scaled(batch):
        x = np.floor(256 * batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1))
        if len(x) and np.abs(x).max() >= LIMIT:
            raise ValueError(f"components of {LIMIT // 256} or more are beyond exact 64-bit distances")
        return {"vec_id": batch.column(0), "label": batch.column(1), "v": list(x.astype(np.int64))}

    return per_batch(rows.filter(F.size("v") == d), scaled, "vec_id long, label string, v array<long>"), d


def _cut(column, parts: int) -> list[np.ndarray]:
    """The parts of a column of vectors, one matrix for each position."""
    x = column.flatten().to_numpy().reshape(len(column), -1)
    return np.split(x, parts, axis=1)


def first_codebooks(vectors: DataFrame, size: int, parts: int) -> list[np.ndarray]:
    """Parts of the vectors with the ``size`` smallest ids; of an id with several vectors the least one."""
    smallest = vectors.filter("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(size)
    ids = [r["vec_id"] for r in smallest.collect()]
    rows = vectors.filter(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    if not rows:
        return []
    return np.split(np.array([r["v"] for r in rows], np.int64), parts, axis=1)


def refined(vectors: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks with every used entry moved to the mean of its parts, rounded down.

    A batch sends one row of sums for each entry it uses, so the shuffle and the driver see codebooks only.
    """
    parts, size, k = len(codebooks), *codebooks[0].shape

    def summed(batch):
        out = {c: [] for c in ["part", "entry", "n", *[f"s{i}" for i in range(k)]]}
        for part, (x, entries) in enumerate(zip(_cut(batch.column(0), parts), codebooks)):
            who, _ = equal_average_search(x, entries)
            n = np.bincount(who, minlength=size)
            sums = np.zeros((size, k), np.int64)
            np.add.at(sums, who, x)
            used = np.flatnonzero(n)
            for c, values in (("part", np.full(len(used), part)), ("entry", used), ("n", n[used]), *((f"s{i}", sums[used, i]) for i in range(k))):
                out[c] += values.tolist()
        return out

    schema = "part int, entry int, n long, " + ", ".join(f"s{i} long" for i in range(k))
    totals = per_batch(vectors.select("v"), summed, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(k)]]])
    new = [c.copy() for c in codebooks]
    for r in totals.collect():  # a row for each entry at most
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(k)]
    return new


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of the components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(c) for book in codebooks for c in book.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, id_col: str = "vec_id", vector: str = "embedding", label: str | None = "label"
) -> DataFrame:
    """Product codes of vectors and their errors.

    Returns ``vec_id, code, error, label_error, codebooks_sha256`` per usable row. Vectors become integers
    floor(256 x) and are cut into ``parts`` equal parts. A part's codebook starts as that part of the ``size``
    smallest ids and is moved ``rounds`` times to the means of what it is assigned, rounded down; unused entries stay.
    ``code`` holds the final indexes in hex, two digits each (as many as ``size`` needs beyond 256); ``error`` is the summed squared
    distance, ``label_error`` its sum over the rows of the same label, null labels together.

    Rows whose vector is null, holds null or non-finite components or has another length than most
    take no part. Rows without an id are coded but start no codebook; repeated rows count each and
    start one entry. With fewer ids than ``size`` the codebooks are shorter; without any, nothing can be coded
    and no rows come back. A length that ``parts`` does not divide, or components of 2^19 or more, raise an error. Other
    columns are ignored.
    """
    rows, _ = codable(vectors, id_col, vector, label, parts)
    rows = stored(rows, "integer-vectors")
    codebooks = first_codebooks(rows, size, parts)
    if not codebooks:
        schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        codebooks = refined(rows, codebooks)
    digits = max(2, len(f"{len(codebooks[0]) - 1:x}"))

    def coded(batch):
        found = [equal_average_search(x, entries) for x, entries in zip(_cut(batch.column(2), parts), codebooks)]
        indexes = np.stack([who for who, _ in found], axis=1).tolist()
        codes = ["".join(f"{i:0{digits}x}" for i in row) for row in indexes]
        return {"vec_id": batch.column(0), "label": batch.column(1), "code": codes, "error": sum(distance for _, distance in found)}

    out = stored(per_batch(rows, coded, "vec_id long, label string, code string, error long"), "vector-codes")
    sums = out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    joined = out.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def decode(codes: DataFrame, codebooks: list[np.ndarray], code: str = "code") -> DataFrame:
    """``codes`` with ``decoded``, the vector each code stands for (components of the codebooks over 256, plus half a step)."""
    digits = max(2, len(f"{len(codebooks[0]) - 1:x}"))
    tables = [F.array(*[F.array(*[F.lit((c + 0.5) / 256) for c in entry]) for entry in book.tolist()]) for book in codebooks]
    place = lambda i: F.conv(F.substring(code, 1 + i * digits, digits), 16, 10).cast("int")
    return codes.withColumn("decoded", F.flatten(F.array(*[F.get(table, place(i)) for i, table in enumerate(tables)])))
