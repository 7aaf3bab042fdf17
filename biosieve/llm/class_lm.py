"""Language-model scores by a Brown class bigram model.

Words are grouped into classes by exchange clustering; a text's probability is the product of class
transitions and of word emissions. Counts are taken over the whole corpus. A block (one Arrow batch of
documents) keeps its tokens as numbers of its own vocabulary, so only vocabularies are shuffled:
each word once per block, out to be summed and back with the total.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from biosieve.llm.texts import id_and_text, per_batch, stored
from biosieve.session import spread

END = b"\n"  # no word holds a line feed
SHAPES = 251
_SHARE = 4096  # words placed by a task at once
_WORD_TYPES = 1024  # types below are shapes, from here on places in the core


def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 when divided by 7."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def shape(word: bytes) -> int:
    """Type shared by infrequent words: by their last three bytes."""
    return zlib.crc32(word[-3:]) % SHAPES


def blocks(docs: DataFrame) -> DataFrame:
    """A row per batch: ``block``, its vocabulary (hashes, shapes, counts in training texts) and its tokens.

    ``tokens`` are places in the vocabulary, compressed, of all texts of the block one after another.
    """

    def encode(batch):
        number = defaultdict(itertools.count().__next__)
        ids = batch.column(0).to_pylist()
        parts, held = [], []
        for doc, text in zip(ids, batch.column(1).to_pylist()):
            words = text.lower().split()
            words.append(END)
            parts.append(np.array([number[w] for w in words], np.int32))
            held.append(held_out(doc))
        tokens = np.concatenate(parts) if parts else np.empty(0, np.int32)
        learnt = [p for p, h in zip(parts, held) if not h]
        counts = np.bincount(np.concatenate(learnt), minlength=len(number)) if learnt else np.zeros(len(number), np.int64)
        # frequent words get small numbers, which compress better
        order = np.argsort(-np.bincount(tokens, minlength=len(number)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        vocabulary = list(number)
        words = [vocabulary[i] for i in order]
        task = TaskContext.get().partitionId()
        state["n"] = state["n"] + 1 if state.get("task") == task else 0
        state["task"] = task
        return {
            "block": [(task << 24) + state["n"]],
            "words": [np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)],
            "shapes": [np.fromiter(map(shape, words), np.int32, len(words))],
            "counts": [counts[order].astype(np.int32)],
            "doc_ids": [ids],
            "held": [held],
            "lengths": [[len(p) for p in parts]],
            "tokens": [zstandard.ZstdCompressor(level=1).compress(rank[tokens].astype(np.int32).tobytes())],
        }

    state: dict = {}
    schema = (
        "block long, words array<long>, shapes array<int>, counts array<int>, doc_ids array<long>, held array<boolean>, "
        "lengths array<int>, tokens binary"
    )
    return per_batch(id_and_text(docs), encode, schema)


def vocabulary(table: DataFrame, least: int) -> DataFrame:
    """Every word of every block: ``block, place, word, shape, local, n, first``.

    ``local`` counts the word in the block's training texts, ``n`` in all of them; ``first`` marks one block of each
    word. ``word``, the hash, is kept where n reaches ``least`` only.
    """
    words = table.select("block", F.posexplode(F.arrays_zip("words", "shapes", "counts")).alias("place", "w")).select("block", "place", "w.*")
    # a word has one row per block at most, so its rows stay few however frequent it is
    same = W.partitionBy("words")
    total = words.withColumn("n", F.sum("counts").over(same)).withColumn("first", F.min("block").over(same) == F.col("block"))
    return total.select(
        "block", "place", F.when(F.col("n") >= least, F.col("words")).alias("word"), F.col("shapes").alias("shape"),
        F.col("counts").alias("local"), "n", "first",
    )


def _unpacked(packed: bytes, kind: type = np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.int64).tobytes())


def _list(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """The array column of a table of one row."""
    column = table.column(name)
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)


def _steps(tokens: np.ndarray, lengths: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each token of the training texts, and the token; before a text stands its own end."""
    ends = np.cumsum(lengths)
    before = np.roll(tokens, 1)
    before[ends - lengths] = tokens[ends - 1]
    learnt = np.repeat(~held, lengths)
    return before[learnt], tokens[learnt]


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among the sorted ones, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def type_bigrams(table: DataFrame, core: np.ndarray) -> DataFrame:
    """``t1, t2, n`` over the training texts; the type of a word in ``core`` is its place there, of another its shape."""

    def count(batch):
        at, is_core = _found(core, _list(batch, "words"))
        types = np.where(is_core, at + _WORD_TYPES, _list(batch, "shapes"))
        before, own = _steps(_unpacked(batch.column("tokens")[0].as_py()), _list(batch, "lengths"), _list(batch, "held"))
        pairs, n = np.unique((types[before] << 32) | types[own], return_counts=True)
        return {"t1": (pairs >> 32).astype(np.int32), "t2": (pairs & 0xFFFFFFFF).astype(np.int32), "n": n}

    rows = table.select("words", "shapes", "tokens", "lengths", "held")
    return per_batch(rows, count, "t1 int, t2 int, n long", rows=1).groupBy("t1", "t2").agg(F.sum("n").alias("n"))


def _phi(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def best_class(own: int, left: np.ndarray, right: np.ndarray, self_count: float, matrix: np.ndarray) -> int:
    """The class in which a type adds most to the clustering's likelihood, all else staying.

    ``left``/``right`` count the classes before/after the type, ``matrix`` the transitions between classes.
    """
    m = matrix.copy()
    m[own] -= right
    m[:, own] -= left
    m[own, own] += self_count
    before, after = left.copy(), right.copy()
    before[own] -= self_count
    after[own] -= self_count
    diagonal = np.diag(m)
    gain = (_phi(m + after[None, :]) - _phi(m)).sum(axis=1) - (_phi(diagonal + after) - _phi(diagonal))
    gain += (_phi(m + before[:, None]) - _phi(m)).sum(axis=0) - (_phi(diagonal + before) - _phi(diagonal))
    gain += _phi(diagonal + before + after + self_count) - _phi(diagonal)
    rows, columns = matrix.sum(axis=1), matrix.sum(axis=0)
    rows[own] -= right.sum()
    columns[own] -= left.sum()
    gain -= _phi(rows + right.sum()) - _phi(rows)
    gain -= _phi(columns + left.sum()) - _phi(columns)
    best = int(np.argmax(gain))
    return best if gain[best] > gain[own] + 1e-9 else own


def likelihood(matrix: np.ndarray) -> float:
    """The part of the training texts' log-likelihood that depends on the classes, from their transition counts."""
    return float(_phi(matrix).sum() - _phi(matrix.sum(axis=0)).sum() - _phi(matrix.sum(axis=1)).sum())


def exchange_classes(bigrams: DataFrame, classes: int, rounds: int) -> tuple[dict[int, int], np.ndarray, list[float]]:
    """Class of each type, the transition counts of the classes and the likelihoods on the way.

    Every round counts the classes around each type and lets one half of the types, then the other, move to
    their best class at once. A round after which the likelihood fell is taken back, and only half as many
    types move at once from then on; rounds end when all types were tried and gained next to nothing.
    The number of types is bounded by the frequency they need, so the assignment fits the driver; bigrams and
    profiles stay on the executors.
    """
    sides = bigrams.select(F.col("t1").alias("t"), F.lit(True).alias("right"), F.col("t2").alias("other"), "n").unionByName(
        bigrams.select(F.col("t2").alias("t"), F.lit(False).alias("right"), F.col("t1").alias("other"), "n")
    )
    known = np.array(sorted(r["t"] for r in bigrams.select(F.explode(F.array("t1", "t2")).alias("t")).distinct().collect()), np.int64)
    assigned = np.array([xxhash.xxh3_64_intdigest(str(t).encode()) % classes for t in known], np.int64)
    if not len(known):
        return {}, np.zeros((classes, classes)), [0.0]

    def profiles(current: np.ndarray) -> DataFrame:
        def classify(batch):
            other = batch.column(2).to_numpy().astype(np.int64)
            return {
                "t": batch.column(0), "right": batch.column(1), "c": current[np.searchsorted(known, other)],
                "same": np.where(batch.column(0).to_numpy() == other, batch.column(3).to_numpy(), 0), "n": batch.column(3),
            }

        counted = per_batch(sides, classify, "t int, right boolean, c int, same long, n long")
        return stored(counted.groupBy("t", "right", "c").agg(F.sum("n").alias("n"), F.sum("same").alias("same")), "class-profiles")

    def transitions(counted: DataFrame, current: np.ndarray) -> np.ndarray:
        """At most classes^2 counts from each task, summed."""

        def collapse(batch):
            of = current[np.searchsorted(known, batch.column(0).to_numpy().astype(np.int64))]
            return {"a": of, "c": batch.column(1), "n": batch.column(2)}

        return _matrix(per_batch(counted.filter("right").select("t", "c", "n"), collapse, "a int, c int, n long"), classes)

    counted = profiles(assigned)
    matrix = transitions(counted, assigned)
    path, parts, turn = [likelihood(matrix)], 2, 0
    for _ in range(rounds):
        current, part = assigned, turn % parts

        def move(group: pa.Table) -> pa.Table:
            t = group.column("t")[0].as_py()
            own = int(current[np.searchsorted(known, t)])
            if xxhash.xxh3_64_intdigest(f"half:{t}".encode()) % parts == part:
                vectors = np.zeros((2, classes))
                side = group.column("right").to_numpy(zero_copy_only=False).astype(int)
                vectors[side, group.column("c").to_numpy()] = group.column("n").to_numpy()
                same = float(group.column("same").to_numpy()[side == 1].sum())
                own = best_class(own, vectors[0], vectors[1], same, matrix)
            return pa.table({"t": pa.array([t], pa.int32()), "c": pa.array([own], pa.int32())})

        moved = {r["t"]: r["c"] for r in counted.groupBy("t").applyInArrow(move, "t int, c int").collect()}
        tried = np.array([moved[int(t)] for t in known], np.int64)
        around = profiles(tried)
        after = transitions(around, tried)
        turn += 1
        if likelihood(after) < path[-1]:
            parts *= 2
            continue
        assigned, counted, matrix = tried, around, after
        path.append(likelihood(matrix))
        if len(path) > parts and path[-1] - path[-1 - parts] <= 0.01 * (path[-1] - path[0]):
            break
    return dict(zip(known.tolist(), assigned.tolist())), matrix, path


def _matrix(pairs: DataFrame, classes: int) -> np.ndarray:
    """Sums of ``n`` by two classes ``a, c``, as many numbers as pairs of classes."""
    m = np.zeros((classes, classes))
    for r in pairs.groupBy("a", "c").agg(F.sum("n").alias("n")).collect():
        m[r["a"], r["c"]] = r["n"]
    return m


def place_words(table: DataFrame, places: DataFrame, core: np.ndarray, core_class: np.ndarray, shape_class: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """``word, class`` of the frequent words outside the core: each leaves its ending's class for its best one.

    A block counts the classes around each of its words. Most of these counts are 0, so it sends the others only, packed
    into a row for each share of the words; shares have ``_SHARE`` words or so, however many there are, and one adds up and
    places the words of a share.
    """
    classes = len(matrix)
    words = places.filter("word IS NOT NULL AND local > 0").select("block", "place", "word")
    shares = 1 + places.filter("first AND word IS NOT NULL").count() // _SHARE

    def around(left: pa.Table, right: pa.Table) -> pa.Table:
        of = shape_class[_list(left, "shapes")]
        place, word = right.column("place").to_numpy(), right.column("word").to_numpy()
        at, is_core = _found(core, word)
        of[place[is_core]] = core_class[at[is_core]]
        place, word = place[~is_core], word[~is_core]
        share = (word.view(np.uint64) % np.uint64(shares)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        place, word, share = place[order], word[order], share[order]
        number = np.full(len(of), -1, np.int64)
        number[place] = np.arange(len(place))
        before, own = _steps(_unpacked(left.column("tokens")[0].as_py()), _list(left, "lengths"), _list(left, "held"))
        # a key is a word's number, a side and a class there
        keys = np.concatenate([
            (number[own] * (2 * classes) + of[before])[number[own] >= 0],
            (number[before] * (2 * classes) + classes + of[own])[number[before] >= 0],
        ])
        keys, n = np.unique(keys, return_counts=True)
        same = np.bincount(number[own][(own == before) & (number[own] >= 0)], minlength=len(place))
        out = {c: [] for c in ("share", "words", "own", "same", "keys", "n")}
        for k in np.unique(share):
            a, z = np.searchsorted(share, [k, k + 1])
            i, j = np.searchsorted(keys, [a * 2 * classes, z * 2 * classes])
            rows = (word[a:z], of[place[a:z]], same[a:z], np.diff(keys[i:j] - a * 2 * classes, prepend=0), n[i:j])
            for c, v in zip(out, (int(k), *(_packed(v) for v in rows))):
                out[c].append(v)
        return pa.table({"share": pa.array(out.pop("share"), pa.int32())} | {c: pa.array(v, pa.binary()) for c, v in out.items()})

    def decide(table: pa.Table) -> pa.Table:
        unpack = lambda c: [_unpacked(x, np.int64) for x in table.column(c).to_pylist()]
        lists = unpack("words")
        known, first = np.unique(np.concatenate(lists), return_index=True)
        own, same = np.concatenate(unpack("own"))[first], np.zeros(len(known))
        sums = np.zeros(len(known) * 2 * classes)
        for word, s, keys, n in zip(lists, *map(table.column, ("same", "keys", "n"))):
            at = np.searchsorted(known, word)
            same[at] += _unpacked(s.as_py(), np.int64)
            keys = np.cumsum(_unpacked(keys.as_py(), np.int64))
            number, side = np.divmod(keys, 2 * classes)
            sums[at[number] * 2 * classes + side] += _unpacked(n.as_py(), np.int64)
        sums = sums.reshape(len(known), 2 * classes)
        best = [best_class(int(o), v[:classes], v[classes:], float(z), matrix) for o, z, v in zip(own, same, sums)]
        return pa.table({"word": known, "class": pa.array(best, pa.int32())})

    texts = table.select("block", "shapes", "lengths", "held", "tokens")
    packed = "share int, words binary, own binary, same binary, keys binary, n binary"
    counted = texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(around, packed)
    # few rows, but much work for each: one task for each share where there are as many
    return spread(counted, "share").groupBy("share").applyInArrow(decide, "word long, class int")


def class_sequences(table: DataFrame, places: DataFrame, assigned: DataFrame, shape_class: np.ndarray) -> DataFrame:
    """Per document: ``doc_id, held, n_tokens, n_known, logs, classes, core_classes``.

    ``logs`` sums log10(count + 1) over the tokens, ``classes`` holds the class of each, compressed; for ``core_classes`` only
    words marked ``core`` in ``assigned`` (``word, class, core``) leave their ending's class. A word that no other block has
    needs no row: its count is the block's own, its class its ending's.
    """
    frequent = places.filter("word IS NOT NULL").join(assigned, "word", "left").select("block", "place", "n", "class", "core")
    rare = places.filter("word IS NULL AND n <> local").select("block", "place", "n", F.lit(None).cast("int").alias("class"), F.lit(None).cast("boolean").alias("core"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        n, of = _list(left, "counts").astype(np.int64), shape_class[_list(left, "shapes")]
        place = right.column("place").to_numpy()
        n[place] = right.column("n").to_numpy()
        named = right.column("class").is_valid().to_numpy(zero_copy_only=False).astype(bool)
        named_class = right.column("class").drop_null().to_numpy()
        is_core = right.column("core").drop_null().to_numpy(zero_copy_only=False).astype(bool)
        of_core = of.copy()
        of[place[named]] = named_class
        of_core[place[named][is_core]] = named_class[is_core]
        tokens, lengths = _unpacked(left.column("tokens")[0].as_py()), _list(left, "lengths").astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        squeeze = zstandard.ZstdCompressor(level=1).compress
        split = lambda seq: pa.array([squeeze(seq[a : a + z].tobytes()) for a, z in zip(starts, lengths)], pa.binary())
        return pa.table({
            "doc_id": pa.array(left.column("doc_ids")[0].as_py(), pa.int64()), "held": pa.array(_list(left, "held")), "n_tokens": lengths,
            "n_known": np.add.reduceat((n > 0)[tokens].astype(np.int64), starts), "logs": np.add.reduceat(np.log10(n + 1.0)[tokens], starts),
            "classes": split(of.astype(np.uint8)[tokens]), "core_classes": split(of_core.astype(np.uint8)[tokens]),
        })

    schema = "doc_id long, held boolean, n_tokens long, n_known long, logs double, classes binary, core_classes binary"
    texts = table.select("block", "shapes", "counts", "doc_ids", "held", "lengths", "tokens")
    return texts.groupBy("block").cogroup(frequent.unionByName(rare).groupBy("block")).applyInArrow(score, schema)


def class_transitions(sequences: DataFrame, classes: int) -> np.ndarray:
    """How often a class follows another in the training texts."""

    def count(batch):
        m = np.zeros(classes * classes, np.int64)
        for held, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if not held:
                c = _unpacked(packed, np.uint8).astype(np.int64)
                m += np.bincount(np.roll(c, 1) * classes + c, minlength=classes * classes)
        at = np.flatnonzero(m)
        return {"a": (at // classes).astype(np.int32), "c": (at % classes).astype(np.int32), "n": m[at]}

    return _matrix(per_batch(sequences.select("held", "classes"), count, "a int, c int, n long"), classes)


@dataclass
class ClassModel:
    """A clustering and the texts read by it."""

    train: int  # training tokens
    distinct: int  # different words among them
    assigned: DataFrame  # word, class: of the words clustered one by one
    shape_class: np.ndarray  # class of all other words, by shape
    words: np.ndarray  # different training words of each class
    matrix: np.ndarray  # transition counts
    sequences: DataFrame  # see class_sequences


def fit_classes(docs: DataFrame, classes: int = 32, rounds: int = 8, least_share: float = 1e-4, least: int = 50) -> ClassModel:
    """Cluster the words of the training texts.

    Words with ``least_share`` of the tokens (at most 1 / ``least_share``) and the endings of all others are clustered by
    exchange. Every other word seen ``least`` times then moves to the class it fits best, unless
    these moves together lower the likelihood. ``least`` does not grow with the corpus, so the clustered share does.
    """
    if not 1 <= classes <= 256:
        raise ValueError("classes must be between 1 and 256")
    spark = docs.sparkSession
    table = stored(blocks(docs), "token-blocks", compression="uncompressed")
    train = table.select(F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))).first()[0] or 0
    share = max(1, int(np.ceil(least_share * train)))
    low = min(least, share)
    places = stored(vocabulary(table, low), "vocabulary")
    core = np.array(sorted(r["word"] for r in places.filter((F.col("n") >= share) & F.col("first")).select("word").collect()), np.int64)
    of, matrix, _ = exchange_classes(stored(type_bigrams(table, core), "type-bigrams"), classes, rounds)
    shape_class = np.array([of.get(t, t % classes) for t in range(SHAPES)], np.int64)
    core_class = np.array([of[_WORD_TYPES + i] for i in range(len(core))], np.int64)
    assigned = spark.createDataFrame([(int(w), int(c)) for w, c in zip(core, core_class)], "word long, class int")

    named = assigned.withColumn("core", F.lit(True))
    if low < share:
        more = stored(place_words(table, places, core, core_class, shape_class, matrix), "word-classes")
        named = named.unionByName(more.withColumn("core", F.lit(False)))
    # with and without the moves, so that the texts pass once whichever is taken
    sequences = stored(class_sequences(table, places, named, shape_class), "class-sequences", compression="uncompressed")
    moved = class_transitions(sequences, classes) if low < share else matrix
    if low < share and likelihood(moved) >= likelihood(matrix):
        assigned, matrix = named.drop("core"), moved
        sequences = sequences.drop("core_classes")
    else:
        sequences = sequences.withColumn("classes", F.col("core_classes")).drop("core_classes")

    # each word is counted in its first block, as its own class or with its ending
    kinds = places.filter("first AND n > 0").join(assigned, "word", "left").groupBy("class", F.when(F.col("class").isNull(), F.col("shape")).alias("shape"))
    words = np.zeros(classes)
    for r in kinds.count().collect():
        words[shape_class[r["shape"]] if r["class"] is None else r["class"]] += r["count"]
    return ClassModel(train, int(words.sum()), assigned, shape_class, words, matrix, sequences)


def log_steps(matrix: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log10 of going from a class to another and of emitting there a word of count 0; its log10(count + 1) comes on top."""
    tokens = matrix.sum(axis=0)
    prior = (tokens + 1) / (tokens.sum() + len(matrix))
    # Witten-Bell: the more different classes follow, the more weight goes to the prior
    after, kinds = matrix.sum(axis=1, keepdims=True), (matrix > 0).sum(axis=1, keepdims=True)
    weight = np.where(after > 0, after / np.maximum(after + kinds, 1), 0.0)
    step = np.log10(weight * matrix / np.maximum(after, 1) + (1 - weight) * prior[None, :] + 1e-300)
    return step - np.log10(tokens + words + 1)[None, :]


def class_scores(docs: DataFrame, classes: int = 32, rounds: int = 8, least_share: float = 1e-4, least: int = 50) -> DataFrame:
    """Log10 probabilities of all texts, learnt from those that are not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``.
    base_score adds one to every count of a unigram model; score is the class model's: add-one
    emissions within the class, transitions interpolated with the class's own frequency.

    Words seen ``least`` times are clustered one by one (see ``fit_classes``), all others by their ending, as one unit per
    ending. A word never seen is emitted by the class of its ending with count 0. Of classes that suit a word equally
    its own is kept, else the smallest taken.

    A null or empty text is its end alone. Rows without ``doc_id`` are learnt from. Repeated rows count
    each. No rows give no rows; other columns are ignored; texts are read whole. Where nothing is
    left to learn from, every count is 0.
    """
    model = fit_classes(docs, classes, rounds, least_share, least)
    step, train = log_steps(model.matrix, model.words), model.train
    base = float(np.log10(train + model.distinct + 1))

    def finish(batch):
        score = []
        for packed, logs in zip(batch.column("classes").to_pylist(), batch.column("logs").to_pylist()):
            c = _unpacked(packed, np.uint8)
            score.append(float(step[np.roll(c, 1), c].sum()) + logs)
        logs, n = batch.column("logs").to_numpy(), batch.column("n_tokens").to_numpy()
        return {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held"), "n_tokens": n, "n_known": batch.column("n_known"),
            "train_tokens": [train] * len(n), "base_score": logs - n * base, "score": score,
        }

    return per_batch(
        model.sequences, finish,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
