"""Token ids of a corpus as one array, with Elias-Fano coded document boundaries."""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biosieve.llm import elias_fano
from biosieve.llm.texts import id_and_text, kept_by_worker, per_batch
from biosieve.session import scratch_path

_BLOCK = "part int, block int, at long, n_docs long, n_null long, n_ids long, width int, least long, doc_ids binary, ends binary, ids binary"

# A pre-token of byte-level BPE reaches over white space only as a single leading blank or inside a
# run of white space, so a text may be cut before a single blank or line feed between other characters.
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
# It never joins letters with these, so a word may be cut before a tail of them.
_TAIL = "!#$%&*,.:;?|"
_LATIN = "\u0250"  # letters below are Latin


def cut(text: str) -> list[str]:
    """``text`` in pieces whose ids can be joined.

    Pieces other than the first follow a blank unless they start with a line feed; that blank is not
    part of the piece.
    """
    words = text.split()
    blanks, feeds = text.count(" "), text.count("\n")
    if len(words) == blanks + feeds + 1 and sum(map(len, words)) + blanks + feeds == len(text):
        # only single blanks and line feeds, all between words
        return text.replace("\n", " \n").split(" ")
    pieces = _CUT.split(text)
    return pieces[:1] + [p[1:] if p[0] == " " else p for p in pieces[1:]]


class Encoder:
    """Ids of texts by the tokenizers library, which is asked once for each distinct piece between cuts.

    The pieces are kept in two generations of at most ``keep`` each, so memory is bounded whatever
    the vocabulary of the corpus.
    """

    def __init__(self, path: str, end_id: int, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        if not os.path.exists(path):
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        # how the vocabulary writes a leading blank and the letters that are not one byte
        written = lambda s: self.tokenizer.pre_tokenizer.pre_tokenize_str(s)[0][0]
        self.blank = written(" a")[:-1]
        self.letters = {ord(c): written(c) for c in map(chr, range(128, ord(_LATIN))) if c.isalpha()}
        self.keep, self.young, self.old = keep, {}, {}

    def _learn(self, missing: set) -> None:
        """Look ``missing`` up in what was known before, put it together from a word and its tail, or ask the library."""
        young, old = self.young, self.old
        ask, joined = {}, []
        for p in missing:
            ids = old.get(p)
            if ids is not None:
                young[p] = ids
            elif p.__class__ is str and p[-1] in _TAIL and (word := p.rstrip(_TAIL)) and word[-1].isalpha():
                tail = (p[len(word) :],)
                joined.append((p, word, tail))
                for x in (word, tail):
                    if x not in young:
                        ask[x] = None
            else:
                ask[p] = None
        rest = []
        for p in ask:
            if p in old:
                young[p] = old[p]
            else:
                rest.append(p)
        code = "H" if self.dtype.itemsize == 2 else "I"
        # a word of letters is a single pre-token, which goes straight to the library's model
        tokenize, blank, letters, asked = self.tokenizer.model.tokenize, self.blank, self.letters, []
        for p in rest:
            if p.__class__ is str and p.isalpha() and (p.isascii() or max(p) < _LATIN):
                young[p] = array(code, [t.id for t in tokenize(blank + (p if p.isascii() else p.translate(letters)))]).tobytes()
            else:
                asked.append(p)
        # one-element tuples are pieces with nothing before them
        texts = [p[0] if p.__class__ is tuple else p if p[0] == "\n" else " " + p for p in asked]
        for p, e in zip(asked, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            young[p] = array(code, e.ids).tobytes()
        for p, word, tail in joined:
            young[p] = young[word] + young[tail]

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` and the end id, as little-endian numbers."""
        pieces: list = cut(text)
        pieces[0] = (pieces[0],)
        if len(self.young) > self.keep:
            self.young, self.old = {}, self.young
        young = self.young
        found = list(map(young.get, pieces))
        if None in found:
            self._learn({p for p, ids in zip(pieces, found) if ids is None})
            found = [young[p] if ids is None else ids for p, ids in zip(pieces, found)]
        return b"".join(found) + self.end


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, block_ids: int = 1 << 20) -> None:
    """Encode every text, append ``end_id`` to each and write the ids in ascending order of ``doc_id``.

    ``path`` becomes a folder of Parquet files of blocks. A block holds whole documents, about
    ``block_ids`` ids or one longer document: the ids (16 bits where the vocabulary allows), the ends
    of its documents and their doc_ids, both as Elias-Fano sequences. ``part`` and ``block`` number
    the blocks in order; ``at`` counts the ids before a block within its part.

    A null or empty text gives the end id alone. Rows without ``doc_id`` come first; equal ids are
    ordered by text. Other columns are ignored; an empty table writes no blocks.
    """
    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    state = {}

    def blocks(batch):
        encoder = kept_by_worker("encoder", lambda: Encoder(tokenizer, end_id))  # what it has learnt serves later tasks of this call
        part = TaskContext.get().partitionId()
        out = {c.split()[0]: [] for c in _BLOCK.split(", ")}
        held: list[tuple] = []

        def close():
            ids = [d for d, _ in held if d is not None]
            ends = np.cumsum([len(b) // encoder.dtype.itemsize for _, b in held])
            row = dict(
                part=part, block=state["block"], at=state["at"], n_docs=len(held), n_null=len(held) - len(ids), n_ids=int(ends[-1]),
                width=encoder.dtype.itemsize, least=ids[0] if ids else 0,
                doc_ids=elias_fano.encode(np.array([d - ids[0] for d in ids], dtype=np.uint64)), ends=elias_fano.encode(ends),
                ids=b"".join(b for _, b in held),
            )
            for c, v in row.items():
                out[c].append(v)
            state["block"] += 1
            state["at"] += int(ends[-1])
            held.clear()

        attempt = TaskContext.get().taskAttemptId()
        if state.get("task") != attempt:
            state.update(task=attempt, block=0, at=0)
        size = 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((doc, encoder.encode(text.decode("utf-8", "replace"))))
            size += len(held[-1][1]) // encoder.dtype.itemsize
            if size >= block_ids:
                close()
                size = 0
        if held:
            close()
        return out

    per_batch(ordered, blocks, _BLOCK).write.option("compression", "zstd").parquet(path)


def part_bases(spark, path: str) -> dict[int, int]:
    """Number of ids before each part: a row for each task that wrote, added up in order."""
    totals = spark.read.schema(_BLOCK).parquet(path).groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    bases, before = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        bases[part] = before
        before += n
    return bases


def _block_documents(row: dict, base: int):
    """``doc_id, start, ids`` (an array) of each document of a block."""
    ends = elias_fano.EliasFano(row["ends"]).values().astype(np.int64)
    known = elias_fano.EliasFano(row["doc_ids"]).values().astype(np.int64) + row["least"]
    ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
    starts = np.concatenate([[0], ends[:-1]])
    before = base + row["at"]
    yield from zip([None] * row["n_null"] + known.tolist(), (starts + before).tolist(), (ids[a:z] for a, z in zip(starts, ends)))


def read_documents(spark, path: str) -> DataFrame:
    """``doc_id, start, ids`` (little-endian 32-bit numbers) of each document, taken from the files."""
    bases = part_bases(spark, path)

    def documents(batch):
        doc, start, ids = zip(*((d, s, i.tobytes()) for row in batch.to_pylist() for d, s, i in _block_documents(row, bases[row["part"]])))
        return {"doc_id": doc, "start": start, "ids": ids}

    return per_batch(spark.read.schema(_BLOCK).parquet(path), documents, "doc_id long, start long, ids binary", rows=8)


def read_digests(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, computed from the files."""
    bases = part_bases(spark, path)

    def digests(batch):
        found = ((d, s, len(i), zlib.crc32(i)) for row in batch.to_pylist() for d, s, i in _block_documents(row, bases[row["part"]]))
        return dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*found)))

    return per_batch(spark.read.schema(_BLOCK).parquet(path), digests, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=8)


def read_document(spark, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document, once for each row that had the id, without decoding any sequence whole.

    Blocks hold ascending ids, so the least id of each says which may hold it; in these a binary search over
    ``select`` finds its places, and two more selects its ends.
    """
    blocks = spark.read.schema(_BLOCK).parquet(path).filter((F.col("least") <= doc_id) & (F.col("n_docs") > F.col("n_null"))).drop("at")

    def find(batch):
        out = []
        for row in batch.to_pylist():
            ids, ends = elias_fano.EliasFano(row["doc_ids"]), elias_fano.EliasFano(row["ends"])
            known = row["n_docs"] - row["n_null"]
            low, high = 0, known
            while low < high:
                middle = (low + high) // 2
                low, high = (middle + 1, high) if ids.select(middle) + row["least"] < doc_id else (low, middle)
            while low < known and ids.select(low) + row["least"] == doc_id:
                place = row["n_null"] + low
                a, z = (ends.select(place - 1) if place else 0), ends.select(place)
                out.append((row["part"], row["block"], low, np.frombuffer(row["ids"], f"<u{row['width']}")[a:z].astype("<u4").tobytes()))
                low += 1
        return dict(zip(("part", "block", "place", "ids"), zip(*out))) if out else {c: [] for c in ("part", "block", "place", "ids")}

    found = per_batch(blocks, find, "part int, block int, place int, ids binary", rows=8).orderBy("part", "block", "place").collect()
    return [np.frombuffer(r["ids"], "<u4") for r in found]


def encode_corpus(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write ``docs`` to a new folder in the shared store and return ``read_digests`` of it."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_digests(docs.sparkSession, path)
