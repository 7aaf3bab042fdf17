import gc
import os
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from biosieve.llm import elias_fano
from biosieve.llm.texts import kept_by_worker, per_batch
from biosieve.llm.token_output import Encoder, encode_corpus, read_document, read_documents, write_tokens
from biosieve.session import scratch_path

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(library, rows):
    at, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_query(spark, documents, library, sf_dir):
    got = sorted(map(tuple, E.queries()["op8_elias_fano_tokens"](spark, sf_dir).collect()), key=str)
    assert got == brute(library, [(r.doc_id, r.text) for r in documents.collect()])


def test_odd(odd, odd_rows, empty, library):
    assert sorted(map(tuple, encode_corpus(odd).collect()), key=str) == brute(library, [r[:2] for r in odd_rows])
    assert encode_corpus(empty).collect() == []


def test_small_blocks(spark, documents, library):
    path = scratch_path(spark, "blocks")
    write_tokens(documents, path, block_ids=100)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in read_documents(spark, path).collect():
        assert np.frombuffer(r.ids, "<u4")[:-1].tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_pieces(library):
    """Cutting texts changes no id, whatever stands around white space, marks and contractions."""
    encoder, rng = Encoder("byte_bpe_50k.json", 0, keep=50), random.Random(2)
    parts = ["a", "é", "the", " ", " ", "  ", "\n", "\n\n", ".", ",", "!!", "'s", "'ll", "1", "\t", " ", "\x1c", "<|endoftext|>", "日", "|", "a.", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900), st.integers(0, 2**40))
def test_elias_fano(steps, first):
    values = np.cumsum(np.array([first, *steps], dtype=np.uint64))
    data = elias_fano.encode(values)
    reader = elias_fano.EliasFano(data)
    assert reader.values().tolist() == values.tolist()
    for i in range(0, len(values), 97):
        assert reader.select(i) == values[i]
    assert elias_fano.EliasFano(elias_fano.encode(values[:0])).values().tolist() == []


def test_elias_fano_size():
    ends = np.cumsum(np.full(10_000, 500, dtype=np.uint64))
    assert len(elias_fano.encode(ends)) < 10_000 * (2 + 9 + 0.3) / 8


def test_one_document_by_select(spark, odd, odd_rows, library):
    """Every document is found in small blocks by select alone, repeated ids once for each row, unknown ids not at all."""
    path = scratch_path(spark, "tokens")
    write_tokens(odd, path, block_ids=8)
    for doc in {r[0] for r in odd_rows if r[0] is not None}:
        want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in odd_rows if d == doc)
        assert sorted(i.tolist() for i in read_document(spark, path, doc)) == want
    assert read_document(spark, path, 4711) == [] and read_document(spark, path, -1) == []


def test_workers_drop_what_was_learnt(spark, documents):
    """An encoder serves the tasks of one call; a worker that goes on to another operator holds none."""
    encode_corpus(documents).collect()
    found = lambda batch: {"n": [sum(isinstance(o, Encoder) for o in gc.get_objects())] * batch.num_rows}
    assert {r.n for r in per_batch(spark.range(0, 100, 1, 20), found, "n long").collect()} == {0}

    def learn(batch):
        seen = kept_by_worker("seen", list)
        seen.append(1)
        return {"worker": [os.getpid()] * batch.num_rows, "n": [len(seen)] * batch.num_rows}

    for _ in range(2):
        rows = per_batch(spark.range(0, 20, 1, 20), learn, "worker long, n long").collect()
        for worker in {r.worker for r in rows}:
            own = sorted(r.n for r in rows if r.worker == worker)
            assert own == list(range(1, len(own) + 1))
