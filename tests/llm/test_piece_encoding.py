"""Encoding by distinct chunks against the library on whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from flowloom.llm import piece_encoding
from flowloom.session import cut_lineage

SF_DIR = "/root/testdata/sf0.001"
PATH = piece_encoding.model_path()


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def plain(library, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return np.array(ids, "<u4").tobytes(), library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "a", "the", "▁", "\n", "é", "日", "😀", "\0", "<s>", "\xa0", "ﬁ"]), max_size=40).map("".join), st.integers(1, 5))
def test_chunks(text, at_once):
    library, model = SentencePieceProcessor(model_file=PATH), piece_encoding.piece_model(PATH)
    ids = model.segment(piece_encoding.chunks_of(text))
    assert b"".join([(1).to_bytes(4, "little"), *ids, (2).to_bytes(4, "little")]) == plain(library, text)[0]
    before = piece_encoding.DECODED_AT_ONCE
    try:
        for piece_encoding.DECODED_AT_ONCE in (before, at_once):
            assert piece_encoding._decoded(model, ids) == plain(library, text)[1]
    finally:
        piece_encoding.DECODED_AT_ONCE = before


TEXTS = [None, "", " ", "  a  b ", "the cat", "the cat", "▁x ▁▁y", "a\n\n b\tc", "日本語 😀 x", "<s> </s> <0x41>", "x" * 5000, "lorem ipsum dolor " * 60_000, "a" + " " * 1000 + "b"]


@pytest.mark.parametrize("block_bytes", [16_000_000, 10])
def test_edges(spark, library, block_bytes):
    rows = [(i if i % 5 else None, t, "x", None, i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, block string, bucket int").repartition(3)
    docs = cut_lineage(docs)
    got = piece_encoding.encode(docs, PATH, block_bytes=block_bytes).collect()
    assert sorted((r["bucket"], bytes(r["ids"]), r["decoded"]) for r in got) == [(i, *plain(library, t)) for i, t in enumerate(TEXTS)]
    assert all(r["doc_id"] == (r["bucket"] if r["bucket"] % 5 else None) and r["block"] is None for r in got)
    assert piece_encoding.encode(docs.limit(0), PATH).count() == 0


def test_small_tables_give_equal_ids(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").where("doc_id < 40")
    for r in piece_encoding.encode(docs, PATH, buckets=2, table_chunks=3).collect():
        assert (bytes(r["ids"]), r["decoded"]) == plain(library, r["text"])


def test_spaces_at_the_end_of_texts(spark, library):
    texts = ["a ", "b", "c  d ", "e   ", "f\n ", " g", "▁", "h▁▁ ", " ", "   ", "i" + " " * 40, "j"]
    docs = cut_lineage(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))
    for buckets in (1, 3):
        got = piece_encoding.encode(docs, PATH, buckets=buckets).collect()
        assert sorted((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == [(i, *plain(library, t)) for i, t in enumerate(texts)]


def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    got = piece_encoding.op12_piece_encoding(spark, SF_DIR).collect()
    assert len(got) == len(texts)
    for r in got:
        ids, decoded = plain(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) // 4
        assert r["ids_sha256"] == hashlib.sha256(ids).hexdigest() and r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
