"""Operators 4 and 9 against the library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiforge.llm import bpe, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [None, "", "  \n", "Hello world's end", "ΟΔΟΣ İI Å ﬁ", "a<|endoftext|>b <|startoftext|>", "x" * 3000, "日本語 😀", "a\x1cb\x85c d", "12345 ½ ٣", "<| |>", "word " * 4000]


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_codec_and_decoding(spark, docs):
    rows = list(enumerate(TEXTS))
    got = bpe.encode(docs(rows + rows[3:4])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        want = ids(TEXTS[r.doc_id])
        assert bytes(r.ids) == np.array(want, "<u4").tobytes()
        assert r.decoded == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=["Cs", "Cn"]), max_size=60))
def test_codec_on_any_latin_text(text):
    assert bpe.codec(PATH).encode(text)[0] == np.array(ids(text), "<u4").tobytes()


def test_counts(spark, docs):
    got = token_counts.count_tokens(docs(list(enumerate(TEXTS)))).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(ids(t)) for i, t in enumerate(TEXTS)}


def test_other_vocabularies(spark, docs):
    import sentencepiece

    rows = [(0, "Hello  world \n"), (1, None), (2, "a b" * 50)]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.count_tokens(docs(rows), path=public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(whole.encode(t or "", add_special_tokens=False)) for i, t in rows}
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(docs(rows), path=public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(piece.encode(t or "")) for i, t in rows}


def test_batches_hold_about_as_many_bytes():
    got = list(token_counts.by_bytes(["a" * 10, "b" * 10, "c" * 30, "d"], 20))
    assert [sum(map(len, b)) for b in got] == [20, 30, 1]


def test_empty_tables_and_clashing_columns(spark, docs):
    assert bpe.encode(docs([])).count() == 0
    assert token_counts.count_tokens(docs([])).count() == 0
    clash = docs([(None, "a b")]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "n_tokens")
    assert len(bytes(bpe.encode(clash).first().ids)) == 8
    assert token_counts.count_tokens(clash).first().n_tokens == 2


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_queries(spark, sf):
    d = f"/root/testdata/{sf}"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in bpe.query(spark, d).collect():
        want = ids(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(want, skip_special_tokens=False).encode()).hexdigest()
    for r in token_counts.query(spark, d).collect():
        want = len(ids(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want, want > 2048)
