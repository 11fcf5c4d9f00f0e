"""Encoding and decoding against the sentencepiece library."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import example, given, settings
from hypothesis import strategies as st

from waymark.llm.queries import op4_sentencepiece, tokenizer_file
from waymark.llm.sentencepiece_codec import MergeCodec, encoded

NAME = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(NAME))


@pytest.fixture(scope="module")
def codec():
    return MergeCodec(tokenizer_file(NAME))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), st.text(" aeinrst▁é\u0000日\t\n", max_size=80), st.text("ab ", max_size=40)))
@example("")
@example(" ")
@example("▁")
@example("  leading and   inner  ")
@example("<s></s><unk><0x41>")
@example("a" * 500)
def test_text(library, codec, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=12))
@example([229, 3, 200])
def test_any_ids(library, codec, ids):
    assert codec.decode(ids) == library.decode(ids)


def test_query(spark, tables, documents, library):
    docs = [*documents, (10**6, None), (10**6 + 1, ""), (10**6 + 2, "x" * 30000 + " " * 3000 + "日本" * 4000), (10**6 + 2, "twice")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for i, text, *_ in docs:
        ids = library.encode(text or "")
        wanted.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, op4_sentencepiece(spark, tables(documents=docs)).collect())) == sorted(wanted)


def test_ids_column(spark, tables, library):
    folder = tables(documents=[(1, "Some words, twice."), (2, None)])
    rows = {r["doc_id"]: r for r in encoded(spark.read.parquet(f"{folder}/documents.parquet"), tokenizer_file(NAME)).collect()}
    assert rows[1]["ids"] == library.encode("Some words, twice.") and rows[1]["decoded"] == "Some words, twice."
    assert rows[2]["ids"] == [] and rows[2]["decoded"] == ""


def test_memo_is_bounded_for_a_worker(library):
    """Workers keep the memo for later tasks of any operator: it holds 150,000 units (before: 600,000), and ids stay exact beyond."""
    codec = MergeCodec(tokenizer_file(NAME))
    words = [f"w{i:x}" for i in range(160_000)]
    for at in range(0, len(words), 10_000):
        codec.digest(" ".join(words[at : at + 10_000]))
    assert len(codec.memo) <= 150_000
    text = " ".join(words[-200:])
    assert codec.digest(text)[:2] == (len(ids := library.encode(text)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
