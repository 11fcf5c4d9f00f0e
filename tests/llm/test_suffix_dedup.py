"""Repeated passages against a plain look-up of every window."""

from __future__ import annotations

import hashlib
import random

import pytest

from waymark.llm.queries import op6_suffix_dedup
from waymark.llm.suffix_dedup import SuffixParams, repeats, without_repeats


def by_hand(docs, length=50):
    first = {}
    for i, text, *_ in docs:
        raw = (text or "").encode()
        for k in range(len(raw) - length + 1 if i is not None else 0):
            w = raw[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text, *_ in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1 if i is not None else 0):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    words = ["one", "two", "größe", "river", "stone", "日本", "lamp", "the"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common, periodic = say(40), "abcab" * 60
    docs = [(i, say(rng.randint(0, 80)) + (common[rng.randint(0, 60) :] if i % 3 else "") + say(5)) for i in range(60)]
    docs += [(200 + i, common) for i in range(20)] + [(300, periodic), (301, "x" + periodic), (302, periodic[3:] * 2), (303, "z" * 400), (304, "z" * 49), (305, "z" * 50)]
    docs += [(401, docs[4][1]), (401, docs[4][1]), (7, docs[9][1]), (None, common), (500, None), (501, ""), (502, common[:50]), (503, common[:49])]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_query(spark, tables, seed):
    docs = corpus(seed)
    assert sorted(map(tuple, op6_suffix_dedup(spark, tables(documents=docs)).collect()), key=repr) == by_hand(docs)


def test_many_blocks_and_shards(spark, tables, documents):
    """Blocks and shards of a few kilobytes give the same result."""
    docs = [*documents, *corpus(3), *((None, f"{k} {documents[k][1]}") for k in range(60))]
    folder = tables(documents=docs)
    found = repeats(spark.read.parquet(f"{folder}/documents.parquet"), SuffixParams(block=40_000, shard=20_000)).drop("spans")
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(docs)


def test_one_id_on_most_rows(spark, tables, documents):
    """An id with more text than a block is cut over several blocks that remove nothing from each other."""
    docs = [(100 if k % 3 else d[0], *d[1:]) for k, d in enumerate([*documents, *documents[:60], *documents[:60]])] + corpus(4)
    folder = tables(True, documents=docs)
    found = repeats(spark.read.parquet(f"{folder}/documents.parquet"), SuffixParams(block=20_000, shard=20_000)).drop("spans")
    assert sorted(map(tuple, found.collect()), key=repr) == by_hand(docs)
    kept = without_repeats(spark.read.parquet(f"{folder}/documents.parquet"), SuffixParams(block=20_000, shard=20_000))
    assert kept.count() == len(docs) and kept.where("_id = 7").count() == len(docs)


def test_texts_are_cut(spark, tables):
    passage = "a passage of more than fifty bytes that stands in two documents, é"
    folder = tables(True, documents=[(1, f"first {passage} end", "en", "s", 3), (2, f"x{passage}y", "fr", "t", 4), (3, None)])
    kept = without_repeats(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert rows[1]["text"].startswith("first") and rows[1]["lang"] == "en"
    assert rows[2]["text"] == "xy" and rows[2]["n_chars"] == 4 and rows[2]["_id"] == 7
    assert rows[3]["text"] is None
