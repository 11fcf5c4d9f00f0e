"""Packing against the tokenizers library, its rules and the least number of sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from waymark.llm.packing import Encoder, PackParams, best_fit, packed
from waymark.llm.queries import op11_packing, tokenizer_file

FILE = tokenizer_file("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "\xa0", "\x85", "\x1c", "　", "a", "don't", "'s", "'", "x1", "12", "é", "日本", "。", "<|", "|>", "\U0001f600", "́", "٣", "Ⅷ", "_", "...", "B", "\r\n", "​", "ſ", "'ſ", "\0"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(FILE.decode())


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("window", [3, 10, 1 << 18])
def test_ids_are_the_librarys(library, window, special):
    rng, encoder = random.Random(window), Encoder(FILE, PackParams(window=window))
    assert encoder.fast is not None
    for _ in range(1500):
        text = "".join(rng.choice(PARTS + ["<|endoftext|>"] * special) for _ in range(rng.randint(0, 40)))
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_ids_of_every_letter(library):
    """Both libraries split at the same kinds of characters; each of the first two planes beside letters, digits and blanks."""
    encoder = Encoder(FILE, PackParams())
    texts = [" ".join(f"a{c}b {c} 1{c}2  {c}'s !{c}!{c} " for c in map(chr, range(at, at + 64)) if not 0xD800 <= ord(c) < 0xE000) for at in range(0, 0x20000, 64)]
    for text, found in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encoder.ids(text).tolist() == found.ids


def test_long_runs_are_cut_or_left_to_the_library(library):
    encoder = Encoder(FILE, PackParams(window=1000))
    for text in (" " * 300_000, "x1" * 5000, "日本。" * 3000, "word, " * 3000 + "z" * 5000):
        assert encoder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_best_fit_by_hand():
    """The tightest bin takes an item; with two open bins at most the fullest closes; full bins are not open."""
    assert best_fit([6, 5, 3, 4, 1], 10, 9) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 9], {0: 9})
    bins, offsets, left = best_fit([6, 7, 8, 3, 2], 10, 2)
    assert (bins, offsets, left) == ([0, 1, 2, 0, 2], [0, 0, 0, 6, 8], {0: 9})
    assert best_fit([10, 10], 10, 1) == ([0, 1], [0, 0], {}) and best_fit([], 10, 1) == ([], [], {})


def test_bitset_equals_a_search_of_all_bins():
    """Fills only: which of several bins of one fill is taken makes no difference to them."""
    rng = np.random.default_rng(4)
    for open_bins in (1, 3, 50):
        items = rng.integers(1, 65, 400).tolist()
        bins, offsets, left = best_fit(items, 64, open_bins)
        fills: list[int] = []
        for item, at in zip(items, offsets, strict=True):
            fit = [f for f in fills if f + item <= 64]
            assert at == max(fit, default=0)
            if fit:
                fills.remove(at)
            elif len(fills) >= open_bins:
                fills.remove(max(fills))
            if at + item < 64:
                fills.append(at + item)
        assert sorted(left.values()) == sorted(fills) and len(set(bins)) == offsets.count(0)


def rules(rows, texts, library, size, end):
    """Each document's pieces are its ids in order, cut only if longer; sequences are gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by_doc) == len(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        mine = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and sum(r["length"] for r in mine) == len(ids)
        assert len(mine) == -(-len(ids) // size) and all(r["length"] == size for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), -(-sum(r["length"] for r in rows) // size)


def test_query_against_the_library(spark, sf_dir, documents, library):
    made, least = rules(op11_packing(spark, sf_dir).collect(), {d[0]: d[1] for d in documents}, library, 2048, 0)
    assert made <= 1.005 * least + 1


@pytest.mark.parametrize(("group", "open_bins"), [(8, 8), (20, 3)])
def test_groups_of_groups(spark, library, group, open_bins):
    """Several levels, with full pieces, repeated texts, nulls and a long text, whose ids are taken in windows."""
    rng = random.Random(group)
    texts = {i: " ".join(rng.choice(["one", "two,", "three3"]) for _ in range(rng.randint(0, 30))) for i in range(150)} | {900: None, 901: "", 902: "w " * 20_000, 903: "z" * 700}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = packed(docs, FILE, PackParams(length=32, end=7, open_bins=open_bins, group=group, window=500)).collect()
    made, least = rules(rows, texts, library, 32, 7)
    assert made <= 1.15 * least


def test_repeated_rows_and_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (5, "same"), (5, "same")], "doc_id long, text string")
    rows = packed(docs, FILE).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 3), (5, 2), (5, 2)]
    assert len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows)[0] == 0
