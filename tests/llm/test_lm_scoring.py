"""LM scoring: base score by hand, the model against counts in dictionaries, sums of probabilities, both ways of looking up."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm.common import in_fold
from waymark.llm.lm_scoring import LmParams, Model, _low, _shard_builder, _width, answers_of, build, ngrams, probabilities, score, token_blocks, tokens
from waymark.llm.queries import op3_lm_scoring

lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def middle(count):
    """The count that a level stands for: 0 and 1 themselves, then 2-3, 4-7, 8-15, ..."""
    if count < 2:
        return float(count)
    low = 2
    while 2 * low <= count:
        low *= 2
    return low * math.sqrt(2) - (0.25 if low == 2 else 0)


def middle_total(total, least):
    """Totals in steps of half an octave from the smallest one on."""
    unit, step = middle(least), 0
    while unit * 2 ** ((step + 1) / 2) <= total * (1 + 1e-9):
        step += 1
    return unit * (2 ** (step / 2 + 0.25) if step else 1)


def by_hand(docs, params=LmParams()):
    """doc_id, n_tokens, n_known, tokens learned from, base and smoothed score from counts in dictionaries."""
    train = [split(t) for i, t, *_ in docs if not held(i)]
    gram = lambda d, k, order: tuple(d[j] if j >= 0 else "start" for j in range(k - order + 1, k + 1))
    counts = [Counter(gram(d, k, order) for d in train for k in range(len(d))) for order in range(1, params.order + 1)]
    totals = [Counter() for _ in counts]
    for order in range(3, params.order + 1):
        for g, c in counts[order - 1].items():
            if c >= params.least:
                totals[order - 1][g[:-1]] += middle(c)
    n = sum(counts[0].values())
    below = n + 0.1 * (len(counts[0]) + 1)
    for i, t, *_ in docs:
        d = split(t)
        base, full = 0.0, 0.0
        for k, x in enumerate(d):
            p = (counts[0][x,] + 0.1) / below
            base += math.log10(p)
            before = counts[0][d[k - 1],] if k else len(train)
            p = (min(middle(counts[1][gram(d, k, 2)]), before, counts[0][x,]) + params.mass * p) / (before + params.mass)
            for order in range(3, params.order + 1):
                g = gram(d, k, order)
                if g[:-1] in totals[order - 1]:
                    total, c = middle_total(totals[order - 1][g[:-1]], params.least), counts[order - 1][g]
                    p = (min(middle(c) if c >= params.least else 0, total) + params.mass * p) / (total + params.mass)
            full += math.log10(p)
        yield i, len(d), sum(counts[0][x,] > 0 for x in d), n, base, full


def model_of(spark, texts, params):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    built, shards, totals = build(docs, F.lit(True), params)
    return Model(built.collect(), shards, params), totals | {"starts": len(texts)}


def next_words(model, totals, params, history, words):
    """Probability of each word, and last of the end, after a history."""
    data = [" ".join(d).encode() for d in [*([*history, w] for w in words), history]]
    tok, bounds = tokens(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    found = [model.found(k, tok if k == 1 else ngrams(tok, bounds, k)) for k in range(1, params.order + 1)]
    return probabilities(tok, bounds, found, totals, params)[1][bounds[:-1] + len(history)]


@pytest.mark.parametrize(("order", "least"), [(2, 1), (3, 1), (3, 2), (4, 2)])
def test_probabilities_add_up(spark, order, least):
    """After histories with one, few and 400 continuations the words of the vocabulary, the end and what is left for an unknown
    word add up to 1. A filter of 40 bits an entry leaves the quantisers alone: a pair's count is off by half an octave at most
    (0.71 to 1.41; "a" has one continuation, so nothing makes it good), a longer history's total by a quarter of one (0.84 to 1.19)."""
    rng = random.Random(order)
    words = [f"w{i}" for i in range(400)]
    texts = [f"a b {w} c" for w in words] + [f"a b {rng.choice(words[:30])} d" for _ in range(600)] + [f"b {w} {w} c a" for w in words[:50]] + ["x y z"] * 9 + ["x y q", "x y q", "p q"]
    params = LmParams(order=order, least=least, bits=40, probes=20)
    model, totals = model_of(spark, texts, params)
    known = sorted({w for t in texts for w in t.split()})
    sums = {}
    for history in (["a", "b"], ["b", "w3"], ["w3", "w3"], ["x", "y"], ["p", "q"], ["w300", "c"], ["z", "a"], ["never", "seen"]):
        sums[tuple(history)] = next_words(model, totals, params, history, [*known, "unseen-word"]).sum()
    print({h: round(float(x), 3) for h, x in sums.items()})
    assert all(0.84 < x < 1.19 for h, x in sums.items() if h != ("z", "a")), sums
    assert 0.7 < sums["z", "a"] < 1.42
    assert sums["never", "seen"] == pytest.approx(1, abs=1e-6)


def test_counts_and_scores(spark, tables, documents):
    docs = [*documents, (10**6, None), (10**6 + 1, "ÄÖ ab AB c \x0b x"), (10**6 + 1, "again"), (10**6 + 2, "")]
    found = {}
    for r in op3_lm_scoring(spark, tables(documents=docs)).collect():
        found.setdefault((r["doc_id"], r["n_tokens"]), []).append(r)
        assert r["held_out"] == held(r["doc_id"])
    assert sum(map(len, found.values())) == len(docs)
    near = 0
    for i, n, known, total, base, full in by_hand(docs):
        r = next(r for r in found[i, n] if math.isclose(r["base_score"], base, rel_tol=1e-9))
        assert (r["n_known"], r["train_tokens"]) == (known, total)
        near += abs(r["score"] - full) < 0.02 * abs(full) + 0.05  # the filter may take an absent pair for one seen
    assert near > 0.97 * len(docs)


def test_model_beats_the_base_on_held_out_rows(spark, sf_dir):
    rows = [r for r in op3_lm_scoring(spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


@pytest.mark.parametrize("order", [2, 3])
def test_exchanged_equals_broadcast(spark, sf_dir, order):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    training = F.col("doc_id").isNotNull() & ~in_fold("doc_id", 10, 0)
    one, other = (sorted(map(tuple, score(docs, training, LmParams(order=order, max_broadcast_mb=mb)).collect())) for mb in (192, -1))
    assert len(one) == len(other)
    assert all(a[:5] == b[:5] and np.allclose(a[5:], b[5:]) for a, b in zip(one, other, strict=True))


def test_shard_looks_equal_names_up_once(spark):
    """A shard's answers to many blocks are those of the whole model, from one look for all of them; there were as many as
    blocks, so time grew with blocks times shards."""
    docs = spark.createDataFrame([(i, f"a{i % 7} b{i % 11} c{i % 13} d") for i in range(300)], "doc_id long, text string")
    params = LmParams()
    built, shards, _ = build(docs, F.lit(True), params)
    built = built.collect()
    whole, bits = Model(list(built), shards, params), shards.bit_length() - 1
    tok, bounds = tokens(np.frombuffer(b"".join(r["text"].encode() for r in docs.collect()), np.uint8), np.cumsum([0, *(len(r["text"]) for r in docs.collect())]))
    looks, asked_in_all = 0, 0

    class Counted(Model):
        def found(self, kind, h):
            nonlocal looks
            looks += 1
            return super().found(kind, h)

    for kind in (1, 2, 3):
        h = np.unique(tok if kind == 1 else ngrams(tok, bounds, kind))
        h = np.concatenate([h, np.random.default_rng(kind).integers(0, 2**63, 999, dtype=np.uint64) * np.uint64(2)])
        for row in built:
            mine = h[h >> np.uint64(64 - bits) == row["shard"]]
            asked = [mine[i::3] if i % 2 else mine for i in range(20)]
            asked_in_all += 1
            found = answers_of(Counted([row], shards, params, row["shard"]), kind, [_low(x, _width(kind)) for x in asked])
            assert [np.frombuffer(x, "<i8" if kind == 1 else "<u2").tolist() for x in found] == [whole.found(kind, x).tolist() for x in asked]
    assert looks == asked_in_all


def test_no_training_rows(spark, tables):
    """The formula's own result: log10(0.1 / 0.1) for each token."""
    alone = next(i for i in range(100) if held(i))
    rows = op3_lm_scoring(spark, tables(documents=[(alone, "three words here"), (alone, None)])).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [(0, 0, 0.0, 0.0)] * 2


def test_counts_above_four_bytes():
    many = 5 * 2**32
    built = _shard_builder(16, LmParams())
    h = np.array([7], np.uint64)
    row = built((0,), pd.DataFrame({"shard": [0] * 2, "kind": [1, 1], "hashes": [h.tobytes()] * 2, "counts": [b"\x05"] * 2})).iloc[0]
    assert (row["uni_c"], row["many"]) == (b"\x0a", b"")
    known = np.array([7, 9, 11, 13], np.uint64)
    model = Model([{"shard": 0, "uni_h": known.tobytes(), "uni_c": bytes([255, 254, 255, 1]), "many": np.array([many, 255]).tobytes(), "bits": b"", "n_bits": 0}], 16, LmParams())
    assert model.unigrams(np.array([7, 8, 9, 11, 13, 14], np.uint64)).tolist() == [many, 0, 254, 255, 1, 0]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("limit", [3, 7, 40, 1000])
def test_long_rows_in_pieces(order, limit):
    """The n-grams of the pieces of a row, without what only stands for what comes before, are those of the whole row."""
    rng = random.Random(limit)
    rows = [b"", b"   ", b"one", b"x" * 60, b" lead and trail  ", *(b"".join(rng.choice([b" ", b"\n\t", b"a", b"bc", b"\xc3\xa4", b" w "]) for _ in range(rng.randint(0, 200))) for _ in range(40))]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["text"])
    for k in range(1, order + 1):
        name = lambda tok, bounds, k=k: tok if k == 1 else ngrams(tok, bounds, k)
        pieces = [[] for _ in rows]
        ended = []
        for first, end, tok, bounds, skip, last in token_blocks(batch, order, limit):
            for row in range(first, end):
                a, b = bounds[row - first], bounds[row - first + 1]
                pieces[row] += name(tok, bounds)[a + (skip if row == first else 0) : b].tolist()
            ended += [row for row in range(first, end) if last]
        whole = [name(*tokens(np.frombuffer(r, np.uint8), np.array([0, len(r)]))).tolist() for r in rows]
        assert pieces == whole and ended == list(range(len(rows)))
