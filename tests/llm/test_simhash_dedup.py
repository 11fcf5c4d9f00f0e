"""SimHash near-duplicates: fingerprints by hand, links against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from waymark.llm.queries import op10_simhash_dedup
from waymark.llm.simhash_dedup import SimHashParams, fingerprint, links, plan


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs):
    """Smallest id of each component, of (id, fingerprint) rows."""
    prints = sorted({fp for _, fp in pairs})
    x = np.array(prints, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    root = np.arange(len(x))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    at = {fp: int(root[k]) for k, fp in enumerate(prints)}
    return {fp: min((i for i, f in pairs if at[f] == at[fp] and i is not None), default=None) for fp in prints}


def test_query(spark, tables, documents):
    rng = random.Random(3)
    docs = [d[:2] for d in documents]
    docs += [(5000 + i, None if i % 2 else " \n") for i in range(4)] + [(6000, "one"), (6001, "ONE"), (6002, "one two three"), (6003, "a b c d"), (6003, "a b c d"), (None, "a b c d"), (None, "nothing like any other text here")]
    base = documents[3][1].split()
    for i in range(30):
        words = base[:]
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = "changed"
        docs.append((7000 + i, " ".join(words)))
    rows = op10_simhash_dedup(spark, tables(True, documents=docs)).collect()
    prints = [(i, print_of(t)) for i, t in docs]
    smallest = components(prints)
    assert sorted(map(tuple, rows), key=repr) == sorted(((i, f"{fp:016x}", smallest[fp]) for i, fp in prints), key=repr)


@pytest.mark.parametrize("block", [2000, 30])
def test_links_join_all_pairs_within_the_limit(spark, block):
    """Random and clustered fingerprints, some groups far above a block."""
    rng = np.random.default_rng(block)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(f) for f in rng.integers(0, 2**63, 300, dtype=np.uint64)]
    for k in range(500):
        f = int(base[k % 40 if k < 250 else 0])
        for b in rng.integers(0, 64, k % 7):
            f ^= 1 << int(b)
        fps.append(f)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = links(spark.createDataFrame([(f,) for f in signed], "fp long"), SimHashParams(block=block)).collect()
    smallest = components([(f, f) for f in fps])
    root = {f: f for f in fps}
    unsigned = lambda f: f % 2**64

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in found:
        a, b = top(unsigned(r["a"])), top(unsigned(r["b"]))
        assert (unsigned(r["a"]) ^ unsigned(r["b"])).bit_count() <= 4 or smallest[unsigned(r["a"])] == smallest[unsigned(r["b"])]
        root[max(a, b)] = min(a, b)
    assert {f: top(f) for f in fps} == smallest


def test_thresholds_cover_the_limit():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 400, dtype=np.uint64)
    for n in (10, 10_000, 10_000_000):
        made = plan(sample, n, SimHashParams())
        assert sum(t + 1 for t in made.thresholds) == 5
        assert sorted(np.concatenate(made.parts).tolist()) == list(range(64))


def test_long_texts_in_pieces():
    """Pieces of a few bytes give the fingerprint of the whole."""
    for text in (b"", b" \n ", b"one", b"one two three", b"one two three four", b"A b\tC d e  f\x0bg h " * 30, b"x" * 500 + b" y z " + b"w" * 50):
        whole = fingerprint(text, 4, 42)
        assert all(fingerprint(text, 4, 42, size) == whole for size in (1, 2, 5, 64))
