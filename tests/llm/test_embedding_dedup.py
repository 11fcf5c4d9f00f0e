"""Embedding near-duplicates against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from waymark.llm.embedding_dedup import EmbeddingParams, cells_of, linked, unit


def by_hand(rows, least=0.95):
    """vec_id -> (links, component) of (vec_id, vector) rows."""
    good = {i: np.asarray(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    link = {i: {j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= least} for i in ids}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in link.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = len(link.get(i, ())), min(seen, default=None) if i is not None else None
    return out


def rows_of(seed, n=600, size=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, size)) * rng.choice([0.05, 0.2, 0.6], (n, 1))
    x = np.float32(x)
    x[50:90] = x[50]
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(n), x, strict=True)] + [(1000, None), (1001, [0.0] * size), (1002, [1.0] * (size + 1)), (1003, [1.0] * (size + 1)), (1004, [float("nan")] * size), (1004, None)]


@pytest.mark.parametrize("cell", [4096, 20])
def test_all_pairs(spark, tables, cell):
    """Also with many small cells and blocks."""
    rows = rows_of(cell)
    folder = tables(True, embeddings=[(i, v, 0) for i, v in rows])
    found = linked(spark.read.parquet(f"{folder}/embeddings.parquet"), EmbeddingParams(cell=cell, block=40 if cell < 100 else 4096, tile=16)).collect()
    wanted = by_hand(rows)
    assert len(found) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == wanted


def test_replication_reaches_every_partner():
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(300, 5)))
    radius = np.sqrt(2 - 2 * 0.95)
    vector, cell, home = cells_of(x, x[:20], radius)
    cells = [set(cell[vector == i].tolist()) for i in range(300)]
    homes = dict(zip(vector[home].tolist(), cell[home].tolist(), strict=True))
    near = x @ x.T >= 0.95
    assert all(homes[i] in cells[j] or homes[j] in cells[i] for i, j in zip(*np.nonzero(near), strict=True))
    assert all(sum((homes[i] in cells[j], homes[j] in cells[i])) == 1 for i, j in zip(*np.nonzero(near), strict=True) if homes[i] != homes[j])
    assert sum(map(len, cells)) < 300 * 20


def by_ids(rows, least=0.95):
    """As above where an id may have several vectors."""
    good = [(i, unit([v])[0]) for i, v in rows]
    ids = sorted({i for i, _ in good})
    link = {i: set() for i in ids}
    for i, v in good:
        for j, w in good:
            if i != j and len(v) == len(w) and v @ w >= least:
                link[i].add(j)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = len(link[i]), min(seen)
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_ids_with_several_vectors(spark, tables, seed):
    probe = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.02]), (5, [0.0, 1.0]), (7, [0.0, 1.0]), (7, [1.0, 0.0])]
    rng = np.random.default_rng(seed)
    many = [(int(i) if rng.random() < 0.6 else 7, v) for i, v in rows_of(seed, 300) if v and len(v) == 6 and np.isfinite(v).all() and any(v)]
    many = [(i % 40 if rng.random() < 0.3 else i, v) for i, v in many]
    for rows in (probe, many):
        folder = tables(embeddings=[(i, v, 0) for i, v in rows])
        found = linked(spark.read.parquet(f"{folder}/embeddings.parquet"), EmbeddingParams(cell=30, block=50)).collect()
        assert len(found) == len(rows)
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found} == by_ids(rows)
