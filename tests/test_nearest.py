"""Nearest neighbours in balls: equal to all pairs, few comparisons where vectors are clustered, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from waymark.operators.nearest import nearest


def by_hand(asked, refs):
    unit = lambda v: np.asarray(v) / max(np.sqrt(np.dot(v, v)), 1e-9)
    for i, v in asked:
        all_ = [(None if v is None or w is None else round(float(unit(v) @ unit(w)), 9), r) for r, w in refs if r != i]
        if all_:
            s, r = min(all_, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
            yield i, r, s


def found(spark, asked, refs, **how):
    df = nearest(spark.createDataFrame(asked, "id long, emb array<double>"), spark.createDataFrame(refs, "ref_id long, emb array<double>"), **how).collect()
    return sorted((r["id"], r["ref_id"], None if r["similarity"] is None else round(r["similarity"], 9)) for r in df), sum(r["pairs"] for r in df)


def rows(values, first=0):
    return [(first + i, [float(x) for x in v]) for i, v in enumerate(values)]


def test_clustered_vectors_meet_few_others(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    data = rows(np.repeat(centres, 50, axis=0) + 0.02 * rng.normal(size=(2000, 16)))
    asked = data[::20]
    got, pairs = found(spark, asked, data, cells=64, sample=1000)
    assert got == sorted(by_hand(asked, data))
    assert pairs < 0.2 * len(asked) * len(data)


@pytest.mark.parametrize(("cells", "reaches", "block"), [(1, (1,), 7), (8, (1, 3), 4096), (30, (4,), 5)])
def test_unclustered_and_tied_vectors(spark, cells, reaches, block):
    """Independent vectors, a third of all rows one text's copies, other lengths of the same direction, blocks of a few rows."""
    rng = np.random.default_rng(cells)
    values = rng.normal(size=(120, 8))
    data = rows([*values, *np.repeat(values[:1], 60, axis=0), *(values[1:20] * 2.0)])
    assert found(spark, data, data, cells=cells, reaches=reaches, block=block, sample=50)[0] == sorted(by_hand(data, data))


def test_odd_rows(spark):
    odd = [(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None), (7, [0.6, 0.8])]
    assert found(spark, odd, odd)[0] == sorted(by_hand(odd, odd))
    against = [(1, [0.0, 0.0]), (4, [-1.0, 0.0])]
    assert found(spark, odd, against)[0] == sorted(by_hand(odd, against))
    assert found(spark, odd, [(2, None), (9, None)])[0] == sorted(by_hand(odd, [(2, None), (9, None)]), key=lambda x: x[0])
    assert found(spark, [], odd)[0] == found(spark, odd, [])[0] == found(spark, [(1, [1.0])], [(1, [1.0])])[0] == []
