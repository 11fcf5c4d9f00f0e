"""Whitening against numpy and exact arithmetic."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from waymark.llm.queries import op13_whitening
from waymark.llm.whitening import WhitenParams, exact_scatter, jacobi, whitened

SCHEMA = "vec_id long, embedding array<double>"


def covariance(x: list[list[int]]) -> tuple[list[int], np.ndarray]:
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    centred = [[Fraction(n * r[i] - s[i], n) for i in range(d)] for r in x]
    return s, np.array([[float(sum(r[i] * r[j] for r in centred) / n) for j in range(d)] for i in range(d)])


def check(rows: list, vectors: dict[int, list[float]], components: int):
    x = {k: [math.floor(1024 * float(c)) + 100_000 for c in v] for k, v in vectors.items()}
    n, (s, v) = len(x), covariance(list(x.values()))
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1], directions[:, ::-1]
    found: dict = {}
    for r in rows:
        found[r["vec_id"], r["component"]] = r
    assert len(rows) == len(found) == n * components
    for k in range(components):
        mine = np.array([found[i, k + 1]["whitened"] for i in x])
        want = np.array([[n * a - b for a, b in zip(row, s, strict=True)] for row in x.values()], float) / n @ directions[:, k] / math.sqrt(values[k])
        assert np.allclose(mine, want, atol=1e-7) or np.allclose(mine, -want, atol=1e-7)
        assert found[next(iter(x)), k + 1]["explained"] == pytest.approx(values[k] / np.trace(v), rel=1e-9)
    w = np.array([[found[i, k + 1]["whitened"] for k in range(components)] for i in x])
    error = np.abs(w.T @ w / n - np.eye(components)).max()
    for (i, _), r in found.items():
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True))
        assert r["identity_error"] == pytest.approx(error, abs=1e-12) and r["identity_error"] < 1e-9


def test_query_against_numpy(spark, sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/embeddings.parquet").to_pydict()
    vectors = {i: v for i, v in zip(table["vec_id"], table["embedding"], strict=True) if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    check(op13_whitening(spark, sf_dir).collect(), vectors, 8)


def test_few_dimensions_and_unusable_rows(spark):
    """Fewer components than eight; rows left out; repeated rows; the commonest length is the dimension."""
    rng = np.random.default_rng(1)
    good = {i: [float(c) for c in rng.normal(size=3) * [5.0, 1.0, 0.2]] for i in range(50)}
    bad = [(100, None), (101, [None, 1.0, 2.0]), (102, [math.nan, 1.0, 2.0]), (103, [math.inf, 1.0, 2.0]), (104, []), (105, [1.0, 2.0])]
    rows = whitened(spark.createDataFrame([*good.items(), *bad], SCHEMA).repartition(3)).collect()
    check(rows, good, 3)
    twice = whitened(spark.createDataFrame([(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0])], SCHEMA)).collect()
    assert len(twice) == 6 and {r["n"] for r in twice} == {3} and sum(r["vec_id"] is None for r in twice) == 2


def test_no_variance(spark):
    rows = whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect()
    assert len(rows) == 4 and all(r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    line = whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])], SCHEMA)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line) and all(r["identity_error"] < 1e-12 for r in line)
    assert whitened(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []


def test_jacobi_keeps_small_eigenvalues():
    """Graded matrices: eigenvalues over twenty orders of magnitude, each right to many digits, unlike those of a plain solver."""
    rng = np.random.default_rng(2)
    for d in (1, 2, 3, 7, 20):
        scale = 10.0 ** -np.linspace(0, 10, d)
        core = np.eye(d) + 0.1 * rng.normal(size=(d, d)) / d
        core = core @ core.T
        values, vectors = jacobi(core * np.outer(scale, scale))
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-13 and (np.diff(values) <= 0).all() and (values > 0).all()
        exact = np.linalg.slogdet(core)[1] + 2 * np.log(scale).sum()  # the determinant, from the well-conditioned core
        assert np.log(values).sum() == pytest.approx(exact, abs=1e-11)
    m = rng.normal(size=(64, 64))
    m = m @ m.T
    assert np.allclose(jacobi(m)[0], np.linalg.eigvalsh(m)[::-1], rtol=1e-11)
    assert np.allclose(jacobi(np.diag([3.0, 3.0, 0.0]))[0], [3.0, 3.0, 0.0])


def test_sums_are_exact():
    rng = np.random.default_rng(3)
    for top in (10, 1 << 24, 1 << 30):
        d = rng.integers(-top, top, (50, 3))
        assert (exact_scatter(d) == d.astype(object).T @ d.astype(object)).all()


def test_large_entries(spark):
    """Beyond the range of doubles' products everything stays exact, or is an error."""
    rows = {i: [float(x) for x in np.random.default_rng(i).normal(size=2) * [3e4, 7.0]] for i in range(9)}
    check(whitened(spark.createDataFrame(list(rows.items()), SCHEMA), WhitenParams()).collect(), rows, 2)
