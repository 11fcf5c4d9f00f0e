"""Whitening of embeddings by a cyclic Jacobi eigensolver.

Components become integers, so sums and centred products are exact whatever the order of addition. Spark sums them over the
rows in two passes: sums of each dimension, then the scatter of what is left after the means' integer parts. The driver holds
only the covariance (dimension by dimension) and rotates it until its off-diagonal entries vanish beside the diagonal ones
they stand between, which leaves small eigenvalues accurate too. The whitening matrix is sent to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored


@dataclass(frozen=True)
class WhitenParams:
    """scale, shift: an entry c becomes floor(scale * c) + shift. components: at most so many. sweeps: at most so many rounds
    over all pairs. tiny: eigenvalues below this part of the trace count as zero."""

    scale: float = 1024.0
    shift: int = 100_000
    components: int = 8
    sweeps: int = 60
    tiny: float = 1e-13


#: Entries beyond this (2^40 after scaling) are an error: their squares would leave the exact range.
LARGEST = float(1 << 40)


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x (array of double): rows whose vector is there and has only finite entries. If lengths differ, the commonest
    length (of several the longest) is the dimension and other rows are left out; empty vectors have no component."""
    found = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return found.where(F.col("x").isNotNull() & (F.size("x") > 0) & F.coalesce(finite, F.lit(False)))


def _matrix(batch: pa.RecordBatch, d: int, params: WhitenParams) -> np.ndarray:
    """A batch's vectors as integers, a row each."""
    values = batch.column("x")
    flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    scaled = np.floor(flat * params.scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError("embedding entries are too large to be summed exactly")
    return scaled.astype(np.int64) + params.shift


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def exact_scatter(d: np.ndarray) -> np.ndarray:
    """d' d of integers as exact Python integers: products of doubles while they stay below 2^53."""
    most = int(np.abs(d).max(initial=0)) ** 2
    total = np.zeros((d.shape[1],) * 2, object)
    if most > 1 << 53:
        return d.astype(object).T @ d.astype(object)
    step = max(1, (1 << 53) // max(1, most))
    for at in range(0, len(d), step):
        part = d[at : at + step].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def moments(rows: DataFrame, d: int, params: WhitenParams) -> tuple[int, list[int], list[list[Fraction]]]:
    """n, the sums of each dimension and the exact covariance (divisor n) of the rows."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d, params)
                n, total = n + len(x), total + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), _decimals(total), pa.array([n] * d, pa.int64())], names=["i", "s", "n"])

    found = rows.select("x").mapInArrow(sums, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    n, s = found[0]["n"], [int(r["s"]) for r in found]
    centre = np.array([v // n for v in s], np.int64)
    above = np.triu_indices(d)

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            if batch.num_rows:
                total = total + exact_scatter(_matrix(batch, d, params) - centre)
        yield pa.RecordBatch.from_arrays([pa.array(above[0], pa.int32()), pa.array(above[1], pa.int32()), _decimals(total[above])], names=["i", "j", "p"])

    products = rows.select("x").mapInArrow(scatter, "i int, j int, p decimal(38,0)").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    rest = [v - int(c) * n for v, c in zip(s, centre, strict=True)]  # sums of what is left after the integer parts
    covariance = [[Fraction(0)] * d for _ in range(d)]
    for r in products:
        i, j = r["i"], r["j"]
        covariance[i][j] = covariance[j][i] = Fraction(n * int(r["p"]) - rest[i] * rest[j], n * n)
    return n, s, covariance


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of a symmetric matrix, largest first.

    A sweep rotates every pair of dimensions once, in rounds of pairs that share none (a tournament), so a round is one
    update of rows and columns. It ends when each off-diagonal entry is below the rounding error of the diagonal entries it
    stands between. Of each vector the largest entry is positive.
    """
    a, d = np.array(matrix, np.float64), len(matrix)
    v = np.eye(d)
    size = d + d % 2
    seats = list(range(size))
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps):
        still = True
        for _ in range(size - 1):
            pairs = [(min(p, q), max(p, q)) for p, q in zip(seats[: size // 2], seats[: size // 2 - 1 : -1], strict=True) if max(p, q) < d]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array([x for x, _ in pairs], int), np.array([x for _, x in pairs], int)
            off, app, aqq = a[p, q], a[p, p], a[q, q]
            turn = np.abs(off) > eps * np.sqrt(np.abs(app * aqq))
            turn &= off != 0
            if not turn.any():
                continue
            still = False
            p, q, off, app, aqq = p[turn], q[turn], off[turn], app[turn], aqq[turn]
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, v):
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            top, low = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * top - s[:, None] * low, s[:, None] * top + c[:, None] * low
            a[p, p], a[q, q] = app - t * off, aqq + t * off
            a[p, q] = a[q, p] = 0.0
        if still:
            break
    values = np.diag(a).copy()
    by = np.argsort(-values, kind="stable")
    v = v[:, by]
    return values[by], v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


def whitened(vectors: DataFrame, params: WhitenParams = WhitenParams()) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and each of
    the first components.

    vectors needs vec_id and embedding; other columns are ignored. Rows that :func:`usable` leaves out have no rows, repeated
    ones have each their own. A component without variance has null for ``whitened`` and counts for nothing in
    ``identity_error``; without any variance ``explained`` and ``identity_error`` are null. A deviation beyond 63 bits is an error.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = usable(vectors)
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    rows = found.where(F.size("x") == d)
    n, s, covariance = moments(rows, d, params)
    trace = float(sum(covariance[i][i] for i in range(d)))
    values, directions = jacobi(np.array([[float(x) for x in row] for row in covariance]), params.sweeps)
    kept = min(params.components, d)
    values = values[:kept]
    alive = values > params.tiny * trace
    explained = values / trace if trace > 0 else np.full(kept, np.nan)
    scale = np.where(alive, 1 / np.sqrt(np.where(alive, values, 1.0)), np.nan)
    sums = np.array(s, object)
    sent = spark.sparkContext.broadcast(directions[:, :kept] * scale)

    def project(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """n x - S exactly, and the whitened coordinates."""
        x = _matrix(batch, d, params)
        if max(n * int(np.abs(x).max(initial=0)), *map(abs, map(int, sums)), 0) < 1 << 62:
            away = n * x - sums.astype(np.int64)
        else:
            away = n * x.astype(object) - sums
        return away, (away.astype(np.float64) / n) @ sent.value

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of whitened coordinates after their own mean, and the mean, of each batch."""
        out = []
        for batch in batches:
            if batch.num_rows:
                w = project(batch)[1]
                mean = w.mean(axis=0)
                out.append((len(w), mean, (w - mean).T @ (w - mean)))
        for count, mean, products in out:
            yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], names=["c", "m", "p"])

    live = np.flatnonzero(alive)
    error = None
    if len(live):
        parts = rows.select("x").mapInArrow(spread, "c long, m array<double>, p array<double>")
        parts = stored(parts, "whitening-parts")
        add = lambda value: F.sum(F.col("c") * value)
        mean = parts.agg(*(add(F.col("m")[int(i)]).alias(f"m{i}") for i in live)).first()
        mean = {int(i): mean[f"m{i}"] / n for i in live}
        cells = [(int(i), int(j)) for i in live for j in live if i <= j]
        shifted = lambda i: F.col("m")[i] - mean[i]
        total = parts.agg(*(F.sum(F.col("p")[i * kept + j] + F.col("c") * shifted(i) * shifted(j)).alias(f"c{i}_{j}") for i, j in cells)).first()
        error = max(abs(total[f"c{i}_{j}"] / n - (i == j)) for i, j in cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away, w = project(batch)
            if away.dtype == object or (away.astype(np.float64) ** 2).sum(axis=1).max() > 2.0**62:
                deviation = [int(v) for v in (away.astype(object) ** 2).sum(axis=1)]
            else:
                deviation = (away * away).sum(axis=1)
            number, flat = len(w), w.ravel()
            each = pa.array(np.repeat(np.arange(number), kept))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, kept + 1), number), pa.int32()), pa.array(np.full(number * kept, n), pa.int64()),
                    pa.array(deviation, pa.int64()).take(each), pa.array(flat, mask=np.isnan(flat)),
                    pa.array(np.tile(explained, number), mask=np.tile(np.isnan(explained), number)), pa.array([error] * (number * kept), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
