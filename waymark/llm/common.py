"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import saved

def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a cut in the lineage that outlives executors."""
    return saved(df, name)


def in_fold(doc_id: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves ``remainder``; a null id is in no fold (false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lowered() -> np.ndarray:
    """Byte table that maps A-Z to a-z and keeps the rest."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def spaces() -> np.ndarray:
    """Byte table: true for the six white-space bytes 20 and 09 to 0D."""
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def text_blocks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a binary or string column into runs of whole rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets from 0); nulls are empty. One row longer than the limit is a run by itself.
    """
    values = batch.column(batch.schema.get_field_index(column))
    values = values.cast(pa.large_binary()) if not pa.types.is_large_binary(values.type) else values
    values = values.fill_null(b"") if values.null_count else values
    n = len(values)
    if not n:
        return
    buffers = values.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class ByteHash:
    """Hashes of all tokens of a byte buffer at once, by prefix sums of a polynomial over random byte values."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = 1 << max(16, int(n - 1).bit_length())
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                factors = np.full(size, np.uint64(base), dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums, one longer than the data."""
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((sums[ends] - sums[starts]) * self.inverses[starts])


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each item's component under the links (a, b), by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within each batch, links become a star around the smallest member of each component."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = union_find(len(names), at[: len(a)], at[len(a) :])
        apart = root != np.arange(len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names[apart]), pa.array(names[root[apart]])], names=["a", "b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a long, b long): rows (node, component), component the smallest node.

    Alternates large-star and small-star steps. Both need only each node's smallest neighbour, a partially aggregated
    minimum; a hub's links meet it in a join, which adaptive execution splits. Links are first contracted inside each batch. Each round is stored in the
    shared folder. Nodes without a link are not returned.
    """
    links = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a != b").mapInArrow(_contracted, "a long, b long"), "links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
        small = down.join(low, F.col("a") == F.col("node")).select("b", "m", "node")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b")))
        links = stored(small.where("a != b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join to a stored ``right`` that has each key once and, in ``weight``, how many rows of ``left`` have it.

    Keys with over a thousandth of the rows, of which there are fewer than a thousand, are broadcast, so that their rows stay
    where they are; the others are shuffled. The weight is dropped.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    many = F.col(weight) * 1000 > total
    hot, rest = right.where(many).drop(weight), right.where(~many).drop(weight)
    apart = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(hot), keys).unionByName(apart.join(rest, keys))


#: Rows of a table of cells that is broadcast: a few MB.
SMALL_TABLE = 100_000


def chunked_pairs(df: DataFrame, cell: str, home: str, size: int, salt: Column, cells: int | None = None) -> tuple[DataFrame, int]:
    """Deal a cell's rows out to blocks (cell, i, j): home rows of chunk i meet member rows of chunk j. Also how many rows
    are dealt in all.

    Chunk counts follow the cell's own sizes, so no block holds more than about ``size`` home and ``size`` member rows,
    however large the cell is. Home rows are members too. Adds columns _i, _j and _left (the row is on the home side).
    ``cells``: a bound on the number of cells, if there is one; up to ``SMALL_TABLE`` their sizes are broadcast.
    """
    counts = df.groupBy(cell).agg(F.sum(F.col(home).cast("int")).alias("_h"), F.count("*").alias("_n")).where("_h > 0 and _n > 1")
    sizes = stored(counts.select(cell, F.ceil(F.col("_h") / size).alias("_ni"), F.ceil(F.col("_n") / size).alias("_nj"), "_h", "_n"), "cells")
    total = sizes.agg(F.sum(F.col("_h") * F.col("_nj") + F.col("_n") * F.col("_ni"))).first()[0] or 0
    sizes = sizes.drop("_h", "_n")
    sizes = F.broadcast(sizes) if cells is not None and cells <= SMALL_TABLE else sizes
    dealt = df.join(sizes, cell).withColumn("_salt", salt)
    left = dealt.where(F.col(home)).withColumn("_i", F.pmod("_salt", "_ni")).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nj") - 1)))
    right = dealt.withColumn("_j", F.pmod("_salt", "_nj")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ni") - 1)))
    return left.withColumn("_left", F.lit(True)).unionByName(right.withColumn("_left", F.lit(False))).drop("_ni", "_nj", "_salt"), int(total)
