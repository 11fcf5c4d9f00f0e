"""Near-duplicate embeddings: exact metric range join over unit vectors.

cosine >= c between unit vectors is distance <= r with r^2 = 2 - 2c. Each distinct vector belongs to the cell of its nearest
pivot and is copied to every other cell that it may have a partner in: by the triangle inequality only if its distances to
the two pivots differ by at most 2r, and, these being Euclidean, only if it lies within r of the plane between them. Cells
are then joined independently, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.cells import each_block
from waymark.llm.common import components, join_hot, stored, union_find


@dataclass(frozen=True)
class EmbeddingParams:
    """cosine: least of a link. cell: distinct vectors aimed at in a cell, as long as there are no more cells than the square
    root of the vectors. block: rows of a side of a block; tile: rows of a home side that are compared at once."""

    cosine: float = 0.95
    cell: int = 4096
    block: int = 4096
    tile: int = 512


def unit(rows: list | np.ndarray) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vector, pivot, is its home) of every cell that each unit vector goes to: its home, and of the cells in reach those
    that are to get this home's boundary vectors."""
    found, step = [], max(1, (1 << 22) // len(pivots))
    every = np.arange(len(pivots))
    for begin in range(0, len(x), step):
        part = x[begin : begin + step]
        square = np.maximum(2 - 2 * part @ pivots.T, 0)
        home = square.argmin(axis=1)
        between = np.sqrt(np.maximum(2 - 2 * pivots[home] @ pivots.T, 0))
        at = np.arange(len(part))
        near = square[at, home][:, None]
        slack = 1e-7
        triangle = np.sqrt(square) - np.sqrt(near) <= 2 * radius + slack
        plane = square - near <= 2 * radius * between + slack
        turn = (every[None] < home[:, None]) == ((every[None] + home[:, None]) % 2 == 0)
        go = triangle & plane & turn
        go[at, home] = True
        vector, pivot = np.nonzero(go)
        found.append((vector + begin, pivot, home[vector] == pivot))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def linked(vectors: DataFrame, params: EmbeddingParams = EmbeddingParams()) -> DataFrame:
    """One row for each row of vectors (vec_id, embedding): vec_id, n_links, component_id.

    n_links counts other vec_ids linked directly, each once. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Rows that share an id are one vector with several
    embeddings: it is linked where one of them is, and all its rows get the same result. A null id has no links and a null
    component. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.coalesce((F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    keyed = rows.where(usable).select("vec_id", "embedding", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), F.size("embedding"), "embedding").alias("k2"))
    pairs = stored(keyed.groupBy("k1", "k2", "vec_id").agg(F.first("embedding").alias("embedding")), "vectors")
    several = stored(pairs.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1").select("vec_id"), "several")
    marked = pairs.join(several.withColumn("many", F.lit(1)), "vec_id", "left")
    h = F.when(F.col("many") == 1, F.xxhash64("vec_id", F.lit(3)))
    grouped = marked.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least"), F.count_if(F.col("many").isNull()).alias("single"), F.count("many").alias("_many"),
        F.bit_xor(h).alias("_x"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.first("embedding").alias("embedding"),
    )
    distinct = stored(grouped.withColumn("key", F.monotonically_increasing_id()), "distinct")
    # ids with several embeddings: vectors that hold the same of them share a name, the smallest key
    owners = stored(marked.where("many = 1").join(distinct.select("k1", "k2", "key", "_many", "_x", "_s"), ["k1", "k2"]).select("vec_id", "key", "_many", "_x", "_s"), "owners")
    named_sets = owners.groupBy("_many", "_x", "_s").agg(F.min("key").alias("same"))
    owners = stored(owners.join(named_sets, ["_many", "_x", "_s"]).select("vec_id", "key", "same"), "owner-sets")
    distinct = distinct.join(owners.select("key", "same").distinct(), "key", "left")
    distinct = stored(distinct.select("k1", "k2", "key", "least", "single", "same", "embedding", (F.col("single") + F.col("_many")).alias("_held")), "named")

    sizes = [r["n"] for r in distinct.groupBy(F.size("embedding").alias("n")).count().collect()]
    found = spark.createDataFrame([], FOUND)
    for n in sorted(sizes):
        found = found.unionByName(_of_length(distinct.where(F.size("embedding") == n).select("key", "single", "same", "embedding"), params))
    found = stored(found, "near")

    first = owners.groupBy("vec_id").agg(F.min("key").alias("b"))
    links = found.where("key2 is not null").select(F.col("key").alias("a"), F.col("key2").alias("b")).unionByName(owners.join(first, "vec_id").where("key <> b").select(F.col("key").alias("a"), "b"))
    part = distinct.select("k1", "k2", "key", "least").join(components(links).withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    part = part.join(part.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("k1", "k2", "key", "component_id")
    counts = found.where("n is not null").groupBy("key").agg(F.sum("n").alias("n"))
    # (vector, id) where the id has several embeddings and one of them is linked to the vector or is the vector itself
    sets = owners.select("same", "vec_id").distinct()
    near = found.where("same is not null").select("key", "same").unionByName(owners.select("key", "same")).distinct()
    near = stored(near.join(sets, "same").select("key", F.col("vec_id").alias("other")).distinct(), "near-ids")
    extra = near.groupBy("key").agg(F.count("*").alias("extra"))
    own = distinct.select("key", "single").join(counts, "key", "left").join(extra, "key", "left")
    own = own.select("key", (F.col("single") + F.coalesce("n", F.lit(0)) + F.coalesce("extra", F.lit(0)) - 1).alias("n_links"))
    held = distinct.select("k1", "k2", "_held")
    one = stored(part.join(own, "key").join(held, ["k1", "k2"]).select("k1", "k2", "n_links", "component_id", "_held"), "per-vector")
    # an id with several embeddings: the distinct ids near any of them
    singles = near.join(distinct.select("key", "single"), "key").groupBy("other").agg(F.sum("single").alias("singles"))
    seen = near.join(owners.select("key", "vec_id"), "key").select("other", "vec_id").distinct().groupBy("other").agg(F.count("*").alias("ids"))
    many = singles.join(seen, "other").select(F.col("other").alias("vec_id"), (F.col("singles") + F.col("ids") - 1).alias("many_links"))
    result = join_hot(pairs.select("k1", "k2", "vec_id"), one, ["k1", "k2"], "_held").join(many, "vec_id", "left")
    per_id = result.groupBy("vec_id").agg(F.max(F.coalesce("many_links", "n_links")).alias("n_links"), F.min("component_id").alias("component_id"))
    named, none = rows.where("vec_id is not null").select("vec_id"), F.lit(0).cast("long")
    every = named.groupBy("vec_id").agg(F.count("*").alias("_n")).join(per_id, "vec_id", "left")
    every = stored(every.select("vec_id", F.coalesce("n_links", none).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), "_n"), "per-id")
    return join_hot(named, every, ["vec_id"], "_n").unionByName(rows.where("vec_id is null").select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id")))


FOUND = "key long, key2 long, n long, same long"


def _of_length(distinct: DataFrame, params: EmbeddingParams) -> DataFrame:
    """For vectors of one length: counts (key, n) of the ids with one embedding that each is linked to, spanning links (key,
    key2), and (key, same) of linked vectors that hold ids with several."""
    spark = distinct.sparkSession
    n = distinct.count()
    k = max(1, min(int(np.sqrt(n)), n // params.cell))
    picked = distinct.select("key", "embedding").orderBy(F.xxhash64("embedding"), "key").limit(k).collect()
    pivots = spark.sparkContext.broadcast(unit([r["embedding"] for r in picked]))
    radius = float(np.sqrt(2 - 2 * params.cosine))
    least, tile = params.cosine, params.tile

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            x = unit(column.flatten().to_numpy().reshape(batch.num_rows, -1))
            vector, pivot, home = cells_of(x, pivots.value, radius)
            for begin in range(0, len(vector), 1 << 14):
                part = slice(begin, begin + (1 << 14))
                take = pa.array(vector[part])
                yield pa.RecordBatch.from_arrays([pa.array(pivot[part].astype(np.int64)), *(batch.column(i).take(take) for i in range(3)), column.take(take), pa.array(home[part])], names=["cell", "key", "single", "same", "embedding", "home"])

    def compare(home: pd.DataFrame, member: pd.DataFrame) -> pd.DataFrame:
        """Links of a block's home rows with its members. The cell's own pairs are met in both orders and counted for the
        home row, a visitor's only here and counted for both."""
        a, b = home["key"].to_numpy(), member["key"].to_numpy()
        x, y = (unit(np.stack(f["embedding"].to_numpy())) for f in (home, member))
        visits = ~member["home"].to_numpy()
        found = []
        for begin in range(0, len(a), tile):
            near = x[begin : begin + tile] @ y.T >= least
            near &= a[begin : begin + tile, None] != b[None]
            i, j = np.nonzero(near)
            found.append((i + begin, j))
        i, j = (np.concatenate(c) for c in zip(*found, strict=True))
        here = np.bincount(i, member["single"].to_numpy()[j], len(a)).astype(np.int64)
        there = np.bincount(j, home["single"].to_numpy()[i], len(b)).astype(np.int64) * visits
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = union_find(len(names), at[: len(a)][i], at[len(a) :][j])
        apart = root != np.arange(len(names))
        parts = [(np.concatenate([a[here > 0], b[there > 0]]), "n", np.concatenate([here[here > 0], there[there > 0]])), (names[apart], "key2", names[root[apart]])]
        for rows, others, mine, theirs, use in ((a, member, i, j, None), (b, home, j, i, visits)):
            same = others["same"].to_numpy(np.float64, na_value=-1).astype(np.int64)[theirs]
            take = (same >= 0) if use is None else (same >= 0) & use[mine]
            once = np.unique(np.stack([rows[mine[take]], same[take]]), axis=1)
            parts.append((once[0], "same", once[1]))
        return pd.concat([pd.DataFrame({"key": key} | {c: pd.array(value if c == name else [None] * len(key), dtype="Int64") for c in ("key2", "n", "same")}) for key, name, value in parts])

    kind = dict(distinct.dtypes)["embedding"]
    members = distinct.select("key", "single", "same", "embedding").mapInArrow(dealt, f"cell long, key long, single long, same long, embedding {kind}, home boolean")
    return each_block(members, "cell", "home", params.block, compare, FOUND, "key", cells=k)
