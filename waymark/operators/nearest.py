"""Exact nearest neighbours by cosine without all pairs: balls around pivots, met in rounds of growing reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.session import attach, saved

#: What two ways of summing a product of unit vectors may differ by.
ROUNDING = 1e-9


def _unit(column: pd.Series) -> np.ndarray:
    """Rows of length 1; a vector of zeros stays."""
    values = np.stack([np.asarray(v, np.float64) for v in column])
    return values / np.maximum(np.sqrt((values * values).sum(axis=1)), 1e-9)[:, None]


def _distances(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (values * values).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * values @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _pivots(refs: DataFrame, cells: int, sample: int) -> np.ndarray | None:
    """Vectors far from each other, among a fixed number of rows that a hash of the id chooses. They steer work, not results."""
    rows = refs.orderBy(F.xxhash64("ref_id"), "ref_id").limit(sample).toPandas()
    if not len(rows):
        return None
    values = _unit(rows["emb"])
    values = values[(values != 0).any(axis=1)]
    if not len(values):
        return np.zeros((1, len(rows["emb"][0])))
    chosen, far = [0], _distances(values, values[:1])[:, 0]
    while len(chosen) < min(cells, len(values)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(values, values[chosen[-1:]])[:, 0])
    pivots = values[chosen]
    home = _distances(values, pivots).argmin(axis=1)
    return np.stack([values[home == k].mean(axis=0) for k in range(len(pivots))])


def _met(group: int):
    """Best reference of each query of one block; what lies within rounding of the best product is summed again, row by row,
    so that equal vectors tie and the smaller ref_id wins."""

    def run(key, asked: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(refs):
            names, theirs = refs["ref_id"].to_numpy(), _unit(refs["emb"])
            for at in range(0, len(asked), group):
                part = asked.iloc[at : at + group]
                ids, mine = part["id"].to_numpy(), _unit(part["emb"])
                product = np.where(ids[:, None] == names, -np.inf, mine @ theirs.T)
                q, r = np.nonzero((product >= product.max(axis=1, keepdims=True) - ROUNDING) & np.isfinite(product))
                out.append(pd.DataFrame({"id": ids[q], "ref_id": names[r], "similarity": (mine[q] * theirs[r]).sum(axis=1), "pairs": 0}).sort_values(["id", "similarity", "ref_id"], ascending=[True, False, True]).drop_duplicates("id"))
                out[-1]["pairs"] = len(names)
        return pd.concat(out) if out else pd.DataFrame({"id": [], "ref_id": [], "similarity": [], "pairs": []})

    return run


def nearest(vectors: DataFrame, reference: DataFrame, cells: int = 256, sample: int = 4096, reaches: tuple[int, ...] = (4,), block: int = 4096) -> DataFrame:
    """The most similar reference (ref_id, emb) of each vector (id, emb), not of the same id, by cosine; exact.

    References belong to the ball of their nearest pivot. A reference in a ball of radius r around p is at least |q - p| - r
    from q, so a ball is asked only if that could beat the best so far. Each vector first asks the balls of highest promise, as many
    as ``reaches`` says, round by round, and last all others that still could hold a better one. Blocks have at most ``block``
    rows of either side. Ids are whole numbers, each once. Ties go to the smaller ref_id. A vector of zeros has similarity 0 to all, a
    null vector null (and is nearest to none, unless there is no other); an id without another reference is left out.
    Returns id, ref_id, similarity and pairs, the number of references it was compared with.
    """
    spark = attach(vectors.sparkSession)
    refs = reference.select(F.col("ref_id").cast("long"), F.col("emb").cast("array<double>"))
    asked = vectors.select(F.col("id").cast("long"), F.col("emb").cast("array<double>"))
    norm = F.aggregate("emb", F.lit(0.0), lambda a, x: a + x * x)
    smallest = lambda df: df.orderBy("ref_id").limit(2).select("ref_id")
    plain = asked.where(F.col("emb").isNull() | (norm == 0))
    first = smallest(refs.where(F.col("emb").isNotNull())).withColumn("similarity", F.lit(0.0)).unionByName(smallest(refs).withColumn("similarity", F.lit(None).cast("double")))
    alike = plain.join(F.broadcast(first), (F.col("id") != F.col("ref_id")) & (F.col("emb").isNotNull() | F.col("similarity").isNull()))
    alike = alike.groupBy("id").agg(F.max_by(F.struct("ref_id", "similarity"), F.struct(F.col("similarity"), -F.col("ref_id"))).alias("b")).select("id", "b.ref_id", "b.similarity", F.lit(0).cast("long").alias("pairs"))
    asked, some = asked.where(F.col("emb").isNotNull() & (norm > 0)), refs.where(F.col("emb").isNotNull())
    pivots = _pivots(some, cells, sample)
    if pivots is None:
        none = asked.join(F.broadcast(smallest(refs)), F.col("id") != F.col("ref_id")).groupBy("id").agg(F.min("ref_id").alias("ref_id"))
        return alike.unionByName(none.select("id", "ref_id", F.lit(None).cast("double").alias("similarity"), F.lit(0).cast("long").alias("pairs")))
    sent = spark.sparkContext.broadcast(pivots)  # at most ``cells`` vectors

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                values = _unit(frame["emb"])
                away = _distances(values, sent.value)
                home = away.argmin(axis=1)
                zero = ~(values != 0).any(axis=1)  # no unit vectors: a ball of their own, whose promise is 0
                yield frame.assign(cell=np.where(zero, -1, home), away=np.where(zero, 0, away[np.arange(len(home)), home]))

    placed = saved(some.mapInPandas(settle, "ref_id long, emb array<double>, cell int, away double"), "balls")
    balls = {r["cell"]: (r["radius"], r["n"]) for r in placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).collect()}  # one row a pivot
    known = sorted(balls)
    radii, sizes = np.array([balls[c][0] for c in known]), np.array([balls[c][1] for c in known])

    def choose(lowest: int, highest: int | None):
        """Send each vector to the balls of these places by promise that may hold a better one."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                away = _distances(_unit(frame["emb"]), sent.value)[:, [max(c, 0) for c in known]]
                promise = np.where(np.array(known) < 0, 0.0, 1 - np.maximum(away - radii - ROUNDING, 0) ** 2 / 2)
                # nearest pivots first where promises are equal, as they are for all balls that hold the vector
                order = np.lexsort((away, -promise), axis=1)
                rank = np.empty_like(order)
                np.put_along_axis(rank, order, np.arange(len(known))[None, :].repeat(len(frame), 0), axis=1)
                open_ = (rank >= lowest) & (rank < (highest or len(known))) & (promise >= frame["best"].to_numpy()[:, None] - ROUNDING)
                q, c = np.nonzero(open_)
                if len(q):
                    yield pd.DataFrame({"id": frame["id"].to_numpy()[q], "emb": frame["emb"].to_numpy()[q], "cell": np.array(known)[c]})

        return run

    found = None
    steps = [0, *np.cumsum(reaches).tolist(), None]
    for lowest, highest in zip(steps[:-1], steps[1:], strict=True):
        if lowest >= len(known):
            break
        so_far = asked.withColumn("best", F.lit(-2.0)) if found is None else asked.join(found.groupBy("id").agg(F.max("similarity").alias("best")), "id", "left").fillna({"best": -2.0})
        sent_out = saved(so_far.mapInPandas(choose(lowest, highest), "id long, emb array<double>, cell int"), "asks")
        asks = {r["cell"]: r["n"] for r in sent_out.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        if not asks:
            continue
        deal = F.broadcast(spark.createDataFrame([(c, -(-asks[c] // block), -(-int(sizes[known.index(c)]) // block)) for c in asks], "cell int, ni long, nj long"))
        spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        left = sent_out.join(deal, "cell").withColumn("i", F.pmod(F.xxhash64("id"), "ni")).withColumn("j", spread("nj"))
        right = placed.join(deal, "cell").withColumn("j", F.pmod(F.xxhash64("ref_id"), "nj")).withColumn("i", spread("ni"))
        keys = ["cell", "i", "j"]
        met = left.select(*keys, "id", "emb").groupBy(*keys).cogroup(right.select(*keys, "ref_id", "emb").groupBy(*keys)).applyInPandas(_met(256), "id long, ref_id long, similarity double, pairs long")
        met = saved(met if found is None else met.unionByName(found), "met")
        found = met
    if found is None:
        return alike
    best = found.groupBy("id").agg(F.max_by("ref_id", F.struct("similarity", -F.col("ref_id"))).alias("ref_id"), F.max("similarity").alias("similarity"), F.sum("pairs").alias("pairs"))
    return alike.unionByName(best)
