"""Toxicity by the nearest labelled examples.

Words and word beginnings are hashed; document frequencies by class come from all labelled training rows. Every feature
spans the TF-IDF space; how much it leans to the toxic class (log-odds) only weighs it. A bounded sample of labelled rows
is indexed in blocks of like examples; for each feature and block the largest weight is kept, so that blocks whose bound
cannot reach the k-th best cosine are skipped and the neighbours found are exact. Queries are answered a batch at a time:
one sparse product bounds all blocks, then the best blocks' postings are added up until no bound is left. Votes are weighted
by cosine and by how many rows an example stands for, then calibrated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import ByteHash, mix64, text_blocks
from waymark.llm.words import WordBlock

_hash = ByteHash(23)


@dataclass(frozen=True)
class ToxicParams:
    """bits: log2 of hashed features. examples: most indexed rows of each class. k: neighbours. block: examples in a block.
    start: letters of a word's beginning. floor, shrink: weights of features. dense: features that the index keeps as a matrix.
    broadcast: most labels that are sent to the texts (12 bytes each, a hash table of about 30 MB); beyond, the texts are
    shuffled to them. batch: postings that are added up at once."""

    bits: int = 20
    examples: int = 2000
    k: int = 15
    block: int = 64
    start: int = 5
    floor: float = 0.3
    shrink: float = 10.0
    dense: int = 2048
    broadcast: int = 1 << 20
    batch: int = 1 << 21


def row_features(data: np.ndarray, offsets: np.ndarray, params: ToxicParams) -> tuple[np.ndarray, np.ndarray]:
    """Features of all words of a block (words, then their first letters) and the row of each."""
    block = WordBlock(data, offsets)
    body = np.frombuffer(block.text, np.uint8)
    sums = _hash.sums(body)
    shift = np.uint64(64 - params.bits)
    whole = _hash.spans(sums, block.starts, block.ends)
    begin = mix64(_hash.spans(sums, block.starts, np.minimum(block.starts + params.start, block.ends)) + np.uint64(1))
    rows = np.repeat(np.arange(len(offsets) - 1), block.n_words())
    return (np.concatenate([whole, begin]) >> shift).astype(np.int64), np.concatenate([rows, rows])


def frequencies(labelled: DataFrame, params: ToxicParams) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class (0, 1) and the rows of each class that hold each feature, over all of ``labelled``."""
    size = 1 << params.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, size), np.int64)
        for batch in batches:
            labels = batch.column(1).to_numpy().astype(np.int64)
            for first, end, data, offsets in text_blocks(batch, "text"):
                feature, row = row_features(data, offsets, params)
                once = np.unique(row << params.bits | feature)
                label = labels[first:end][once >> params.bits]
                for c in (0, 1):
                    df[c] += np.bincount(once[label == c] & (size - 1), minlength=size)
        at = np.flatnonzero(df.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[0, at]), pa.array(df[1, at])], names=["feature", "clean", "toxic"])

    held = labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    counted = labelled.select("text", "toxic").mapInArrow(count, "feature long, clean long, toxic long")
    found = counted.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # 2**bits rows at most
    n, df = np.zeros(2, np.int64), np.zeros((2, size), np.int64)
    for r in held:
        n[r["toxic"]] = r["n"]
    for c, name in enumerate(("clean", "toxic")):
        df[c, found.column("feature").to_numpy()] = found.column(name).to_numpy()
    return n, df


def feature_weights(n: np.ndarray, df: np.ndarray, params: ToxicParams) -> np.ndarray:
    """Inverse document frequency of every feature times ``floor`` and the log-odds by which its rows are toxic more often
    than all, as if ``shrink`` more rows were as toxic as all. None weighs nothing."""
    total, here = n.sum(), df.sum(axis=0)
    idf = np.log((1 + total) / (1 + here)) + 1
    if not n.all():
        return idf
    rate = n[1] / total
    toxic = (df[1] + params.shrink * rate) / (here + params.shrink)
    return idf * (params.floor + np.maximum(0, np.log(toxic / (1 - toxic)) - np.log(rate / (1 - rate))))


@dataclass(frozen=True)
class Vectors:
    """Unit vectors of n rows: entries (row, feature, weight) in order of row and feature; a row without words has none."""

    n: int
    row: np.ndarray
    feature: np.ndarray
    weight: np.ndarray

    def some(self, first: int, end: int) -> Vectors:
        cut = slice(*np.searchsorted(self.row, [first, end]))
        return Vectors(end - first, self.row[cut] - first, self.feature[cut], self.weight[cut])


def unit_vectors(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, params: ToxicParams) -> Vectors:
    feature, row = row_features(data, offsets, params)
    n = len(offsets) - 1
    at, count = np.unique(row << params.bits | feature, return_counts=True)
    row, feature = at >> params.bits, at & ((1 << params.bits) - 1)
    weight = (1 + np.log(count)) * weights[feature]
    return Vectors(n, row, feature, weight / np.sqrt(np.bincount(row, weight * weight, n))[row])


def ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (many[0] numbers), then the same from first[1], and so on."""
    kind = np.int32 if len(first) and int(first.max()) + int(many.sum()) < 1 << 31 else np.int64
    return np.repeat((first - np.cumsum(many) + many).astype(kind), many) + np.arange(many.sum(), dtype=kind)


def like_groups(vectors: Vectors, size: int, width: int = 512) -> list[np.ndarray]:
    """The rows in groups of like ones, at most ``size`` in each: random signs fold the features to ``width`` numbers, then
    rows are split across the direction in which they vary most. Large groups are cut at the widest gap near the middle,
    smaller ones so that the parts are full groups."""
    rng = np.random.default_rng(size)
    signs = rng.integers(0, 2**63, 1 << 16)
    folded, start = np.zeros((vectors.n, width)), rng.normal(size=width)
    code = signs[vectors.feature & 0xFFFF] ^ (vectors.feature >> 16)
    np.add.at(folded, (vectors.row, code % width), np.where(code >> 40 & 1, vectors.weight, -vectors.weight))
    out, todo = [], [np.arange(vectors.n)]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        x = folded[rows] - folded[rows].mean(axis=0)
        along = x @ start
        for _ in range(20):  # towards the first principal component
            turned = along @ x
            along = x @ (turned / max(1e-12, np.sqrt(turned @ turned)))
        by = np.argsort(along, kind="stable")
        half = -(-len(rows) // (2 * size)) * size
        if len(rows) > 8 * size:
            low, high = len(rows) * 3 // 10, len(rows) * 7 // 10
            half = low + 1 + int(np.argmax(np.diff(along[by][low : high + 1])))
        todo += [rows[by[half:]], rows[by[:half]]]
    return out


class BlockMaxIndex:
    """Postings of examples by feature and block, with each feature's largest weight there; exact nearest examples by cosine.

    The ``dense`` features that most examples hold are kept as matrices (their postings are nearly full) of single precision,
    others as lists. The matrices only choose: what may be among the nearest by them is summed again in double precision.
    """

    SLACK = 1e-5  # more than single precision can be wrong by

    def __init__(self, vectors: Vectors, features: int, block: int, dense: int = 2048):
        self.n, self.block = vectors.n, block
        groups = like_groups(vectors, block)
        self.blocks = len(groups)
        self.names = np.full(self.blocks * block, -1)  # the example at each place
        for b, rows in enumerate(groups):
            self.names[b * block : b * block + len(rows)] = rows
        spot_of = np.empty(self.n, np.int64)
        spot_of[self.names[self.names >= 0]] = np.flatnonzero(self.names >= 0)
        at_block, at_place = np.divmod(spot_of[vectors.row], block)
        found, which, held = np.unique(vectors.feature, return_inverse=True, return_counts=True)
        common = np.sort(np.lexsort((found, -held))[:dense])
        self.common = np.full(features, -1, np.int32)
        self.common[found[common]] = np.arange(len(common))
        spot = self.common[vectors.feature]
        rare = spot < 0
        self.wide = np.zeros((self.n, len(common)), np.float32)
        self.wide[vectors.row[~rare], spot[~rare]] = vectors.weight[~rare]
        self.full = np.zeros((self.blocks, len(common), block), np.float32)
        self.full[at_block[~rare], spot[~rare], at_place[~rare]] = vectors.weight[~rare]
        self.full_most = self.full.max(axis=2, initial=0.0).T.copy()
        self.full_norm = np.sqrt((self.full**2).sum(axis=1)).max(axis=1, initial=0.0)  # of a block's examples in these features
        key = which[rare].astype(np.int64) * self.blocks + at_block[rare]
        order = np.argsort(key, kind="stable")
        self.local, self.weight = at_place[rare][order].astype(np.int32), vectors.weight[rare][order]
        keys, self.begin, self.size = np.unique(key[order], return_index=True, return_counts=True)
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(keys) else np.zeros(0)
        self.block_of = (keys % max(1, self.blocks)).astype(np.int32)
        listed, self.first, self.many = np.unique(keys // max(1, self.blocks), return_index=True, return_counts=True)
        self.held = held[listed]  # postings of a feature
        self.place = np.full(features, -1, np.int32)
        self.place[found[listed]] = np.arange(len(listed))
        self.visited = 0

    def nearest(self, queries: Vectors, k: int, batch: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the k largest positive cosines of each query, ties (to 12 digits) to the smaller number; where
        there are fewer, the rest is (-1, 0)."""
        ids, cosines = np.full((queries.n, k), -1), np.zeros((queries.n, k))
        place = self.place[queries.feature]
        listed = place >= 0
        work = np.cumsum(np.bincount(queries.row[listed], self.held[place[listed]], queries.n) + self.full.shape[1])
        first = 0
        while first < queries.n and self.n:
            end = max(first + 1, int(np.searchsorted(work, (work[first - 1] if first else 0) + batch, side="right")))
            ids[first:end], cosines[first:end] = self._nearest(queries.some(first, end), k)
            first = end
        return ids, cosines

    def _nearest(self, queries: Vectors, k: int) -> tuple[np.ndarray, np.ndarray]:
        n, blocks, block = queries.n, self.blocks, self.block
        spot, place = self.common[queries.feature], self.place[queries.feature]
        dense = np.zeros((n, self.full.shape[1]), np.float32)
        dense[queries.row[spot >= 0], spot[spot >= 0]] = queries.weight[spot >= 0]
        known = place >= 0
        place, many = place[known], self.many[place[known]]
        entry = ranges(self.first[place], many)
        force = np.repeat(queries.weight[known], many)
        pair = np.repeat(queries.row[known].astype(np.int32) * np.int32(blocks), many) + self.block_of[entry]
        most = np.minimum(dense @ self.full_most, np.sqrt((dense * dense).sum(axis=1))[:, None] * self.full_norm)
        bound = np.bincount(pair, force * self.most[entry], n * blocks).reshape(n, blocks) + most
        order = np.argsort(-bound, axis=1, kind="stable")
        turns = np.array([0, *(1 << np.arange(blocks.bit_length()))])  # blocks visited before each turn: 0, 1, 2, 4, ...
        turns = np.append(turns[turns < blocks], blocks)
        turn_of = np.empty((n, blocks), np.uint8)
        np.put_along_axis(turn_of, order, np.repeat(np.arange(len(turns) - 1), np.diff(turns)).astype(np.uint8)[None], axis=1)
        turn = turn_of.ravel()[pair]
        by_turn = np.argsort(turn, kind="stable")
        cut = np.searchsorted(turn[by_turn], np.arange(len(turns)))
        doc, ids, lists, cosines = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        enough = np.zeros(n)  # a cosine below this is not among the nearest
        for t in range(len(turns) - 1):
            live = bound + self.SLACK > enough[:, None]
            if not (live & (turn_of >= t)).any():
                break
            live = (live & (turn_of == t)).ravel()
            at = np.flatnonzero(live)  # the pairs (query, block) of this turn
            self.visited += len(at)
            e = by_turn[cut[t] : cut[t + 1]]
            e = e[live[pair[e]]]
            size = self.size[entry[e]]
            posting = ranges(self.begin[entry[e]], size)
            target = np.repeat(((np.cumsum(live, dtype=np.int32) - 1) * np.int32(block))[pair[e]], size) + self.local[posting]
            sums = np.bincount(target, np.repeat(force[e], size) * self.weight[posting], len(at) * block).astype(np.float64, copy=False).reshape(-1, block)
            hope = sums.max(axis=1, initial=0.0) + most.ravel()[at] + self.SLACK > enough[at // blocks]
            at, sums = at[hope], sums[hope]
            full = np.zeros(sums.shape, np.float32)
            by_block = np.argsort(at % blocks, kind="stable")
            ends = np.searchsorted((at % blocks)[by_block], np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                these = by_block[ends[b] : ends[b + 1]]
                full[these] = dense[at[these] // blocks] @ self.full[b]
            near = sums + full
            pairs, local = np.nonzero((near > 0) & (near >= enough[at // blocks][:, None]))
            doc, ids = np.concatenate([doc, at[pairs] // blocks]), np.concatenate([ids, self.names[at[pairs] % blocks * block + local]])
            lists, cosines = np.concatenate([lists, sums[pairs, local]]), np.concatenate([cosines, near[pairs, local]])
            best = np.lexsort((-cosines, doc))
            doc, ids, lists, cosines = doc[best], ids[best], lists[best], cosines[best]
            begin = np.searchsorted(doc, np.arange(n + 1))
            full_up = np.diff(begin) >= k
            enough = np.where(full_up, np.append(cosines, 0)[np.minimum(begin[:-1] + k - 1, len(cosines))] - self.SLACK, 0)
            stay = cosines >= enough[doc]
            doc, ids, lists, cosines = doc[stay], ids[stay], lists[stay], cosines[stay]
        exact = lists.copy()
        for first in range(0, len(doc), 1 << 10):
            part = slice(first, first + (1 << 10))
            exact[part] += np.einsum("ij,ij->i", dense[doc[part]], self.wide[ids[part]], dtype=np.float64)
        best = np.lexsort((ids, -np.round(exact, 12), doc))
        doc, ids, exact = doc[best], ids[best], exact[best]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        doc, ids, exact, rank = (x[rank < k] for x in (doc, ids, exact, rank))
        out, cos = np.full((n, k), -1), np.zeros((n, k))
        out[doc, rank], cos[doc, rank] = ids, exact
        return out, cos


@dataclass(frozen=True)
class Examples:
    """The indexed rows: vectors, labels, how many rows each stands for (1 on average), ids. blank: score
    of a row without words; everyone: of one that shares no feature with an example. The index itself is made where it is
    first used, and does not travel."""

    vectors: Vectors
    weights: np.ndarray
    labels: np.ndarray
    stands: np.ndarray
    doc_ids: np.ndarray
    blank: float
    everyone: float
    params: ToxicParams

    @cached_property
    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex(self.vectors, 1 << self.params.bits, self.params.block, self.params.dense)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "index"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def votes(self, queries: Vectors, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(toxic share, neighbours, cosines) of each query; ``without`` names an example that each may not use."""
        k = self.params.k
        ids, cosines = self.index.nearest(queries, k + (without is not None), self.params.batch)
        if without is not None:
            own = ids == without[:, None]
            own[~own.any(axis=1), k] = True
            ids, cosines = ids[~own].reshape(-1, k), cosines[~own].reshape(-1, k)
        force = np.where(ids >= 0, cosines * self.stands[ids], 0.0) if len(self.stands) else cosines
        toxic = (force * self.labels[ids]).sum(axis=1) if len(self.labels) else force.sum(axis=1)
        share = (toxic + 0.5 * self.everyone) / (force.sum(axis=1) + 0.5)
        return np.clip(share, 1e-4, 1 - 1e-4), ids, cosines


@dataclass(frozen=True)
class Judge:
    """Examples, the same as sent to the workers, and the logistic map of their votes' log-odds."""

    examples: Examples
    shared: Broadcast
    a: float
    b: float


def calibrated(share: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * np.log(share / (1 - share)) + b, -30, 30)))


def calibration(share: np.ndarray, labels: np.ndarray, stands: np.ndarray) -> tuple[float, float]:
    """Logistic map from the votes of each example without itself to its label, by damped Newton steps."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x = np.log(share / (1 - share))
    design = np.stack([x, np.ones_like(x)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (stands * (p - labels)) + 1e-2 * (theta - [1, 0])
        curve = (design * (stands * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(curve, slope), -1, 1)
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)


def examples_of(rows: list[tuple[int, int, int, bytes, bytes]], n: np.ndarray, weights: np.ndarray, params: ToxicParams) -> Examples:
    """Examples of (doc_id, toxic, copies, features, weights) rows."""
    rows = sorted(rows, key=lambda r: (r[0], r[3], r[4]))
    labels, copies = np.array([r[1] for r in rows], np.float64), np.array([r[2] for r in rows], np.float64)
    got = np.array([max(1.0, copies[labels == c].sum()) for c in (0, 1)])
    stands = copies * np.array([n[r[1]] / got[r[1]] for r in rows]) if rows else copies
    stands = stands / max(1e-12, stands.mean() if rows else 1.0)
    sizes = np.array([len(r[3]) // 4 for r in rows], np.int64)
    empty = sizes == 0
    everyone = float((stands @ labels + 0.5) / (stands.sum() + 1)) if rows else 0.0
    blank = float((stands[empty] @ labels[empty] + everyone) / (stands[empty].sum() + 1)) if rows else 0.0
    full = np.flatnonzero(~empty)
    feature = np.frombuffer(b"".join(rows[i][3] for i in full), "<i4")
    weight = np.frombuffer(b"".join(rows[i][4] for i in full), "<f8")
    vectors = Vectors(len(full), np.repeat(np.arange(len(full), dtype=np.int32), sizes[full]), feature, weight)
    ids = np.array([rows[i][0] for i in full], np.int64)
    return Examples(vectors, weights, labels[full], stands[full], ids, blank, everyone, params)


def learn(docs: DataFrame, labels: DataFrame, training: Column, params: ToxicParams = ToxicParams()) -> Judge:
    """docs needs doc_id and text, labels doc_id and toxic; ``training`` is a condition on doc_id. Rows of labels without a
    text or a 0/1 label teach nothing; an id labelled twice counts with its larger label. At most ``examples`` distinct rows
    of each class are indexed; a repeated row is one example that stands for all its copies."""
    spark = docs.sparkSession
    marks = labels.where(training & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = F.broadcast(marks) if marks.count() <= params.broadcast else marks
    labelled = docs.where(training & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text")).join(marks, "doc_id")
    n, df = frequencies(labelled, params)
    weights = feature_weights(n, df, params)

    labelled = labelled.withColumn("_by", F.xxhash64("doc_id", "text", F.lit(5)))
    counted = labelled.groupBy("toxic", "_by").agg(F.count("*").alias("copies"))
    picked = counted.where("toxic = 0").orderBy("_by").limit(params.examples).unionByName(counted.where("toxic = 1").orderBy("_by").limit(params.examples))
    picked = spark.createDataFrame(picked.collect(), "toxic int, _by long, copies long")
    shared = spark.sparkContext.broadcast(weights)

    def vectors(batches):
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch, "text"):
                found = unit_vectors(data, offsets, shared.value, params)
                cut = np.searchsorted(found.row, np.arange(found.n + 1))
                parts = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                columns = [batch.column(i).slice(first, end - first) for i in range(3)]
                yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int64()), *columns[1:], pa.array([found.feature[p].astype("<i4").tobytes() for p in parts], pa.binary()), pa.array([found.weight[p].astype("<f8").tobytes() for p in parts], pa.binary())], names=["doc_id", "toxic", "copies", "at", "weight"])

    chosen = labelled.join(F.broadcast(picked), ["toxic", "_by"]).dropDuplicates(["toxic", "_by"])
    rows = chosen.select("doc_id", "toxic", "copies", "text").mapInArrow(vectors, "doc_id long, toxic int, copies long, at binary, weight binary").collect()
    shared.destroy()
    examples = examples_of([tuple(r) for r in rows], n, weights, params)
    sent = spark.sparkContext.broadcast(examples)
    return Judge(examples, sent, *_own_votes(spark, examples, sent))


def _own_votes(spark: SparkSession, examples: Examples, sent: Broadcast, size: int = 128) -> tuple[float, float]:
    """Calibration on the votes of every example without itself, computed by tasks of ``size`` examples."""
    n = examples.vectors.n
    if not n:
        return 1.0, 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for part in batch.column(0).to_pylist():
                first, end = part * size, min(n, (part + 1) * size)
                share = known.votes(known.vectors.some(first, end), np.arange(first, end))[0]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([share.tolist()], pa.list_(pa.float64()))], names=["part", "share"])

    parts = -(-n // size)
    found = spark.range(0, parts, 1, parts).mapInArrow(run, "part long, share array<double>").collect()
    share = np.concatenate([r["share"] for r in sorted(found, key=lambda r: r["part"])])
    return calibration(share, examples.labels, examples.stands)


def score(docs: DataFrame, judge: Judge) -> DataFrame:
    """doc_id, score (0 to 1) and evidence (up to three nearest labelled ids) for every row's whole text. Null and empty
    texts, and texts without a word, get the smoothed rate among labelled rows of that kind; texts that share no feature
    with an example the rate among all."""
    shared, a, b = judge.shared, judge.a, judge.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch, "text"):
                queries = unit_vectors(data, offsets, known.weights, known.params)
                share, ids, _ = known.votes(queries)
                words = np.bincount(queries.row, minlength=queries.n) > 0
                found = np.where(words, np.where(ids[:, 0] >= 0, calibrated(share, a, b), known.everyone), known.blank)
                evidence = [[int(known.doc_ids[i]) for i in near if i >= 0] for near in ids[:, :3].tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(found, pa.float64()), pa.array(evidence, pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, score double, evidence array<long>")
