"""LM scoring with a log-frequency Bloom filter.

Tokens and n-grams of the training rows are counted by Spark, sharded by hash. Each shard turns its n-grams into a slice
of one Bloom filter: an n-gram of count c enters at levels 1 .. 1 + floor(log2 c), so that probing level after level until
one is absent gives back the quantised count. Scores are hierarchical Dirichlet smoothing over these counts, with exact
unigram counts at the bottom.

From three words on an n-gram's name begins with its history's, so all continuations of a history meet in one shard. There
the quantised counts of those that are kept are added up, and this total enters the filter too, in steps of half an octave.
Scores divide by it, so the probabilities after any history add up to 1 but for the two quantisers and for false positives.

If filter and unigram table stay below ``max_broadcast_mb`` they are broadcast to the workers. Beyond that the same
slices stay where they are and the documents' distinct probes are shuffled to them and back, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import ByteHash, lowered, mix64, spaces, stored, text_blocks

LOWER, SPACE = lowered(), spaces()
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_hash = ByteHash(11)
#: The bits of a name that tell the continuations of one history apart, the bits of a name by number of words that are sent,
#: and the bit that marks a total.
WORD_BITS, PAIR_BYTES, GRAM_BYTES = np.uint64((1 << 20) - 1), 5, 6
TOTAL = np.uint64(1 << 50)


def _width(kind: int) -> int:
    return 8 if kind == 1 else PAIR_BYTES if kind == 2 else GRAM_BYTES


@dataclass(frozen=True)
class LmParams:
    """order: longest n-gram (2 or more). least: n-grams of three words or more that occur fewer times are left to the shorter
    ones, and their counts are in no total either. mass: Dirichlet weight of the shorter history. bits, probes: filter bits an entry and hash functions
    a level. shard_mb: text that one shard of the counts stands for."""

    order: int = 3
    least: int = 2
    mass: float = 100.0
    bits: int = 8
    probes: int = 5
    shard_mb: int = 16
    max_broadcast_mb: int = 192


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of the rows of one block, an end after each row, and the rows' offsets in them."""
    n = len(data)
    space = SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = True
    after[offsets[1:][full] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    hashes = _hash.spans(_hash.sums(LOWER[data]), starts, ends)
    at = np.searchsorted(starts, offsets)
    bounds = at + np.arange(len(offsets))
    out = np.full(len(hashes) + len(offsets) - 1, END)
    out[np.arange(len(hashes)) + np.repeat(np.arange(len(offsets) - 1), np.diff(at))] = hashes
    return out, bounds


def token_blocks(batch: pa.RecordBatch, order: int, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, bool]]:
    """Tokens of runs of rows of about ``limit`` bytes: first row, end row, tokens, their offsets by row, how many leading
    tokens only stand for what comes before, and whether the rows end here.

    A row longer than ``limit`` comes in several pieces, cut at white space; each but the first begins with the last order - 1
    tokens before it, so that its n-grams are those of the whole row.
    """
    for first, end, data, offsets in text_blocks(batch, "text", limit):
        if len(data) <= limit or end - first > 1:
            yield first, end, *tokens(data, offsets), 0, True
            continue
        before, start = np.zeros(0, np.uint64), 0
        while start < len(data):
            stop = start + limit
            while stop < len(data) and not (space := SPACE[data[stop : stop + limit]]).any():
                stop += limit
            stop = min(len(data), stop + int(space.argmax()) + 1) if stop < len(data) else len(data)
            tok, _ = tokens(data[start:stop], np.array([0, stop - start]))
            tok = np.concatenate([before, tok if stop == len(data) else tok[:-1]])
            if len(tok):
                yield first, end, tok, np.array([0, len(tok)]), len(before), stop == len(data)
            before, start = tok[max(0, len(tok) - order + 1) :], stop


def ngrams(tok: np.ndarray, bounds: np.ndarray, order: int) -> np.ndarray:
    """Name of the n-gram of this order that ends at each token; starts of rows are padded. From three words on the upper 44
    bits are the history's alone."""
    row_start = np.repeat(bounds[:-1], np.diff(bounds))
    history = np.zeros(len(tok), np.uint64)
    for back in range(order - 1, 0, -1):
        at = np.arange(len(tok)) - back
        previous = np.where(at >= row_start, tok[np.maximum(at, 0)], START)
        history = mix64(history * np.uint64(0x100000001B3) + previous + np.uint64(back))
    whole = mix64(mix64(history + np.uint64(order)) + tok)
    return whole if order < 3 else history & ~WORD_BITS | whole & WORD_BITS


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted different values. ``np.unique`` without counts goes through a hash table, some twenty times slower than this."""
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts)
    by = np.argsort(h)
    h, c = h[by], c[by]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _pack(h: np.ndarray, c: np.ndarray, width: int) -> tuple[bytes, bytes]:
    """Low ``width`` bytes of each hash, and counts as bytes; counts over 255 take several entries."""
    if len(c) and c.max() > 255:
        times = (c + 254) // 255
        h, last = np.repeat(h, times), np.cumsum(times) - 1
        rest = c - (times - 1) * 255
        c = np.full(len(h), 255, np.int64)
        c[last] = rest
    return _low(h, width), c.astype(np.uint8).tobytes()


def _low(h: np.ndarray, width: int) -> bytes:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(raw: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, :width] = part
    return out.view("<u8").ravel().astype(np.uint64)


def _counter(shards: int, params: LmParams):
    """Count the n-grams of each task and send them, packed, one row to each shard."""
    shift = np.uint64(64 - max(1, shards.bit_length() - 1))
    spill = 2_000_000

    def send(kinds):
        for kind, (hs, cs) in kinds.items():
            if not hs:
                continue
            h, c = _merged(hs, cs)
            cut = np.searchsorted(h >> shift, np.arange(shards + 1).astype(np.uint64))
            packed = [_pack(h[a:b], c[a:b], _width(kind)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            at = [i for i, (x, _) in enumerate(packed) if x]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array([packed[i][0] for i in at], pa.binary()), pa.array([packed[i][1] for i in at], pa.binary())], names=["shard", "kind", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {k: ([], []) for k in range(1, params.order + 1)}
        held = 0
        for batch in batches:
            for _, _, tok, bounds, skip, _ in token_blocks(batch, params.order):
                for k, (hs, cs) in kinds.items():
                    h, c = np.unique((tok if k == 1 else ngrams(tok, bounds, k))[skip:], return_counts=True)
                    hs.append(h)
                    cs.append(c)
                    held += len(h)
                if held > spill:
                    yield from send(kinds)
                    kinds, held = {k: ([], []) for k in kinds}, 0
        yield from send(kinds)

    return run


def levels_of(counts: np.ndarray) -> np.ndarray:
    return (np.frexp(counts.astype(np.float64))[1]).astype(np.int64)


def dequantised(level: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level on the log scale; 0 and 1 are exact."""
    return np.where(level < 2, level, np.exp2(level.astype(np.float64) - 1) * 1.4142135623730951 - 0.25 * (level == 2))


def _smallest_total(least: int) -> float:
    return float(dequantised(levels_of(np.array([least])))[0])


def total_levels(totals: np.ndarray, least: int) -> np.ndarray:
    """Two levels to the octave, the first one at the smallest total there can be."""
    return 1 + np.floor(2 * np.log2(totals / _smallest_total(least)) + 1e-9).astype(np.int64)


def dequantised_total(level: np.ndarray, least: int) -> np.ndarray:
    """Middle of a level's totals on the log scale; the first level is nearly always the smallest total itself."""
    return np.where(level < 2, level, np.exp2((level - 1) / 2 + 0.25)) * _smallest_total(least)


def _bit_at(h: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    x = mix64(h * np.uint64(0x9FB21C651E98DF25) + np.uint64(level * 64 + probe + 1))
    return (x - x // size * size).astype(np.int64) if np.isscalar(size) else (x % size.astype(np.uint64)).astype(np.int64)


def _shard_builder(shards: int, params: LmParams):
    bits_of_shard = max(1, shards.bit_length() - 1)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        uni_h, uni_c, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for kind, part in frame.groupby("kind"):
            h, c = _merged([_unpack(x, _width(kind)) for x in part["hashes"]], [np.frombuffer(x, np.uint8).astype(np.int64) for x in part["counts"]])
            if kind == 1:
                uni_h, uni_c = h, c
            elif kind == 2:
                grams.append((h, levels_of(c)))
            elif (c >= params.least).any():
                h, q = h[c >= params.least], levels_of(c[c >= params.least])
                history = h & ~WORD_BITS
                first = np.flatnonzero(np.concatenate([[True], history[1:] != history[:-1]]))
                grams += [(h, q), (history[first] | TOTAL, total_levels(np.add.reduceat(dequantised(q), first), params.least))]
        entries = sum(int(q.sum()) for _, q in grams)
        size = max(64, -(-entries * params.bits // 8) * 8)
        bits = np.zeros(size, bool)
        for h, q in grams:
            for level in range(1, int(q.max(initial=0)) + 1):
                h, q = h[q >= level], q[q >= level]
                for probe in range(params.probes):
                    bits[_bit_at(h, level, probe, np.uint64(size))] = True
        return pd.DataFrame({"shard": [shard], "uni_h": [uni_h.tobytes()], "uni_c": [np.minimum(uni_c, 255).astype(np.uint8).tobytes()], "many": [uni_c[uni_c >= 255].astype("<i8").tobytes()], "bits": [np.packbits(bits, bitorder="little").tobytes()], "n_bits": [size], "train_tokens": [int(uni_c.sum())], "vocabulary": [len(uni_h)], "n_bytes": [len(uni_h) * 9 + int((uni_c >= 255).sum()) * 16 + size // 8], "shard_bits": [bits_of_shard]})

    return run


BUILT = "shard int, uni_h binary, uni_c binary, many binary, bits binary, n_bits long, train_tokens long, vocabulary long, n_bytes long, shard_bits int"


def build(docs: DataFrame, training: Column, params: LmParams) -> tuple[DataFrame, int, dict]:
    """Shards of unigram counts and filter slices over the training rows, stored; the number of shards; the totals, with the
    bytes of all rows' texts."""
    train = docs.where(training).select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    size = docs.agg(F.sum(length).alias("all"), F.sum(F.when(training, length)).alias("train"), F.count_if(training).alias("starts")).first()
    shards = 1 << max(4, int((size["train"] or 0) // (params.shard_mb << 20)).bit_length())
    counted = train.mapInArrow(_counter(shards, params), "shard int, kind int, hashes binary, counts binary")
    built = stored(counted.groupBy("shard").applyInPandas(_shard_builder(shards, params), BUILT), "lm")
    total = built.agg(F.sum("train_tokens").alias("n"), F.sum("vocabulary").alias("v"), F.sum("n_bytes").alias("bytes")).first()
    return built, shards, {"n": total["n"] or 0, "v": total["v"] or 0, "bytes": total["bytes"] or 0, "starts": size["starts"], "text": size["all"] or 0}


class Model:
    """Unigram counts and filter slices of some shards; looks hashes up. ``only``: the shard that all names looked up belong to, if it is one."""

    def __init__(self, rows: list, shards: int, params: LmParams, only: int | None = None):
        self.shift, self.params = np.uint64(64 - max(1, shards.bit_length() - 1)), params
        rows.sort(key=lambda r: r["shard"])
        self.uni_h = np.concatenate([np.frombuffer(r["uni_h"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
        self.uni_c = np.concatenate([np.frombuffer(r["uni_c"], np.uint8) for r in rows] or [np.zeros(0, np.uint8)])
        self.many_at = np.flatnonzero(self.uni_c == 255)  # counts from 255 on, in 8 bytes each
        self.many = np.concatenate([np.frombuffer(r["many"], "<i8") for r in rows] or [np.zeros(0, "<i8")])
        sizes = np.zeros(shards, np.int64)
        starts = np.zeros(shards, np.int64)
        at = 0
        for r in rows:
            sizes[r["shard"]], starts[r["shard"]] = r["n_bits"], at
            at += len(r["bits"])
        self.sizes, self.starts = sizes, starts * 8
        self.bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8)
        self.only = only

    def unigrams(self, h: np.ndarray) -> np.ndarray:
        if not len(self.uni_h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.uni_h, h), len(self.uni_h) - 1)
        count = self.uni_c[at].astype(np.int64)
        large = np.flatnonzero(count == 255)
        count[large] = self.many[np.searchsorted(self.many_at, at[large])]
        return np.where(self.uni_h[at] == h, count, 0)

    def found(self, kind: int, h: np.ndarray) -> np.ndarray:
        """What is known of n-grams of this many words: exact counts; levels; from three words on levels, and 256 times the
        level of the history's total."""
        if kind == 1:
            return self.unigrams(h)
        if kind == 2:
            return self.levels(h, h & np.uint64((1 << 8 * PAIR_BYTES) - 1)).astype(np.int64)
        whole = np.uint64((1 << 8 * GRAM_BYTES) - 1)
        histories, at = np.unique(h & ~WORD_BITS, return_inverse=True)
        total = self.levels(histories, histories & whole | TOTAL).astype(np.int64)[at]
        level, known = np.zeros(len(h), np.int64), np.flatnonzero(total)
        level[known] = self.levels(h[known], h[known] & whole)
        return level + 256 * total

    def levels(self, h: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Quantised counts of names whose shard is that of ``h``: the highest level up to which every level's probes are set."""
        if self.only is not None:  # a size for all, and pieces that stay in the processor's cache
            return np.concatenate([np.zeros(0, np.uint8), *(self._levels_of_only(low[a : a + NEAR]) for a in range(0, len(low), NEAR))])
        out = np.zeros(len(h), np.uint8)
        shard = (h >> self.shift).astype(np.int64)
        live = np.flatnonzero(self.sizes[shard] > 0)
        level = 0
        while len(live):
            level += 1
            size, start = self.sizes[shard[live]], self.starts[shard[live]]
            for probe in range(self.params.probes):
                at = start + _bit_at(low[live], level, probe, size)
                there = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                live, size, start = live[there], size[there], start[there]
                if not len(live):
                    break
            out[live] = level
        return out

    def _levels_of_only(self, low: np.ndarray) -> np.ndarray:
        """``levels`` of names that are all in the one shard there is."""
        out, size, level = np.zeros(len(low), np.uint8), np.uint64(self.sizes[self.only]), 0
        live = np.arange(len(low) if size else 0)
        while len(live):
            level += 1
            for probe in range(self.params.probes):
                at = _bit_at(low[live], level, probe, size)
                live = live[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[live] = level
        return out


def probabilities(tok: np.ndarray, bounds: np.ndarray, found: list[np.ndarray], totals: dict, params: LmParams) -> tuple[np.ndarray, np.ndarray]:
    """Base and smoothed probability of each token. found: for 1, 2, .. words what ``Model.found`` says of each token's n-gram.

    A pair is counted at most as often as its words are; longer n-grams need the shorter one and their history's total.
    """
    uni, first = found[0], bounds[:-1]
    base = p = (uni + 0.1) / (totals["n"] + 0.1 * (totals["v"] + 1))
    seen = uni
    for order, level in enumerate(found[1:], 2):
        if order == 2:
            below = np.empty(len(tok), np.float64)
            below[1:], below[first] = uni[:-1], int(totals["starts"])
            c = np.minimum(dequantised(level), uni)
        else:
            level, total = level % 256, level // 256
            below = dequantised_total(total, params.least)
            c = np.where((seen > 0) & (level >= levels_of(np.array(params.least))), dequantised(level), 0)
        p = (np.minimum(c, below) + params.mass * p) / (below + params.mass)
        seen = c
    return base, p


class _Sums:
    """Row sums of the base and the smoothed log probabilities, over the pieces of a long row."""

    def __init__(self, totals: dict, params: LmParams):
        self.totals, self.params = totals, params
        self.held: list[np.ndarray] = []

    def add(self, tok: np.ndarray, bounds: np.ndarray, skip: int, found: list[np.ndarray]) -> None:
        base, p = probabilities(tok, bounds, found, self.totals, self.params)
        each = np.stack([np.ones(len(tok)), found[0] > 0, np.log10(base), np.log10(p)])
        each[:, :skip] = 0
        self.held.append(np.add.reduceat(each, bounds[:-1], axis=1))

    def done(self) -> dict:
        sums, self.held = sum(self.held), []
        return {"n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base_score": sums[2], "score": sums[3]}


def score(docs: DataFrame, training: Column, params: LmParams = LmParams()) -> DataFrame:
    """Log10 probability of every row's whole text under a model of the training rows.

    docs needs doc_id and text; other columns are ignored. A null or empty text is one end token. Repeated rows are each
    counted and scored. Texts over half a megabyte are taken in pieces, with the result of the whole. With no training rows every token has the probability that
    the formula then gives, 0.1 / 0.1. Returns doc_id, training, n_tokens, n_known,
    train_tokens, base_score (add-0.1 unigram) and score (the smoothed model).
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("training"))
    built, shards, totals = build(docs, F.col("training"), params)
    trained = totals["n"]
    out = "doc_id long, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def rows(batch, first, end, found):
        names = ["doc_id", "training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        ids = [batch.column(batch.schema.get_field_index(c)).slice(first, end - first) for c in names[:2]]
        return pa.RecordBatch.from_arrays([ids[0].cast(pa.int64()), ids[1], pa.array(found["n_tokens"], pa.int64()), pa.array(found["n_known"]), pa.array(np.full(end - first, trained, np.int64)), pa.array(found["base_score"]), pa.array(found["score"])], names=names)

    if totals["bytes"] <= params.max_broadcast_mb << 20:
        model = spark.sparkContext.broadcast(Model(list(built.toLocalIterator()), shards, params))  # shard by shard, to keep the driver small

        def run(batches):
            sums = _Sums(totals, params)
            for batch in batches:
                for first, end, tok, bounds, skip, last in token_blocks(batch, params.order):
                    names, at = np.unique(tok, return_inverse=True)
                    sums.add(tok, bounds, skip, [model.value.found(1, names)[at]] + [model.value.found(k, ngrams(tok, bounds, k)) for k in range(2, params.order + 1)])
                    if last:
                        yield rows(batch, first, end, sums.done())

        return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, out)
    return _score_exchanged(docs, built, shards, totals, params, rows, out)


def answers_of(model: Model, kind: int, asked: list[bytes]) -> list[bytes]:
    """What the one shard of the model says to the low bytes of names that blocks ask for; equal names are looked up together."""
    sizes, top, out = np.array([len(raw) // _width(kind) for raw in asked]), np.uint64(model.only) << model.shift, []
    for at in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1):
        names, places = np.unique(_unpack(b"".join(asked[i] for i in at), _width(kind)), return_inverse=True)
        value = model.found(kind, names | top).astype("<i8" if kind == 1 else "<u2")[places]
        out += [x.tobytes() for x in np.split(value, np.cumsum(sizes[at])[:-1])]
    return out


#: Names that a shard looks up together, those of them that are probed together, and text of a block whose tokens are kept.
TOGETHER, NEAR, KEPT = 1 << 20, 1 << 14, 16 << 20


def _score_exchanged(docs, built, shards, totals, params, rows, out) -> DataFrame:
    """As above without a broadcast: each block of rows asks the shards for its distinct probes.

    A probe goes as the bytes of its name that the shard's place does not say, and a shard looks up equal ones of all blocks once.
    """
    blocks = max(1, totals["text"] // (4 << 20))
    block = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(blocks))
    placed = docs.select("doc_id", "training", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"), block.alias("block"))
    shift = np.uint64(64 - max(1, shards.bit_length() - 1))
    orders = range(1, params.order + 1)

    def parts(frame):
        batch = pa.RecordBatch.from_pandas(frame[["doc_id", "training", "text"]].sort_values(["doc_id", "text"], kind="stable"), preserve_index=False, schema=pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("text", pa.large_binary())]))
        for first, end, tok, bounds, skip, last in token_blocks(batch, params.order):
            yield batch, first, end, tok, bounds, skip, last, {k: tok if k == 1 else ngrams(tok, bounds, k) for k in orders}

    def ask(key, frame):
        held = {k: [np.zeros(0, np.uint64)] for k in orders}
        for *_, kinds in parts(frame):
            for k, h in kinds.items():
                held[k].append(distinct(h))
        sent = []
        for k, hs in held.items():
            h = distinct(np.concatenate(hs))
            sent += [(int(key[0]), k, i, _low(h[a:b], _width(k))) for i, (a, b) in enumerate(cuts(h)) if a < b]
        return pd.DataFrame(sent, columns=["block", "kind", "shard", "hashes"])

    def cuts(h):
        cut = np.searchsorted(h >> shift, np.arange(shards + 1).astype(np.uint64))
        return list(zip(cut[:-1], cut[1:], strict=True))

    def answer(key, asked, shard):
        model, asked = Model(shard.to_dict("records"), shards, params, int(key[0])), asked.sort_values("kind", kind="stable")
        found = [x for k, raws in asked.groupby("kind")["hashes"] for x in answers_of(model, k, list(raws))]
        return asked[["block", "kind", "shard"]].assign(found=found)

    def finish(key, frame, answers):
        told = {(k, i): raw for k, i, raw in zip(answers["kind"], answers["shard"], answers["found"], strict=True)}

        def named():
            for *piece, kinds in parts(frame):
                yield *piece, {k: np.unique(h, return_inverse=True) for k, h in kinds.items()}

        kept = list(named()) if frame["text"].map(len).sum() <= KEPT else None  # else a long row's are made twice
        tables, names = {}, {k: [np.zeros(0, np.uint64)] for k in orders}
        for *_, kinds in kept or named():
            for k, (h, _) in kinds.items():
                names[k].append(h)
        for k in orders:
            h = distinct(np.concatenate(names.pop(k)))
            value = [np.frombuffer(told[k, i], "<i8" if k == 1 else "<u2") for i, (a, b) in enumerate(cuts(h)) if a < b]
            tables[k] = h, np.concatenate(value).astype(np.int64)
        done, sums = [], _Sums(totals, params)
        for batch, first, end, tok, bounds, skip, last, kinds in kept or named():
            sums.add(tok, bounds, skip, [tables[k][1][np.searchsorted(tables[k][0], h)][at] for k, (h, at) in kinds.items()])
            if last:
                done.append(rows(batch, first, end, sums.done()).to_pandas())
        return pd.concat(done) if done else pd.DataFrame(columns=[c.split()[0] for c in out.split(", ")])

    asked = placed.groupBy("block").applyInPandas(ask, "block long, kind int, shard int, hashes binary")
    answers = asked.groupBy("shard").cogroup(built.groupBy("shard")).applyInPandas(answer, "block long, kind int, shard int, found binary")
    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, out)
