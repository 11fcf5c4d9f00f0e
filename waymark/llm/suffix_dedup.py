"""Removal of repeated passages by three rounds of hashes of growing length (not prefix doubling: no ranks are built).

Every position of the corpus begins a suffix. Documents are packed in blocks of ascending ids; in rounds of growing length
the blocks send names (hashes) of what stands at their positions to shards, Spark brings equal names together, the shards
sort them and answer which names are still shared, and positions whose name is unique leave:

1. the first ``seed`` bytes at sampled positions. A position is sampled if its name is the least of the ``length - seed + 1``
   names in some window of ``length`` bytes, so equal windows sample the same place and one in about 15 positions goes on;
2. for shared names, all windows around the position that sampled it, named together (up to about twice the length);
3. where these differ, each window of ``length`` bytes by itself, at the threshold.

Names of one block are sent once, however often they occur in it, and a shard only needs the blocks of a name, so a passage
in a third of all documents makes no large group. Blocks ascend, hence "in a smaller document" is "in an earlier block" or
is settled inside the block; an id with more text than a block has blocks of its own, which do not count for each other.
What decides a removal has 64 bits and a shard chosen by another 64-bit hash, so names grow with the corpus.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import SMALL_TABLE, ByteHash, stored, text_blocks
from waymark.session import shared_path

_a, _b = ByteHash(31), ByteHash(37)


@dataclass(frozen=True)
class SuffixParams:
    """length: bytes of a match. seed: bytes of the first round's names. block: bytes of text in a block; shard: bytes of
    text that one shard of the names stands for. A block sends each shard one message of about block / 15 / shards names, and
    a shard holds about 8 x shard / 15 bytes of names: for hundreds of terabytes take larger ones (128 and 512 MB)."""

    length: int = 50
    seed: int = 20
    block: int = 4 << 20
    shard: int = 8 << 20


# ---------------------------------------------------------------- positions of one block


def _least_places(data: np.ndarray, seed: int, width: int) -> np.ndarray:
    """Leftmost place of the least name of ``seed`` bytes in each window of ``width`` places, by doubling. Names are
    compared by 32 bits; the place in the low half breaks ties to the left."""
    sums = _a.sums(data)
    n = len(data) - seed + 1
    key = sums[seed:] - sums[:n]
    key *= _a.inverses[:n]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(n, dtype=np.uint64)
    span = 1
    while span < width:
        step = min(span, width - span)
        key = np.minimum(key[step:], key[: len(key) - step])
        span += step
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int32)


@dataclass
class Runs:
    """Maximal runs of windows that share a sampled place: row, first and last window start, names."""

    row: np.ndarray
    first: np.ndarray
    last: np.ndarray
    seed: np.ndarray
    around: np.ndarray
    wide: np.ndarray

    def where(self, ok: np.ndarray) -> Runs:
        return Runs(*(x[ok] for x in (self.row, self.first, self.last, self.seed, self.around, self.wide)))


def _pieces(batch: pa.RecordBatch, column: str, length: int, limit: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the rows: bytes, offsets, row numbers and where in the row each part begins. Long rows are cut so that
    each window lies in exactly one part."""
    for first, end, data, offsets in text_blocks(batch, column, limit):
        if len(data) <= 2 * limit:
            yield data, offsets, np.arange(first, end), np.zeros(end - first, np.int64)
            continue
        for at in range(0, max(1, len(data) - length + 1), limit):
            part = data[at : at + limit + length - 1]
            yield part, np.array([0, len(part)]), np.array([first]), np.array([at])


def runs_of(batch: pa.RecordBatch, column: str, params: SuffixParams) -> Runs:
    out: list[tuple] = []
    length, width = params.length, params.length - params.seed + 1
    for data, offsets, rows, begins in _pieces(batch, column, length):
        if len(data) < length:
            continue
        place = _least_places(data, params.seed, width)
        sizes = np.diff(offsets)
        final = np.repeat(offsets[1:] - length, sizes)[: len(place)]  # last window start of the row
        new = np.ones(len(place), bool)
        np.not_equal(place[1:], place[:-1], out=new[1:])
        new[offsets[:-1][offsets[:-1] < len(place)]] = True
        first = np.flatnonzero(new & (np.arange(len(place)) <= final))
        if not len(first):
            continue
        row = np.searchsorted(offsets, first, side="right") - 1
        last = final[first]
        last[:-1] = np.minimum(last[:-1], first[1:] - 1)
        at = place[first]
        sums_a, sums_b = _a.sums(data), _b.sums(data)
        out.append((rows[row], first - offsets[row] + begins[row], last - offsets[row] + begins[row], _a.spans(sums_a, at, at + params.seed), _b.spans(sums_b, first, last + length), _a.spans(sums_a, first, last + length)))
    empty = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 3
    return Runs(*(np.concatenate(x) for x in zip(*out, strict=True))) if out else Runs(*empty)


def _windows(batch: pa.RecordBatch, column: str, runs: Runs, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Run, start, name and second name of every window of the chosen runs."""
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)
    count = runs.last[which] - runs.first[which] + 1
    run = np.repeat(which, count)
    start = np.repeat(runs.first[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    names, wide = np.empty(len(run), np.uint64), np.empty(len(run), np.uint64)
    ends = np.cumsum(count)
    begin = 0
    while begin < len(which):  # the chosen runs' bytes side by side, a bounded number at a time
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 14))))
        size = count[begin:end] + length - 1
        shift = np.cumsum(size) - size
        near = data[np.repeat(offsets[runs.row[which[begin:end]]] + runs.first[which[begin:end]] - shift, size) + np.arange(size.sum())]
        at = np.repeat(shift - (np.cumsum(count[begin:end]) - count[begin:end]), count[begin:end]) + np.arange(count[begin:end].sum())
        part = slice(ends[begin] - count[begin], ends[end - 1])
        names[part], wide[part] = (h.spans(h.sums(near), at, at + length) for h in (_b, _a))
        begin = end
    return run, start, names, wide


# ---------------------------------------------------------------- blocks and rounds


def _packed(docs: DataFrame, params: SuffixParams) -> tuple[DataFrame, int, str]:
    """A bucketed table of blocks (block, alone, solo, rows: an Arrow stream of whole input rows in order of doc_id), the number
    of shards and the table's name. An id with more text than a block is cut over several, which hold nothing else: ``alone``
    is true there and ``solo`` is the id."""
    spark = docs.sparkSession
    per_id = stored(docs.groupBy(F.col("doc_id").alias("_id")).agg(F.sum(F.octet_length("text")).alias("_size")), "suffix-ids")
    size = per_id.agg(F.sum("_size")).first()[0] or 0
    blocks = max(1, -(-size // params.block))
    limit = params.block
    own = "_" * (1 + max(map(len, docs.columns)))  # begins no column's name
    heavy_, spread_ = own + "heavy", own + "spread"
    heavy = per_id.where((F.col("_size") >= limit) & F.col("_id").isNotNull()).select(F.col("_id").alias(own), F.lit(True).alias(heavy_))
    n_heavy = heavy.count()
    marked = docs.withColumn(heavy_, F.lit(False))
    if n_heavy:
        marked = docs.join(F.broadcast(heavy) if n_heavy <= SMALL_TABLE else heavy, F.col("doc_id") == F.col(own), "left").drop(own).withColumn(heavy_, F.coalesce(heavy_, F.lit(False)))
    columns = docs.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, serial, held, held_bytes = TaskContext.get().partitionId(), 0, [], 0
        last, alone = None, False  # the id of the rows held last, and whether it has blocks of its own

        def packet():
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(held).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + serial], pa.int64()), pa.array([alone]), pa.array([last if alone else 0], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "alone", "solo", "rows"])

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            heavies = batch.column(batch.schema.get_field_index(heavy_)).to_pylist()
            lengths = batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            ends = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
            batch = batch.select(columns)
            begin = 0
            for i in range(len(ids)):
                have = bool(held) or i > begin
                new = ids[i] is None or ids[i] != last
                full = held_bytes + ends[i] - ends[begin] >= limit
                if have and (new and (full or heavies[i] or alone) or heavies[i] and full):
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield packet()
                    serial, held, held_bytes, begin = serial + 1, [], 0, i
                last, alone = ids[i], heavies[i]
            if begin < len(ids):
                held.append(batch.slice(begin))
                held_bytes += int(ends[-1] - ends[begin])
        if held:
            yield packet()

    table = f"waymark_blocks_{uuid.uuid4().hex}"
    spread = F.when(F.col("doc_id").isNull() | F.col(heavy_), F.monotonically_increasing_id())  # these rows may lie in any block
    ordered = marked.withColumn(spread_, spread).repartitionByRange(max(1, min(int(blocks) // 2, RANGES)), "doc_id", spread_).sortWithinPartitions("doc_id").drop(spread_)
    packed = ordered.mapInArrow(pack, "block long, alone boolean, solo long, rows binary")
    packed.write.bucketBy(max(1, min(int(blocks), BUCKETS)), "block").format("parquet").option("path", shared_path(spark, table)).saveAsTable(table)
    return spark.table(table), 1 << max(3, int(size // params.shard).bit_length()), table


#: Most partitions that the rows are sorted in, and most buckets of the table of blocks; each holds several blocks beyond.
RANGES, BUCKETS = 20_000, 50_000


def _unpacked(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_all().combine_chunks().to_batches(max_chunksize=1 << 40)[0]


ASKED = "block long, alone boolean, solo long, kind int, shard int, names binary, more binary"
ANSWERED = "block long, kind int, shard int, flags binary"


def _distinct(shard: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of shard and name, and the place of each in them."""
    order = np.lexsort((names, shard))
    shard, names = shard[order], names[order]
    new = np.ones(len(order), bool)
    new[1:] = (names[1:] != names[:-1]) | (shard[1:] != shard[:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return shard[new], names[new], place


def _answers(key, frame: pd.DataFrame) -> pd.DataFrame:
    """For each name that a block asked about, one bit: kind 1 (seeds): some other block has it; kind 2: its windows are not
    the same everywhere; kinds 3 and 4 (runs, windows): an earlier block has it that is not of the same single id."""
    kind = int(key[0])
    frame = frame.sort_values("block", kind="stable")
    names = [np.frombuffer(x, np.uint64) for x in frame["names"]]
    sizes = np.array([len(x) for x in names])
    all_names = np.concatenate(names)
    order = np.argsort(all_names, kind="stable")  # blocks ascend among equal names
    ordered = all_names[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    if kind == 1:
        again = ~new
        again[:-1] |= ~new[1:]
    elif kind == 2:
        more = np.concatenate([np.frombuffer(x, np.uint64) for x in frame["more"]])[order]
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        differ = (np.minimum.reduceat(more, first) != np.maximum.reduceat(more, first)) | (np.minimum.reduceat(more, first) == 0)
        again = differ[group]
    else:
        again = ~new
        if frame["alone"].any():
            message = np.repeat(np.arange(len(sizes)), sizes)[order]
            first = message[np.flatnonzero(new)[np.cumsum(new) - 1]]
            alone, solo = frame["alone"].to_numpy(bool), frame["solo"].to_numpy(np.int64)
            again &= ~(alone[message] & alone[first] & (solo[message] == solo[first]))
    flags = np.empty(len(order), bool)
    flags[order] = again
    cut = np.concatenate([[0], np.cumsum(sizes)])
    return pd.DataFrame({"block": frame["block"], "kind": frame["kind"], "shard": frame["shard"], "flags": [np.packbits(flags[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})


class _Round:
    """State of one block, rebuilt from its bytes and the answers so far."""

    def __init__(self, raw: bytes, answers: list, params: SuffixParams, shards: int):
        self.params, self.shards = params, shards
        self.batch = _unpacked(raw)
        self.ids = self.batch.column(self.batch.schema.get_field_index("doc_id"))
        self.runs = runs_of(self.batch, "text", params)
        null = np.asarray(self.ids.is_null())
        if null.any():
            self.runs = self.runs.where(~null[self.runs.row])
        self.doc = np.asarray(self.ids.fill_null(0).cast(pa.int64()))
        self.answers = {(a["kind"], a["shard"]): a["flags"] for a in answers or []}

    def shard(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(64 - self.shards.bit_length() + 1)).astype(np.int32)

    def told(self, kind: int, shard: np.ndarray) -> np.ndarray:
        """The shards' answers, in the order of the distinct names."""
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        out = np.zeros(len(shard), bool)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            out[cut[i] : cut[i + 1]] = np.unpackbits(np.frombuffer(self.answers[kind, i], np.uint8), count=cut[i + 1] - cut[i])
        return out

    def sent(self, kind: int, shard: np.ndarray, names: np.ndarray, more: np.ndarray | None = None) -> list[tuple]:
        """A message (kind, shard, names, more) for each shard."""
        cut = np.searchsorted(shard, np.arange(self.shards + 1))
        parts = [(i, slice(cut[i], cut[i + 1])) for i in np.flatnonzero(np.diff(cut)).tolist()]
        return [(kind, i, names[p].tobytes(), more[p].tobytes() if more is not None else b"") for i, p in parts]

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _distinct(self.shard(self.runs.seed), self.runs.seed)

    def shared(self) -> np.ndarray:
        """Runs whose seed stands in another block or in two documents of this one."""
        shard, names, at = self.seeds()
        doc = self.doc[self.runs.row]
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, at, doc)
        np.maximum.at(high, at, doc)
        return np.flatnonzero((self.told(1, shard) | (low < high))[at])

    def second(self, runs: Runs) -> tuple:
        """Distinct seeds and whole runs of those that go on, with their places in them."""
        seeds = _distinct(self.shard(runs.seed), runs.seed)
        around = runs.around | np.uint64(1)
        least, most = np.full(len(seeds[1]), np.uint64(2**64 - 1)), np.zeros(len(seeds[1]), np.uint64)
        np.minimum.at(least, seeds[2], around)
        np.maximum.at(most, seeds[2], around)
        return seeds, np.where(least == most, least, np.uint64(0)), _distinct(self.shard(runs.wide), runs.around)

    def smaller_here(self, at: np.ndarray, n: int, doc: np.ndarray) -> np.ndarray:
        """Whether a smaller document of this block has the same name."""
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, at, doc)
        return low[at] < doc

    def settled(self) -> tuple[np.ndarray, np.ndarray]:
        """Runs that are covered as a whole, and runs whose windows must be named one by one."""
        which = self.shared()
        runs = self.runs.where(which)
        seeds, _, whole_runs = self.second(runs)
        whole = self.told(3, whole_runs[0])[whole_runs[2]] | self.smaller_here(whole_runs[2], len(whole_runs[1]), self.doc[runs.row])
        open_ = ~whole & self.told(2, seeds[0])[seeds[2]]
        return which[whole], which[open_]

    def windows(self, open_: np.ndarray) -> tuple:
        run, start, names, wide = _windows(self.batch, "text", self.runs, open_, self.params.length)
        return run, start, *_distinct(self.shard(wide), names)

    def ask(self, step: int) -> list[tuple]:
        if step == 1:
            return self.sent(1, *self.seeds()[:2])
        if step == 2:
            seeds, only, whole_runs = self.second(self.runs.where(self.shared()))
            return self.sent(2, *seeds[:2], only) + self.sent(3, *whole_runs[:2])
        return self.sent(4, *self.windows(self.settled()[1])[2:4])

    def covered(self) -> list[list[tuple[int, int]]]:
        """Maximal removed spans [from, to) of each row."""
        whole, open_ = self.settled()
        run, start, shard, names, at = self.windows(open_)
        gone = self.told(4, shard)[at] | self.smaller_here(at, len(names), self.doc[self.runs.row[run]])
        row = np.concatenate([self.runs.row[whole], self.runs.row[run[gone]]])
        low = np.concatenate([self.runs.first[whole], start[gone]])
        high = np.concatenate([self.runs.last[whole], start[gone]]) + self.params.length
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(self.ids))]
        order = np.lexsort((low, row))
        for r, a, b in zip(row[order].tolist(), low[order].tolist(), high[order].tolist(), strict=True):
            spans = out[r]
            if spans and a <= spans[-1][1]:
                spans[-1] = spans[-1][0], max(b, spans[-1][1])
            else:
                spans.append((a, b))
        return out


def _cleared(docs: DataFrame, schema: str, result: Callable, params: SuffixParams) -> DataFrame:
    """Run the rounds and apply ``result(batch, spans)`` to each block."""
    spark = docs.sparkSession
    blocks, shards, table = _packed(docs, params)
    answers = None
    try:
        for step in (1, 2, 3, 4):
            if answers is None:
                joined = blocks.withColumn("answers", F.lit(None).cast("array<struct<kind:int,shard:int,flags:binary>>"))
            else:
                listed = answers.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "flags")).alias("answers"))
                joined = blocks.join(listed, "block", "left")

            def asks(batches, step=step):
                for batch in batches:
                    for i in range(batch.num_rows):
                        state = _Round(batch.column(3)[i].as_py(), batch.column(4)[i].as_py(), params, shards)
                        if step < 4:
                            sent = state.ask(step)
                            if sent:
                                here = [pa.array([batch.column(k)[i].as_py()] * len(sent), t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.int64()))]
                                yield pa.RecordBatch.from_arrays([*here, *(pa.array(list(c), t) for c, t in zip(zip(*sent, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True))], names=["block", "alone", "solo", "kind", "shard", "names", "more"])
                        else:
                            yield result(state.batch, state.covered())

            if step < 4:
                asked = joined.select("block", "alone", "solo", "rows", "answers").mapInArrow(asks, ASKED)
                more = stored(asked.groupBy("kind", "shard").applyInPandas(_answers, ANSWERED), f"suffix-{step}")
                answers = more if answers is None else answers.unionByName(more)
            else:
                return stored(joined.select("block", "alone", "solo", "rows", "answers").mapInArrow(asks, schema), "suffix-kept")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def _kept(value: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return value
    out, at = [], 0
    for a, b in spans:
        out.append(value[at:a])
        at = b
    return b"".join([*out, value[at:]])


def repeats(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """What is removed from each row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of [from, to)).

    A byte goes if a string of ``length`` bytes that covers it also starts in a row with a smaller doc_id. A null text is
    empty. Rows with equal ids are one document to each other: neither removes from the other. A null id is neither
    smaller nor larger than any, so such rows stay whole. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def result(batch, spans):
        values = [v or b"" for v in batch.column(1).to_pylist()]
        removed = [sum(b - a for a, b in s) for s in spans]
        sha = [hashlib.sha256(_kept(v, s)).hexdigest() for v, s in zip(values, spans, strict=True)]
        pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
        listed = [[{"begin": a, "end": b} for a, b in s] for s in spans]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), pa.array(sha, pa.string()), pa.array(listed, pa.list_(pair))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return _cleared(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>", result, params)


def without_repeats(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """docs with repeated passages cut from ``text``; all other columns stay. Characters that a cut splits go too."""
    schema = docs.schema
    named = docs.select(*(F.col(f"`{c}`") for c in docs.columns))

    def result(batch, spans):
        at = batch.schema.get_field_index("text")
        values = [v if v is None or not s else _kept(v.encode(), s).decode("utf-8", "ignore") for v, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
        columns = [pa.array(values, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return _cleared(named, schema, result, params)
