"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints are compared only where they agree in some part. Correlated bits are grouped into parts; thresholds
t_i with sum(t_i + 1) = limit + 1 guarantee that two fingerprints within the limit differ by at most t_i in some part i.
Dynamic programming picks the unequal thresholds with the least estimated probes and candidates. Each fingerprint stands in
the cell of its own value of each part and probes the cells of all values within t_i; candidates are verified in full and
each block of a cell sends a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.cells import each_block
from waymark.llm.common import components, join_hot, stored, union_find


@dataclass(frozen=True)
class SimHashParams:
    """words: of a shingle. limit: differing bits of a link. seed: of the hash. sample: fingerprints that the costs of the
    plan are estimated on (they steer the work, not the result). block: rows of a side of a block."""

    words: int = 4
    limit: int = 4
    seed: int = 42
    sample: int = 1500
    block: int = 2000
    probe_cost: float = 300.0


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, about ``size`` bytes of it at a time, so that a very long one is no list of all its words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().split()
        at = end


def fingerprint(text: bytes, words: int, seed: int, size: int = 1 << 20) -> int:
    """A bit is set if it is set in over half the hashes of the shingles, repeats included; without a word, zero."""
    digest, counts, n, held = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for more in _words(text, size):
        held += more
        if len(held) < words:
            continue
        joined = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(held) - words + 1]
        ends = ends[words - 1 :]
        for at in range(0, len(starts), 1 << 14):
            part = slice(at, at + (1 << 14))
            h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], np.uint64)
            counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(starts)
        held = held[len(held) - words + 1 :]
    if not n:
        return digest(b" ".join(held), seed) if held else 0
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > n).tolist()))


def fingerprints(docs: DataFrame, params: SimHashParams = SimHashParams(), carry: list[str] | None = None) -> DataFrame:
    """(doc_id, fp, carried columns) of every row's whole text; fp holds the 64 bits as a signed long. A null text has no
    words."""
    carry = carry or []
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t or b"", params.words, params.seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *carry])

    schema = ", ".join(["doc_id long, fp long", *(f"`{c}` {types[c]}" for c in carry)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *carry).mapInArrow(run, schema)


@dataclass
class Plan:
    parts: list[np.ndarray]
    thresholds: list[int]
    cost: float


def grouped_bits(bits: np.ndarray, parts: int) -> list[np.ndarray]:
    """Bits (columns) in parts of near equal size, correlated ones together: each part grows from the bit that is left with
    the most ties, by the bit most correlated with the part."""
    with np.errstate(invalid="ignore", divide="ignore"):
        tie = np.nan_to_num(np.abs(np.corrcoef(bits.T))) if len(bits) > 1 else np.eye(bits.shape[1])
    left, out = set(range(bits.shape[1])), []
    for i in range(parts):
        size = -(-len(left) // (parts - i))
        rest = sorted(left)
        part = [max(rest, key=lambda b: (tie[b, rest].sum(), -b))]
        left.remove(part[0])
        while len(part) < size:
            best = max(sorted(left), key=lambda b: (tie[b, part].mean(), -b))
            part.append(best)
            left.remove(best)
        out.append(np.array(sorted(part)))
    return out


def plan(sample: np.ndarray, n: int, params: SimHashParams) -> Plan:
    """Parts and thresholds of least estimated cost for n distinct fingerprints, from a sample of them."""
    bits = np.unpackbits(sample.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
    best = None
    for parts in range(1, params.limit + 2):
        groups = grouped_bits(bits, parts)
        costs = []
        for group in groups:
            b = bits[:, group]
            apart = np.rint(b.sum(1)[:, None] + b.sum(1)[None] - 2 * b @ b.T)
            np.fill_diagonal(apart, 99)
            near = [(apart <= t).mean() for t in range(params.limit + 1)]
            costs.append([0.0] + [n * (n * near[t] + params.probe_cost * sum(comb(len(group), d) for d in range(t + 1))) for t in range(params.limit + 1)])
        table = {0: (0.0, [])}  # budget spent so far: cost and thresholds; a part spends t + 1, with t = -1 for none
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for spent, (sofar, ts) in table.items():
                for use in range(params.limit + 2 - spent):
                    offer = sofar + cost[use], [*ts, use - 1]
                    if spent + use not in new or offer < new[spent + use]:
                        new[spent + use] = offer
            table = new
        found = table[params.limit + 1]
        if best is None or found[0] < best.cost:
            best = Plan(groups, found[1], found[0])
    return best


def links(fps: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """Spanning links (a, b) among distinct fingerprints (column fp) within ``limit`` differing bits."""
    distinct = stored(fps.select("fp").distinct(), "fps")
    n = distinct.count()
    spark = distinct.sparkSession
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    sample = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(params.sample).collect()], np.int64).view(np.uint64)
    made = plan(sample, n, params)
    limit = params.limit

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for part, (group, t) in enumerate(zip(made.parts, made.thresholds, strict=True)):
                if t < 0:
                    continue
                value = np.zeros(len(fp), np.uint64)
                for i, b in enumerate(group.tolist()):
                    value |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
                for d in range(t + 1):
                    for flip in combinations(range(len(group)), d):
                        at = (value ^ np.uint64(sum(1 << i for i in flip))) * np.uint64(8) + np.uint64(part)
                        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), d == 0))], names=["cell", "fp", "home"])

    def compare(home: pd.DataFrame, member: pd.DataFrame) -> pd.DataFrame:
        a, b = home["fp"].to_numpy().view(np.uint64), member["fp"].to_numpy().view(np.uint64)
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        near = np.bitwise_count(a[:, None] ^ b[None]) <= limit
        x, y = np.nonzero(near)
        root = union_find(len(names), at[: len(a)][x], at[len(a) :][y])
        apart = root != np.arange(len(names))
        return pd.DataFrame({"a": names[apart].view(np.int64), "b": names[root[apart]].view(np.int64)})

    wide = len(made.parts) == 1 and len(made.parts[0]) > 60
    if wide:  # one part of all bits would not fit the cell key
        raise ValueError("a single part needs more key bits than there are")
    members = distinct.mapInArrow(dealt, "cell long, fp long, home boolean")
    return each_block(members, "cell", "home", params.block, compare, "a long, b long", "fp").distinct()


def components_of(docs: DataFrame, params: SimHashParams = SimHashParams(), carry: list[str] | None = None) -> DataFrame:
    """(doc_id, fp, component_id, component, carried columns) of every row: component_id is the smallest doc_id reachable by
    links, itself included; component the smallest fingerprint there.

    Equal fingerprints are linked, whatever the texts; texts without words share fingerprint zero. Repeated rows get equal
    results. A null id belongs to its component but names none: where only null ids are, component_id is null. Columns
    other than doc_id, text and the carried ones are ignored.
    """
    fps = stored(fingerprints(docs, params, carry), "fingerprints")
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n"))
    found = components(links(fps, params))
    named = least.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = stored(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = stored(named.join(smallest, "component").select("fp", "component_id", "component", "_n"), "by-fp")
    return join_hot(fps, by_fp, ["fp"], "_n").select("doc_id", "fp", "component_id", "component", *(carry or []))
