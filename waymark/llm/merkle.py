"""Merkle manifest of a table: one tree a group (source), one tree over the groups' roots, and a proof for every row.

Rows become digests where they are read, and the digests are sorted by range. Counts by partition give each row its place in
its group. A task then builds every complete aligned subtree of what it holds, up to blocks of ``arity ** height`` rows;
blocks that a task's run does not hold whole leave their largest complete subtrees, which are shuffled by block and
finished there. Blocks' roots go on in the same way, block of blocks after block of blocks, until each group has one node;
the groups' roots are the rows of the last tree. Rows then meet the path above their subtree in one join.

A path is a byte for each level (place in the run and four times the run's size) beside the run's other digests in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import stored


@dataclass(frozen=True)
class MerkleParams:
    """arity: nodes of a run. height: levels of a block. part_rows: rows of a sorted partition, about."""

    arity: int = 3
    height: int = 7
    part_rows: int = 100_000


def field(column: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, in 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(c) for c in fields)), 256))


def parent(run: list[bytes]) -> bytes:
    """Digest of a run of nodes, whose digests count as lower-case hex text."""
    return sha256("".join(x.hex() for x in run).encode()).digest()


def folded(digest: bytes, steps: bytes, siblings: bytes) -> bytes:
    """The root that a node and a path lead to."""
    at = 0
    for step in steps:
        place, size = step & 3, step >> 2
        others = [siblings[k : k + 32] for k in range(at, at + 32 * (size - 1), 32)]
        at += 32 * (size - 1)
        digest = parent([*others[:place], digest, *others[place:]])
    return digest


class Subtree:
    """Aligned nodes of one block, level by level: finishes what is complete, and tells each node's path to the top."""

    def __init__(self, arity: int):
        self.arity, self.levels, self.sizes = arity, {}, {}

    def put(self, level: int, at: int, digest: bytes) -> None:
        self.levels.setdefault(level, {})[at] = digest

    def finish(self, base: int, top: int, first: int, count: int, alone: bool) -> int:
        """All levels above ``base`` of ``count`` nodes from ``first`` on (aligned): to level ``top``, or, if the nodes are all
        that the tree has at their level (``alone``), until one is left. Returns the level reached."""
        level = base
        while level < top and not (alone and count <= 1):
            nodes, above = self.levels.setdefault(level, {}), self.levels.setdefault(level + 1, {})
            self.sizes[level] = first, count
            for at in range(first, first + count, self.arity):
                run = [nodes.get(k) for k in range(at, min(at + self.arity, first + count))]
                if at // self.arity not in above and None not in run:
                    above[at // self.arity] = parent(run)
            first, count, level = first // self.arity, -(-count // self.arity), level + 1
        self.sizes[level] = first, count
        return level

    def path(self, level: int, at: int, top: int) -> tuple[bytes, bytes]:
        steps, siblings = bytearray(), []
        while level < top:
            first, count = self.sizes[level]
            start = at - at % self.arity
            size = min(self.arity, first + count - start)
            steps.append(at - start + 4 * size)
            siblings += [self.levels[level][k] for k in range(start, start + size) if k != at]
            level, at = level + 1, at // self.arity
        return bytes(steps), b"".join(siblings)


def covers(first: int, end: int, arity: int, top: int) -> list[tuple[int, int]]:
    """(level, at) of the largest aligned full subtrees of the rows first .. end - 1."""
    out = []
    while first < end:
        level = 0
        while level < top and first % arity ** (level + 1) == 0 and first + arity ** (level + 1) <= end:
            level += 1
        out.append((level, first // arity**level))
        first += arity**level
    return out


SORTED = "part long, k long, j long, tail int, doc_id long, leaf binary, other binary"


def sorted_leaves(leaves: DataFrame, order: list[str], group: str, parts: int) -> DataFrame:
    """Leaves sorted by range, numbered inside their partition and group: ``k`` counts the partition's rows of the group, ``j``
    its groups; ``tail`` marks the group's last row here (1) and the partition's (2). One group's rows may fill many
    partitions. ``group`` comes along."""
    by = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)]
    dealt = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, k, j, named = None, 0, 0, None

        def numbered(batch, next_group, last):
            nonlocal k, j, named
            groups = batch.column("group").to_pylist()
            ks, js, tails = [], [], []
            for g, after in zip(groups, [*groups[1:], next_group], strict=True):
                if named is None:
                    named = (g,)
                elif named[0] != g:
                    named, k, j = (g,), 0, j + 1
                ks.append(k)
                js.append(j)
                tails.append(int(after != g))
                k += 1
            if last:
                tails[-1] = 2
            extra = [pa.array(ks, pa.int64()), pa.array(js, pa.int64()), pa.array(tails, pa.int32())]
            return pa.RecordBatch.from_arrays([batch.column("part"), *extra, *(batch.column(c) for c in ("group", "doc_id", "leaf", "other"))], names=["part", "k", "j", "tail", "group", "doc_id", "leaf", "other"])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield numbered(held, batch.column("group")[0].as_py(), False)
                held = batch
        if held is not None:
            yield numbered(held, None, True)

    kind = dict(leaves.dtypes)[group]
    named = dealt.select("part", F.col(group).alias("group"), "doc_id", "leaf", "other")
    return named.mapInArrow(run, f"part long, k long, j long, tail int, `group` {kind}, doc_id long, leaf binary, other binary")


LOCAL = "leaf_row boolean, g long, level int, at long, digest binary, other binary, doc_id long, steps binary, siblings binary, rows long"


def _local(params: MerkleParams):
    """Rows of one task as runs of places of a group; each run's blocks, whole or as their largest full subtrees."""
    block = params.arity**params.height

    def built(g: int, rows: list[tuple], ended: bool) -> Iterator[tuple]:
        """rows: (place, leaf, other, doc_id) of one block, in order and without a hole."""
        first, end = rows[0][0], rows[-1][0] + 1
        base = first - first % block
        tree = Subtree(params.arity)
        for at, leaf, _, _ in rows:
            tree.put(0, at, leaf)
        if first == base and (ended or end == base + block):
            top = tree.finish(0, params.height, base, end - base, alone=base == 0 and ended)
            at = base // params.arity**top
            yield False, g, params.height, base // block, tree.levels[top][at], None, None, None, None, end - base
            for place, leaf, other, doc_id in rows:
                yield True, g, params.height, base // block, leaf, other, doc_id, *tree.path(0, place, top), None
            return
        for level, at in covers(first, end, params.arity, params.height):
            low, size = at * params.arity**level, params.arity**level
            tree.finish(0, level, low, size, alone=False)
            yield False, g, level, at, tree.levels[level][at], None, None, None, None, size
            for place, leaf, other, doc_id in rows[low - first : low - first + size]:
                yield True, g, level, at, leaf, other, doc_id, *tree.path(0, place, level), None

    kinds = (pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    names = [c.split()[0] for c in LOCAL.split(", ")]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key, out = None, []

        def close(ended):
            if held:
                out.extend(built(key[0], held, ended))
                held.clear()

        for batch in batches:
            for g, place, ended, leaf, other, doc_id in zip(*(batch.column(c).to_pylist() for c in ("g", "place", "ended", "leaf", "other", "doc_id")), strict=True):
                if held and ((g, place // block) != key or place != held[-1][0] + 1):
                    close(False)
                key = g, place // block
                held.append((place, leaf, other, doc_id))
                if ended:
                    close(True)
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        close(False)
        if out:
            yield batch_of(out)

    return run


def _finish_blocks(pieces: DataFrame, params: MerkleParams, base: int) -> DataFrame:
    """Pieces (g, level, at, digest, rows, total) of blocks over nodes of level ``base``, brought together by block. Rows: each
    piece's path to the block's top; the block's own row has no steps but its digest. ``total``: nodes of the group at ``base``;
    ``rows``: those that the piece stands for."""
    arity, top = params.arity, base + params.height
    block = arity**params.height

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        g, count, total = int(frame["g"].iloc[0]), int(frame["rows"].sum()), int(frame["total"].iloc[0])
        number = int(frame["block"].iloc[0])
        tree = Subtree(arity)
        for level, at, digest in zip(frame["level"], frame["at"], frame["digest"], strict=True):
            tree.put(int(level), int(at), bytes(digest))
        reached = tree.finish(base, top, number * block, count, alone=total <= block)
        root = tree.levels[reached][number * block // arity ** (reached - base)]
        out = [(g, int(level), int(at), number, *tree.path(int(level), int(at), reached), None) for level, at in zip(frame["level"], frame["at"], strict=True)]
        return pd.DataFrame([*out, (g, top, number, number, None, None, root)], columns=["g", "level", "at", "block", "steps", "siblings", "digest"])

    keyed = pieces.withColumn("block", F.expr(f"at DIV CAST(power({arity}, {top} - level) AS LONG)"))
    return keyed.groupBy("g", "block").applyInPandas(run, "g long, level int, at long, block long, steps binary, siblings binary, digest binary")


def _upper(nodes: DataFrame, totals: DataFrame, params: MerkleParams, base: int) -> tuple[DataFrame, DataFrame]:
    """From each node (g, at, digest; level ``base``) to its group's root: (g, at, steps, siblings) and (g, root).
    totals: g and its nodes at this level. Each round makes blocks of blocks until no group has more than one node."""
    block = params.arity**params.height
    path = nodes.select("g", "at", F.lit(b"").alias("steps"), F.lit(b"").alias("siblings"), F.col("at").alias("top"))
    while (totals.agg(F.max("total")).first()[0] or 0) > 1:
        pieces = nodes.join(totals, "g").select("g", F.lit(base).alias("level"), "at", "digest", F.lit(1).cast("long").alias("rows"), "total")
        done = stored(_finish_blocks(pieces, params, base), "merkle-upper")
        rise = done.where("digest is null").select("g", F.col("at").alias("top"), "block", F.col("steps").alias("_s"), F.col("siblings").alias("_b"))
        path = path.join(rise, ["g", "top"]).select("g", "at", F.concat("steps", "_s").alias("steps"), F.concat("siblings", "_b").alias("siblings"), F.col("block").alias("top"))
        nodes = done.where("digest is not null").select("g", "at", "digest")
        totals = totals.select("g", F.expr(f"(total + {block - 1}) DIV {block}").alias("total"))
        base += params.height
    return path.drop("top"), nodes.select("g", F.col("digest").alias("root"))


def manifest(leaves: DataFrame, group: str, params: MerkleParams = MerkleParams()) -> DataFrame:
    """doc_id, leaf, subroot, root, steps, siblings, other of every leaf (doc_id long, leaf, other, ``group``): its group's
    root, the root over the groups, and the path from leaf to root. ``other`` comes along.

    Groups come in order of their key, null first, strings by their bytes; leaves by doc_id, null first, then by digest. Equal
    rows are leaves of their own, and may share a key or even a row with a third of all others: they are sorted by where they
    stood too. A group's lone leaf is its root. No rows give no rows.
    """
    leaves = stored(leaves.select("doc_id", "leaf", "other", F.col(group).alias("group"), F.monotonically_increasing_id().alias("_place")), "merkle-leaves")
    parts = max(1, -(-leaves.count() // params.part_rows), int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(sorted_leaves(leaves, ["doc_id", "leaf", "_place"], "group", parts), "merkle-sorted")
    # one row for each partition and group: its rows; before it the group's rows in earlier partitions
    w, whole = Window.partitionBy("group").orderBy("part"), Window.partitionBy("group")
    counts = rows.where("tail > 0").select("part", "j", "group", (F.col("k") + 1).alias("n"), "tail")
    counts = counts.withColumn("base", F.sum("n").over(w) - F.col("n")).withColumn("total", F.sum("n").over(whole)).withColumn("more", F.lead("n").over(w).isNotNull())
    counts = stored(counts, "merkle-counts")
    # partitions, as many as the sort was given: groups that begin in earlier ones, where the first group goes on, whether the last one does
    begin = F.sum((F.col("base") == 0).cast("long"))
    by_part = counts.groupBy("part").agg(begin.alias("begun"), F.max(F.when(F.col("j") == 0, F.col("base"))).alias("base"), F.max(F.when(F.col("j") == 0, (F.col("base") > 0).cast("long"))).alias("goes_on"), F.bool_or(F.col("more")).alias("more"))
    numbered = by_part.withColumn("g0", F.sum("begun").over(Window.orderBy("part")) - F.col("begun") - F.col("goes_on")).select("part", "g0", "base", "more")
    numbered = stored(numbered, "merkle-parts")
    totals = counts.where("base = 0").join(F.broadcast(numbered.select("part", "g0")), "part").select((F.col("g0") + F.col("j")).alias("g"), "total")
    totals = stored(totals, "merkle-totals")

    placed = rows.join(F.broadcast(numbered), "part").select(
        (F.col("g0") + F.col("j")).alias("g"), (F.col("k") + F.when(F.col("j") == 0, F.col("base")).otherwise(0)).alias("place"),
        ((F.col("tail") == 1) | ((F.col("tail") == 2) & ~F.col("more"))).alias("ended"), "leaf", "other", "doc_id",
    )
    local = stored(placed.mapInArrow(_local(params), LOCAL), "merkle-local")
    top, block = params.height, params.arity**params.height
    nodes = local.where("not leaf_row").select("g", "level", "at", "digest", "rows")
    ragged = nodes.where(F.col("level") < top).join(totals, "g")
    mended = stored(_finish_blocks(ragged, params, 0), "merkle-ragged")
    roots = nodes.where(F.col("level") == top).select("g", "at", "digest").unionByName(mended.where("digest is not null").select("g", "at", "digest"))
    roots = stored(roots, "merkle-blocks")
    above, subroots = _upper(roots, totals.select("g", F.expr(f"(total + {block - 1}) DIV {block}").alias("total")), params, top)
    subroots = stored(subroots, "merkle-subroots")
    # the tree over the groups' roots, whose rows are the groups in order
    tops = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.col("root").alias("digest"))
    n = tops.count()
    one = tops.sparkSession.createDataFrame([(0, n)], "g long, total long")
    crown, root = _upper(tops, one, params, 0)
    crown = crown.select(F.col("at").alias("g"), F.col("steps").alias("_cs"), F.col("siblings").alias("_cb"))
    last = root.first()
    last = F.lit(bytes(last["root"])) if last else F.lit(None).cast("binary")
    above = above.join(crown, "g").join(subroots.withColumnRenamed("root", "subroot"), "g")
    above = above.select("g", F.col("at").alias("block"), F.concat("steps", "_cs").alias("up_steps"), F.concat("siblings", "_cb").alias("up_siblings"), "subroot", last.alias("root"))
    # what a row's subtree has above it: blocks that were whole from the block on, others from their piece on
    pieces = mended.where("digest is null").join(above, ["g", "block"]).select("g", "level", "at", F.concat("steps", "up_steps").alias("up_steps"), F.concat("siblings", "up_siblings").alias("up_siblings"), "subroot", "root")
    whole_ = nodes.where(F.col("level") == top).select("g", F.col("at").alias("block")).join(above, ["g", "block"]).select("g", F.lit(top).alias("level"), F.col("block").alias("at"), "up_steps", "up_siblings", "subroot", "root")
    tails = stored(pieces.unionByName(whole_), "merkle-tails")
    found = local.where("leaf_row").select("g", "level", "at", F.col("digest").alias("leaf"), "other", "doc_id", "steps", "siblings").join(tails, ["g", "level", "at"])
    return found.select("doc_id", "leaf", "subroot", "root", F.concat("steps", "up_steps").alias("steps"), F.concat("siblings", "up_siblings").alias("siblings"), "other")


def proof_digest(siblings: Column) -> Column:
    """SHA-256, in hex, of a path's digests as hex text."""
    return F.sha2(F.lower(F.hex(siblings)).cast("binary"), 256)


def refolded(proofs: DataFrame, digest: str, name: str) -> DataFrame:
    """Adds ``name``: the root that ``digest`` and the row's path lead to."""
    from pyspark.sql.types import BinaryType, StructField, StructType

    schema = StructType([*proofs.schema.fields, StructField(name, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [folded(*row) for row in zip(*(batch.column(c).to_pylist() for c in (digest, "steps", "siblings")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=[*batch.schema.names, name])

    return proofs.mapInArrow(run, schema)


def audited(docs: DataFrame, params: MerkleParams = MerkleParams()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row (doc_id, source, lang, n_chars, text).

    Leaves are made of these five columns, null or not; further columns are ignored. Rows whose id's crc32 is even are
    tampered with after the manifest is made: their text loses its line feeds. ``folded_root`` is what their new leaf, else
    the old one, leads to by the untampered path; ``verified`` whether that is the root. A null id is never tampered with.
    """
    kept = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    leaf = digest_of([*kept, F.col("text")])
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    other = F.when(tampered & F.contains("text", F.lit("\n")), digest_of([*kept, F.translate("text", "\n", "")]))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf.alias("leaf"), other.alias("other"))
    proofs = manifest(leaves, "source", params).withColumn("digest", F.coalesce("other", "leaf"))
    found = refolded(proofs, "digest", "found")
    text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof_digest(F.col("siblings")).alias("proof_sha256"), text("found").alias("folded_root"), (F.col("found") == F.col("root")).alias("verified"))
