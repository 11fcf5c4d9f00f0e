"""Best-fit packing of tokenised texts into sequences of a fixed length.

Texts become ids and pieces where they are read. The pieces that do not fill a sequence by themselves are dealt to groups of
bounded size, and in each a bounded-space online best-fit places one after the other: a fixed number of bins is open, a
bitset has a bit for each free space that some open bin has, and a shift and its lowest bit name the tightest bin that fits.
If none fits and no further bin may open, the fullest closes. A group's stream runs from long to short. Bins still open at
its end are items themselves, placed the same way in groups of groups until one group is left.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stored


@dataclass(frozen=True)
class PackParams:
    """length: tokens of a sequence. end: id after each document. open_bins: bins open at once. group: items of one stream.
    window: characters encoded at once."""

    length: int = 2048
    end: int = 0
    open_bins: int = 4096
    group: int = 8192
    window: int = 1 << 18


#: Before white space that follows anything else the tokenizer never joins, whatever comes after.
BREAK = re.compile(r"(?<=\S)\s")
#: Nor where letters and digits meet, or punctuation follows them: places to cut a very long word at.
INNER = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9一-鿿])(?=[!-&(-/:-@\[-`{-~。，])")
#: Pattern of the byte-level tokenizer's words, as public_tokenizers states it (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if printable, the others from 256 on in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


_loaded: dict[int, Encoder] = {}


class Encoder:
    """Ids of texts as the tokenizers library gives them, taken window by window.

    If the file is a byte-level BPE whose ids follow the order of its merges, tiktoken does the work with the same vocabulary,
    some five times faster; what its pattern engine cannot match (very long runs of white space) goes to tokenizers.
    """

    def __init__(self, file: bytes, params: PackParams):
        import tiktoken

        self.file, self.tokenizer, self.params, self.fast = file, None, params, None
        said = json.loads(file)
        vocabulary, merges, byte = said["model"]["vocab"], said["model"].get("merges", []), _bytes_of()
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        self.special = [t["content"] for t in said["added_tokens"]]
        plain = said["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and said["normalizer"] is None and not said["model"].get("ignore_merges")
        if plain and made == sorted(made) and not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in self.special}
            self.fast = tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in said["added_tokens"]})

    @staticmethod
    def of(file: bytes, params: PackParams) -> Encoder:
        """The worker's encoder for this file."""
        key = hash((file, params))
        if key not in _loaded:
            _loaded[key] = Encoder(file, params)
        return _loaded[key]

    def _windows(self, text: str) -> Iterator[str]:
        at, size = 0, self.params.window
        while at < len(text):
            end = len(text)
            if end - at > size:
                cut = BREAK.search(text, at + size, at + 2 * size) or INNER.search(text, at + size) if not any(s in text for s in self.special) else BREAK.search(text, at + size)
                end = cut.start() if cut else end
            yield text[at:end]
            at = end

    def ids(self, text: str) -> np.ndarray:
        found = []
        for part in self._windows(text):
            try:
                found.append(self.fast.encode_to_numpy(part, allowed_special="all") if self.fast else self._slow(part))
            except ValueError:
                found.append(self._slow(part))
        return np.concatenate(found).astype("<u4") if found else np.zeros(0, "<u4")

    def _slow(self, part: str) -> np.ndarray:
        if self.tokenizer is None:  # seldom needed, and some 50 MB
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_str(self.file.decode())
        return np.array(self.tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u4")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, place long"


def pieces(docs: DataFrame, file: bytes, params: PackParams = PackParams()) -> DataFrame:
    """The pieces of each text's ids and the end: only longer ones are cut, into full pieces after a first that may be
    shorter. ``place`` is different for each row, and stays so only if the result is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, place, size = Encoder.of(file, params), TaskContext.get().partitionId() << 40, params.length
        end = np.array([params.end], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), end])
                n = len(ids)
                cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    rows.append((doc_id.as_py(), k, a, b - a, zlib.crc32(ids[a:b].tobytes()), place))
                    place += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Bin and offset of each item in order, and the fills of the bins that are open at the end. Bins are numbered from 0."""
    spaces = 0  # bit f: some open bin has f free
    by_space: dict[int, list[int]] = {}
    bins, offsets, made, n_open = [], [], 0, 0

    def take(space: int) -> int:
        nonlocal spaces, n_open
        found = by_space[space].pop()
        if not by_space[space]:
            spaces ^= 1 << space
        n_open -= 1
        return found

    for length in lengths:
        fits = spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = take(space)
        else:
            if n_open >= open_bins:
                take((spaces & -spaces).bit_length() - 1)  # the fullest closes
            space, bin_, made = size, made, made + 1
        bins.append(bin_)
        offsets.append(size - space)
        if space > length:
            by_space.setdefault(space - length, []).append(bin_)
            spaces |= 1 << space - length
            n_open += 1
    return bins, offsets, {b: size - space for space, bs in by_space.items() for b in bs}


def _placed(items: DataFrame, params: PackParams) -> DataFrame:
    """Items (name, length) with the sequence they go to, named after its first item, their offset, and for the first item of
    a sequence that is still open its fill."""
    groups = max(1, -(-items.count() // params.group))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "name"], ascending=[False, True])
        bins, offsets, left = best_fit(frame["length"].tolist(), params.length, params.open_bins)
        names = frame["name"].to_numpy()
        bins, offsets = np.array(bins), np.array(offsets)
        lead = np.empty(len(bins), np.int64)
        first = np.flatnonzero(offsets == 0)
        lead[bins[first]] = names[first]
        fill = np.array([left.get(b, 0) if o == 0 else 0 for b, o in zip(bins.tolist(), offsets.tolist(), strict=True)], np.int64)
        return pd.DataFrame({"name": names, "sequence_id": lead[bins], "offset": offsets, "fill": fill})

    dealt = items.withColumn("_group", F.pmod(F.xxhash64("name"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, "name long, sequence_id long, offset long, fill long")


def pack(found: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """Stored pieces with their sequence_id (the place of its first piece) and gapless offset. Full ones stay where they are."""
    moved = None
    items = found.where(F.col("length") < params.length).select(F.col("place").alias("name"), "length")
    while True:
        level = stored(_placed(items, params), "packed")
        if moved is None:
            moved = level.select(F.col("name").alias("place"), "sequence_id", "offset")
        else:
            next_ = level.select(F.col("name").alias("_name"), F.col("sequence_id").alias("_to"), F.col("offset").alias("_by"))
            joined = moved.join(next_, moved["sequence_id"] == next_["_name"], "left")
            moved = joined.select("place", F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_by", F.lit(0))).alias("offset"))
        left = level.where("fill > 0").select(F.col("sequence_id").alias("name"), F.col("fill").alias("length"))
        n, items = items.count(), left
        if n <= params.group or left.count() >= n:  # one group, or bins of which no two fit together
            break
    full = found.where(F.col("length") >= params.length).withColumn("sequence_id", F.col("place")).withColumn("offset", F.lit(0).cast("long"))
    return found.join(moved, "place").unionByName(full).drop("place")


def packed(docs: DataFrame, file: bytes, params: PackParams = PackParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row's text.

    docs needs doc_id and text; other columns are ignored. A null or empty text is the end alone. Repeated rows and rows
    without an id are packed each. ``file``: the tokenizer's file. An empty table gives no rows. Of a very long text only its
    ids are held (4 bytes each) beside one window; a word that has no place to cut at is encoded whole.
    """
    return pack(stored(pieces(docs, file, params), "pieces"), params)
