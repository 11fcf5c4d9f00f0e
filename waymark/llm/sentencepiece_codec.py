"""Exact encoding and decoding of merge-type SentencePiece models by a prefix table.

The text is cut where no piece can reach across: before each run of word separators and, inside long units, nowhere
else. For every prefix of a unit the table stores the one token that the prefix's encoding ends with: of the pieces that an
automaton finds to end there, the one that is compatible with the last token of what stands before it. Two tokens are
compatible if the merge rules, applied to the two alone, leave them apart; a sequence whose neighbours are all compatible
is the encoding. The ids are then read from the table backwards. Units are memoised in a table of bounded size per worker,
which keeps it for later tasks; once it is full it stays as it is, since frequent units come early.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class MergeCodec:
    """Encoder and decoder of one model; needs no SentencePiece code at run time beyond reading the model's pieces."""

    def __init__(self, model: bytes, memo: int = 150_000):
        from sentencepiece import sentencepiece_model_pb2 as spec

        proto = spec.ModelProto()
        proto.ParseFromString(model)
        kinds = {p.type for p in proto.pieces}
        normal = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces or 4 in kinds:
            raise ValueError("only merge models that keep the text as it is and have no user-defined pieces are supported")
        self.dummy = normal.add_dummy_prefix
        self.unknown = proto.trainer_spec.unk_id
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.surface = {i: p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces) if p.type == 1}
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.surface |= dict.fromkeys(self.control, b"")
        self.byte_of = {i: b for b, i in self.bytes.items()}
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.units = re.compile(".+" if crossing else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL)
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            if len(piece) == 1 or self._merge(piece) == [piece]:
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.apart: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, tuple[str, bytes]] = {}
        self.memo_size = memo

    def _merge(self, text: str) -> list[str]:
        """The merge rules themselves, best score first and leftmost among equals; for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.pieces.get(parts[i] + parts[i + 1])
                if found and (best is None or found[1] > best):
                    best, at = found[1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = left, right
        found = self.apart.get(key)
        if found is None:
            found = self._merge(left + right) == [left, right]
            if len(self.apart) < 1_000_000:
                self.apart[key] = found
        return found

    def _tokens(self, unit: str) -> list[str]:
        last = ["", *unit]  # a character that no piece ends with stands alone
        settled, apart = -1, self.apart.get
        for end, (name, length) in self.automaton.iter(unit):
            if end == settled:
                continue
            begin = end + 1 - length
            if begin:
                pair = last[begin], name
                free = apart(pair)
                if not (self.compatible(*pair) if free is None else free):
                    continue
            last[end + 1], settled = name, end
        out, at = [], len(unit)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for token in self._tokens(unit):
            found = self.pieces.get(token)
            if found:
                out.append(found[0])
            elif self.bytes:
                out.extend(self.bytes[b] for b in token.encode())
            else:
                out.append(self.unknown)
        return out

    def raw(self, ids: list[int]) -> bytes:
        return b"".join(self.surface[i] if i in self.surface else bytes([self.byte_of[i]]) if i in self.byte_of else self.unknown_surface.encode() for i in ids)

    def prepare(self, text: str) -> str:
        return (SPACE if self.dummy and text else "") + text.replace(" ", SPACE)

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units.findall(self.prepare(text)) for i in self.ids(unit)]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: surfaces and bytes in order, the added first separator removed, each stray byte replaced."""
        first = next((i for i in ids if i not in self.control), -1)
        parts = [_byte_by_byte(self.raw(list(run))) if single else self.raw(list(run)) for single, run in groupby(ids, self.byte_of.__contains__)]
        return self.decoded(b"".join(parts), self.surface.get(first, b"")[:1] == b" ").decode()

    def decoded(self, raw: bytes, separated: bool) -> bytes:
        """separated: the first token that is written begins with a separator."""
        raw = raw[1:] if self.dummy and separated else raw
        try:
            raw.decode()
        except UnicodeDecodeError:
            return _byte_by_byte(raw)
        return raw

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals joined by commas, SHA-256 of the decoded text."""
        memo, units = self.memo, self.units.findall(self.prepare(text))
        found = list(map(memo.get, units))
        if None in found:
            for at, unit in enumerate(units):
                if found[at] is None:
                    found[at] = memo.get(unit) or self._remember(unit)
        listed = ",".join(map(itemgetter(0), found)).encode()
        raw = b"".join(map(itemgetter(1), found))
        n = listed.count(b",") + 1 if listed else 0
        return n, hashlib.sha256(listed).hexdigest(), hashlib.sha256(self.decoded(raw, bool(units) and units[0][0] == SPACE)).hexdigest()

    def _remember(self, unit: str) -> tuple[str, bytes]:
        ids = self.ids(unit)
        found = ",".join(map(str, ids)), self.raw(ids)
        if len(unit) < 64 and len(self.memo) < self.memo_size:
            self.memo[unit] = found
        return found


def _byte_by_byte(raw: bytes) -> bytes:
    """Valid characters kept, every other byte one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                raw[at : at + size].decode()
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + size])
            break
        else:
            size = 1
            out.append("�".encode())
        at += size
    return b"".join(out)


@lru_cache(maxsize=2)
def _codec(model: bytes) -> MergeCodec:
    return MergeCodec(model)


def digests(docs: DataFrame, model: bytes, carry: list[str] | None = None) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_tokens, ids_sha256, decoded_sha256, then the ``carry`` columns.

    model: the model file's bytes, a few MB at most, sent with the function. A null text is empty (no ids). Repeated rows
    give repeated results; other columns are ignored unless carried.
    """
    if len(model) > 64 << 20:
        raise ValueError("the model file is larger than 64 MB")
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            found = [codec.digest(t or "") for t in batch.column(1).to_pylist()]
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string()), *batch.columns[2:]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *carry])

    schema = ", ".join(["doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", *(f"`{c}` {types[c]}" for c in carry)])
    return docs.select(F.col("doc_id").cast("long"), "text", *carry).mapInArrow(run, schema)


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text) of every whole text; a null text gives no ids and an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
