"""Benchmark decontamination by pigeonhole edit matching.

Items and texts are compared as lower-cased words with single spaces. An item of L characters may have floor(share * L)
errors; it is split into one piece more than that, so an occurrence with no more errors holds some piece unchanged. An
automaton finds all pieces in a text; around each hit a q-gram count rules out most places, and Myers' bit-parallel
algorithm gives the edit distance of the item to the best substring there.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import text_blocks
from waymark.llm.words import WordBlock, pieces


@dataclass(frozen=True)
class LeakParams:
    """share: errors for each character of an item. shortest: items of fewer characters are looked for without an error, as
    whole words. part: bytes of benchmark text that one automaton holds; larger benchmarks are scanned in parts."""

    share: float = 0.1
    shortest: int = 24
    part: int = 8 << 20


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of text and the end of the first such; (limit + 1, -1) if none is
    within the limit."""
    full, high = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = (m, 0) if m <= limit else (limit + 1, -1)
    for i, c in enumerate(text):
        e = eq.get(c, 0)
        vertical = e | minus
        horizontal = (((e & plus) + plus) ^ plus) | e
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, i + 1
            if not best:
                break
    return best, end


def distance(pattern: str, text: str, limit: int) -> tuple[int, int, int]:
    """(edits, start, end) of the best substring; edits is limit + 1 if there is none."""
    edits, end = myers(masks(pattern), len(pattern), text, limit)
    if end < 0:
        return edits, -1, -1
    _, back = myers(masks(pattern[::-1]), len(pattern), text[:end][::-1], edits)
    return edits, end - back, end


#: Length of the grams that a window must share with an item before the distance is computed.
Q = 5


def _grams(text: str) -> set[str]:
    return {text[i : i + Q] for i in range(len(text) - Q + 1)}


def _words(text: str) -> str:
    data = text.encode()
    return WordBlock(np.frombuffer(data, np.uint8), np.array([0, len(data)])).row_text(0).decode().strip()


#: Scripts written without spaces (Thai to Burmese, Khmer, East Asian): their characters are no part of a longer word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uac00-\ud7af\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef\U00020000-\U0003ffff]")


def _one_word(text: str, at: int) -> bool:
    """Whether the characters before and at a place belong to one word."""
    return 0 < at < len(text) and all(c.isalnum() and not _UNSPACED.match(c) for c in text[at - 1 : at + 1])


class Exact:
    """Items below ``shortest``, as whole words without an error."""

    def __init__(self, items: list[tuple[int, str]], params: LeakParams):
        found: dict[str, list[int]] = {}
        for item_id, text in items:
            if 0 < len(words := _words(text)) < params.shortest:
                found.setdefault(words, []).append(item_id)
        self.automaton = ahocorasick.Automaton()
        for words, ids in found.items():
            self.automaton.add_word(words, (words, ids))
        self.any = bool(found)
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, 0, start, end) of each item found in a normalised text, at its first place."""
        first: dict[str, tuple[list[int], int, int]] = {}
        for last, (words, ids) in self.automaton.iter(text) if self.any else ():
            begin, end = last + 1 - len(words), last + 1
            if words not in first and not _one_word(text, begin) and not _one_word(text, end):
                first[words] = ids, begin, end
        return [(i, 0, begin, end) for ids, begin, end in first.values() for i in ids]


class Matcher:
    def __init__(self, items: list[tuple[int, str]], params: LeakParams):
        self.items, found = [], {}
        for item_id, text in items:
            words = _words(text)
            if len(words) < params.shortest:
                continue
            errors = int(len(words) * params.share)
            self.items.append((item_id, words, errors, _grams(words)))
            for at, piece in pieces(words, errors):
                found.setdefault(piece, []).append((len(self.items) - 1, at))
        held = Counter(g for *_, grams in self.items for g in grams)
        self.items = [(*item, sorted(grams, key=lambda g: (held[g], g))) for *item, grams in self.items]  # rare ones first
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of each item found in a normalised text, at its best place."""
        if not self.items:
            return []
        begins: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for k, at in where:
                begins.setdefault(k, []).append(end + 1 - size - at)
        out = []
        for k, starts in begins.items():
            item_id, words, errors, grams = self.items[k]
            best = errors + 1, -1, -1
            for a, b in _merged(sorted(set(starts)), errors):
                low, high = max(0, a - errors), min(len(text), b + len(words) + errors)
                window = text[low:high]
                if high - low < len(words) - errors or _lacks(grams, window, Q * errors):
                    continue
                edits, begin, end = distance(words, window, best[0] - 1)
                if edits < best[0]:
                    best = edits, low + begin, low + end
                    if not edits:
                        break
            if best[1] >= 0:
                out.append((item_id, *best))
        return out


def _merged(starts: list[int], errors: int) -> list[tuple[int, int]]:
    """Starts no farther apart than the errors allowed, as ranges of bounded length."""
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s - out[-1][0] <= errors:
            out[-1] = out[-1][0], s
        else:
            out.append((s, s))
    return out


def _lacks(grams: list[str], window: str, most: int) -> bool:
    """Whether more than ``most`` of the item's distinct grams are not in the window; an edit takes away Q at most."""
    missing = 0
    for g in grams:
        if g not in window:
            missing += 1
            if missing > most:
                return True
    return False


def leaks(docs: DataFrame, benchmark: DataFrame, params: LeakParams = LeakParams(), carry: list[str] | None = None, short: bool | None = None) -> DataFrame:
    """One row for each row of docs and benchmark item found in its whole text: doc_id, item_id, edits, similarity, start,
    end (in characters of the normalised text), then the ``carry`` columns.

    Items shorter than ``shortest`` are found as whole words without an error; ``short`` looks for them alone (True) or for
    the others alone (False). Null texts and items, and items without a word, match nothing. Repeated items are each reported, repeated
    rows of docs too. Ids pass through, null ones included; extra columns are ignored.
    """
    spark, carry = docs.sparkSession, carry or []
    kinds = dict(docs.dtypes)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // params.part))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *carry)
    schema = ", ".join(["doc_id long, item_id long, edits int, similarity double, start long, end long", *(f"`{c}` {kinds[c]}" for c in carry)])
    out = None
    for part in range(parts):
        share = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(sorted(((r[0], r[1]) for r in share.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matchers = [kind(shared.value, params) for kind, wanted in ((Matcher, short is not True), (Exact, short is not False)) if wanted]
            for batch in batches:
                rows, at = [], []
                for first, end, data, offsets in text_blocks(batch, "text"):
                    block = WordBlock(data, offsets)
                    for i in range(end - first):
                        text = block.row_text(i).decode()
                        found = [hit for m in matchers for hit in m.hits(text)]
                        rows += found
                        at += [first + i] * len(found)
                item, edits, begin, end_ = zip(*rows, strict=True) if rows else [()] * 4
                similar = [max(0.0, 1 - e / max(1, b - a)) for e, a, b in zip(edits, begin, end_, strict=True)]
                there = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(there), pa.array(item, pa.int64()), pa.array(edits, pa.int32()), pa.array(similar, pa.float64()), pa.array(begin, pa.int64()), pa.array(end_, pa.int64()), *(c.take(there) for c in batch.columns[2:])], names=["doc_id", "item_id", "edits", "similarity", "start", "end", *carry])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out
