"""Fuzzy search for short licence notices.

Each notice is split into one piece more than it may have errors; exact hits of the pieces are the candidates, and the
``regex`` library's bounded-error matching verifies them and gives the edits and the span. Any cut finds the same notices;
each task cuts where the pieces are rarest in the first text that it sees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import text_blocks
from waymark.llm.words import WordBlock, places, rare_pieces

#: Notices and their labels.
NOTICES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


#: Bytes of text that choose the cuts of the notices: they steer work, not results.
SHOWN = 1 << 18


@dataclass(frozen=True)
class LicenseParams:
    """share: errors allowed for each character of a notice, rounded up."""

    notices: tuple[tuple[str, str], ...] = NOTICES
    share: float = 0.1


class Scanner:
    def __init__(self, params: LicenseParams):
        self.notices = []
        for phrase, label in params.notices:
            errors = min(len(phrase) - 1, -int(-len(phrase) * params.share // 1))
            near = rf"(?:{regex.escape(phrase)}){{e<={errors}}}"
            self.notices.append((phrase, label, errors, regex.compile(near), regex.compile(f"(?b){near}")))
        self.seeds: list[list[tuple[int, bytes]]] | None = None

    def exact(self, block: WordBlock) -> list[tuple[int, int, str]]:
        """(row, start word, label) where a notice's words stand consecutively."""
        out, text = [], block.text
        for phrase, label, *_ in self.notices:
            size = len(phrase.encode())
            for p in places(text, phrase.encode()):
                if (p == 0 or text[p - 1] in b" \n") and text[p + size] in b" \n":
                    row = block.row_of(p)
                    out.append((row, block.word_of(p, row), label))
        return out

    def fuzzy(self, block: WordBlock) -> list[tuple[int, int, int, str, int, float]]:
        """(row, start word, end word, label, edits, similarity) of each verified candidate."""
        out, text = {}, block.text
        if self.seeds is None:
            self.seeds = [rare_pieces(phrase, errors, text[:SHOWN]) for phrase, _, errors, *_ in self.notices]
        for (phrase, label, errors, plain, match), seeds in zip(self.notices, self.seeds, strict=True):
            size, reach = len(phrase.encode()), 4 * errors
            begins = sorted({p - at for at, seed in seeds for p in places(text, seed)})
            for row, low, high, near in self._neighbours(block, begins, size, reach):
                a, b = max(low, near[0] - reach - 1), min(high, near[-1] + size + reach + 2)
                while a > low and text[a] & 0xC0 == 0x80:
                    a -= 1
                while b < high and text[b] & 0xC0 == 0x80:
                    b += 1
                if not plain.search(text[a:b].decode()):
                    continue
                for begin in near:
                    found = self._whole_words(block, begin, begin + size, reach, (low, high), len(phrase), errors, match)
                    if found:
                        edits, start, end = found
                        first, last = block.word_of(start, row), block.word_of(end, row)
                        key = row, first, label
                        if key not in out or out[key][4] > edits:
                            out[key] = row, first, last, label, edits, 1 - edits / len(phrase)
        return list(out.values())

    @staticmethod
    def _neighbours(block: WordBlock, begins: list[int], size: int, reach: int) -> Iterator[tuple[int, int, int, list[int]]]:
        """(row, its bounds, candidates) of candidates of one row whose windows meet: what no search finds in the whole, it
        finds in no part."""
        near: list[int] = []
        here = (-1, 0, 0)
        for begin in begins:
            middle = max(0, min(begin + size // 2, len(block.text) - 1))
            if near and middle < here[2] and begin - near[-1] <= size + 2 * reach:
                near.append(begin)
                continue
            if near:
                yield *here, near
            row = block.row_of(middle)
            here, near = (row, int(block.bounds[row]), int(block.bounds[row + 1])), [begin]
        if near:
            yield *here, near

    @staticmethod
    def _whole_words(block: WordBlock, begin: int, end: int, reach: int, row: tuple[int, int], length: int, errors: int, match: regex.Pattern) -> tuple[int, int, int] | None:
        """(edits, start, end) of the run of whole words near a candidate that matches with the fewest edits, if any does."""
        near = lambda at, place: at[slice(*np.searchsorted(at, [max(row[0], place - reach), min(row[1], place + reach) + 1]))].tolist()
        best = None
        for start in near(block.starts, begin):
            for stop in near(block.ends, end):
                run = block.text[start:stop].decode() if start < stop else ""
                if run and abs(len(run) - length) <= errors and (found := match.fullmatch(run)):
                    this = sum(found.fuzzy_counts), start, stop
                    best = this if best is None else min(best, this)
        return best


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, base (array of (word, label)) and spans (array of (first, end, label,
    edits, similarity)), over the whole text. A null text is empty; rows without a notice have empty arrays; repeated rows
    give repeated results."""
    span = "struct<first:long,end:long,label:string,edits:int,similarity:double>"
    schema = f"doc_id long, n_words long, base array<struct<word:long,label:string>>, spans array<{span}>"
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("similarity", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(params)
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch, "text"):
                block = WordBlock(data, offsets)
                base, spans = [[] for _ in range(end - first)], [[] for _ in range(end - first)]
                for row, word, label in sorted(scanner.exact(block)):
                    base[row].append({"word": word, "label": label})
                for row, a, b, label, edits, similarity in sorted(scanner.fuzzy(block)):
                    spans[row].append({"first": a, "end": b, "label": label, "edits": edits, "similarity": similarity})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(block.n_words(), pa.int64()), pa.array(base, base_type), pa.array(spans, span_type)], names=["doc_id", "n_words", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
