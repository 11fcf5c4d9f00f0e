"""Whole blocks of texts as normalised words, for the scans that look for phrases."""

from __future__ import annotations

import numpy as np

_word = np.zeros(256, bool)
_word[0x30:0x3A] = _word[0x41:0x5B] = _word[0x61:0x7B] = _word[0x80:] = True
_clean = np.full(256, 32, np.uint8)
_clean[_word] = np.flatnonzero(_word)
_clean[65:91] += 32


class WordBlock:
    """Rows of a block as lower-cased words (letters and digits of ASCII, and all other characters) with one space between.

    ``text`` holds the rows one after another, each followed by a line feed, so that nothing found in it crosses rows.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        rows = len(offsets) - 1
        ends = offsets[1:] + np.arange(rows)
        body = np.insert(data, offsets[1:], 10)
        word = _word[body]
        clean = _clean[body]
        clean[ends] = 10
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[ends] = True
        at = np.cumsum(keep)
        self.text = clean[keep].tobytes()
        self.bounds = np.concatenate([[0], at[ends]])
        kept = word[keep]
        first = kept.copy()
        first[1:] &= ~kept[:-1]
        last = kept.copy()
        last[:-1] &= ~kept[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.starts, self.bounds)

    def n_words(self) -> np.ndarray:
        return np.diff(self.first_word)

    def row_of(self, place: int) -> int:
        return int(np.searchsorted(self.bounds, place, side="right")) - 1

    def word_of(self, place: int, row: int) -> int:
        """Index within its row of the word that stands at or after a place."""
        return int(np.searchsorted(self.starts, place)) - int(self.first_word[row])

    def row_text(self, row: int) -> bytes:
        return self.text[self.bounds[row] : self.bounds[row + 1] - 1]


def places(text: bytes, what: bytes) -> list[int]:
    """All places, overlapping ones too."""
    out, at = [], text.find(what)
    while at >= 0:
        out.append(at)
        at = text.find(what, at + 1)
    return out


def pieces(text: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of near equal length with their offsets: with that many errors one piece stays whole."""
    n = errors + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def rare_pieces(text: str, errors: int, shown: bytes) -> list[tuple[int, bytes]]:
    """errors + 1 pieces with their offsets in bytes, cut so that they occur least often in what is shown, all together.

    Pieces are at most two characters shorter than equal ones; of equally rare cuts the one with the longer shortest piece is taken.
    """
    n, size = errors + 1, len(text)
    least = max(1, size // n - 2)
    counts: dict[str, int] = {}

    def hits(piece: str) -> int:
        if piece not in counts:
            counts[piece] = shown.count(piece.encode())
        return counts[piece]

    best = {(0, 0): (0, 0, ())}  # (end, pieces so far): hits, minus the shortest length, cuts
    for k in range(1, n + 1):
        for end in range(k * least, size - (n - k) * least + 1 if k < n else size + 1):
            ways = [(cost + hits(text[at:end]), max(short, at - end) if k > 1 else at - end, (*cuts, at)) for (at, j), (cost, short, cuts) in best.items() if j == k - 1 and end - at >= least]
            if ways:
                best[end, k] = min(ways)
    cuts = [*best[size, n][2], size]
    return [(len(text[:a].encode()), text[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]
