"""Texts of an Arrow batch in spans of bounded size: a longer text comes in several, cut between words.

What is worked on at once no longer grows with a text, but for a single word that is longer than a
span. A span after a text's first begins with the last `lap` words of those before it, so that
windows of words that cross the cut are seen once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tillstream.llm.textbytes import _WS, CHUNK, Texts, column

#: Bytes that are no white space.
SPACED = ~_WS


class Span(Texts):
    """Texts [first, first + n) of a batch. With `more` the only text goes on in the next span; `lead` of its first bytes
    repeat the last words of the span before."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, lead: int = 0, more: bool = False):
        super().__init__(data, offsets, first)
        self.lead, self.more = lead, more


def _cut(data: np.ndarray, at: int, inside: np.ndarray) -> int:
    """The first position from `at` that is in no word, or the end."""
    while at < len(data):
        out = np.flatnonzero(~inside[data[at : at + 4096]])
        if len(out):
            return at + int(out[0])
        at += 4096
    return len(data)


def _back(data: np.ndarray, at: int, words: int, inside: np.ndarray) -> int:
    """Where the `words`-th last word before `at` begins; the start if there are fewer."""
    width = 4096
    while words:
        low = max(0, at - width)
        x = inside[data[low:at]]
        starts = np.flatnonzero(x & ~np.concatenate([[low > 0], x[:-1]])) if len(x) else np.zeros(0, np.int64)  # a word cut by the window has no start in it
        if len(starts) >= words:
            return low + int(starts[-words])
        if low == 0:
            return int(starts[0]) if len(starts) else at
        width *= 4
    return at


def spans(batch: pa.RecordBatch, inside: np.ndarray = SPACED, lap: int = 0, size: int | None = None) -> Iterator[Span]:
    """inside: by byte, whether it belongs to a word. ASCII bytes must tell words apart."""
    size = size or CHUNK
    data, offsets = column(batch)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        own = data[offsets[i] : offsets[j]]
        if len(own) <= size:
            yield Span(own, offsets[i : j + 1] - offsets[i], i)
        else:  # one text
            begin = 0
            while True:
                end = _cut(own, min(begin + size, len(own)), inside)
                start = _back(own, begin, lap, inside) if begin else 0
                yield Span(own[start:end], np.array([0, end - start]), i, begin - start, end < len(own))
                if end == len(own):
                    break
                begin = end
        i = j


def words(t: Texts, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each maximal run of bytes that are inside."""
    x = inside[t.data]
    cut = np.zeros(len(x) + 1, bool)
    cut[t.offsets] = True
    before, after = np.zeros(len(x), bool), np.zeros(len(x), bool)
    before[1:], after[:-1] = x[:-1] & ~cut[1:-1], x[1:] & ~cut[1:-1]
    starts, ends = np.flatnonzero(x & ~before), np.flatnonzero(x & ~after) + 1
    return starts, ends, t.rows(starts)


def joined(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one space behind each, and where each begins."""
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    total = int(size.sum()) + len(size)
    out, letters = np.full(total, 32, np.uint8), np.ones(total, bool)
    letters[at + size] = False
    low = np.zeros(len(t.data) + 1, np.int8)
    low[starts] += 1
    low[ends] -= 1
    out[letters] = t.data[np.cumsum(low[:-1], dtype=np.int8) > 0]
    return out, at
