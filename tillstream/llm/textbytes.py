"""Whole texts of an Arrow batch as one UTF-8 byte array, with vectorised words, hashes and n-grams.

Every operator that runs Python works on these arrays inside Arrow-batched tasks: no Python
object is made for a word or a character. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once: the temporary arrays take about 50 times this.
CHUNK = 1 << 20
U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C13)
_PINV = U64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64, i below n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, CHUNK + (1 << 17))
        out = []
        for p in (_P, _PINV):
            a = np.full(n, p, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads each bit of a 64-bit hash over all others."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


class Texts:
    """Rows [first, first + n) of a batch: bytes `data`; text i is data[offsets[i]:offsets[i+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def lower(self) -> Texts:
        """A-Z lower-cased, other characters kept."""
        return Texts(_LOWER[self.data], self.offsets, self.first)

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The text that each byte position lies in."""
        return np.searchsorted(self.offsets, at, "right") - 1

    def words(self) -> Words:
        """Maximal runs of bytes other than space and 0x09-0x0D."""
        inside = ~_WS[self.data]
        before = np.empty_like(inside)
        before[1:], before[:1] = inside[:-1], False
        cut = self.offsets[:-1][self.offsets[:-1] < len(self.data)]
        before[cut] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1], after[-1:] = inside[1:], False
        cut = self.offsets[1:]
        after[cut[cut > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return Words(self, starts, ends)


class Words:
    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.rows = texts.rows(starts)

    def counts(self) -> np.ndarray:
        return np.bincount(self.rows, minlength=self.texts.n)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes; the same in every batch."""
        t = self.texts
        p, inv = _powers(len(t.data) + 1)
        acc = np.zeros(len(t.data) + 1, np.uint64)
        np.cumsum(_BYTE[t.data] * p[: len(t.data)], out=acc[1:])
        h = (acc[self.ends] - acc[self.starts]) * inv[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * U64(0xD6E8FEB86659FD93))

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of each run of n words that lies in one text."""
        if len(h) < n:
            return self.rows[:0], h[:0]
        m = len(h) - n + 1
        ok = self.rows[:m] == self.rows[n - 1 :]
        g = h[:m].copy()
        for k in range(1, n):
            g = mix(g * U64(0x9FB21C651E98DF25) + h[k : k + m])
        return self.rows[:m][ok], g[ok]


def column(batch: pa.RecordBatch | pa.Array, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; null is empty."""
    a = batch.column(batch.schema.get_field_index(name)) if isinstance(batch, pa.RecordBatch) else batch
    a = pc.fill_null(a.cast(pa.large_string()), "")
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, name: str = "text", size: int = CHUNK) -> Iterator[Texts]:
    """A batch's texts in runs of about `size` bytes; a longer text comes alone, whole."""
    data, offsets = column(batch, name)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def int_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
