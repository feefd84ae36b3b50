"""CRC-32 of concatenations from the sums of their parts, for whole arrays.

The sum of A followed by B is that of A carried over len(B) zero bytes, xor that of B. Carrying is
linear, so it is four table lookups for each length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

#: Lengths with tables of their own; longer ones go by powers of two.
SHORT = 64
_BYTE = np.array([(zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0")) for b in range(256)], np.uint32)
_TABLES: list[np.ndarray] = []


def _apply(t: np.ndarray, c: np.ndarray) -> np.ndarray:
    return t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]


def _tables() -> list[np.ndarray]:
    """Of 0 to SHORT - 1 bytes in one array, then of 2, 4, 8, ... times as many as SHORT / 2."""
    if not _TABLES:
        one = np.arange(256, dtype=np.uint32)
        rows = [np.stack([one << np.uint32(8 * k) for k in range(4)])]
        for _ in range(SHORT):
            rows.append(_BYTE[rows[-1] & 255] ^ (rows[-1] >> 8))
        _TABLES.append(np.stack(rows[:SHORT]).reshape(-1))
        power = rows[SHORT]
        for _ in range(40):
            _TABLES.append(power)
            power = _apply(power, power)
    return _TABLES


def carried(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each sum carried over n zero bytes."""
    t = _tables()
    base = (n & (SHORT - 1)) * 1024
    out = t[0][base + (c & 255)] ^ t[0][base + 256 + (c >> 8 & 255)] ^ t[0][base + 512 + (c >> 16 & 255)] ^ t[0][base + 768 + (c >> 24)]
    rest, j = n // SHORT, 1
    while (rest > 0).any():
        at = np.flatnonzero(rest & 1)
        out[at] = _apply(t[j], out[at])
        rest, j = rest >> 1, j + 1
    return out


def distinct(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of joined words (see `spans.joined`), and which of them each is."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    spaced = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])  # each with its space
    d = spaced.dictionary_encode()
    return d.dictionary, d.indices.to_numpy()
