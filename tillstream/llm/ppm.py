"""Prediction by partial matching: the keys of byte contexts that `lm_score` counts, and a table that finds them.

A text is scored as its tokens: lower-cased words, a space between two, one end mark. Each byte is predicted
from up to ORDER bytes before it; a key holds both, the byte lowest. A context that saw n bytes, t of them only
once, escapes with probability (t + 1/2) / (n + t + 1/2); the rest is shared as it was seen. The escape mass
goes to the context without its first byte, whose prediction excludes the bytes already seen (it is renormalised over
the rest), down to the uniform one. As the trie is trained beforehand, `lm_score` resolves escapes and exclusions once.
"""

from __future__ import annotations

import numpy as np

from tillstream.llm.textbytes import Texts

ORDER = 6
END = 10
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def normalised(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of each text with one space between two and an end mark behind; n + 1 offsets."""
    w = t.words()
    d = t.lower().data
    inside = ~_SPACE[d]
    last = np.zeros(len(w.rows), bool)
    if len(w.rows):
        last[:-1] = w.rows[1:] != w.rows[:-1]
        last[-1] = True
    # each word's bytes and one more: a space, or the end mark after a text's last word
    size = w.ends - w.starts + 1
    none = np.flatnonzero(w.counts() == 0)
    total = np.bincount(w.rows, weights=size, minlength=t.n).astype(np.int64)
    total[none] = 1
    offsets = np.concatenate([[0], np.cumsum(total)])
    out = np.full(offsets[-1], END, np.uint8)
    if len(size):
        begin = np.cumsum(size) - size + np.searchsorted(none, w.rows)  # texts without words have one place each
        out[begin + size - 1] = np.where(last, END, 32)
        at = np.repeat(begin - (np.cumsum(size - 1) - (size - 1)), size - 1) + np.arange((size - 1).sum())
        out[at] = d[inside]
    return out, offsets


def byte_keys(t: Texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte below the `order` bytes before it (the latest lowest; 0 before a text's start), 8 bits each; n + 1 offsets."""
    b, offsets = normalised(t)
    return keys(b, offsets, order), offsets


def keys(b: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The keys of normalised bytes: each round puts as many earlier bytes before those that are there, twice as many as the last."""
    out, have = b.astype(np.int64), 1
    while have <= order:
        more = min(have, order + 1 - have)
        before = out[:-have] if more == have else out[:-have] & ((1 << 8 * more) - 1)
        out[have:] |= before << 8 * have
        have += more
    for k in range(order):  # the first bytes of a text have fewer before them
        at = offsets[:-1] + k
        at = at[at < offsets[1:]]
        out[at] &= (1 << 8 * (k + 1)) - 1
    return out


class Level:
    """Ascending keys, and a hash table that finds their rows."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        todo, at = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]  # of several for one slot the last stays
            lost = self.slots[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self._hash(keys)
        out = self.slots[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))  # most are found, or told absent, at their own slot
        at = at[todo]
        while len(todo):
            at = (at + 1) & ((1 << self.bits) - 1)
            row = self.slots[at]
            out[todo] = row
            go = (row >= 0) & (self.keys[row] != keys[todo])
            todo, at = todo[go], at[go]
        return out
