"""Token ids of whole texts from a public tokenizer file, a batch at a time.

The tokenizer splits a text into pieces before its merges, and never merges across them. A single
space or line feed between two other characters always starts a new piece, so texts may be cut
there; the distinct cuts of a batch are encoded once and their ids are put together again. That
gives the same ids as encoding each text, for a fraction of the work.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillstream.llm.textbytes import Texts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task per core already

#: Bytes of text whose cuts are told apart at once.
SPAN = 12 << 20
_OPENED: dict[str, Encoder] = {}
# bytes that may be, or begin, white space or a control character; multi-byte white space begins with c2, e1, e2 or e3
_DOUBT = np.zeros(256, bool)
_DOUBT[:33] = _DOUBT[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def opened(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    if path not in _OPENED:
        _OPENED[path] = Encoder(path)
    return _OPENED[path]


def cuts(t: Texts) -> np.ndarray:
    """Ascending starts of the cuts of all texts of a batch."""
    d = t.data
    n = len(d)
    marks = np.zeros(n + 1, bool)
    marks[t.offsets] = True
    at = np.flatnonzero((d == 32) | (d == 10))
    at = at[(at > 0) & (at < n - 1)]
    at = at[~marks[at] & ~marks[at + 1]]
    p = d[at - 1]
    clear = ~_DOUBT[p] & ~_DOUBT[d[at + 1]]
    high = np.flatnonzero(p >= 0x80)  # the last byte of a longer character: its first byte decides
    two, three = d[np.maximum(at[high] - 2, 0)], d[np.maximum(at[high] - 3, 0)]
    clear[high[(two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))]] = False
    at = at[clear]
    marks[at] = True
    marks[at[d[at] == 10] + 1] = True
    marks[n] = False
    return np.flatnonzero(marks)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True  # in a text their strings are ordinary text
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes that each id stands for
        for word, i in vocab.items():
            self.size[i] = len(word)  # one character a byte in byte-level vocabularies

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each distinct cut, one after another, and where each begins."""
        _, off, data = values.buffers()
        offsets = np.frombuffer(off, np.int64)[values.offset : values.offset + len(values) + 1]
        raw = np.frombuffer(data, np.uint8)
        s, e = offsets[:-1], offsets[1:]
        head = np.where(raw[s] == 32, raw[np.minimum(s + 1, e - 1)], raw[s])
        plain = ~_DOUBT[head] & (raw[e - 1] < 0x80) & ~_DOUBT[raw[e - 1]]
        high = ~_DOUBT[head] & (raw[e - 1] >= 0x80) & (e - s > 3)
        k = np.flatnonzero(high)
        plain[k] = (raw[e[k] - 2] != 0xC2) & ~((raw[e[k] - 3] >= 0xE1) & (raw[e[k] - 3] <= 0xE3))
        out = np.zeros(len(values), np.int64)
        parts: list[np.ndarray] = []
        order: list[np.ndarray] = []
        # plain cuts are joined by line feeds, each of which is a piece of its own; ids tell their
        # bytes, so that the joined ids come apart again
        rows = np.flatnonzero(plain)
        text = values.take(pa.array(rows))
        groups = np.searchsorted(np.cumsum(e[rows] - s[rows]), np.arange(1, 1 + int((e[rows] - s[rows]).sum()) // (1 << 17) + 1) * (1 << 17))
        for i, j in zip([0, *groups], [*groups, len(rows)], strict=True):
            if i == j:
                continue
            width = (e - s)[rows[i:j]]
            [ids] = self._ids([b"\n".join(text.slice(i, j - i).to_pylist()).decode()])
            ends = np.cumsum(self.size[ids])
            starts = np.concatenate([[0], np.cumsum(width + 1)[:-1]])
            first = np.searchsorted(ends, starts, "right")  # the id that begins at each cut's start
            last = np.searchsorted(ends, starts + width, "left") + 1
            if (np.diff(np.append(first, len(ids) + 1)) != last - first + 1).any():
                raise ValueError("the tokenizer joined what should stay apart")
            out[rows[i:j]] = last - first
            keep = np.ones(len(ids), bool)
            keep[last[:-1]] = False
            parts.append(ids[keep])
            order.append(rows[i:j])
        rest = np.flatnonzero(~plain)
        if len(rest):
            for i, ids in zip(rest, self._ids([x.decode() for x in values.take(pa.array(rest)).to_pylist()]), strict=True):
                out[i] = len(ids)
                parts.append(ids)
            order.append(rest)
        where = np.empty(len(values), np.int64)
        by = np.concatenate([*order, np.zeros(0, np.int64)])
        where[by] = np.concatenate([[0], np.cumsum(out[by])[:-1]])
        return np.concatenate([*parts, np.zeros(0, np.int32)]), np.stack([where, out])

    def encode(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and n + 1 offsets into them."""
        if not len(t.data):
            return np.zeros(0, np.int32), np.zeros(t.n + 1, np.int64)
        starts = cuts(t)
        bounds = np.append(starts, len(t.data))
        a = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(t.data))])
        d = pc.dictionary_encode(a)
        which = d.indices.to_numpy()
        ids, place = self._distinct(d.dictionary)
        n = place[1][which]
        ends = np.cumsum(n)
        at = np.repeat(place[0][which] - (ends - n), n) + np.arange(ends[-1])
        total = np.concatenate([[0], ends])
        return ids[at], total[np.searchsorted(starts, t.offsets)]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each text, and their offsets."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, offsets + np.arange(n + 1)
