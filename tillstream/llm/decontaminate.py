"""Benchmark decontamination: pigeonhole edit matching.

Texts and test items are normalised: A-Z lower-cased, each run of bytes other than letters, digits
and non-ASCII bytes becomes one space. An item of m bytes may differ by k = floor(max_error * m)
edits. It is split into k + 1 pieces, at least one of which any such passage holds unchanged. All
pieces are found in one pass (Aho-Corasick); each hit names a window of the text, which must hold
m - 2 - 3k of the item's trigrams (no edit destroys more than three) and is then verified with
Myers' bit-parallel distance. The bounds are necessary conditions, so no passage within k edits is lost.

Documents are scanned in Arrow batches without a shuffle. The test items travel to the tasks in
blocks of about `block_bytes`: a larger benchmark takes more passes, not more memory.

An item so short that its budget is 0 is one piece, and counts only where it stands as whole words: within a word it would
be any syllable.

Defined cases: a null or empty text holds no passage; an item without letters, digits and non-ASCII bytes (a null
one too) is matched by nothing; repeated documents
or items are matched each for itself; of several places the one of least distance, then the first,
is told; empty tables give no matches; other columns are ignored by `matches` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm.tables import table
from tillstream.llm.textbytes import Texts, chunks

_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[128:] = np.arange(128, 256)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = _NORMAL[65:91] = np.arange(97, 123)
MATCHES = "doc_id bigint, item_id bigint, distance int, item_bytes int, start_byte bigint, end_byte bigint"


def normalised(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The normalised bytes, each text's offsets into them, and the original place of each byte."""
    b = _NORMAL[t.data]
    space = b == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    first = t.offsets[:-1][t.offsets[:-1] < len(b)]
    keep[first] = ~space[first]
    at = np.flatnonzero(keep)
    return b[keep], np.searchsorted(at, t.offsets), at


def myers(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and where the first such part ends."""
    m, peq = len(pattern), {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def whole_words(b: np.ndarray, want: bytes, lo: int, hi: int, begin: int, end: int) -> int:
    """First place in b[lo:hi] where the words stand between spaces or at an end of their text b[begin:end]; -1 if there is none."""
    text, at = b[lo:hi].tobytes(), -1
    while (at := text.find(want, at + 1)) >= 0:
        s, e = lo + at, lo + at + len(want)
        if (s == begin or b[s - 1] == 32) and (e == end or b[e] == 32):
            return s
    return -1


@dataclass
class Items:
    """A block of test items and the pieces to look for."""

    ids: list[int]
    texts: list[bytes]
    budget: list[int]
    words: list[str] = field(default_factory=list)
    owners: list[list[tuple[int, int]]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], max_error: float) -> Items:
        out, at = cls([], [], []), {}
        for item, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            b = normalised(Texts(raw, np.array([0, len(raw)])))[0].tobytes().strip()
            if not b:
                continue
            k, own = int(len(b) * max_error), len(out.ids)
            out.ids.append(item)
            out.texts.append(b)
            out.budget.append(k)
            cuts = [len(b) * j // (k + 1) for j in range(k + 2)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                n = at.setdefault(b[s:e].decode("latin-1"), len(at))
                if n == len(out.owners):
                    out.words.append(b[s:e].decode("latin-1"))
                    out.owners.append([])
                out.owners[n].append((own, s))
        return out


class Scanner:
    """Built once per task from a block of items."""

    def __init__(self, items: Items):
        self.items, self.search = items, ahocorasick.Automaton()
        for n, w in enumerate(items.words):
            self.search.add_word(w, n)
        if items.words:
            self.search.make_automaton()
        self.width = np.array([len(w) for w in items.words], np.int64)
        self.count = np.array([len(o) for o in items.owners], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        flat = np.array([x for o in items.owners for x in o], np.int64).reshape(-1, 2)
        self.owner, self.place = flat[:, 0], flat[:, 1]
        self.m = np.array([len(x) for x in items.texts], np.int64)
        self.k = np.array(items.budget, np.int64)
        tri = [self._tri(np.frombuffer(x, np.uint8)) for x in items.texts]
        self.tri, self.tri_at = np.concatenate([*tri, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum([len(x) for x in tri])])

    @staticmethod
    def _tri(b: np.ndarray) -> np.ndarray:
        a = b.astype(np.int64)
        return (a[:-2] * 961 + a[1:-1] * 31 + a[2:]) & 4095

    def windows(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Distinct (row, item, from, to) around all piece hits, as columns."""
        hits = np.array(list(self.search.iter(b.tobytes().decode("latin-1"))), np.int64).reshape(-1, 2)
        piece = hits[:, 1]
        start = hits[:, 0] + 1 - self.width[piece]
        row = np.searchsorted(offsets, start, "right") - 1
        ok = start + self.width[piece] <= offsets[row + 1]
        piece, start, row = piece[ok], start[ok], row[ok]
        n = self.count[piece]
        each = np.repeat(np.arange(len(piece)), n)
        own = np.repeat(self.first[piece] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        item, row, diagonal = self.owner[own], row[each], start[each] - self.place[own]
        step = 2 * self.k[item] + 16
        near = (diagonal + (1 << 40)) // step
        found = np.unique(np.stack([row, item, near]), axis=1) if len(item) else np.zeros((3, 0), np.int64)
        row, item, near = found
        step = 2 * self.k[item] + 16
        low = near * step - (1 << 40)
        return np.stack([row, item, np.maximum(offsets[row], low - self.k[item]), np.minimum(offsets[row + 1], low + step + self.m[item] + self.k[item])])

    def likely(self, b: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The windows with as many of the item's trigrams as k edits must leave."""
        out = []
        for i in range(0, w.shape[1], 512):
            _, item, lo, hi = p = w[:, i : i + 512]
            flags = np.zeros((p.shape[1], 4096), bool)
            n = np.maximum(hi - lo - 2, 0)
            who = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            x = b.astype(np.int64) if len(b) < len(at) else None
            t = (x[at] * 961 + x[at + 1] * 31 + x[at + 2]) & 4095 if x is not None else (b[at].astype(np.int64) * 961 + b[at + 1].astype(np.int64) * 31 + b[at + 2]) & 4095
            flags[who, t] = True
            n = self.tri_at[item + 1] - self.tri_at[item]
            who = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) + np.repeat(self.tri_at[item] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            left = np.bincount(who, weights=flags[who, self.tri[at]], minlength=len(n))
            out.append(p[:, left >= n - 3 * self.k[item]])
        return np.concatenate(out, axis=1) if out else w

    def scan(self, t: Texts) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) -> (distance, from, to) in bytes of the original text."""
        if not self.items.words or not len(t.data):
            return {}
        b, offsets, at = normalised(t)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, lo, hi in self.likely(b, self.windows(b, offsets)).T.tolist():
            text, want, k = b[lo:hi].tobytes(), self.items.texts[item], self.items.budget[item]
            if k == 0:
                if (place := whole_words(b, want, lo, hi, offsets[row], offsets[row + 1])) < 0:
                    continue
                found = (0, place, place + len(want))
            elif (place := text.find(want)) >= 0:
                found = (0, lo + place, lo + place + len(want))
            else:
                distance, end = myers(want, text)
                if distance > k:
                    continue
                _, back = myers(want[::-1], text[max(0, end - len(want) - k) : end][::-1])
                found = (distance, lo + end - back, lo + end)
            key = (row, item)
            if key not in best or found < best[key]:
                best[key] = found
        base = t.offsets
        return {(r, i): (d, int(at[s] - base[r]), int(at[e - 1] + 1 - base[r])) for (r, i), (d, s, e) in best.items()}


def blocks(benchmark: DataFrame, max_error: float, block_bytes: int) -> Iterator[Items]:
    """The items in blocks of about block_bytes, each small enough for the driver and every task."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // block_bytes))
    for k in range(parts):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).select("item_id", "text").collect()
        yield Items.of(sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0], x[1] or "")), max_error)


def matches(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.1, block_bytes: int = 1 << 20) -> DataFrame:
    """One row for each document and test item of which it holds a passage within the error budget."""
    out = None
    for items in blocks(benchmark, max_error, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            s = Scanner(items)
            for b in batches:
                ids, rows = b.column(0), []
                for t in chunks(b):
                    for (r, i), (d, lo, hi) in sorted(s.scan(t).items()):
                        rows.append((ids[t.first + r].as_py(), items.ids[i], d, len(items.texts[i]), lo, hi))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in MATCHES.split(", ")])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.1, block_bytes: int = 1 << 20) -> DataFrame:
    """The documents, all columns, that hold no passage of the benchmark."""
    for items in blocks(benchmark, max_error, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            s = Scanner(items)
            for b in batches:
                bad = {t.first + r for t in chunks(b) for r, _ in s.scan(t)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_())) if bad else b

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
