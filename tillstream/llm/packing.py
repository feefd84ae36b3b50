"""Packing: documents into windows of a fixed number of tokens, by non-negative least squares.

A document's ids (with the end id) are cut into whole windows and one rest shorter than a window.
The rests' lengths make a histogram of at most `window` counts, whatever the corpus. Shallow length
combinations that fill a window exactly (or a power of two below it, which needs no padding) are
enumerated; non-negative least squares finds how often to use each, so that they use up the
histogram; the counts are rounded down to what is there and the residual lengths are packed
greedily, longest first with the longest that still fits. The driver holds histogram and plan only.

The plan says for each length which ranks go to which windows. A piece's rank among those of its
length is its rank within the task that made it plus the number in earlier tasks, so that no length,
however common, meets in one task. Pieces are written once with their task's number; all later
steps read that table.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are packed each for
itself; an empty table gives no pieces; null ids stay null; columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.llm.tables import kept, table
from tillstream.llm.textbytes import chunks
from tillstream.llm.tokens import SPAN, default_path, opened, with_end

WINDOW = 1024
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, task int, local bigint"
PACKED = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def combinations(hist: np.ndarray, window: int) -> np.ndarray:
    """Rows of three lengths (0: none) of the histogram that fill the window, or with one or two a power of two."""
    have = hist > 0
    have[0] = True
    rows = []
    targets = [window] + [1 << k for k in range(window.bit_length() - 1) if 1 << k < window]
    for total in targets:
        a = np.arange(total // 2, total + 1)
        a = a[a < len(hist)]
        b = total - a
        ok = have[a] & have[b] & (a < window)
        rows.append(np.stack([a[ok], b[ok], np.zeros(ok.sum(), int)], 1))
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    ok = (a >= b) & (b >= c) & (c > 0)
    a, b, c = a[ok], b[ok], c[ok]
    ok = have[a] & have[b] & have[c]
    rows.append(np.stack([a[ok], b[ok], c[ok]], 1))
    return np.concatenate(rows)


def least_squares(hist: np.ndarray, combos: np.ndarray, sweeps: int = 80) -> np.ndarray:
    """x >= 0 that brings |A x - hist| down, by block coordinate descent: each sweep moves a set of
    combinations without a common length, those of the largest steps first, each to its optimum."""
    x, left = np.zeros(len(combos)), hist.astype(float).copy()
    left[0] = 0
    if not len(combos):
        return x
    used = (combos > 0).sum(1)
    # |column|^2: a length that a combination has twice counts four times
    a, b, c = combos.T
    norm = used + 2.0 * ((a == b) & (b > 0)) + 2.0 * ((b == c) & (c > 0)) + 2.0 * ((a == c) & (c > 0))
    for _ in range(sweeps):
        step = np.maximum((left[a] + left[b] + left[c]) / norm, -x)
        order = np.argsort(-np.abs(step), kind="stable")[:20000]
        if abs(step[order[0]]) < 0.25:
            break
        taken, move = bytearray(len(hist)), []
        for j, (p, q, r) in zip(order.tolist(), combos[order].tolist(), strict=True):
            if taken[p] or (q and taken[q]) or (r and taken[r]):
                continue
            taken[p] = 1
            if q:
                taken[q] = 1
            if r:
                taken[r] = 1
            move.append(j)
        move = np.array(move)
        x[move] += step[move]
        for k in range(3):
            np.subtract.at(left, combos[move, k], step[move])
        left[0] = 0
    return x


@dataclass
class Plan:
    """Slots sorted by (length, first rank): ranks from `rank` on go to windows from `window` on, at `offset`."""

    length: np.ndarray
    rank: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    windows: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.length.astype(np.int64) << 48 | self.rank
        at = np.searchsorted(key, length.astype(np.int64) << 48 | rank, "right") - 1
        return self.window[at] + rank - self.rank[at], self.offset[at]


def plan(hist: np.ndarray, window: int = WINDOW) -> Plan:
    """Where each piece of each length goes; hist[n]: pieces of length n, n up to the window."""
    left, chosen = hist.astype(np.int64).copy(), []
    chosen.append(((window,), int(left[window])))
    left[window] = 0
    combos = combinations(left[:window], window)
    x = least_squares(left[:window], combos)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 1:
            break
        parts = tuple(int(v) for v in combos[j] if v)
        times = min(int(x[j]), *(int(left[v]) // parts.count(v) for v in parts))
        if times > 0:
            chosen.append((parts, times))
            for v in parts:
                left[v] -= times
    while (present := np.flatnonzero(left)).size:
        room, parts, stock = window, [], left.copy()
        while room > 0 and (fit := present[(present <= room) & (stock[present] > 0)]).size:
            parts.append(int(fit[-1]))
            stock[fit[-1]] -= 1
            room -= int(fit[-1])
        times = min(int(left[v]) // parts.count(v) for v in parts)
        chosen.append((tuple(parts), times))
        for v in parts:
            left[v] -= times
    slots, base, seen = [], 0, np.zeros(window + 1, np.int64)
    for parts, times in chosen:
        at = 0
        for v in parts:
            if times:
                slots.append((v, int(seen[v]), base, at))
            seen[v] += times
            at += v
        base += times
    s = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return Plan(s[:, 0], s[:, 1], s[:, 2], s[:, 3], base)


def pieces(docs: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """One row per piece with its rank among those of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = opened(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for b in batches:
            doc = b.column(0)
            for t in chunks(b, size=SPAN):
                ids, offsets = with_end(*encoder.encode(t), end_id)
                total = np.diff(offsets)
                n = -(-total // window)
                row = np.repeat(np.arange(t.n), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(window, total[row] - start)
                raw = ids.astype("<u4").view(np.uint8)
                low = (offsets[row] + start) * 4
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(low.tolist(), (low + length * 4).tolist(), strict=True)]
                by = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=window + 1)
                local = np.empty(len(row), np.int64)
                local[by] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
                seen += counts
                cols = [doc.take(pa.array(t.first + row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row]), pa.array(np.full(len(row), task, np.int32)), pa.array(local)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """One row per piece: the part of a document and its place in a window."""
    own = kept(pieces(docs, path or default_path(), end_id, window), "pieces")
    counts = own.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = kept(counts, "piece-counts")
    hist = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `window` rows
        hist[r.length] = r.n
    given = docs.sparkSession.sparkContext.broadcast(plan(hist, window))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = own.join(first, ["task", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("local") + F.col("first")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            window_id, offset = given.value.place(b.column(2).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(window_id), pa.array(offset)], names=[x.split()[0] for x in PACKED.split(", ")])

    return ranked.mapInArrow(run, PACKED)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
