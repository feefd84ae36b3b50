"""Hashed word and character n-grams of whole texts, bounded samples of labelled rows, and calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.llm.tables import held_out
from tillstream.llm.textbytes import Texts, chunks, int_column

#: Each group of n-grams (characters 1 to 3, words 1 and 2) has 2**BITS buckets of its own.
BITS = 17
GROUPS = 5
SIZE = GROUPS << BITS


def grams(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each group: (row of each n-gram, its bucket); no n-gram spans two texts."""
    t = t.lower()
    data = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])[t.offsets]  # before each text
    row = np.repeat(np.arange(t.n, dtype=np.int32), np.diff(chars))
    code = data
    for n in range(1, 4):
        if n > 1:
            code = code[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        m = len(code)
        ok = row[:m] == row[len(row) - m :] if n > 1 else slice(None)
        spread = code[ok] * np.uint32(2654435761)
        yield row[:m][ok], (spread >> np.uint32(32 - BITS)).astype(np.int32) + ((n - 1) << BITS)
    w = t.words()
    h = w.hashes()
    for n in (1, 2):
        rows, g = w.grams(h, n)
        yield rows.astype(np.int32), (g >> np.uint64(64 - BITS)).astype(np.int32) + ((n + 2) << BITS)


def sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)


def unique_grams(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of each distinct n-gram of each text, ascending."""
    keys = np.concatenate([(r.astype(np.int64) << 20) | f for r, f in grams(t)])
    keys.sort()
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    k = keys[first]
    return k >> 20, k & ((1 << 20) - 1), np.diff(np.append(first, len(keys)))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        label, ids = int_column(b, "label"), int_column(b, "doc_id")
        for t in chunks(b):
            r, f, c = unique_grams(t)
            cut = np.searchsorted(r, np.arange(t.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[t.first : t.first + t.n], pa.int64()), pa.array(label[t.first : t.first + t.n], pa.int32()),
                 pa.ListArray.from_arrays(cut, pa.array(f, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(c, pa.int32()))],
                names=["doc_id", "label", "buckets", "counts"],
            )


def labelled(labels: DataFrame, label: str, limit: int, hold_out: int | None) -> DataFrame:
    """(doc_id, label) of at most `limit` labelled ids, the first in the order of a hash of the id.

    Rows without id or label don't count; of several labels of one id the larger share wins, a tie
    is 1. With hold_out, ids whose crc32 modulo it is 0 are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if hold_out:
        rows = rows.where(~held_out(F.col("doc_id"), hold_out))
    one = rows.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def sampled(docs: DataFrame, labels: DataFrame, label: str, limit: int, hold_out: int | None) -> DataFrame:
    """(doc_id, label, text) of the picked ids, one row each: of several texts of one id that of the least hash,
    so that repeated rows don't outgrow the limit."""
    picked = labelled(labels, label, limit, hold_out)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))


class Sample:
    """Sparse rows of the sampled documents on the driver: at most the sample's limit of them. Without counts, each n-gram counts once."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str, limit: int, hold_out: int | None, counts: bool = True):
        rows = sampled(docs, labels, label, limit, hold_out).select("doc_id", "text", "label")
        rows = rows.mapInArrow(_sample_rows, "doc_id bigint, label int, buckets array<int>, counts array<int>")
        got = (rows if counts else rows.drop("counts")).toArrow().combine_chunks()
        lists = got.column("buckets").combine_chunks() if got.num_rows else None
        ids = got.column("doc_id").to_numpy()
        self.y = got.column("label").to_numpy().astype(np.int64)
        if lists is None:
            self.cut, self.f, self.c = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            self.cut = lists.offsets.to_numpy().astype(np.int64)
            self.f = lists.values.to_numpy()
            self.c = got.column("counts").combine_chunks().values.to_numpy() if counts else np.broadcast_to(np.int32(1), len(self.f))
        self.order = np.lexsort((np.diff(self.cut), ids))  # the same for any partitioning
        self.n = len(self.y)

    def both(self) -> bool:
        return self.n >= 10 and 0 < self.y.sum() < self.n

    def split(self, parts: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Rows to fit on, and every `parts`-th, kept for calibration."""
        k = np.arange(self.n) % parts == parts - 1
        return self.order[~k], self.order[k]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.cut[i], self.cut[i + 1])
        return self.f[s], self.c[s]


def platt(z: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept that turn raw scores into probabilities (regularised logistic fit on
    smoothed targets, Newton steps)."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = z.std() + 1e-9
    x = np.stack([z / scale, np.ones_like(z)], 1)
    v = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        g = x.T @ (p - target) + 1e-3 * v
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        v = v - np.clip(np.linalg.solve(h, g), -5, 5)
    return float(max(v[0], 0) / scale), float(v[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
