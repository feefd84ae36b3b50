r"""Quality rules: hashed n-gram logistic regression behind plain text rules.

A text fails the plain rules with fewer than ten words or when over a fifth of its words lie in
five-word windows that occur twice or more in it. What passes them is judged by a logistic
regression on hashed word (1, 2) and character (1 to 3) n-gram shares, fitted on a bounded sample of
labelled rows, calibrated on rows kept from the fit, and scored in Arrow batches against a fixed
probability threshold. Words are runs of characters other than space and 0x09-0x0D.

Defined cases: a null or empty text has zero counts and fails; repeated rows and ids are judged row
by row; without labels of both classes (or fewer than ten) only the plain rules decide; lines
without a word are never counted as repeated; other columns are kept by `judge`, unless they have
the name of one of its own columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillstream.llm.features import GROUPS, SIZE, Sample, grams, platt, sigmoid, sums
from tillstream.llm.tables import table
from tillstream.llm.textbytes import Texts, Words, chunks, mix

SAMPLE_ROWS = 4000
#: The least calibrated probability of label 1 with which a text is kept.
THRESHOLD = 0.3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_GROUP = np.repeat(np.arange(GROUPS), SIZE // GROUPS)


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    intercept: float
    constant: float | None = None

    def score(self, t: Texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(t.n, self.constant)
        z = np.full(t.n, self.bias)
        for rows, buckets in grams(t):
            z += sums(rows, self.weight[buckets], t.n) / np.maximum(np.bincount(rows, minlength=t.n), 1)
        return sigmoid(self.slope * z + self.intercept)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, hold_out: int | None = None, epochs: int = 20, rate: float = 2.0, decay: float = 1e-6) -> Model:
    """Mini-batch Adagrad on the shares of each group's n-grams."""
    s = Sample(docs, labels, label, sample_rows, hold_out)
    if not s.both():
        return Model(np.zeros(SIZE), 0.0, 0.0, 0.0, 1.0)
    train, check = s.split()
    if len(set(s.y[train])) < 2 or len(set(s.y[check])) < 2:
        train = check = s.order
    x = {}
    for i in s.order:
        f, c = s.row(i)
        g = _GROUP[f]
        x[i] = (f, (c / np.maximum(np.bincount(g, weights=c, minlength=GROUPS), 1)[g]).astype(np.float32))
    w, b = np.zeros(SIZE, np.float32), float(np.log((s.y[train].sum() + 1) / (len(train) - s.y[train].sum() + 1)))
    past, past_b, order = np.full(SIZE, 1e-8, np.float32), 1e-8, np.random.default_rng(5)
    for _ in range(epochs):
        shuffled = order.permutation(train)
        for k in range(0, len(shuffled), 64):
            own = shuffled[k : k + 64]
            f, v = np.concatenate([x[i][0] for i in own]), np.concatenate([x[i][1] for i in own])
            r = np.repeat(np.arange(len(own)), [len(x[i][0]) for i in own])
            e = (sigmoid(sums(r, w[f] * v, len(own)) + b) - s.y[own]) / len(own)
            g = np.bincount(f, weights=v * e[r], minlength=SIZE).astype(np.float32) + np.float32(decay) * w
            past += g * g
            past_b += e.sum() ** 2
            w -= np.float32(rate) * g / np.sqrt(past)
            b -= rate * 0.1 * e.sum() / np.sqrt(past_b)
    z = np.array([w[x[i][0]] @ x[i][1] for i in check]) + b
    return Model(w.astype(np.float64), b, *platt(z, s.y[check]))


def _spread(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of `length` from one of the starts."""
    d = np.zeros(n + length + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d)[:n] > 0


def repeat_words(w: Words, h: np.ndarray, window: int = 5) -> np.ndarray:
    """Words of each text in windows that occur twice or more in it."""
    n = w.texts.n
    if len(h) < window:
        return np.zeros(n, np.int64)
    at = np.flatnonzero(w.rows[: len(h) - window + 1] == w.rows[window - 1 :])
    rows, g = w.grams(h, window)
    key = g ^ mix(rows.astype(np.uint64) + np.uint64(1))
    by = np.argsort(key, kind="stable")
    k = key[by]
    same = np.zeros(len(k), bool)
    same[1:] |= k[1:] == k[:-1]
    same[:-1] |= k[1:] == k[:-1]
    return np.bincount(w.rows[_spread(at[by[same]], window, len(h))], minlength=n)


def dup_lines(t: Texts, w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    data = t.data
    brk = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([t.offsets[:-1], brk + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros(t.n, np.int64)
    ends = np.append(starts[1:], len(data))
    cut = (data[ends - 1] == 10) & ~np.isin(ends, t.offsets[1:])  # the line feed is no part of a line
    last = np.isin(ends, t.offsets[1:]) & (data[ends - 1] == 10)
    ends = ends - (cut | last)
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    lines = Words(t, starts[has], ends[has])
    key = lines.hashes() ^ mix(lines.rows.astype(np.uint64) + np.uint64(1))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    return np.bincount(lines.rows[again], minlength=t.n)


def measures(t: Texts) -> dict[str, np.ndarray]:
    w = t.words()
    h, n = w.hashes(), t.n
    n_words = w.counts()
    points = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
    chars = sums(w.rows, points[w.ends] - points[w.starts], n).astype(np.int64)
    hits = np.concatenate([[0], np.cumsum(_SYMBOL[t.data])])
    repeated = repeat_words(w, h)
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": hits[t.offsets[1:]] - hits[t.offsets[:-1]], "n_dup_lines": dup_lines(t, w), "n_repeat_words": repeated}
    return out | {"base_failed": (n_words < 10) | (100 * repeated > 20 * n_words)}


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD, columns: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those named), the measures, base_failed, kept and score (the calibrated probability)."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # about 5 MB at any input size
    own = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "score": "double"}
    keep = [c for c in docs.columns if c not in own]
    back = [i for i, c in enumerate(keep) if columns is None or c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for t in chunks(b):
                m = measures(t)
                z = given.value.score(t)
                parts.append(m | {"kept": ~m["base_failed"] & (z >= threshold), "score": z})
            if parts:
                new = [pa.array(np.concatenate([p[c] for p in parts])) for c in own]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in back), *new], names=[*(b.schema.names[i] for i in back), *own])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(keep[i] for i in back)).schema.fields] + [f"{k} {v}" for k, v in own.items()]
    return docs.select(*keep).mapInArrow(run, ", ".join(fields))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
