"""Quality classifier: naive Bayes support vectors.

Binary n-gram indicators (characters 1 to 3, words 1 and 2, hashed) are scaled by the log-count ratio of
the two classes; a linear hinge-loss model is fitted on the scaled rows by dual coordinate descent,
its weights are drawn towards their mean magnitude, and its margin becomes a probability on rows
that were kept from the fit. The fit takes a bounded sample of labelled rows; scoring reads every
whole text once, in Arrow batches, without a shuffle.

Defined cases: a null or empty text has no n-grams and gets the score of the intercepts; repeated
rows and ids are scored row by row; without labels of both classes (or fewer than ten) every score
is the labels' mean, 1.0 without labels, so that nothing is rejected; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillstream.llm.features import SIZE, Sample, platt, sigmoid, sums, unique_grams
from tillstream.llm.tables import held_out, table
from tillstream.llm.textbytes import chunks

#: Labelled rows that a model is fitted on at most.
SAMPLE_ROWS = 4000


@dataclass
class Model:
    ratio: np.ndarray  # log-count ratio of each bucket
    weight: np.ndarray  # hinge weight times ratio of each bucket
    bias: float
    slope: float
    intercept: float
    constant: float | None = None

    def margin(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        r = self.ratio[buckets]
        norm = np.sqrt(sums(rows, r * r, n))
        return sums(rows, self.weight[buckets], n) / np.maximum(norm, 1e-9) + self.bias

    def score(self, t) -> np.ndarray:
        if self.constant is not None:
            return np.full(t.n, self.constant)
        rows, buckets, _ = unique_grams(t)
        return sigmoid(self.slope * self.margin(rows, buckets, t.n) + self.intercept)


def log_count_ratio(s: Sample, rows: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for i in rows:
        (p if s.y[i] else q)[s.row(i)[0]] += 1
    seen = (p > alpha) | (q > alpha)
    return np.where(seen, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, rounds: int, seed: int = 1) -> tuple[np.ndarray, float]:
    """min 1/2 |w|^2 + sum cost_i max(0, 1 - y_i (w x_i + b)), b as the weight of a constant 1."""
    w, b, a = np.zeros(SIZE), 0.0, np.zeros(len(x))
    q = np.array([float(v @ v) + 1 for _, v in x])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            f, v = x[i]
            g = y[i] * (w[f] @ v + b) - 1
            new = min(max(a[i] - g / q[i], 0.0), cost[i])
            if (step := (new - a[i]) * y[i]) != 0:
                w[f] += step * v
                b += step
                a[i] = new
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, hold_out: int | None = 5, rounds: int = 12, cost: float = 1.0, blend: float = 0.25) -> Model:
    s = Sample(docs, labels, label, sample_rows, hold_out, counts=False)
    if not s.both():
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0, 0.0, float(s.y.mean()) if s.n else 1.0)
    train, check = s.split()
    if len(set(s.y[train])) < 2 or len(set(s.y[check])) < 2:
        train = check = s.order
    r = log_count_ratio(s, train)
    flat = r[s.f]  # one array, so that its memory goes back whole
    x = []
    for i in train:
        v = flat[s.cut[i] : s.cut[i + 1]]
        v /= max(np.sqrt(v @ v), 1e-9)
        x.append((s.row(i)[0], v))
    y = np.where(s.y[train] == 1, 1.0, -1.0)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    w, b = dual_coordinate_descent(x, y, cost * 0.5 / share, rounds)
    w = (1 - blend) * np.abs(w).sum() / max((r != 0).sum(), 1) + blend * w
    m = Model(r, w * r, b, 1.0, 0.0)
    z = np.array([m.margin(np.zeros(len(s.row(i)[0]), np.int64), s.row(i)[0], 1)[0] for i in check])
    m.slope, m.intercept = platt(z, s.y[check])
    return m


def score(docs: DataFrame, model: Model, threshold: float = 0.3, columns: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those named) but score and predicted, then these two. What is not named need not come back from Python."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # about 10 MB at any input size
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    back = [i for i, c in enumerate(keep) if columns is None or c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([given.value.score(t) for t in chunks(b)] or [np.zeros(0)])
            cols = [b.column(i) for i in back]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(z), pa.array((z >= threshold).astype(np.int32))], names=[*(b.schema.names[i] for i in back), "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(keep[i] for i in back)).schema.fields]
    return docs.select(*keep).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select("doc_id", held_out(out.doc_id, 5).alias("held_out"), "score", "predicted")
