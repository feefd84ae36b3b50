"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is the sum of a hashed word embedding, the mean of hashed embeddings of its byte trigrams
(with marks at both ends) and that of its beginnings of LEAST to MOST bytes, so that new words are known
by their parts and stems; training leaves out half of the words' own embeddings at random, and averages
its later networks, so that it does not learn single words of few texts by heart. All windows of 24 words, each
overlapping the next by half, are read in both directions; attention pools the states into one
logit per window, and the largest is the text's. Training is by the same rule: the gradient goes
through each text's strongest window, so that labels of texts suffice. A held-back part of the sample
turns logits into probabilities.

Only the fit is on a bounded sample: at most SAMPLE_ROWS labelled rows, whole. Their texts, of whatever length, stay in a
table: every REFRESH steps tasks read all their windows and give each text's TOP strongest under the network of then, and the driver
trains on the strongest of those found so far. Calibration is on the logits of whole texts, as scoring gives them. Scoring reads every whole text once, in Arrow batches,
without a shuffle; each distinct word of a run of texts is embedded once.

Defined cases: a null or empty text has no window and gets the probability of an empty one; repeated
rows and ids are scored row by row; without labels of both classes (or fewer than ten) every score is
the labels' mean, 0.0 without labels; other columns are kept by `score`, unless named as its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm.features import platt, sampled, sigmoid
from tillstream.llm.tables import forget, held_out, kept, table
from tillstream.llm.textbytes import Texts, Words, chunks, int_column

SAMPLE_ROWS = 3000
REFRESH = 30
#: Windows that a sampled text brings in at each of these times.
TOP = 8
WORDS, PARTS, DIM, HIDDEN, ATTEND = 1 << 15, 1 << 15, 16, 8, 8
#: Share of words that a training step shows by their parts alone.
DROP = 0.5
LEAST, MOST = 3, 8
WINDOW, STRIDE = 24, 12
f32 = np.float32


@dataclass
class Tokens:
    """Distinct words of a run of texts (bucket; parts of each kind with their first positions) and the texts as numbers of these."""

    bucket: np.ndarray
    parts: dict[str, tuple[np.ndarray, np.ndarray]]  # trigrams ("tri") and beginnings ("pre"): buckets, first ones
    which: np.ndarray
    offsets: np.ndarray  # of each text in `which`


def tokens(t: Texts) -> Tokens:
    w = t.lower().words()
    _, at, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
    s, e, d = w.starts[at], w.ends[at], w.texts.data
    n = e - s
    first = np.cumsum(n) - n
    p = np.arange(n.sum()) + np.repeat(s - first, n)
    left = np.where(p > np.repeat(s, n), d[np.maximum(p - 1, 0)], 2).astype(np.int64)
    right = np.where(p < np.repeat(e, n) - 1, d[np.minimum(p + 1, len(d) - 1)], 3).astype(np.int64)
    tri = (((left << 16 | d[p].astype(np.int64) << 8 | right) * 2654435761) >> 15) & (PARTS - 1)
    hashes = w.hashes()
    bucket = (hashes[at] >> np.uint64(49)).astype(np.int64)
    # beginnings of LEAST to MOST bytes, shorter words whole
    k = np.clip(n - LEAST + 1, 1, MOST - LEAST + 1)
    begin = np.cumsum(k) - k
    size = np.arange(k.sum()) - np.repeat(begin, k) + LEAST
    own = Words(w.texts, np.repeat(s, k), np.minimum(np.repeat(e, k), np.repeat(s, k) + size))
    pre = (own.hashes() >> np.uint64(49)).astype(np.int32)
    return Tokens(bucket, {"tri": (tri.astype(np.int32), first), "pre": (pre, begin)}, which, np.concatenate([[0], np.cumsum(w.counts())]))


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts: (text, first token, tokens in it)."""
    n = np.diff(offsets)
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    row = np.repeat(np.arange(len(n)), k)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)) * STRIDE
    return row, offsets[row] + start, np.minimum(WINDOW, n[row] - start)


def _gate(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        g = lambda *s, k=0.1: (r.standard_normal(s) * k).astype(f32)
        h = HIDDEN
        self.p = {"word": g(WORDS, DIM), "tri": g(PARTS, DIM), "pre": g(PARTS, DIM), "att": g(2 * h, ATTEND, k=0.3), "query": g(ATTEND, k=0.3), "out": g(2 * h, k=0.3), "bias": np.zeros(1, f32)}
        for d in "fb":
            self.p |= {f"x{d}": g(DIM, 3 * h, k=0.25), f"b{d}": np.zeros(3 * h, f32), f"u{d}": g(h, 3 * h, k=0.3)}

    def start(self, n: np.ndarray, seen: dict[str, np.ndarray]) -> None:
        """First values of one dimension of the embeddings: the log ratio of the shares of each class's texts
        that have the word or part, so that training starts from what single words tell. n and seen: the
        number of texts of each class, and how many of them have each."""
        for name, c in seen.items():
            share = (c + 1) / (n[:, None] + 2)
            sure = c.sum(0) > 1
            self.p[name][:, 0] = np.where(sure, np.clip(np.log(share[1] / share[0]), -3, 3), 0)

    def embed(self, t: Tokens, on: np.ndarray | None = None) -> np.ndarray:
        """One row for each distinct word; `on` tells which of them bring in their own embedding besides those of their parts."""
        if not len(t.bucket):
            return np.zeros((0, DIM), f32)
        out = self.p["word"][t.bucket] * (1 if on is None else on[:, None])
        for name, (ids, first) in t.parts.items():
            out += np.add.reduceat(self.p[name][ids], first, axis=0) / np.diff(np.append(first, len(ids)))[:, None].astype(f32)
        return out

    def forward(self, words: np.ndarray, place: np.ndarray, live: np.ndarray, keep: bool = False):
        """Logit of each window; place: its tokens as rows of `words` (embeddings), live: which of them there are."""
        h, n = HIDDEN, len(place)
        states = np.zeros((WINDOW, n, 2 * h), f32)
        kept = {}
        for d, order, half in (("f", range(WINDOW), slice(0, h)), ("b", range(WINDOW - 1, -1, -1), slice(h, 2 * h))):
            x = words @ self.p[f"x{d}"] + self.p[f"b{d}"]
            u, s = self.p[f"u{d}"], np.zeros((n, h), f32)
            for k in order:
                xk, hu = x[place[:, k]], s @ u
                zr = _gate(xk[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(xk[:, 2 * h :] + r * hu[:, 2 * h :])
                on = live[:, k : k + 1]
                new = np.where(on, z * s + (1 - z) * c, s)
                if keep:
                    kept[d, k] = (s, z, r, c, hu[:, 2 * h :])
                s = new
                states[k][:, half] = s
        a = np.tanh(states @ self.p["att"])
        e = np.where(live.T, a @ self.p["query"], f32(-1e9))
        e = np.exp(e - e.max(0))
        e = e * live.T
        e /= np.maximum(e.sum(0), 1e-9)
        pooled = (e[:, :, None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (states, a, e, pooled, kept)) if keep else logit

    def backward(self, t: Tokens, words: np.ndarray, place: np.ndarray, live: np.ndarray, kept: tuple, dz: np.ndarray, whole: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Gradients for d loss / d logit = dz."""
        p, h = self.p, HIDDEN
        states, a, e, pooled, steps = kept
        g = {"out": pooled.T @ dz, "bias": np.array([dz.sum()], f32)}
        dpool = dz[:, None] * p["out"]
        de = (states * dpool).sum(2)
        ds = e * (de - (e * de).sum(0))
        da = ds[:, :, None] * p["query"] * (1 - a * a)
        g["query"] = (ds[:, :, None] * a).sum((0, 1))
        g["att"] = np.einsum("kni,knj->ij", states, da)
        dstates = e[:, :, None] * dpool + da @ p["att"].T
        dwords = np.zeros_like(words)
        for d, order, half in (("f", range(WINDOW - 1, -1, -1), slice(0, h)), ("b", range(WINDOW), slice(h, 2 * h))):
            u, carry = p[f"u{d}"], np.zeros((len(place), h), f32)
            gx, gu, gb = np.zeros_like(p[f"x{d}"]), np.zeros_like(u), np.zeros(3 * h, f32)
            for k in order:
                s, z, r, c, hn = steps[d, k]
                on = live[:, k : k + 1]
                full = carry + dstates[k][:, half]
                dn = np.where(on, full, 0)
                dc = dn * (1 - z) * (1 - c * c)
                dpre = np.concatenate([dn * (s - c) * z * (1 - z), dc * hn * r * (1 - r), dc], 1)
                dhu = np.concatenate([dpre[:, : 2 * h], dc * r], 1)
                gu += s.T @ dhu
                x = words[place[:, k]]
                gx += x.T @ dpre
                gb += dpre.sum(0)
                np.add.at(dwords, place[:, k], np.where(on, dpre @ p[f"x{d}"].T, 0).astype(f32))
                carry = np.where(on, dn * z + dhu @ u.T, full)
            g |= {f"x{d}": gx, f"u{d}": gu, f"b{d}": gb}
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], t.bucket, dwords if whole is None else dwords * whole[:, None])
        for name, (ids, first) in t.parts.items():
            n = np.diff(np.append(first, len(ids)))
            g[name] = np.zeros_like(p[name])
            np.add.at(g[name], ids, np.repeat(dwords / n[:, None].astype(f32), n, axis=0))
        return g


def present(t: Tokens) -> dict[str, np.ndarray]:
    """The distinct buckets of each table that a text has."""
    return {"word": np.unique(t.bucket)} | {name: np.unique(ids) for name, (ids, _) in t.parts.items()}


def gather(t: Tokens, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    live = np.arange(WINDOW) < length[:, None]
    at = np.minimum(start[:, None] + np.arange(WINDOW), max(len(t.which) - 1, 0))
    return t.which[at], live


def text_windows(net: Network, t: Tokens, top: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's largest window logit (that of an empty window for texts without words), and its `top` strongest windows: text, (first
    token, tokens in it)."""
    out = np.full(len(t.offsets) - 1, float(net.p["bias"][0]))
    row, start, length = windows(t.offsets)
    if not len(row):
        return out, row, np.zeros((0, 2), np.int64)
    z = net.forward(net.embed(t), *gather(t, start, length))
    order = np.lexsort((-z, row))
    first = np.flatnonzero(np.concatenate([[True], row[order][1:] != row[order][:-1]]))
    out[row[order[first]]] = z[order[first]]
    at = order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order)))) < top]
    return out, row[at], np.stack([start[at], length[at]], 1)


def text_logits(net: Network, t: Tokens) -> np.ndarray:
    return text_windows(net, t)[0]


@dataclass
class Model:
    net: Network | None
    slope: float = 0.0
    intercept: float = 0.0
    constant: float = 0.0

    def score(self, t: Texts) -> np.ndarray:
        if self.net is None:
            return np.full(t.n, self.constant)
        return sigmoid(self.slope * text_logits(self.net, tokens(t)) + self.intercept)


def _texts(rows: list[str]) -> Texts:
    raw = [x.encode() for x in rows]
    return Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, hold_out: int | None = 5, passes: int = 300, drop: float = DROP, seed: int = 11) -> Model:
    """The network learned from a bounded sample of labelled rows."""
    rows = kept(sampled(docs, labels, label, sample_rows, hold_out).withColumn("text", F.coalesce("text", F.lit(""))), "sample")
    got = sorted((r.doc_id, r.label) for r in rows.select("doc_id", "label").collect())
    model = learn(Sample(rows, [i for i, _ in got]), np.array([y for _, y in got], np.int64), passes, drop, seed=seed)
    forget(rows)
    return model


class Sample:
    """The sampled texts, which stay in a table, and what tasks tell of them; ids: one for each place in the sample."""

    def __init__(self, rows: DataFrame, ids: list[int]):
        self.rows, self.at = rows.select("doc_id", "label", "text"), {i: k for k, i in enumerate(ids)}

    def strongest(self, net: Network) -> tuple[np.ndarray, list[list[str]]]:
        """Logit of each whole text, and its TOP strongest windows."""
        given = self.rows.sparkSession.sparkContext.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for t in chunks(b):
                    n, tk, w, raw = given.value, tokens(t), t.words(), t.data.tobytes()
                    z, row, best = text_windows(n, tk, TOP)
                    text = [b" ".join(raw[w.starts[k] : w.ends[k]] for k in range(s, s + c)).decode() for s, c in best.tolist()]
                    cut = np.searchsorted(row, np.arange(t.n + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, t.n), pa.array(z), pa.ListArray.from_arrays(pa.array(cut), pa.array(text, pa.string()))], names=["doc_id", "z", "windows"])

        got = self.rows.select("doc_id", "text").mapInArrow(run, "doc_id bigint, z double, windows array<string>").toArrow().to_pylist()
        given.destroy()
        z, windows = np.zeros(len(self.at)), [[] for _ in self.at]
        for r in got:
            z[self.at[r["doc_id"]]], windows[self.at[r["doc_id"]]] = r["z"], r["windows"]
        return z, windows

    def presence(self, train: np.ndarray) -> dict[str, np.ndarray]:
        """How many of the texts of each class at these places have each word and part."""
        ids = np.array(list(self.at), np.int64)[train]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = np.zeros((2, WORDS + 2 * PARTS), np.int64)
            for b in batches:
                mine, label = np.isin(int_column(b, "doc_id"), ids), int_column(b, "label")
                for t in chunks(b):
                    for k in np.flatnonzero(mine[t.first : t.first + t.n]).tolist():
                        own = present(tokens(Texts(t.data[t.offsets[k] : t.offsets[k + 1]], t.offsets[k : k + 2] - t.offsets[k])))
                        both[label[t.first + k], np.concatenate([own["word"], own["tri"] + WORDS, own["pre"] + WORDS + PARTS])] += 1
            side, bucket = np.nonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(both[side, bucket])], names=["label", "bucket", "n"])

        got = self.rows.mapInArrow(run, "label int, bucket int, n bigint").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
        both = np.zeros((2, WORDS + 2 * PARTS))
        both[got.column("label").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        return {"word": both[:, :WORDS], "tri": both[:, WORDS : WORDS + PARTS], "pre": both[:, WORDS + PARTS :]}


def learn(sample: Sample, y: np.ndarray, passes: int, drop: float, size: int = 32, rate: float = 0.01, seed: int = 11) -> Model:
    """`passes` steps of Adam on as many texts of label 1 as of label 0 each; a quarter of the texts is kept for calibration.
    The network is the mean of those of the second half of the steps."""
    if len(y) < 10 or not 0 < y.sum() < len(y):
        return Model(None, constant=float(y.mean()) if len(y) else 0.0)
    check = np.arange(len(y)) % 4 == 3
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check = np.ones(len(y), bool)
        train = np.arange(len(y))
    else:
        train = np.flatnonzero(~check)
    net, rng = Network(seed), np.random.default_rng(3)
    net.start(np.bincount(y[train], minlength=2), sample.presence(train))
    found: list[list[str]] = [[] for _ in y]
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(x) for k, x in net.p.items()}
    mean = {k: np.zeros_like(x) for k, x in net.p.items()}
    sides = [train[y[train] == k] for k in (0, 1)]
    for step in range(1, passes + 1):
        own = np.concatenate([rng.choice(s, min(size // 2, len(s)), replace=False) for s in sides])
        if step % REFRESH == 1:
            for had, now in zip(found, sample.strongest(net)[1], strict=True):
                had.extend(x for x in dict.fromkeys(now) if x not in had)
        t = tokens(_texts([x for i in own for x in found[i]]))
        on = (rng.random(len(t.bucket)) >= drop).astype(f32)
        words = net.embed(t, on)
        row, start, length = windows(t.offsets)
        if not len(row):
            continue
        row = np.repeat(np.arange(len(own)), [len(found[i]) for i in own])[row]
        z = net.forward(words, *gather(t, start, length))
        order = np.lexsort((-z, row))
        best = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        # the gradient goes through each text's strongest window
        place, live = gather(t, start[best], length[best])
        z, kept = net.forward(words, place, live, keep=True)
        target = y[own[row[best]]]
        dz = ((_gate(z) - target) / len(best)).astype(f32)
        g = net.backward(t, words, place, live, kept, dz, on)
        lr = rate * min(1.0, 2 * (1 - step / (passes + 1)))
        for k, d in g.items():
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            net.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(f32)
            if step > passes // 2:
                mean[k] += (net.p[k] - mean[k]) / (step - passes // 2)
    if passes:
        net.p = mean
    at = np.flatnonzero(check)
    return Model(net, *platt(sample.strongest(net)[0][at], y[at]))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, columns: list[str] | None = None) -> DataFrame:
    """All columns of docs (or those named) but score and predicted, then these two. What is not named need not come back from Python."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # about 6 MB at any input size
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    back = [i for i, c in enumerate(keep) if columns is None or c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([given.value.score(t) for t in chunks(b, size=1 << 20)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in back), pa.array(z), pa.array((z >= threshold).astype(np.int32))], names=[*(b.schema.names[i] for i in back), "score", "predicted"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(keep[i] for i in back)).schema.fields]
    return docs.select(*keep).mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def op7_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), columns=["doc_id"])
    return out.select("doc_id", held_out(out.doc_id, 5).alias("held_out"), "score", "predicted")
