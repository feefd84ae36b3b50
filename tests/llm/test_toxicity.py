import numpy as np
import pyarrow as pa
import pytest

from tillstream.llm import toxicity as x
from tillstream.llm.tables import table
from tillstream.llm.textbytes import chunks


def texts(rows):
    return next(chunks(pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["text"])))


def test_windows_cover_all_words():
    row, start, n = x.windows(np.array([0, 0, 5, 29, 54, 1054]))
    for i, (lo, hi) in enumerate(zip([0, 0, 5, 29, 54], [0, 5, 29, 54, 1054], strict=True)):
        seen = [k for r, s, c in zip(row, start, n, strict=True) if r == i for k in range(s, s + c)]
        assert set(seen) == set(range(lo, hi))
    assert (row == 1).sum() == 1 and (row == 2).sum() == 1 and (row == 3).sum() == 2


def test_gradients_by_differences():
    net = x.Network(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = x.tokens(texts(["the cat sat on the mat " * 5, "one two"]))
    row, start, length = x.windows(t.offsets)
    place, live = x.gather(t, start, length)

    def loss():
        return float((net.forward(net.embed(t), place, live) * w).sum())

    w = np.linspace(-1, 1, len(row))
    old = x.f32
    x.f32 = np.float64
    try:
        _, kept = net.forward(net.embed(t), place, live, keep=True)
        g = net.backward(t, net.embed(t), place, live, kept, w)
        r = np.random.default_rng(0)
        for k, v in net.p.items():
            flat, grad = v.reshape(-1), g[k].reshape(-1)
            live_at = np.flatnonzero(grad)
            for i in r.choice(live_at, min(6, len(live_at)), replace=False):
                was = flat[i]
                flat[i] = was + 1e-5
                up = loss()
                flat[i] = was - 1e-5
                down = loss()
                flat[i] = was
                assert grad[i] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-7), k
    finally:
        x.f32 = old


def test_score_does_not_depend_on_the_batch():
    m = x.Model(x.Network(1), 1.0, 0.0)
    rows = ["a b c " * 40, None, "", "d e f", "long " * 900]
    whole = m.score(texts(rows))
    alone = [m.score(texts([r]))[0] for r in rows]
    assert np.allclose(whole, alone, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in x.op7_toxicity_bigru(spark, sf).collect()}
    assert len(rows) == table(spark, sf, "documents").count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    y = np.array([(r.toxic, rows[r.doc_id].predicted) for r in table(spark, sf, "labels").collect() if rows[r.doc_id].held_out])
    assert y[y[:, 0] == 1, 1].mean() > 0.8 and y[y[:, 0] == 0, 1].mean() < 0.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", 9), (1, "", "s", 9), (None, "w " * 20000, "s", 9), (2, "a b", None, 9)], "doc_id bigint, text string, source string, score int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    out = x.score(docs, x.fit(docs, none))
    assert out.columns == ["doc_id", "text", "source", "score", "predicted"] and [r.predicted for r in out.collect()] == [0] * 4
    few = spark.createDataFrame([(k, "you are an idiot" if k % 2 else "have a nice day") for k in range(40)], "doc_id bigint, text string")
    model = x.fit(few, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, toxic int"), hold_out=None, passes=60)
    got = x.score(docs.unionByName(few.selectExpr("doc_id + 100 as doc_id", "text", "'' as source", "0 as score")), model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id and r.doc_id >= 100) and x.score(docs.limit(0), model).count() == 0


def test_short_passages_of_long_texts_are_learned(spark):
    r = np.random.default_rng(0)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for d in range(80):
        text = r.choice(words, 6000).tolist()
        if d % 2:
            text[(at := int(r.integers(100, 5900))) : at + 4] = "you are an idiot".split()
        rows.append((d, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    model = x.fit(docs, spark.createDataFrame([(d, d % 2) for d in range(80)], "doc_id bigint, toxic int"), hold_out=None)
    got = {r.doc_id: r.predicted for r in x.score(docs, model).collect()}
    assert np.mean([got[d] == d % 2 for d in range(80)]) > 0.95


def test_logits_against_a_plain_network():
    net = x.Network(3)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rows = ["One two, three four five " * 9, "x", "été ß 日本語 words"]
    t = x.tokens(texts(rows))
    gate = lambda v: 1 / (1 + np.exp(-v))
    h = x.HIDDEN
    words = p["word"][t.bucket].copy()
    for name, (ids, first) in t.parts.items():
        for i in range(len(words)):
            words[i] += p[name][ids[first[i] : [*first, len(ids)][i + 1]]].mean(0)
    want = []
    for i in range(len(rows)):
        own = [words[k] for k in t.which[t.offsets[i] : t.offsets[i + 1]]]
        starts = range(0, max(1, len(own) - x.WINDOW + x.STRIDE), x.STRIDE)
        logits = []
        for s in starts:
            window = own[s : s + x.WINDOW]
            states = []
            for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
                now, seen = np.zeros(h), {}
                for k in order:
                    a, u = window[k] @ p[f"x{d}"] + p[f"b{d}"], now @ p[f"u{d}"]
                    z, r = gate(a[:h] + u[:h]), gate(a[h : 2 * h] + u[h : 2 * h])
                    now = z * now + (1 - z) * np.tanh(a[2 * h :] + r * u[2 * h :])
                    seen[k] = now
                states.append([seen[k] for k in range(len(window))])
            both = np.concatenate(states, 1)
            e = np.exp(np.tanh(both @ p["att"]) @ p["query"])
            logits.append((e / e.sum()) @ both @ p["out"] + p["bias"][0])
        want.append(max(logits))
    assert np.allclose(x.text_logits(net, t), want, atol=1e-4)
