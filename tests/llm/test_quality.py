import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillstream.llm import features, nbsvm, quality_rules, textbytes
from tillstream.llm.tables import held_out, table

SF = "/root/testdata/sf0.01"
TEXTS = [
    None, "", " ", "one", "a b c d e f g h i j k", "a a a a a a a", "x\ny\nx\n\n \n\nx", "é ü # $$ <b> |\n", "a b c d e z a b c d e q a b c d e",
    "tail\n", "\n", "A\tb\rC\x0bd\x0ce", "no break ñandú", "line one\nline one \nline one", "w " * 3000 + "end", "last",
]


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    cover = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
def test_measures_against_brute_force(size):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = []
    for t in textbytes.chunks(batch(TEXTS), size=size):
        m = quality_rules.measures(t)
        got += list(zip(*(m[c].tolist() for c in names), strict=True))
    assert got == [brute(t) for t in TEXTS]


def test_word_hashes_do_not_depend_on_the_place():
    h = [t.words().hashes().tolist() for t in textbytes.chunks(batch(["aa bb", "x aa", "bb"]), size=1)]
    assert h[0] == [h[1][1], h[2][0]]


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents"), table(spark, SF, "labels")


def accuracy(rows, labels, p):
    y = {r.doc_id: r.quality for r in labels.collect()}
    pairs = [(y[r.doc_id], p(r)) for r in rows if r.doc_id in y]
    bad = [k for v, k in pairs if v == 0]
    good = [k for v, k in pairs if v == 1]
    return np.mean(good), 1 - np.mean(bad)


def test_rules_keep_good_and_drop_bad(spark, tables):
    docs, labels = tables
    rows = quality_rules.op2_quality_rules(spark, SF).collect()
    assert len(rows) == docs.count()
    kept, dropped = accuracy(rows, labels, lambda r: r.kept)
    assert kept > 0.9 and dropped > 0.8


def test_nbsvm_on_rows_that_it_did_not_learn_from(spark, tables):
    docs, labels = tables
    rows = nbsvm.op9_quality_nbsvm(spark, SF).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    kept, dropped = accuracy([r for r in rows if r.held_out], labels, lambda r: r.predicted)
    assert kept > 0.9 and dropped > 0.7


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "s", 9), (1, "", "s", 9), (None, "w " * 20000, "s", 9), (2, "a b", None, 9)], "doc_id bigint, text string, source string, score int")
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id bigint, quality int")
    for labels in (none, one):
        out = nbsvm.score(docs, nbsvm.fit(docs, labels, hold_out=None))
        assert out.columns == ["doc_id", "text", "source", "score", "predicted"] and [r.predicted for r in out.collect()] == [1] * 4
        assert [r.kept for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()] == [False] * 4
    empty = docs.limit(0)
    assert nbsvm.score(empty, nbsvm.fit(empty, none)).count() == 0 and quality_rules.judge(empty, quality_rules.fit(empty, none)).count() == 0


def test_rules_on_rows_that_they_did_not_learn_from(spark, tables):
    docs, labels = tables
    rows = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.fit(docs, labels, hold_out=5), columns=["doc_id"])
    rows = rows.where(held_out(F.col("doc_id"), 5)).collect()
    kept, dropped = accuracy(rows, labels, lambda r: r.kept)
    assert kept > 0.9 and dropped > 0.7


def test_character_grams_against_brute_force():
    texts = ["", "Ab", "ñé a", "日本語", "aab aab"]
    [t] = textbytes.chunks(batch(texts))
    for n, (rows, buckets) in zip((1, 2, 3), features.grams(t), strict=False):
        want = [(i, x[k : k + n]) for i, x in enumerate("".join(c.lower() if c < "\x80" else c for c in x) for x in texts) for k in range(len(x) - n + 1)]
        assert rows.tolist() == [i for i, _ in want]
        assert len(set(buckets.tolist())) == len({g for _, g in want}) == len(set(zip([g for _, g in want], buckets.tolist(), strict=True)))


def test_dual_coordinate_descent_against_the_primal():
    r = np.random.default_rng(4)
    x = [(np.sort(r.choice(6, 3, replace=False)), r.standard_normal(3)) for _ in range(40)]
    y = np.where(r.random(40) < 0.4, 1.0, -1.0)
    cost = np.full(40, 0.3)
    w, b = nbsvm.dual_coordinate_descent(x, y, cost, 400)
    dense = np.zeros((40, 7))
    for i, (f, v) in enumerate(x):
        dense[i, f] = v
    dense[:, 6] = 1

    def loss(u):
        return u @ u / 2 + cost @ np.maximum(0, 1 - y * (dense @ u))

    own, best = np.append(w[:6], b), np.zeros(7)
    u = np.zeros(7)
    for k in range(1, 60001):  # plain subgradient steps on the same problem
        u = u - (u - (cost * y * (y * (dense @ u) < 1)) @ dense) / (k + 10)
        best = u if loss(u) < loss(best) else best
    assert loss(own) <= loss(best) + 1e-3 and np.allclose(own, best, atol=0.05)


def test_ratios_against_counts():
    class Own:
        y = np.array([1, 1, 0])
        rows = [np.array([0, 1]), np.array([1]), np.array([1, 2])]

        def row(self, i):
            return self.rows[i], None

    got = nbsvm.log_count_ratio(Own(), np.arange(3))
    p, q = np.ones(nbsvm.SIZE), np.ones(nbsvm.SIZE)
    p[:2] += [1, 2]
    q[1:3] += [1, 1]
    want = np.log(p / p.sum()) - np.log(q / q.sum())
    assert np.allclose(got[:3], want[:3]) and not got[3:].any()
