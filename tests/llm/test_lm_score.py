import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tillstream.llm import lm_score, ppm
from tillstream.llm.tables import table

SCHEMA = "doc_id bigint, text string, score string, row string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def unigram(docs):
    c = Counter(w for d, t in docs if not out(d) for w in tokens(t))
    ends = sum(not out(d) for d, _ in docs)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    p = lambda k: math.log10((k + 0.1) / (n + 0.1 * (v + 1)))
    return [(d, out(d), len(tokens(t)) + 1, sum(c[w] > 0 for w in tokens(t)) + (ends > 0), n, p(ends) + sum(p(c[w]) for w in tokens(t))) for d, t in docs]


def plain(text):
    return (" ".join(tokens(text)) + "\n").encode()


def test_base_scores_and_better_predictions(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    got = {r.doc_id: r for r in lm_score.op6_lm_ppm(spark, "/root/testdata/sf0.01").collect()}
    for d, held, n, known, train, base in unigram(docs):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and math.isclose(r.base_score, base, rel_tol=1e-9)
    assert len(got) == len(docs)
    rows = [r for r in got.values() if r.held_out]
    text = dict(docs)
    bits = -sum(r.score for r in rows) / math.log10(2) / sum(len(plain(text[r.doc_id])) for r in rows)
    assert bits < 2.3


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAVY", 4)
    rows = [(1, None), (2, ""), (3, "a a a b"), (3, "a a a b"), (None, "A\tb c"), (4, "x" * 100000), (5, "rare words only"), (20, "a b"), (28, "unseen a")]
    got = lm_score.score(spark.createDataFrame([(a, b, "", "") for a, b in rows], SCHEMA)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(unigram(rows), key=key)
    assert [tuple(r)[:5] for r in sorted(got, key=key)] == [r[:5] for r in want]
    assert np.allclose([r.base_score for r in sorted(got, key=key)], [r[5] for r in want])
    assert lm_score.score(spark.createDataFrame([], SCHEMA)).collect() == []
    only = [d for d in range(200) if out(d)][:1]
    r = lm_score.score(spark.createDataFrame([(only[0], "a b", "", "")], SCHEMA)).first()
    assert r.held_out and r.n_known == 0 and r.base_score == 0 and r.train_tokens == 0


def every_context(train, order=6):
    """All byte contexts as nested dictionaries, symbol by symbol."""
    trie = defaultdict(Counter)
    for t in train:
        b = bytes(order) + plain(t)
        for i in range(order, len(b)):
            for k in range(order + 1):
                trie[b[i - k : i]][b[i]] += 1

    def predict(ctx):
        low = predict(ctx[1:]) if ctx else [1 / 256] * 256
        c = trie.get(ctx)
        if not c:
            return low
        n, once = sum(c.values()), sum(v == 1 for v in c.values()) + 0.5
        escape, rest = once / (n + once), 1 - sum(low[s] for s in c)
        return [c[s] / n * (1 - escape) if s in c else escape * low[s] / rest for s in range(256)]

    def score(t):
        b = bytes(order) + plain(t)
        return sum(math.log10(predict(b[i - order : i])[b[i]]) for i in range(order, len(b)))

    return score


@pytest.mark.parametrize("grams", [1 << 20, 50])
def test_scores_are_those_of_all_byte_contexts(spark, monkeypatch, grams):
    monkeypatch.setattr(lm_score, "GRAMS", grams)
    texts = [r.text[:300] for r in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").limit(60).collect()]
    texts += ["année 1984, été 1985; straße 12", "год 1984 и год 1985", "année 1985, été 1984; straße 21", "год 1985 и ещё 1984", "", None]
    docs = list(enumerate(texts)) + [(d, t) for d, t in zip((d for d in range(100, 999) if out(d)), texts[-6:])]
    want = every_context([t for d, t in docs if not out(d)])
    got = {r.doc_id: r.score for r in lm_score.score(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert sum(map(out, got)) >= 6 and all(math.isclose(got[d], want(t), rel_tol=1e-9) for d, t in docs)


def test_keys_and_their_table():
    r = np.random.default_rng(3)
    texts = [r.integers(0, 256, n).tolist() for n in (1, 2, 5, 6, 7, 8, 40, 1, 300, 3)]
    offsets = np.cumsum([0, *map(len, texts)])
    for order in (1, 2, 3, 6):
        want = [sum((t[i - k] if i >= k else 0) << 8 * k for k in range(order + 1)) for t in texts for i in range(len(t))]
        assert ppm.keys(np.array(sum(texts, []), np.uint8), offsets, order).tolist() == want
    known = np.unique(r.integers(0, 2**56, 20000))
    asked = np.concatenate([known[::-1], r.integers(0, 2**56, 5000), known[:7] + 1])
    place = {k: i for i, k in enumerate(known.tolist())}
    assert ppm.Level(known).find(asked).tolist() == [place.get(k, -1) for k in asked.tolist()]
    assert ppm.Level(known[:0]).find(asked[:3]).tolist() == [-1] * 3
