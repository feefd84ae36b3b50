import random
import re
from collections import Counter

import numpy as np
import pytest

from tillstream.llm import ngram_join, shingles
from tillstream.llm.components import components

SCHEMA = "doc_id bigint, text string, n string, comp string"


def shingle_set(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(docs, size, num, den):
    sets = [(i, shingle_set(t, size)) for i, t in docs]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and None not in (sets[a][0], sets[b][0]) and den * len(x & y) >= num * len(x | y):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((-1 if i is None else i), len(s), (-1 if i is None else least[root(k)])) for k, (i, s) in enumerate(sets))


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


def corpus(seed, families, copies, words=60, vocabulary=400):
    r = random.Random(seed)
    prose = lambda n: [r.choice("abcdefgh") + str(r.randrange(vocabulary)) for _ in range(n)]
    out = []
    for _ in range(families):
        base = prose(r.randint(3, words))
        for _ in range(copies):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                k = r.randrange(len(x))
                x[k : k + r.choice([1, 1, 1, 4])] = r.choice([["zz"], prose(1), [], prose(2)])
            out.append(" ".join(x).upper() if r.random() < 0.2 else "  ".join(x))
    r.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "families", "copies", "size", "num", "den", "small"), [(1, 25, 8, 3, 9, 10, 16), (2, 4, 60, 3, 9, 10, 2), (3, 4, 60, 5, 4, 5, 3), (4, 3, 70, 1, 7, 10, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, families, copies, size, num, den, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    docs = corpus(seed, families, copies, vocabulary=30 if seed > 1 else 400)
    got = result(ngram_join.groups(spark.createDataFrame([(a, b, "", "") for a, b in docs], SCHEMA), size, num, den))
    assert got == brute(docs, size, num, den)


def test_size_bands_cover_similar_sizes():
    for num, den in ((9, 10), (4, 5), (1, 2)):
        first, differ = shingles.bands(num, den, 3000)
        for a in range(1, 2000, 7):
            b = a * den // num
            x, y = (first.searchsorted(v, "right") - 1 for v in (a, b))
            assert y - x <= 1 and differ[y] >= (a + b) * (den - num) // (den + num)


def test_odd_rows(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "a b c"), (11, "d e f"), (12, "d e f"), (None, "a b c"), (13, "a b c"), (14, "w " * 30000), (15, "w " * 20), (16, "x\ty\rz"), (3, "x y z"), (3, "x y z"), (20, "p q r s t u v w x y z a"), (21, "p q r s t u v w x y z a"), (21, "m n o p q r s t u v w x"), (22, "m n o p q r s t u v w x k")]
    docs = spark.createDataFrame([(a, b, "own", "own") for a, b in rows], SCHEMA)
    assert result(ngram_join.groups(docs, 3, 9, 10)) == brute(rows, 3, 9, 10)
    left = ngram_join.one_of_each(docs, 3, 9, 10)
    assert left.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, 3, 3, 5, 6, 7, 8, 10, 11, 11, 14, 20]
    assert result(ngram_join.groups(docs.limit(0))) == []


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.comp for r in components(links).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {101: 100}


def test_layouts_leave_a_clean_subset():
    r = random.Random(8)
    seen = set()
    for num, den in ((9, 10), (4, 5), (1, 2)):
        first, differ = shingles.bands(num, den, 3000)
        for size, k in zip(first.tolist(), differ.tolist()):
            n1, n2, k2, spare = shingles.layout(size, k)
            seen.add((n2, k2))
            for _ in range(20):
                hit = [r.randrange(n1 * n2) for _ in range(k)] if r.random() < 0.5 else [i % (n1 * n2) for i in range(k)]
                clean = sum(len(set(range(p * n2, p * n2 + n2)) & set(hit)) <= k2 for p in range(n1))
                assert clean > spare or k == 0
    assert any(n2 - k2 > 1 for n2, k2 in seen)


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_similar_sets_share_a_signature(num, den):
    r = np.random.default_rng(num)
    for size in [*range(1, 40), 60, 100, 250, 700]:
        for _ in range(12):
            base = r.integers(0, 2**63, 3 * size, dtype=np.uint64)
            a, b = set(base[:size].tolist()), set(base[:size].tolist())
            for x in base[size:].tolist():
                trial = (a - {next(iter(a))}, b | {x})[r.integers(2)] if r.integers(2) else b | {x}
                pair = (trial, b) if len(trial) < len(a) else (a, trial)
                if pair[0] and den * len(pair[0] & pair[1]) >= num * len(pair[0] | pair[1]):
                    a, b = pair
            rows = np.repeat([0, 1], [len(a), len(b)])
            row, sig = shingles.signatures(rows, np.array(sorted(a) + sorted(b), np.uint64), 2, num, den)
            assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())


def test_shared_beginnings(spark):
    docs = corpus(1, 25, 8)
    df = spark.createDataFrame([(a, b, "", "") for a, b in docs], SCHEMA).repartition(3)
    shared, bits = ngram_join.shared_beginnings(df, 3, 9, 10, 5000)
    got = sorted(r.h for r in shared.collect())
    seen = Counter(r.sig % 2**64 >> (64 - bits) for r in ngram_join.signed(df, 3, 9, 10).collect())
    assert got == sorted(h for h, c in seen.items() if c > 1) and got


def test_parities_differ_in_no_more_cells_than_sets_in_elements(spark):
    r = np.random.default_rng(5)
    shapes = [(1, 3, 0), (40, 0, 0), (40, 4, 1), (300, 12, 25), (300, 400, 90), (9000, 700, 200), (1000, 30, 60), (5000, 2, 2000)]
    rows = []
    for k, (size, more, less) in enumerate(shapes):
        x = r.integers(0, 2**63, size + more, dtype=np.uint64)
        p, q = ngram_join._parities(np.repeat([0, 1], [size, size + more - less]), np.concatenate([x[:size], x[less:]]), 2).to_pylist()
        rows.append((k, -k, size, size + more - less, p, q))
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, na bigint, nb bigint, p binary, q binary")
    for num, den in ((9, 10), (4, 5), (1, 2)):
        got = {x.a for x in ngram_join._few_odd(pairs, num, den).collect()}
        near = {k for k, (size, more, less) in enumerate(shapes) if den * (size - less) >= num * (size + more)}
        close = {k for k, (size, more, less) in enumerate(shapes) if 1.1 * den * (size - less) >= num * (size + more)}
        assert near <= got <= close


@pytest.mark.parametrize(("num", "den"), [(9, 10), (4, 5), (1, 2)])
def test_first_lacking_elements_are_few_and_enough(spark, num, den):
    r = random.Random(num)
    pivot = list(range(200))
    sets = [set(pivot) - set(r.sample(pivot, r.choice([2, 12, 25, 45, 110, 140]))) for _ in range(40)]
    core = set(r.sample(pivot, 70))
    sets += [(core | set(r.sample(pivot, k))) - set(r.sample(sorted(core), k)) for k in (0, 1, 1, 2, 2, 3, 5, 8) for _ in range(5)]
    sets = [s | {1000 * k + j for j in range(r.choice([0, 0, 1, 3]))} for k, s in enumerate(sets, 1)]  # nothing added in common
    near = lambda x, y: den * len(x & y) >= num * len(x | y)
    whole = set(pivot)
    rows = [(0, k, k, not near(s, whole), len(s), len(s - whole), len(whole - s), 200, sorted(whole - s)) for k, s in enumerate(sets)]
    shape = "a bigint, b bigint, comp bigint, out boolean, n bigint, na bigint, nb bigint, np bigint, less array<bigint>"
    got = {x.b: x for x in ngram_join.first_lacking(spark.createDataFrame(rows, shape), num, den).collect()}
    linked = 0
    for k, x in enumerate(sets):
        for m, y in enumerate(sets):
            if k != m and got[k].out and near(x, y):
                linked += 1
                i, j = min((i, got[m].first.index(e)) for i, e in enumerate(got[k].first) if e in got[m].first)
                assert i < got[k].outer and j < got[m].inner
    assert linked > 40 and sum(len(x.first) for x in got.values()) < (0.4 if num > 1 else 0.6) * sum(len(x[-1]) for x in rows)
