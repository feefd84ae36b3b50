import random
import re

import numpy as np
import pyarrow as pa
import pytest
from xxhash import xxh64_intdigest

from tillstream.llm import simhash, spans

SCHEMA = "doc_id bigint, text string, fp string, times string"


def fingerprint(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute(docs, radius, size=4):
    fps = [fingerprint(t, size) for _, t in docs]
    comp = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if None not in (docs[a][0], docs[b][0]) and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = comp[a], comp[b]
                comp = [x if c == y else c for c in comp]
    ids = [-1 if i is None else i for i, _ in docs]
    least = {c: min(i for i, d in zip(ids, comp) if d == c) for c in comp}
    return sorted((i, f"{f:016x}", least[c]) for i, f, c in zip(ids, fps, comp))


def result(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", -1 if r.component_id is None else r.component_id) for r in df.collect())


def corpus(seed, families, copies):
    r = random.Random(seed)
    out = []
    for _ in range(families):
        base = [r.choice("abcdefgh") + str(r.randrange(300)) for _ in range(r.randint(1, 120))]
        for _ in range(copies):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                x[r.randrange(len(x))] = r.choice(["zz", "éà", "Q"])
            out.append("  ".join(x).upper() if r.random() < 0.2 else "\n".join(x))
    r.shuffle(out)
    return [(i * 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("seed", "families", "copies", "radius", "members", "tile"), [(1, 40, 8, 4, 2048, 4096), (2, 5, 60, 4, 4, 16), (3, 30, 6, 7, 8, 32), (4, 30, 6, 0, 8, 32)])
def test_against_all_pairs(spark, monkeypatch, seed, families, copies, radius, members, tile):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "TILE", tile)
    docs = corpus(seed, families, copies)
    assert result(simhash.groups(spark.createDataFrame([(a, b, "", "") for a, b in docs], SCHEMA), 4, radius)) == brute(docs, radius)


def test_bit_planes_count_distances():
    r = np.random.default_rng(5)
    for n, spread in ((1, 64), (64, 3), (65, 12), (700, 9), (700, 64)):
        bits = np.zeros((n, 64), np.uint8)
        bits[:, :spread] = r.random((n, spread)) < 0.3
        fps = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)
        apart = (bits[:, None] != bits[None]).sum(2)
        for radius in (0, 3, 4, 7):
            found = np.unpackbits(simhash.near(fps, radius).view(np.uint8), axis=1, bitorder="little")[:, :n]
            assert (found == ((apart <= radius) & ~np.eye(n, dtype=bool))).all()


def test_every_choice_of_blocks():
    for n in (10, 10**6, 10**8, 10**10):
        chosen, bits = simhash.layout(n, 4)
        assert all(any(not set(c) & {a, b, d, e} for c in map(set, chosen)) for a, b, d, e in (random.Random(k).sample(range(64), 4) for k in range(200)))
        assert bits <= min(map(len, chosen))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (5, "one"), (6, "a b c"), (6, "p q r s t"), (None, "a b c"), (7, "A  b\nc"), (8, "w " * 40000), (9, "w " * 9), (10, "x" * 5000 + " y z"), (11, "p q r s t")]
    docs = spark.createDataFrame([(a, b, "own", "own") for a, b in rows], SCHEMA)
    want = brute(rows, 4)
    assert result(simhash.groups(docs)) == want
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, 1, 4, 6, 6, 8, 10]
    assert result(simhash.groups(docs.limit(0))) == []


def test_spans_repeat_the_last_words(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "bc", " ", "\n ", "é", "x" * 30]) for _ in range(r.randint(0, 400))) for _ in range(30)] + ["one" + " " * 200 + "two", " " * 300, "a b c" + " " * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for lap in (3, 0, 1):
        got = {}
        for s in spans.spans(batch, spans.SPACED, lap, 50):
            start, end, row = spans.words(s, spans.SPACED)
            assert sum(start < s.lead) == (min(lap, len(got.get(s.first, []))) if s.n == 1 else 0)
            for a, b, i in zip(start, end, row):
                if a >= s.lead:
                    got.setdefault(s.first + i, []).append(bytes(s.data[a:b]).decode())
        assert [got.get(i, []) for i in range(33)] == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    monkeypatch.setattr(spans, "CHUNK", 50)
    assert [f"{f & (1 << 64) - 1:016x}" for f in simhash.bits_of(batch, 4)[0].tolist()] == [f"{fingerprint(t):016x}" for t in texts]
