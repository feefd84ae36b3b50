import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tillstream.llm import crc, resample, spans

SCHEMA = "doc_id bigint, text string, score string, rank string"


def feats(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    for rows, into in ((docs, s), (target, t)):
        for _, x in rows:
            for b in feats(x)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        n, f = feats(x)
        weight, score = sum(gain[b] for b in f), None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), weight, score, n])
    able = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(able):
        r.append(k + 1 if k < percent * len(able) // 100 else None)
    return sorted(((str(r[0]), r[1], r[2], r[3], r[5] if len(r) > 5 else None) for r in rows), key=str)


def result(df):
    return sorted(((str(r.doc_id), r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def frames(spark, docs, target):
    return spark.createDataFrame([(a, b, "", "") for a, b in docs], SCHEMA), spark.createDataFrame(target, "item_id bigint, text string")


def test_against_plain_python(spark):
    r = random.Random(1)
    word = lambda: r.choice(["Alpha", "beta", "é" * r.randint(1, 3), "x1", "q" * r.randint(1, 90), str(r.randrange(50))])
    docs = [(r.randrange(-50, 10**6), r.choice([" ", "-", "\n", "_,"]).join(word() for _ in range(r.randint(0, 60)))) for _ in range(400)]
    docs += [(7, None), (8, ""), (None, "beta " * 30), (9, " ".join(["x1 beta"] * 20000))]
    target = [(k, " ".join(word() for _ in range(40))) for k in range(20)] + [(99, None)]
    a, b = frames(spark, docs, target)
    assert result(resample.resample(a, b, 50)) == brute(docs, target, 50)


def test_odd_tables(spark):
    docs = [(3, "one two " * 15)] * 4 + [(4, "one two " * 15), (5, "ONE, two-" * 15), (-(2**63), "one " * 25), (2**63 - 1, "two " * 25)]
    a, b = frames(spark, docs, [])
    got = result(resample.resample(a, b, 60))
    want = brute(docs, [], 60)
    assert got == want and sorted(x[4] for x in got if x[4]) == [1, 2, 3, 4]
    assert result(resample.resample(a.limit(0), b)) == []
    assert result(resample.resample(a.where("doc_id is null"), b)) == []


@pytest.mark.parametrize(("digit", "block"), [(3, 4), (5, 2), (12, 17)])
def test_radix_sort_is_a_stable_sort(spark, digit, block):
    r = random.Random(digit)
    rows = [(r.choice([0, 5, r.randrange(2000)]), k) for k in range(700)]
    df = spark.createDataFrame(rows, "key bigint, own bigint").repartition(5)
    from pyspark.sql import functions as F

    low = resample.digits_of(F.col("own"), 0, 699, digit)
    got = resample.radix_sorted(df, low + resample.digits_of(F.col("key"), 0, 2000, digit), digit, block).orderBy("place").collect()
    assert [(x.key, x.own) for x in got] == sorted(rows) and [x.place for x in got] == list(range(700))


def test_sums_of_concatenations():
    r = np.random.default_rng(2)
    parts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 5, 63, 64, 65, 127, 128, 1000, 70000)]
    for a in parts[:4]:
        c = crc.carried(np.array([zlib.crc32(a)] * len(parts), np.uint32), np.array([len(p) for p in parts]))
        assert (c ^ np.array([zlib.crc32(p) for p in parts], np.uint32)).tolist() == [zlib.crc32(a + p) for p in parts]


def test_spans_of_a_long_text_have_all_features(monkeypatch):
    import pyarrow as pa

    r = random.Random(9)
    texts = ["".join(r.choice(["ab", "C", " ", "--", "é", "7"]) for _ in range(r.randint(0, 3000))) for _ in range(20)]
    monkeypatch.setattr(spans, "CHUNK", 300)
    got = [[] for _ in texts]
    n = [0] * 20
    for first, _, row, bucket, own in resample.features(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])):
        for i, b in zip(row, bucket):
            got[first + i].append(int(b))
        for i in own:
            n[first + i] += 1
    assert [(k, sorted(g)) for k, g in zip(n, got)] == [(k, sorted(f)) for k, f in map(feats, texts)]
