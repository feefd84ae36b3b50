import random
import re
import zlib
from collections import Counter

from tillstream.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n string"


def counted(docs):
    out = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    n = counted(docs)
    form, out = {}, []
    for w in n:
        close = [v for v in n if v != w and one_apart(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out.append((w, len(close)))
    rows = []
    for w, near in out:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], near, n[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def result(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def changed(r, w):
    k = r.randrange(len(w))
    return r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("aebéÿ") + w[k:], w[:k] + r.choice("aebéÿ") + w[k + 1 :]])


def test_against_all_pairs(spark):
    r = random.Random(4)
    base = ["".join(r.choice("aabé") for _ in range(r.randint(5, 9))) for _ in range(40)] + ["commission", "aaaaaaaa", "öäüÖß÷×ÿ"]
    docs = []
    for i in range(260):
        words = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.12)), len(base) - 1)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 1, 2])):
                w = changed(r, w) or w
            words.append(w.upper() if r.random() < 0.1 else w)
        docs.append((i * 7 - 3, r.choice([" ", ", ", "1", "Ā", "\n"]).join(words)))
    docs += [(5, None), (6, ""), (None, "commission " * 7), (9, "commissjon " * 3), (9, "commissjon " * 3)]
    want = brute(docs)
    assert len(want) > 150 and any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 8 for r in want)
    assert result(spelling.variants(spark.createDataFrame([(a, b, "", "") for a, b in docs], SCHEMA))) == want


def test_odd_rows(spark):
    long, run = "ab" * 15000, "a" * 20000
    docs = [(1, f"{long} " * 6), (2, f"{long}c {run} {run}a " * 40), (3, "word " * 300000), (4, None)]
    rows = brute([(1, None)]) + sorted(((w, None, w, n, 0, None) for w, n in counted(docs).items()), key=str)
    got = result(spelling.variants(spark.createDataFrame([(a, b, "", "") for a, b in docs], SCHEMA)))
    assert [(x[0], x[3]) for x in got] == [(x[0], x[3]) for x in rows]
    near = {x[0]: x for x in got}
    assert near[long][1] == f"{long}c" and near[long][4] == 1 and near[run][4] == 1 and near[run][1] is None
    assert result(spelling.variants(spark.createDataFrame([], SCHEMA))) == []


def test_tries_have_each_node_once(spark):
    vocab = spark.createDataFrame([("ananas", 5, 0), ("banana", 6, 1), ("bandana", 7, 2)], "word string, n bigint, ord bigint")
    from tillstream.llm.tables import Scratch

    s = Scratch()
    tries = spelling.nodes(spelling.numbered(vocab, s)).collect()
    words = ["ananas", "banana", "bandana"]
    assert sum(x.trie == "down" for x in tries) == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    assert sum(x.trie == "up" for x in tries) == len({w[i:] for w in words for i in range(len(w))})
    assert sum(x.words for x in tries) == 2 * sum(map(len, words))
    s.clear()
