import random
import re

import duckdb
import pytest

from tillstream.llm import line_dedup

SCHEMA = "doc_id bigint, text string, n_lines string, gone string, d string"


def brute(docs, m):
    """Every run of m words and more, of any length, against every earlier one."""
    seqs = []
    for doc, text in docs:
        x = [(i, t) for i, t in enumerate(s.strip(" \t\n\x0b\x0c\r") for s in text.split("\n")) if t]
        seqs.append((doc, x))
    first, gone = {}, set()
    for doc, x in sorted(seqs):
        for s in range(len(x)):
            for e in range(s + 1, len(x) + 1):
                body = tuple(t for _, t in x[s:e])
                if sum(len(re.split(r"[ \t\n\x0b\x0c\r]+", t)) for t in body) >= m:
                    first.setdefault(body, []).append((doc, s))
    for doc, x in seqs:
        for body, places in first.items():
            fd, fs = min(places)
            for d, s in places:
                if d == doc and (d, s) != (fd, fs):
                    gone |= {(doc, x[j][0]) for j in range(s, s + len(body)) if not (d == fd and j < fs + len(body))}
    return gone


@pytest.mark.parametrize(("seed", "m"), [(1, 1), (2, 3), (3, 5), (4, 8), (5, 12), (6, 4)])
def test_against_all_runs(spark, seed, m):
    r = random.Random(seed)
    line = lambda: " ".join(r.choice("ab") for _ in range(r.randint(1, 3)))
    docs = []
    for n in range(25):
        own = [r.choice([line(), line(), "", "  ", f"only {n} {r.random()}", " c d\t"]) for _ in range(r.randint(0, 12))]
        for _ in range(r.randint(0, 3)):  # a passage of an earlier text, or of this one
            x = (docs[r.randrange(len(docs))][1].split("\n") if docs else []) + own
            s = r.randint(0, len(x))
            own[r.randint(0, len(own)) :] = x[s : s + r.randint(1, 15)]
        docs.append((n, "\n".join(own)))
    rows = line_dedup.dedup_lines(spark.createDataFrame([(a, b, "x", "y", "z") for a, b in docs], SCHEMA), m).collect()
    gone = brute(docs, m)
    want = {n: ("\n".join(x for i, x in enumerate(t.split("\n")) if (n, i) not in gone), sum(a == n for a, _ in gone)) for n, t in docs}
    assert {x.doc_id: (x.text, x.n_removed) for x in rows} == want and gone
    assert rows[0].asDict().keys() == {"doc_id", "text", "gone", "d", "n_lines", "n_removed"}


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(line_dedup.ORACLE_SQL).fetchall()}
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.op5_line_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(v[2] for v in got.values())


def test_odd_rows(spark):
    body = "a b c d e f g h i j\nk l m n o p q r s t"
    rows = [(1, None), (2, ""), (3, body), (3, body), (4, f"\n{body}\nown line"), (None, body), (5, "\n".join(f"row {i % 977} of many words in one line that say nothing new at all to any reader here or there" for i in range(4000)))]
    out = line_dedup.dedup_lines(spark.createDataFrame([(a, b, "", "", "") for a, b in rows], SCHEMA))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_removed))
    assert got[1] == [(None, 0)] and got[2] == [("", 0)] and got[3] == [("", 2)] * 2 and got[4] == [("\nown line", 2)] and got[None] == [(body, 0)]
    assert got[5][0][1] == 4000 - 977
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []
