import random

import numpy as np
import pyarrow as pa

from tillstream.llm import decontaminate as d
from tillstream.llm.textbytes import Texts, chunks

DOCS = "doc_id bigint, text string, item_id string"


def distance(p, t):
    """Least edit distance of p to a part of t, by the full table."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def plain(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return d.normalised(Texts(raw, np.array([0, len(raw)])))[0].tobytes()


def test_normalised_texts_and_places():
    t = next(chunks(pa.RecordBatch.from_arrays([pa.array(["  A--b", None, "É x!", "!"])], names=["text"])))
    b, offsets, at = d.normalised(t)
    assert b.tobytes() == b"a b" + "É".encode() + b" x " and offsets.tolist() == [0, 3, 3, 8, 8] and at[0] == 2


def test_myers_against_the_full_table():
    r = random.Random(3)
    for _ in range(60):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90))).encode()
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120))).encode()
        best, end = d.myers(p, t)
        assert best == distance(p, t) and distance(p, t[:end]) == best


def test_finds_all_passages_within_the_budget(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(r.randint(8, 40))) for i in range(12)]
    docs = []
    for n in range(120):
        _, text = items[r.randrange(12)]
        s = list(text)
        for _ in range(r.randint(0, int(len(s) * 0.14))):
            i = r.randrange(len(s))
            s[i : i + 1] = r.choice([[], ["x"], ["q", s[i]]])
        docs.append((n, f"{prose(30)}. {''.join(s).capitalize()}!\n{prose(20)}" if n % 5 else prose(60), "own"))
    got = {(x.doc_id, x.item_id): x.distance for x in d.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for n, text, _ in docs:
        for i, item in items:
            p = plain(item).strip()
            if (e := distance(p, plain(text))) <= int(len(p) * 0.1):
                want[n, i] = e
    assert got == want and len(want) > 40
    kept = {x.doc_id for x in d.clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=200).collect()}
    assert kept == {n for n, _, _ in docs} - {n for n, _ in want}


def test_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog of the neighbour."
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, item.upper(), "a"), (3, item, "a"), (None, "x" * 200000 + " " + item, "a"), (4, item[:20], "a")], DOCS)
    bench = spark.createDataFrame([(7, item, 0), (7, item, 0), (8, None, 0), (9, "of the", 0), (None, "!!", 0)], "item_id bigint, text string, doc_id int")
    got = sorted((x.doc_id or 0, x.item_id, x.distance, x.start_byte) for x in d.matches(docs, bench).collect())
    at = item.index("of the")  # a short item counts where it stands as whole words
    assert got == sorted([(0, 7, 0, 200001)] * 2 + [(3, 7, 0, 0)] * 4 + [(0, 9, 0, 200001 + at)] + [(3, 9, 0, at)] * 2)
    assert sorted(x.doc_id for x in d.clean(docs, bench).collect()) == [1, 2, 4]
    assert d.matches(docs.limit(0), bench).count() == 0 and d.matches(docs, bench.limit(0)).count() == 0 and d.clean(docs, bench.limit(0)).count() == 6


def test_short_items_are_found_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "Well, x = 42!"), (2, "x = 421"), (3, "max 42"), (4, "X 42"), (5, "a x 42 x 421"), (6, "x 421 x 42"), (7, "42")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "x=42"), (2, ""), (3, None), (4, "?!")], "item_id bigint, text string")
    assert {r.doc_id: r.distance for r in d.matches(docs, items).collect()} == {1: 0, 4: 0, 5: 0, 6: 0}
    assert sorted(r.doc_id for r in d.clean(docs, items).collect()) == [2, 3, 7]


def test_the_budget_goes_by_length_alone(spark):
    items = [(1, "pale blue moon shine"), (2, "ten bytes."), (3, "nine byte"), (4, "the wide river bends north")]  # budgets 2, 0, 0, 2
    docs = [(1, "a pale blve moonn shine"), (2, "pale bluue mon shyne"), (3, "ten bytes"), (4, "often bytes"), (5, "xnine byte"), (6, "the wode river bend north"), (7, "Pale. BLUE, mon shine")]
    got = {(r.doc_id, r.item_id): r.distance for r in d.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, 1): 2, (3, 2): 0, (6, 4): 2, (7, 1): 1}
