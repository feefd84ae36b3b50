import zlib

import numpy as np
import pyarrow as pa
import pytest

from tillstream.llm import packing, tokens
from tillstream.llm.tables import table
from tillstream.llm.textbytes import chunks

ODD = [
    "", None, " ", "  a  b ", "a\n\nb", "a \nb\n c", "\n", "don't we'll x 's", "<|endoftext|> a", "é ü 　x y", "tab\tb \x0b\x1c \x85z", "  lead", "trail  ", "a\r\nb",
    "日本語 テスト x", "1 2 33 4a a4", "x" * 3000, "!! ?? ..", "🙂 🙂\n🙂", "ñ   b \u0085 c", "a  b", "a  b", "Ġ Ċ", "\x00 \x01a",
]


def plain(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def encoded(texts, size):
    out = []
    for t in chunks(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), size=size):
        ids, o = tokens.opened(tokens.default_path()).encode(t)
        out += [ids[i:j].tolist() for i, j in zip(o, o[1:], strict=False)]
    return out


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_ids_are_those_of_whole_texts(spark, size):
    texts = ODD + [r.text for r in table(spark, "/root/testdata/sf0.001", "documents").limit(80).collect()]
    assert encoded(texts, size) == plain(texts)


def test_random_white_space():
    r = np.random.default_rng(1)
    parts = [" ", "\n", "a", "é", "1", "'s", ".", " ", "\t", " ", "b c", "　"]
    texts = ["".join(r.choice(parts, 12)) for _ in range(3000)]
    assert encoded(texts, 1 << 20) == plain(texts)


def padding(rows, window):
    ends = {}
    for r in rows:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    return sum(0 if e & (e - 1) == 0 else window - e for e in ends.values()), sum(ends.values())


def check(rows, texts, window=1024, end=0):
    ids = {k: [*v, end] for k, v in zip([k for k, _ in texts], plain([t for _, t in texts]), strict=True)}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert got.keys() == ids.keys()
    for k, v in got.items():
        v.sort(key=lambda r: r.start)
        assert [r.start for r in v] == [0, *np.cumsum([r.length for r in v])[:-1]] and sum(r.length for r in v) == len(ids[k])
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in windows.values():
        v.sort()
        assert [o for o, _ in v] == [0, *np.cumsum([n for _, n in v])[:-1]] and sum(n for _, n in v) <= window
    assert sorted(windows) == list(range(len(windows)))


def test_packs_all_documents(spark):
    rows = packing.op8_pack(spark, "/root/testdata/sf0.01").collect()
    texts = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    check(rows, texts)
    pad, total = padding(rows, 1024)
    assert pad < 0.02 * total


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, length string, task int"
    rows = [(i, x, "own", 3) for i, x in enumerate(ODD)]
    check(packing.pack(spark.createDataFrame(rows, schema)).collect(), [(i, x) for i, x in enumerate(ODD)])
    twice = packing.pack(spark.createDataFrame([(1, "a b c", "", 0), (1, "a b c", "", 0), (None, "a", "", 0)], schema)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in twice) == [(0, 2), (1, 4), (1, 4)]
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_each_rank_once(seed):
    r = np.random.default_rng(seed)
    hist = np.zeros(1025, np.int64)
    hist[1:] = r.integers(0, [3, 200, 5000, 1][seed], 1024)
    hist[100 if seed < 3 else 600] = 20000
    p = packing.plan(hist)
    length = np.repeat(np.arange(1025), hist)
    rank = np.concatenate([np.arange(n) for n in hist])
    w, o = p.place(length, rank)
    assert len(set(zip(w.tolist(), o.tolist(), strict=True))) == len(w)
    fill = np.bincount(w, weights=length, minlength=p.windows)
    assert fill.max() <= 1024 and fill.min() > 0
