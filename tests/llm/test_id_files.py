import tempfile
import zlib

import numpy as np
import pytest

from tests.llm.test_packing import ODD, plain
from tillstream.llm import id_files, range_coder
from tillstream.llm.tables import table


@pytest.mark.parametrize(("shape", "most"), [((3, 50), 65536), ((2, 400), 1), ((40, 300), 5), ((1, 1), 50257), ((5, 700), 50257)])
def test_coder_round_trip(shape, most):
    x = np.random.default_rng(shape[1]).integers(0, most, shape)
    assert (range_coder.decode(range_coder.encode(x), shape[1]) == x).all()


def test_coder_is_adaptive_and_blocks_stand_alone():
    r = np.random.default_rng(1)
    x = r.choice(r.integers(0, 50000, 30), (20, 2048))
    coded = range_coder.encode(x)
    assert sum(map(len, coded)) < 0.55 * 2 * x.size  # ids take 16 bits each
    assert (range_coder.decode(coded[7:8], 2048) == x[7]).all()
    y = np.tile(np.arange(900, 950), 60)[:2048].reshape(1, -1)
    assert len(range_coder.encode(y)[0]) < 400


def test_damage_is_found():
    blocks = id_files.pack_blocks(np.arange(5000) % 700)
    assert (id_files.unpack_blocks(blocks) == np.arange(5000) % 700).all()
    bad = bytearray(blocks[1])
    bad[40] ^= 1
    with pytest.raises(ValueError):
        id_files.unpack_blocks([blocks[0], bytes(bad), blocks[2]])


def expected(rows, end=2):
    start, out = 0, []
    for d, ids in rows:
        ids = np.array([*ids, end], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark):
    docs = sorted((r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect())
    got = sorted(tuple(r) for r in id_files.op3_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == expected(list(zip([d for d, _ in docs], plain([t for _, t in docs]), strict=True)))


def test_odd_rows(spark, monkeypatch):
    rows = [(i, x, "own") for i, x in enumerate(ODD)]
    for k, given in enumerate((rows, [], [(None, "a", ""), (1, "b c", ""), (1, "b c", "")])):
        to = f"{tempfile.mkdtemp()}/x{k}"
        id_files.write_ids(spark.createDataFrame(given, "doc_id bigint, text string, part string"), to)
        got = [tuple(r) for r in id_files.read_ids(spark, to).orderBy("start").collect()]
        assert got == expected(list(zip([d for d, *_ in given], plain([t for _, t, _ in given]), strict=True)))
