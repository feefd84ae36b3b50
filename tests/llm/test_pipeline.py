import random

import duckdb
import pandas as pd
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_decontaminate import distance, plain
from tests.llm.test_ngram_join import brute as grouped
from tests.llm.test_packing import check
from tests.llm.test_packing import plain as encoded_plain
from tillstream.llm import line_dedup, nbsvm
from tillstream.llm.tables import BATCH_BYTES, kept, table

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = kept(stage(spark, docs, SF), "test-stage")
        tables[name] = (before, docs)
        assert name == "packing" or docs.columns == columns

    before, after = tables["quality classifier"]
    scores = nbsvm.score(table(spark, SF, "documents"), nbsvm.fit(table(spark, SF, "documents"), labels))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scores.collect() if r.score >= 0.3}

    before, after = tables["line dedup"]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": list(before), "text": list(before.values())}))
    want = {d: (t, len(t)) for d, t, _, _ in con.sql(line_dedup.ORACLE_SQL).fetchall()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == want and want.keys() == before.keys()

    before, after = tables["n-gram Jaccard join"]
    least = {d: c for d, _, c in grouped(list(before.items()), 5, 4, 5)}
    assert {r.doc_id for r in after.collect()} == {d for d, c in least.items() if d == c}

    before, after = tables["benchmark decontamination"]
    items = [plain(r.text).strip() for r in table(spark, SF, "benchmark").collect()]
    left = {r.doc_id for r in after.collect()}
    whole = {d for d, t in before.items() if any(i in plain(t) for i in items)}
    assert not left & whole and len(left) > 0.8 * len(before)
    for d in sorted(before.keys() - left - whole):
        assert any(distance(i, plain(before[d])) <= int(len(i) * 0.1) for i in items)

    before, after = tables["packing"]
    check(after.collect(), list(before.items()))


def test_run_gives_what_the_stages_give(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, SF), "test-stage")
    rows = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, SF)) == rows(docs)


def test_stages_on_odd_rows(spark, tmp_path):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    item = " ".join(word() for _ in range(14))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(3000))
    near = " ".join(word() for _ in range(60))
    run = "\n".join(" ".join(word() for _ in range(12)) for _ in range(2))
    rows = [
        (1, None), (2, ""), (3, near), (3, near), (4, near + " more"), (5, f"{word()} {item} {word()}"), (None, near), (6, long), (7, f"head {word()}\n{run}\ntail {word()}"), (8, f"{run}\nother {word()}"), (None, None), (9, "\n \n"),
    ]
    names = ("score", "n_lines", "d", "k", "hit", "component_id", "node", "bits", "start")
    shape = "doc_id bigint, text string, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame([(*x, *names) for x in rows], shape).repartition(3)
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((x.doc_id is not None, x.doc_id or 0) for x in df.collect())
    every = sorted((d is not None, d or 0) for d, _ in rows)
    out = stages["quality classifier"](spark, docs, sf)
    assert out.columns == docs.columns and ids(out) == every and all(x[c] == c for x in out.collect() for c in names)
    out = stages["line dedup"](spark, docs, sf)
    text = {}
    for x in out.collect():
        text.setdefault(x.doc_id, []).append(x.text)
        assert [x[c] for c in names] == list(names)
    assert out.columns == docs.columns and ids(out) == every and text[1] == [None] and text[3] == ["", ""] and text[6] == [long] and text[8][0].startswith("other") and text[7] == [rows[8][1]] and sorted(text[None], key=str) == [None, near]
    out = stages["n-gram Jaccard join"](spark, docs, sf)
    assert out.columns == docs.columns and ids(out) == [x for x in every if x[1] != 4]
    out = stages["benchmark decontamination"](spark, docs, sf)
    assert out.columns == docs.columns and ids(out) == [x for x in every if x[1] != 5]
    pieces = stages["packing"](spark, docs, sf).collect()
    assert sorted((x.doc_id or 0) for x in pieces if x.start == 0) == sorted((d or 0) for d, _ in rows)
    assert sum(x.length for x in pieces) == sum(len(i) + 1 for i in encoded_plain([t for _, t in rows]))
    assert [stage(spark, docs.limit(0), sf).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_texts_go_to_python_in_batches_of_few_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    rows = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    for stage in ("quality classifier", "n-gram Jaccard join", "benchmark decontamination", "packing"):
        spark.conf.unset(name)
        dict(corpus_pipeline.STAGES)[stage](spark, table(spark, SF, "documents").limit(0), SF)
        seen = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
        assert sum(seen) > 4 * BATCH_BYTES and max(seen) < 2 * BATCH_BYTES
