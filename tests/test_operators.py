"""Boundaries of single operators."""

import pathlib
import time

import pytest
from pyspark.sql import functions as F

from tillstream.functions.text import CANDIDATE, json_candidate, money, parse_receipt
from tillstream.functions.wrapped import parse_wrapped
from tillstream.operators import decision, ingest, reads, widgets
from tillstream.operators.coherence import incoherence
from tillstream.plans import catalogue
from tillstream.sources import mapped
from tillstream.streaming import jobs

BASE = {"items": [{"description": "Té verde", "quantity": 3.0, "unit_price": 600.0, "subtotal": 1800.0, "voided": False}], "discount": None, "tip": None, "total": 1800.0, "printed_at": None}
NAN, INF = float("nan"), float("inf")


def item(**change):
    return BASE | {"items": [BASE["items"][0] | change]}


CASES = [
    (BASE, None), (BASE | {"total": 1799.0}, None), (BASE | {"total": 1798.0}, "T4"), (BASE | {"total": NAN}, "T1"), (BASE | {"total": INF}, "T1"), (BASE | {"total": -1.0}, "T2"), (BASE | {"total": 500001.0}, "T3"),
    (BASE | {"items": []}, "N1"), (BASE | {"items": BASE["items"] * 51}, "N2"), (BASE | {"items": BASE["items"] * 50, "total": 90000.0}, None),
    (item(description="  "), "I1"), (item(quantity=NAN), "I2"), (item(unit_price=INF), "I2"), (item(quantity=0.0), "I3"), (item(subtotal=-1.0), "I4"), (item(unit_price=600000.0, subtotal=1200000.0), "I5"),
    (item(quantity=1000.0, subtotal=900000.0), "I6"), (item(subtotal=1802.0), "I7"), (item(voided=True) | {"total": 0.0}, None), (item(voided=True, subtotal=5.0) | {"total": 0.0}, "I7"),
    (BASE | {"discount": 300.0, "tip": 200.0, "total": 1700.0}, None), (BASE | {"discount": 0.0, "tip": 0.0}, None), (BASE | {"discount": -1.0}, "D1"), (BASE | {"discount": NAN}, "D1"), (BASE | {"discount": 2000.0}, "D2"),
    (BASE | {"tip": -1.0}, "P1"), (BASE | {"tip": INF}, "P1"), (BASE | {"tip": 500001.0}, "P2"),
]


def test_coherence_rules(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], f"i int, c {CANDIDATE}")
    got = {r.i: r.reason for r in df.select("i", incoherence(F.col("c")).alias("reason")).collect()}
    assert got == {i: code for i, (_, code) in enumerate(CASES)}


def test_money(spark):
    cases = {"$ 1.234,50": 1234.5, "-$ 5,00": -5.0, "": 0.0, "abc": 0.0, "7": 7.0, "1,2,3": None, ",": None, "5-": -5.0}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("t", money(F.col("t")).alias("v"))
    assert {r.t: r.v for r in df.collect()} == cases


RECEIPT = "﻿  BAR\n Fecha: 27/07/2026   Hora: 23:05\r\n2  Pizza Muzzarella   5200  10400\n1  Combo   3450  3450  *ANULADO*\n1 near miss 10 10\nSUBTOTAL: 9\nPropina: 1.920\nTOTAL: $1\nTOTAL: $ 12.320,00"


def test_receipt(spark):
    rows = [(0, RECEIPT), (1, ""), (2, "junk"), (3, "1  a   2  2\nTOTAL: 1,2,3"), (4, "Fecha: 31/02/2026 Hora: 10:00\n1  a   2  2\nTOTAL: 2"), (5, "TOTAL: 5")]
    got = {r.i: r.own for r in spark.createDataFrame(rows, "i int, t string").select("i", parse_receipt(F.col("t")).alias("own")).collect()}
    c = got[0].candidate
    assert [(x.description, x.quantity, x.unit_price, x.subtotal, x.voided) for x in c["items"]] == [("Pizza Muzzarella", 2, 5200, 10400, False), ("Combo", 1, 3450, 3450, True)]
    assert (c.total, c.tip, c.discount, c.printed_at.minute) == (12320, 1920, None, 5)
    assert [got[k].poison for k in range(6)] == [None, None, None, "bad_amount", "bad_date", None] and all(got[k].candidate is None for k in range(1, 6))


def test_answers_are_read_by_type(spark):
    good = '{"items":[{"description":"x","quantity":1,"unitPrice":2,"subtotal":2,"voided":"no"}],"total":2.5}'
    rows = [(0, f"text {good} more"), (1, good.replace('"total":2.5', '"total":"2.5"')), (2, good.replace('"x"', "3")), (3, "{"), (4, None), (5, '{"items":[],"total":1}'), (6, good.replace('"total"', '"unparseable":null,"total"'))]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", json_candidate(F.col("t")).alias("c")).collect()}
    assert got[0].total == 2.5 and got[0]["items"][0].voided and [k for k, v in got.items() if v is None] == [1, 2, 3, 4, 5, 6]


def test_requests_are_checked_in_order(spark):
    good = ("5f2b9c3a-1111-4444-8888-abcdefabcdef", "COM3", "2026-07-27T23:00:00.000Z", "x")
    cases = [(good, None), (("x", *good[1:]), "ticket_id"), ((good[0], "COM3\n", *good[2:]), "port"), ((good[0], "", *good[2:]), "port"), ((*good[:2], "2026-02-31T00:00:00.000Z", "x"), "captured_at"), ((*good[:2], "2026-07-27T23:00:00Z", "x"), "captured_at"), ((*good[:3], ""), "empty_text"), ((*good[:3], None), "empty_text"), ((*good[:3], "é" * 32768), None), ((*good[:3], "é" * 32769), "text_too_long")]
    df = spark.createDataFrame([(i, "k", "T1", False, False, *c) for i, (c, _) in enumerate(cases)], "i int, api_key_id string, tenant_id string, corrupt boolean, shapeless boolean, ticket_id string, port string, captured_at string, raw_text string")
    assert {r.i: r.r for r in df.select("i", ingest.reject_reason().alias("r")).collect()} == {i: e for i, (_, e) in enumerate(cases)}


def test_page_sizes_and_specs():
    assert [reads.page_size(x) for x in (None, "x", 0, -1, 1.5, "7", 100, 101, "1e1", " 8 ")] == [50, 50, 50, 50, 50, 7, 100, 100, 10, 8]
    assert [reads.page_size(x) for x in ("inf", "-inf", "Infinity", "nan", "1e400", "1_0", "", "٣", float("inf"))] == [50] * 9
    for bad in ({"field": "price"}, {"field": "total", "aggregation": "median"}, {"field": "total", "group_by": "tenant"}, {"field": "tip", "group_by": "description"}):
        with pytest.raises(ValueError):
            widgets.Spec("T1", **bad)


def test_cursors(spark):
    df = spark.createDataFrame([("2026-07-27T23:00:00.000Z", "5f2b"), ("a", "ñ?>")], "c string, t string")
    got = df.select("c", "t", reads.cursor_place(reads.cursor(F.col("c"), F.col("t"))).alias("p")).collect()
    assert all((r.p.c, r.p.t) == (r.c, r.t) for r in got)
    assert spark.createDataFrame([("no cursor",), ("",)], "x string").select(reads.cursor_place(F.col("x")).alias("p")).where("p is not null").count() == 0


def test_ticket_measures_count_once(spark):
    rows = [("T1", "t", "2026-01-01T00:00:00.000Z", "COM1", "parsed", "deterministic", d, 1.0, 1.0, 1.0, False, None, None, 3600.0) for d in "abc"]
    items = spark.createDataFrame(rows, "tenant string, ticket_id string, captured_at string, port string, status string, parsed_by string, description string, quantity double, unit_price double, subtotal double, voided boolean, discount double, tip double, total double")
    assert widgets.widget_query(items, widgets.Spec("T1", "total")).first().value == 3600
    assert widgets.widget_query(items, widgets.Spec("T1", "discount")).first().value == 0
    assert widgets.widget_query(items, widgets.Spec("T2", "total", group_by="port")).count() == 0


def test_every_readable_receipt_is_judged(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.reason: r["count"] for r in catalogue.coherence_all(spark, sf).groupBy("reason").count().collect()}
    assert got["T2"] > 0 and sum(got.values()) == catalogue.parse_tickets(spark, sf).where("total is not null").count()


def test_item_lines_at_their_edges(spark):
    void, far = "1  a   2  2  *ANULADO*", "1 x" + " " * 65_000 + "y"
    lines = {
        "1  a   2  2": ("a", 2, False), void: ("a", 2, True), "1  a   2  2\u0085": None, "1  a   2  2\u00a0": ("a", 2, False), "1  a\x01b   2  2": ("a\x01b", 2, False), "1\x01a\x012\x012\x01": None,
        "1  a  2   3  4": ("a  2", 4, False), "1 a 2 2": None, "1    5  6": ("", 6, False), "1   5  6": None, "1  a   2  2 *ANULADO": None, "x 1  a   2  2": None, far: None, far + "  3  4": ("x" + " " * 65_000 + "y", 4, False),
        "1 " + "7 " * 32_000 + "x": None, "1" * 65_000: None, "1  b\u0085c   2  2": ("b\u0085c", 2, False), "1a  b   2  2": None,
    }
    df = spark.createDataFrame([(i, f"{t}\nTOTAL: 2") for i, t in enumerate(lines)], "i int, t string").repartition(4)
    began = time.time()
    got = {r.i: r.own.candidate for r in df.select("i", parse_receipt(F.col("t")).alias("own")).collect()}
    assert time.time() - began < 20
    assert [None if got[i] is None else (lambda x: (x.description, x.subtotal, x.voided))(got[i]["items"][0]) for i in range(len(lines))] == list(lines.values())


def test_blank_names_are_refused(spark):
    df = spark.createDataFrame([(1, "ABCDE-FGHJK", "\t\u00a0", "agent-12", 1), (2, "ABCDE-FGHJK", "\u00a0till ", "agent-34", 2)], "claim_id long, code string, name string, agent_id string, seq long")
    codes = spark.createDataFrame([("T1", "ABCDE-FGHJK", "unused")], "tenant_id string, code string, status string")
    assert {r.claim_id: (r.outcome, r.agent_name) for r in reads.claims(df, codes).collect()} == {1: ("rejected", None), 2: ("won", "till")}


def test_bodies_are_read_by_type(spark):
    whole = '{"ticketId": "a", "port": "p", "capturedAt": "c", "rawText": "r"}'
    cases = {
        whole: (False, False, "r"), f"{whole} x": (True, False, None), f"{whole}, {whole}": (True, False, None), f"{whole}],[1": (True, False, None), whole + '}, {"a": 1': (True, False, None), "": (True, False, None), "null": (False, True, None),
        "7": (False, True, None), '"{}"': (False, True, None), "[1]": (False, False, None), '{"rawText": 7}': (False, False, None), '{"rawText": {"a": 1}}': (False, False, None), '{"rawText": ""}': (False, False, ""), f" {whole}\n": (False, False, "r"),
        '{"rawText": 7, "rawText": "last"}': (False, False, "last"), '{"rawText": "first", "rawText": null}': (False, False, None),
    }
    df = spark.createDataFrame([(i, "k", b) for i, b in enumerate([*cases, None])], "arrival_seq long, api_key_id string, body string")
    got = {r.arrival_seq: (r.corrupt, r.shapeless, r.raw_text) for r in ingest.decoded(df).collect()}
    assert [got[i] for i in range(len(got))] == [*cases.values(), (True, False, None)]


def test_unknown_states_and_widgets(spark):
    with pytest.raises(ValueError):
        reads.ticket_page(spark.createDataFrame([], "tenant_id string"), "T1", status="done")
    shape = "tenant string, widget_id string, field string, aggregation string, group_by string, date_from string, date_to string, port string, status string"
    specs = spark.createDataFrame([("T1", "w", "total", "sum", None, None, None, None, None), ("T1", "bad", "price", "sum", None, None, None, None, None)], shape)
    assert widgets.stored_widget(specs, "T1", "w").field == "total"
    with pytest.raises(KeyError):
        widgets.stored_widget(specs, "T2", "w")
    with pytest.raises(ValueError):
        widgets.stored_widget(specs, "T1", "bad")


def test_folders_of_other_months_are_not_read(spark):
    row = ("T7", "1", "1995-03-15T00:00:00.000Z", "COM1", "parsed", "deterministic", "a", 1.0, 2.0, 2.0, False, None, None, 2.0, "T7", "1995", "03", "15")
    rows = spark.createDataFrame([row, ("T8", *row[1:14], "T8", *row[15:])], decision.flatten(spark.createDataFrame([], jobs.OUTCOME)).schema)
    items = catalogue.written_items(spark, rows)
    assert items.count() == 1
    plan = items._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert all(c in filters for c in ("tenant#", "year#", "month#", "day#")) and "concat_ws" in filters
    assert widgets.matching(items, widgets.Spec("T7", "subtotal"), years=(2024, 2035)).count() == 0


GOOD, BAD = "1  thing   2  2\nTOTAL: 2", "no receipt"


def change(spark, *rows):
    """Change log of (ticket, day, text)."""
    return spark.createDataFrame([("T1", f"2026-01-0{d}T10:00:00.000Z", t, "COM1", x, "INSERT", "pending") for t, d, x in rows], "tenant_id string, captured_at string, ticket_id string, port string, raw_text string, event string, status string")


def tenant(spark):
    return spark.createDataFrame([("T1", "columns38", None)], "tenant_id string, parser_id string, port_parsers map<string,string>")


def items_of(spark, path):
    return sorted(r.ticket_id for r in spark.read.parquet(path).collect()) if any(f.suffix == ".parquet" for f in pathlib.Path(path).rglob("*")) else []


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    sf, out = "/root/testdata/sf0.001", str(tmp_path)
    events, tenants, folders = mapped.change_events(spark, sf), mapped.tenants(spark, sf), ("tenant", "year")
    halves = [events.where(f"o_orderkey % 2 = {k}") for k in (0, 1)]

    def state():
        jobs.items_stream(spark, out, f"{out}/items", f"{out}/items-log", folders)
        return [sorted(map(str, spark.read.parquet(f"{out}/{t}").collect())) for t in ("tickets", "items", "quarantine")]

    for k in (0, 1):
        jobs.ticket_batch(halves[k], k, tenants, None, out, folders)
    once = state()
    jobs.ticket_batch(halves[1], 1, tenants, None, out, folders)
    assert state() == once and once[1]
    # a later version of a ticket takes the place of the earlier one
    again = halves[0].withColumn("raw_text", F.lit("1  other   2  2\nTOTAL: 2"))
    jobs.ticket_batch(again, 2, tenants, None, out, folders)
    state()
    items = spark.read.parquet(f"{out}/items")
    assert {r.description for r in items.where("ticket_id % 2 = 0").collect()} == {"other"}
    assert items.where("ticket_id % 2 = 1").count() == sum(int(r.split("ticket_id='")[1].split("'")[0]) % 2 for r in once[1])
    rows = spark.createDataFrame([("T1", "2026-01-01T00:00:00.000Z", "t", 5), ("T1", "2026-01-01T00:00:00.000Z", "t", 3)], "tenant_id string, captured_at string, ticket_id string, arrival_seq long")
    for _ in range(2):
        jobs.dedup_batch(rows, 0, f"{out}/seen")
        jobs.dedup_batch(rows.withColumn("arrival_seq", F.lit(9).cast("long")), 1, f"{out}/seen")
    assert [r.arrival_seq for r in spark.read.parquet(f"{out}/seen").collect()] == [3]


def test_items_follow_the_state_of_their_tickets(spark, tmp_path):
    out, items, log = str(tmp_path), f"{tmp_path}/items", f"{tmp_path}/log"
    run = lambda n, *rows: jobs.ticket_batch(change(spark, *rows), n, tenant(spark), None, out)
    follow = lambda: jobs.items_stream(spark, out, items, log)
    follow()  # nothing is there yet
    run(0, ("a", 1, GOOD), ("b", 2, GOOD))
    follow()
    assert items_of(spark, items) == ["a", "b"]
    run(1, ("a", 1, BAD))  # the last one of its day
    follow()
    assert items_of(spark, items) == ["b"]
    run(2, ("c", 1, GOOD), ("b", 2, BAD), ("d", 2, GOOD))
    run(2, ("c", 1, GOOD), ("b", 2, BAD), ("d", 2, GOOD))
    follow()
    follow()
    assert items_of(spark, items) == ["c", "d"]
    run(3, ("c", 1, BAD), ("d", 2, BAD))
    follow()
    assert items_of(spark, items) == []


def test_items_that_cannot_be_written_hold_nothing_back(spark, tmp_path):
    out, items, log = str(tmp_path / "out"), tmp_path / "items", f"{tmp_path}/log"
    jobs.items_stream(spark, out, None, log)
    items.write_text("a file where the folder should be")
    for n, t in enumerate("ab"):
        jobs.ticket_batch(change(spark, (t, 1, GOOD)), n, tenant(spark), None, out)
        with pytest.raises(Exception):
            jobs.items_stream(spark, out, str(items), log)
    assert sorted(r.ticket_id for r in spark.read.parquet(f"{out}/tickets").where("status = 'parsed'").collect()) == ["a", "b"]
    items.unlink()
    jobs.items_stream(spark, out, str(items), log)
    assert items_of(spark, str(items)) == ["a", "b"]


def test_answers_come_when_they_like(spark, tmp_path):
    good = '{"items":[{"description":"x","quantity":1,"unitPrice":2,"subtotal":2}],"total":2}'
    said = lambda *rows: spark.createDataFrame([("T1", f"2026-01-0{d}T10:00:00.000Z", t, x) for t, d, x in rows], "tenant_id string, captured_at string, ticket_id string, response_text string")
    nothing = said(), change(spark)
    batches = [
        (change(spark, ("own", 1, GOOD), ("late", 1, BAD), ("never", 1, BAD)), said(("early", 1, good), ("own", 1, good), ("lost", 3, good))),
        (change(spark, ("early", 1, BAD), ("same", 2, BAD), ("null", 2, BAD)), said(("same", 2, good), ("null", 2, None), ("early", 1, "worse"))),
        (nothing[1], said(("own", 1, "x"))),
        (nothing[1], said(("late", 1, good))),
        (change(spark, ("never", 1, BAD)), said(("late", 1, "second"), ("same", 2, "second"))),
    ]
    out = str(tmp_path)

    def state(before=99):
        rows = jobs.read_table(spark, f"{out}/tickets", jobs.OUTCOME, jobs.FOLDERS).where(f"batch < {before}").drop(*jobs.FOLDERS, "batch")
        return {r.ticket_id: (r.status, r.reason, r.version) for r in ingest.current_state(rows).collect()}

    for n, (new, answers) in enumerate(batches):
        both = new.withColumn("kind", F.lit("ticket")).unionByName(answers.withColumn("kind", F.lit("answer")), allowMissingColumns=True)
        for _ in range(2):  # a batch that runs again changes nothing
            jobs.answered_batch(both, n, tenant(spark), out)
            now = state()
        if n == 2:
            assert now["late"] == ("pending", "no_answer", 0)
    assert now == {
        "own": ("parsed", None, 0), "late": ("needs_review", None, 3), "never": ("pending", "no_answer", 4), "early": ("needs_review", None, 1), "same": ("needs_review", None, 1),
        "null": ("failed", "no_parser_matched_incl_fallback", 1),
    }


def test_a_batch_reads_the_folders_it_touches(spark, tmp_path, monkeypatch):
    out = str(tmp_path)
    for n in range(6):
        jobs.ticket_batch(change(spark, *((f"{n}-{d}", d, GOOD) for d in range(1, 7))), n, tenant(spark), None, out)
    touched = spark.createDataFrame([("T1", "2026", "01", "02"), ("T1", "2026", "02", "01"), ("T/=%2", "2026", "01", "02")], "tenant string, year string, month string, day string")
    read = lambda before=None: jobs.history(spark, f"{out}/tickets", jobs.OUTCOME, jobs.FOLDERS, touched, before)
    assert {r.ticket_id for r in read(4).collect()} == {f"{n}-2" for n in range(4)}
    assert all("/day=02/" in f for f in read().inputFiles())
    monkeypatch.setattr(jobs, "MOST_FOLDERS", 0)
    assert {r.ticket_id for r in read(4).collect()} == {f"{n}-2" for n in range(4)}
    plan = read()._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert jobs.history(spark, f"{out}/none", jobs.OUTCOME, jobs.FOLDERS, touched).isEmpty()
    # the first writer of each key, by the day's own folders
    rows = spark.createDataFrame([("T1", f"2026-01-0{d}T00:00:00.000Z", "t", d) for d in (1, 2, 3)], "tenant_id string, captured_at string, ticket_id string, arrival_seq long")
    jobs.dedup_batch(rows, 0, f"{out}/seen")
    jobs.dedup_batch(rows.withColumn("arrival_seq", F.lit(0).cast("long")).unionByName(rows.withColumn("ticket_id", F.lit("u"))), 1, f"{out}/seen")
    assert sorted((r.ticket_id, r.arrival_seq) for r in spark.read.parquet(f"{out}/seen").collect()) == [(t, d) for t in "tu" for d in (1, 2, 3)]


def test_every_customer_has_a_code_of_its_own(spark):
    codes = spark.range(200_000).select(mapped._code(F.col("id")).alias("code"))
    assert codes.distinct().count() == 200_000 and codes.where(~F.col("code").rlike(reads.CODE_SHAPE)).count() == 0


def test_a_page_reads_few_days(spark, tmp_path):
    out = str(tmp_path)
    rows = [(f"{y}-{m:02d}-{d:02d}T10:00:00.000Z", f"{y}{m}{d}-{k}") for y in range(2019, 2027) for m in (1, 12) for d in (3, 28) for k in range(4)]
    log = spark.createDataFrame([("T1", at, t, "COM1", BAD if t.endswith("3") else GOOD, "INSERT", "pending") for at, t in rows], "tenant_id string, captured_at string, ticket_id string, port string, raw_text string, event string, status string")
    jobs.ticket_batch(log, 0, tenant(spark), None, out)
    jobs.ticket_batch(log.where("captured_at > '2026-12'"), 1, tenant(spark), None, out)  # other versions of the same tickets
    want, read = sorted(rows, reverse=True), []

    def page(limit, **more):
        df = jobs.ticket_page(spark, out, "T1", limit, **more)
        read[:] = sorted({tuple(x.split("=")[1] for x in f.split("/") if x.startswith(("year=", "month=", "day="))) for f in df.inputFiles()})
        return df.orderBy("place").collect()

    first = page(6)
    assert [(r.captured_at, r.ticket_id) for r in first] == want[:6] and first[-1].more and len(read) <= 3 and read[-1] == ("2026", "12", "28")
    after = (first[-1].captured_at, first[-1].ticket_id)
    assert [(r.captured_at, r.ticket_id) for r in page(6, after=after)] == want[6:12] and ("2026", "12", "28") not in read and len(read) <= 3
    assert [r.ticket_id for r in page(100, status="failed")] == [t for _, t in want if t.endswith("3")]
    assert len(page(100)) == 100 and len(page(100, after=("2019-01-03T10:00:00.000Z", "201913-2"))) == 2
    assert page(5, after=("2018", "")) == [] and jobs.ticket_page(spark, out, "none").count() == 0


def test_the_second_layout(spark):
    text = "BAR\n\nCafé con\r\n  leche  \n2 x 1.250,50    2.501,00\nPan\n0,350 x 1.000,00  350,00  ANULADO\n1 x 5,00  5,00\nDESC. -1,00\nPROPINA $ 7,5\n2026-07-05 21:40\nTOTAL 2.512,50\nGracias"
    cases = {
        text: None, text.replace("07-05", "13-05"): "bad_date", text.replace("TOTAL 2.512,50", "TOTAL 2,5,1"): "bad_amount", "TOTAL 5,00": None, "Pan\n1 x 2,00  2,00": None, "": None,
        "x\n" * 20_000 + "1 x 1,00  1,00\nTOTAL 1,00": None, "1 x " * 15_000: None,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").repartition(4)
    began = time.time()
    got = {r.i: r.own for r in df.select("i", parse_wrapped(F.col("t")).alias("own")).collect()}
    assert time.time() - began < 20 and [got[i].poison for i in range(len(cases))] == list(cases.values())
    c = got[0].candidate
    assert [(x.description, x.quantity, x.unit_price, x.subtotal, x.voided) for x in c["items"]] == [("Café con leche", 2.0, 1250.5, 2501.0, False), ("Pan", 0.35, 1000.0, 350.0, True), ("", 1.0, 5.0, 5.0, False)]
    assert (c.discount, c.tip, c.total, str(c.printed_at)) == (1.0, 7.5, 2512.5, "2026-07-05 21:40:00")
    assert got[6].candidate["items"][0].description == " ".join("x" * 20_000) and all(got[i].candidate is None for i in (1, 2, 3, 4, 5, 7))


def test_quarantined_receipts_are_tried_again(spark, tmp_path):
    out, bad = str(tmp_path), "1  thing   2  2\nTOTAL: 1,2,3"
    log = change(spark, ("a", 1, bad), ("b", 2, bad), ("c", 2, GOOD))
    jobs.ticket_batch(log, 0, tenant(spark), None, out)
    reader = decision.PARSERS | {"columns38": lambda raw: parse_receipt(F.replace(raw, F.lit("1,2,3"), F.lit("2")))}
    state = lambda: {r.ticket_id: (r.status, r.version) for r in ingest.current_state(jobs.read_table(spark, f"{out}/tickets", jobs.OUTCOME, jobs.FOLDERS).drop(*jobs.FOLDERS, "batch")).collect()}
    again = lambda n, version, parsers=None, most=5: jobs.requeue(spark, n, tenant(spark), log.select("tenant_id", "ticket_id", "raw_text"), out, parsers=parsers, version=version, most=most)
    again(1, decision.VERSION)  # has tried already
    again(2, "x")
    again(2, "x")
    assert state() == {"a": ("quarantined", 2), "b": ("quarantined", 2), "c": ("parsed", 0)}
    again(3, "y", reader, most=2)
    assert state()["a"] == ("quarantined", 2)
    again(4, "y", reader)
    again(5, "z", reader)
    assert state() == {"a": ("parsed", 4), "b": ("parsed", 4), "c": ("parsed", 0)}
    assert {r.ticket_id: (r.attempts, sorted(r.tried)) for r in jobs.attempts(spark, out).collect()} == {t: (2, sorted([decision.VERSION, "x"])) for t in "ab"}
