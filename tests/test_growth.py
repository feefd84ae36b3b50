"""Plans and inputs of jobs that must not grow faster than their tables."""

from pyspark.sql import functions as F

from tillstream.functions.text import let, parse_receipt
from tillstream.operators import ingest, widgets
from tillstream.plans import catalogue
from tillstream.sources import mapped

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_outcomes_computes_none_of_them_again(spark):
    assert plan(catalogue.QUERIES["quarantine"](spark, SF)).count("parse_json") <= plan(catalogue.QUERIES["decide"](spark, SF)).count("parse_json") <= 2


def test_the_change_log_reads_order_lines_once(spark):
    assert plan(mapped.change_events(spark, SF)).count("l_linenumber#") <= plan(mapped.receipts(spark, SF)).count("l_linenumber#")


def test_texts_that_are_not_the_last_ones_go_before_they_are_sorted(spark):
    rows = spark.createDataFrame([("T1", "a", 1, "x"), ("T1", "a", 3, "z"), ("T1", "a", 2, "y"), ("T2", "a", 2, "w"), ("T2", "b", None, "n")], "tenant_id string, ticket_id string, arrival_seq long, raw_text string")
    out = ingest.latest_payload(rows)
    assert "LeftSemi" in plan(out)
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in rows.groupBy("tenant_id", "ticket_id").agg(F.max_by("raw_text", "arrival_seq")).collect())


def test_requests_meet_their_keys_without_a_shuffle_of_bodies(spark):
    rows, key = (spark.range(3).selectExpr(*c) for c in (("concat('K', id) AS api_key_id", "'x' AS body"), ("concat('K', id) AS api_key_id", "concat('T', id) AS tenant_id")))
    assert plan(ingest.resolve_tenant(rows, key, key)).count("strategy=broadcast") == 2


def test_a_portion_of_receipts_is_parsed_by_many_tasks(spark, monkeypatch):
    files = []
    monkeypatch.setattr(catalogue.jobs, "source", lambda spark, path, schema, n=1: files.append(n))
    monkeypatch.setattr(catalogue.jobs, "transform_stream", lambda *a: None)
    monkeypatch.setattr(catalogue, "parse_receipt", lambda raw: raw)
    try:
        catalogue.QUERIES["stream_parse"](spark, SF)
    except Exception as e:
        assert "PATH_NOT_FOUND" in str(e)  # nothing was parsed
    assert files and min(files) > 1


def test_tickets_of_a_label_are_dealt_before_they_are_told_apart(spark):
    items = spark.createDataFrame([("T1", "a", "x"), ("T1", "a", "x"), ("T1", "b", "x"), ("T1", "a", None), ("T2", "a", "y")], "tenant string, ticket_id string, description string")
    out = widgets.every_event_count(items, "description")
    assert "RepartitionByExpression" in plan(out)
    assert sorted((r.tenant, r.label, r.value) for r in out.collect()) == [("T1", "(sin dato)", 1.0), ("T1", "x", 2.0), ("T2", "y", 1.0)]


def test_a_bound_value_is_no_element_of_an_array(spark):
    one = spark.createDataFrame([(3,), (None,)], "x int")
    assert [r[0] for r in one.select(let(F.col("x") + 1, lambda v: F.coalesce(v * v, F.lit(-1)))).collect()] == [16, -1]
    assert "[0]" not in plan(one.select(let(F.col("x") + 1, lambda v: v * v).alias("v")))  # which works out the type of the body for each row


def test_a_line_is_matched_once_for_its_item_and_once_for_its_date(spark):
    p = plan(spark.createDataFrame([("1  a  2  2",)], "raw string").select(parse_receipt(F.col("raw")).alias("p")))
    assert p.count("regexp_extract(") <= 1 and p.lower().count("rlike") == 0


def test_item_lines_that_hold_marks_and_breaks(spark):
    def names(line):
        c = spark.createDataFrame([(f"{line}\nTOTAL: 2",)], "raw string").select(parse_receipt(F.col("raw"))["candidate"]).first()[0]
        return c and [tuple(i) for i in c["items"]]

    assert names("2 a\u0001b \u0001  3  6 *ANULADO*") == [("a\u0001b \u0001", 2.0, 3.0, 6.0, True)]
    assert names("2  3 4  5  6") == [("3 4", 2.0, 5.0, 6.0, False)]
    assert names("2    5  6") == [("", 2.0, 5.0, 6.0, False)]
    for line in ("2   5  6", "2 a 5  6", "2a  5  6", "2 a\rb  5  6", "2\u0001a\u00015\u00016\u0001\u0001", "2 a  5  6 x"):
        assert names(line) is None


def test_tickets_that_are_parsed_anew_need_no_receipts(spark):
    log = spark.createDataFrame([("T1", 9, "1995-01-01", "text"), ("T7", 1, "1995-01-01", "text"), ("T7", 2, "1996-01-01", "text")], "tenant_id string, o_orderkey long, captured_at string, raw_text string")
    assert [(r.o_orderkey, r.raw_text) for r in catalogue._unreadable(log).orderBy("o_orderkey").collect()] == [(1, "no receipt"), (9, "no receipt")]
