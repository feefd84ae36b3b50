"""The registered queries: each applies one operator or job to whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.functions.text import json_candidate, money, once, parse_receipt
from tillstream.operators import decision, ingest, reads, widgets
from tillstream.operators.coherence import incoherence
from tillstream.plans.oracles import SPEC_FIELDS
from tillstream.sources import mapped
from tillstream.sources.shared import shared_dir
from tillstream.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
TENANT = "T7"
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def work_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"


def _written(rows: DataFrame, path: str) -> DataFrame:
    """rows, computed once."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@query
def kpi_item_all(spark, sf_dir):
    return widgets.every_measure(mapped.ticket_items(spark, sf_dir), widgets.ITEM_FIELDS)


@query
def kpi_ticket_all(spark, sf_dir):
    return widgets.every_measure(mapped.ticket_items(spark, sf_dir), widgets.TICKET_FIELDS)


@query
def kpi_event_count(spark, sf_dir):
    return widgets.every_event_count(mapped.ticket_items(spark, sf_dir))


def _grouped(name: str, fields: dict[str, str], group: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: widgets.every_measure(mapped.ticket_items(spark, sf_dir), fields, group)


for _g, _c in widgets.GROUPS.items():
    _grouped(f"group_item_by_{_c}", widgets.ITEM_FIELDS, _g)
    if _g != "description":
        _grouped(f"group_ticket_by_{_c}", widgets.TICKET_FIELDS, _g)


@query
def group_events_by_description(spark, sf_dir):
    return widgets.every_event_count(mapped.ticket_items(spark, sf_dir), "description")


@query
def group_unlabelled(spark, sf_dir):
    """Sales by port where the port of some tickets is unknown."""
    items = mapped.ticket_items(spark, sf_dir)
    items = items.withColumn("port", F.when(F.col("ticket_id").cast("long") % 7 != 0, F.col("port")))
    return widgets.widget_query(items, widgets.Spec(TENANT, "subtotal", group_by="port"), 2).select(F.lit(TENANT).alias("tenant"), "label", "value")


@query
def flagship(spark, sf_dir):
    out = widgets.widget_query(mapped.ticket_items(spark, sf_dir), widgets.Spec(TENANT, "total", group_by="port"), 2)
    return out.select(F.lit(TENANT).alias("tenant"), "label", "value")


@query
def widget_filters(spark, sf_dir):
    items = mapped.ticket_items(spark, sf_dir)
    specs = {
        "both_bounds": {"date_from": "1994-01-01", "date_to": "1996-06-30T12:00:00.000Z"}, "day_bound": {"date_to": "1995-03-15"}, "port": {"port": "COM2"}, "status": {"status": "needs_review"}, "none": {"status": "failed"},
    }
    return widgets.one_values(items, {n: widgets.Spec(TENANT, "total", **s) for n, s in specs.items()}, 2)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query
def widget_years(spark, sf_dir):
    """Tickets by port of a tenant, of the years alone that the table shows."""
    rows = widgets.matching(mapped.ticket_items(spark, sf_dir), widgets.Spec(TENANT, widgets.EVENTS, group_by="port"), years=(1994, 1996))
    return rows.groupBy(F.col("port").alias("label")).agg(F.count_distinct("ticket_id").cast("double").alias("value"))


@query
def widget_empty(spark, sf_dir):
    """Widgets that no row meets: one value is 0, a table has no points."""
    items = mapped.ticket_items(spark, sf_dir)
    specs = {"kpi": {"field": "quantity", "status": "failed"}, "ticket_kpi": {"field": "total", "port": "none"}, "grouped": {"field": "quantity", "group_by": "port", "status": "failed"}}
    shown = [widgets.widget_query(items, widgets.Spec(TENANT, **s)).agg(F.count("*").alias("points"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(F.lit(n).alias("widget"), "points", "value") for n, s in specs.items()]
    return _union(shown)


@query
def widget_by_id(spark, sf_dir):
    return widgets.widget_query(mapped.ticket_items(spark, sf_dir), widgets.stored_widget(widget_specs(spark, sf_dir), TENANT, "w2"), 4)


def widget_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine widgets for each tenant."""
    none = "cast(null as string)"
    rows = [
        ("w1", "total", "sum", None, None, None, None, None), ("w2", "total", "avg", "port", None, None, None, None), ("w3", "subtotal", "sum", "description", None, None, None, None),
        ("w4", "event_count", "sum", "status", None, None, None, None), ("w5", "discount", "max", "parsedBy", None, None, None, None), ("w6", "quantity", "min", None, None, None, None, None),
        ("w7", "tip", "count", None, None, None, "COM1", None), ("w8", "subtotal", "avg", "port", "1994-01-01", "1996-06-30", None, "parsed"), ("w9", "total", "sum", None, None, None, None, "failed"),
    ]
    names = ("widget_id", "field", "aggregation", "group_by", "date_from", "date_to", "port", "status")
    each = F.array(*(F.struct(*(F.expr(none if v is None else f"'{v}'").alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
    return mapped.table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("tenant"), F.explode(each).alias("w")).select("tenant", "w.*")


@query
def widgets_batch(spark, sf_dir):
    return widgets.widgets_batch(mapped.ticket_items(spark, sf_dir), widget_specs(spark, sf_dir))


@query
def widget_spec_validation(spark, sf_dir):
    rows = mapped.table(spark, sf_dir, "events").selectExpr(*mapped._columns(SPEC_FIELDS))
    names = ("name", "visualization", "field", "aggregation", "group_by", "date_from", "date_to", "port", "status")
    return rows.select("widget", widgets.spec_reject(*(F.col(c) for c in names)).alias("reason"))


@query
def widget_body_validation(spark, sf_dir):
    return widgets.checked_bodies(mapped.widget_bodies(spark, sf_dir)).select("widget", "reason", "name")


@query
def field_catalogue(spark, sf_dir):
    return widgets.field_catalogue(mapped.ticket_items(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ingest.resolve_tenant(ingest.decoded(mapped.requests(spark, sf_dir)), mapped.agents(spark, sf_dir), mapped.tenants(spark, sf_dir))
    return rows.withColumn("reason", ingest.reject_reason())


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).where("reason is null").select("tenant_id", "captured_at", "ticket_id", "arrival_seq", "port", "raw_text")


@query
def ingest_validate(spark, sf_dir):
    return _requests(spark, sf_dir).select("arrival_seq", "reason")


@query
def ingest_tenant_resolve(spark, sf_dir):
    return _requests(spark, sf_dir).select("arrival_seq", "tenant_id")


@query
def ingest_dedup(spark, sf_dir):
    return ingest.first_of_each(_accepted(spark, sf_dir))


@query
def raw_latest_payload(spark, sf_dir):
    """Written as the raw table, by tenant, and read from there."""
    path = work_dir(spark)
    ingest.write_payloads(_written(_accepted(spark, sf_dir), f"{path}-accepted"), path)
    return spark.read.schema("tenant_id string, ticket_id string, raw_text string").parquet(path).select("tenant_id", "ticket_id", "raw_text")


@query
def payload_lookup(spark, sf_dir):
    """The texts of the tickets that were taken, and of others that have none."""
    rows = _written(_accepted(spark, sf_dir), f"{work_dir(spark)}/accepted")
    asked = rows.select("tenant_id", "ticket_id").distinct().unionByName(_tickets(spark, sf_dir).select("tenant_id", "ticket_id"))
    return ingest.with_payload(asked, ingest.latest_payload(rows))


@query
def parse_money(spark, sf_dir):
    k, whole = F.col("o_orderkey"), F.replace(F.format_number(F.floor("o_totalprice"), 0), F.lit(","), F.lit("."))
    shown = F.concat(F.when(k % 5 == 0, "-").otherwise(""), F.lit("$ "), whole, F.lit(","), F.lpad((k % 100).cast("string"), 2, "0"))
    text = F.when(k % 13 == 0, "1,2,3").when(k % 17 == 0, "$ --").otherwise(shown)
    return mapped.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.abs(money(text)) * F.signum(money(text)), 2).alias("value"))


def _parsed(receipts: DataFrame) -> DataFrame:
    return receipts.select("*", once(parse_receipt(F.col("raw_text"))).alias("own"))


def _parsed_tickets(receipts: DataFrame) -> DataFrame:
    c = "own.candidate"
    return _parsed(receipts).select("ticket_id", "own.poison", F.when(F.col(c).isNotNull(), F.size(f"{c}.items")).cast("long").alias("n_items"), f"{c}.discount", f"{c}.tip", f"{c}.total")


@query
def parse_tickets(spark, sf_dir):
    return _parsed_tickets(mapped.receipts(spark, sf_dir))


@query
def parse_items(spark, sf_dir):
    return _parsed(mapped.receipts(spark, sf_dir)).select("ticket_id", F.explode("own.candidate.items").alias("i")).select("ticket_id", "i.*")


@query
def parse_layouts(spark, sf_dir):
    """Receipts of two layouts, each read by its port's parser: all orders in the one with wrapped names, and once more in the other."""
    wide = mapped.wrapped_receipts(spark, sf_dir).withColumn("port", F.lit("COM9"))
    rows = wide.unionByName(mapped.receipts(spark, sf_dir).select(*wide.columns).withColumn("port", F.lit("COM1")))
    tenants = mapped.table(spark, sf_dir, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("tenant_id"), F.lit("columns38").alias("parser_id"), F.create_map(F.lit("COM9"), F.lit("wrapped")).alias("port_parsers"))
    c = "own.candidate"
    out = decision.parsed(decision.with_parser(rows, tenants)).select("ticket_id", "parser", f"{c}.total", incoherence(F.col(c)).alias("reason"), F.explode(f"{c}.items").alias("i"))
    return out.select("ticket_id", "parser", "total", "reason", "i.description", "i.quantity", "i.unit_price", "i.subtotal", "i.voided")


@query
def parse_junk(spark, sf_dir):
    """Prose is no receipt."""
    rows = mapped.table(spark, sf_dir, "documents").withColumn("own", parse_receipt(F.coalesce("text", F.lit(""))))
    return rows.agg(F.count("*").alias("documents"), F.count("own.candidate").alias("receipts"))


@query
def coherence(spark, sf_dir):
    """Receipts whose numbers close, and ones with a single fault put in."""
    return _judged(_candidates(spark, sf_dir))


@query
def coherence_all(spark, sf_dir):
    """Receipts with a fault for each of the rules, by their number."""
    rows, c = _candidates(spark, sf_dir), F.col("own.candidate")
    f = F.floor(F.col("o_orderkey") / 8) % 40
    first = lambda field, value: c.withField("items", F.transform(c["items"], lambda x, i: F.when(i == 0, x.withField(field, value(x))).otherwise(x)))
    number = lambda v: lambda x: F.lit(v)
    faults = [
        c.withField("total", F.lit(float("nan"))), c.withField("total", F.lit(-1.0)), c.withField("total", F.lit(500001.0)), c.withField("items", F.filter(c["items"], lambda x: F.lit(False))),
        c.withField("items", F.array_repeat(c["items"][0], 51)), first("description", number(" \u00a0")), first("quantity", number(float("nan"))), first("quantity", number(0.0)), first("unit_price", number(-1.0)),
        first("unit_price", number(500001.0)), first("subtotal", number(500001.0)), first("subtotal", lambda x: x["subtotal"] + 2), c.withField("discount", F.lit(-1.0)), c.withField("discount", F.lit(500001.0)),
        c.withField("tip", F.lit(-1.0)), c.withField("tip", F.lit(500001.0)), c.withField("total", c["total"] + 2),
    ]
    case = F.when(f == 0, faults[0])
    for k, fault in enumerate(faults[1:], 1):
        case = case.when(f == k, fault)
    return rows.select("ticket_id", incoherence(case.otherwise(c)).alias("reason"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(mapped.receipts(spark, sf_dir)).where(F.col("own.candidate").isNotNull())


def _judged(rows: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("own.candidate")
    first = lambda field, value: F.transform(c["items"], lambda x, i: F.when(i == 0, x.withField(field, value(x))).otherwise(x))
    faulty = (
        F.when(k % 101 == 0, c.withField("total", F.lit(float("nan"))))
        .when(k % 97 == 0, c.withField("items", first("quantity", lambda x: F.lit(0.0))))
        .when(k % 89 == 0, c.withField("items", first("description", lambda x: F.lit("  "))))
        .when(k % 83 == 0, c.withField("items", first("subtotal", lambda x: x["subtotal"] + 2)))
        .when(k % 79 == 0, c.withField("tip", F.lit(-1.0)))
        .otherwise(c)
    )
    return rows.select("ticket_id", incoherence(faulty).alias("reason"))


@query
def fallback_extract(spark, sf_dir):
    k, total = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    item = lambda q, v="": F.concat(F.lit('{"description":"x","quantity":'), F.lit(q), F.lit(',"unitPrice":2.5,"subtotal":5'), F.lit(v), F.lit("}"))
    body = lambda items, more="": F.concat(F.lit('ok:\n{"items":['), items, F.lit('],"total":'), total, F.when(k % 2 == 0, ',"discount":5').otherwise(',"discount":"5"'), F.lit(more), F.lit("}\nbye"))
    text = (
        F.when(k % 7 == 1, body(item('"12"'))).when(k % 7 == 2, F.lit("no receipt {here")).when(k % 7 == 3, body(item("2"), ',"unparseable":false')).when(k % 7 == 4, body(F.lit("")))
        .when(k % 7 == 5, body(item("2", ',"voided":"yes"'))).otherwise(body(item("2", ',"voided":0')))
    )
    rows = mapped.table(spark, sf_dir, "orders").withColumn("c", json_candidate(text))
    return rows.select("o_orderkey", "c.total", "c.discount", F.get("c.items", F.lit(0))["voided"].alias("voided"))


def _answers(receipts: DataFrame, *more: str) -> DataFrame:
    """Model answers for two of three receipts; of these every other with one item that closes."""
    k, live = F.col("o_orderkey"), F.col("live").cast("string")
    good = F.concat(F.lit('{"items":[{"description":"all","quantity":1,"unitPrice":'), live, F.lit(',"subtotal":'), live, F.lit('}],"total":'), live, F.lit("}"))
    return receipts.where(k % 3 != 0).select("tenant_id", "captured_at", "ticket_id", F.when(k % 3 == 1, good).alias("response_text"), *more)


def _decided(spark: SparkSession, sf_dir: str, answers: bool) -> DataFrame:
    r = mapped.receipts(spark, sf_dir)
    return decision.decide(r, mapped.tenants(spark, sf_dir), _answers(r) if answers else None)


@query
def decide(spark, sf_dir):
    return _decided(spark, sf_dir, True).select("tenant_id", "ticket_id", "status", "parsed_by", "reason")


@query
def decide_deterministic(spark, sf_dir):
    """Without a model's answers."""
    return _decided(spark, sf_dir, False).select("tenant_id", "ticket_id", "status", "parsed_by", "reason")


@query
def quarantine(spark, sf_dir):
    return decision.quarantine(_decided(spark, sf_dir, True)).select("tenant_id", "ticket_id", "reason")


@query
def flatten_items(spark, sf_dir):
    return decision.flatten(_decided(spark, sf_dir, False)).select("tenant_id", "ticket_id", "description", "quantity", "subtotal", "voided", "discount", "tip", "total", "year", "month", "day")


@query
def sink_roundtrip(spark, sf_dir):
    """The item table written by tenant and year (its days hold a few rows each) and read again with a tenant and a range of days, which prune folders."""
    return written_items(spark, decision.flatten(_decided(spark, sf_dir, False)), ("year",)).groupBy("tenant", "year", "month").agg(F.count("*").alias("n_items"), F.round(F.sum("subtotal"), 2).alias("subtotal"))


def written_items(spark: SparkSession, rows: DataFrame, folders: tuple[str, ...] = ("year", "month", "day")) -> DataFrame:
    path = work_dir(spark)
    rows.repartition("tenant", *folders).write.partitionBy("tenant", *folders).parquet(path)
    schema = spark.createDataFrame([], rows.schema).schema
    spec = widgets.Spec(TENANT, "subtotal", date_from="1994-01-01", date_to="1995-12-31T23:59:59.999Z")
    return widgets.matching(spark.read.schema(schema).parquet(path), spec, folders)


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped.tickets(spark, sf_dir).withColumnRenamed("tenant", "tenant_id")


_PAGE = ("ticket_id", "captured_at", "status", "place", "more", "next")


@query
def ticket_page(spark, sf_dir):
    return reads.ticket_page(_tickets(spark, sf_dir), TENANT).select(*_PAGE)


@query
def ticket_page_walk(spark, sf_dir):
    """A page of the outcome table that a batch of tickets made, from the newest folders."""
    path = work_dir(spark)
    jobs.ticket_batch(mapped.change_events(spark, sf_dir), 0, mapped.tenants(spark, sf_dir), None, path, _FOLDERS)
    return jobs.ticket_page(spark, path, TENANT, 30, folders=_FOLDERS).select(*_PAGE)


@query
def ticket_page_status(spark, sf_dir):
    return reads.ticket_page(_tickets(spark, sf_dir), TENANT, 500, "needs_review").select(*_PAGE)


@query
def ticket_page_next(spark, sf_dir):
    first = reads.ticket_page(_tickets(spark, sf_dir), TENANT, 20)
    at = first.where("next is not null").select(reads.cursor_place(F.col("next")).alias("p")).first()  # one row
    return reads.ticket_page(_tickets(spark, sf_dir), TENANT, 20, after=(at.p.c, at.p.t) if at else None).select(*_PAGE)


@query
def public_tickets(spark, sf_dir):
    out = reads.public_tickets(_decided(spark, sf_dir, True), TENANT)
    return out.withColumn("n_items", F.when(F.col("items").isNotNull(), F.size("items")).cast("long")).drop("items", "parsed_at")


@query
def registry_columns(spark, sf_dir):
    """Widgets, agents and codes of a tenant with all that is shown of them, as text."""
    specs = widget_specs(spark, sf_dir).withColumns({"name": F.upper("widget_id"), "visualization": F.when(F.col("group_by").isNull(), "kpi").otherwise("bar"), "created_at": F.lit("2026-01-01"), "tenant_id": F.col("tenant")})
    specs = specs.withColumns({"metric": F.struct("field", "aggregation"), "filters": F.struct("date_from", "date_to", "port", "status")})
    w = reads.registry(specs, TENANT, *reads.PUBLIC_WIDGET)
    a = reads.registry(mapped.agents(spark, sf_dir), TENANT, *reads.PUBLIC_AGENT)
    c = reads.registry(mapped.registry_codes(spark, sf_dir), TENANT, *reads.PUBLIC_CODE)
    row = lambda kind, key, *shown: [F.lit(kind).alias("kind"), F.col(key).alias("id"), F.concat_ws("|", *shown).alias("shown")]
    widget = w.select(*row("widget", "widget_id", "name", "visualization", "metric.field", "metric.aggregation", "group_by", "filters.date_from", "filters.date_to", "filters.port", "filters.status", "created_at"))
    return _union([widget, a.select(*row("agent", "agent_id", "name", "created_at", "last_seen_at")), c.select(*row("code", "code", "status", "created_at", "used_at", "agent_id"))])


@query
def registry_lists(spark, sf_dir):
    agents = reads.registry(mapped.agents(spark, sf_dir), TENANT, "agent_id").select(F.lit("agent").alias("kind"), F.col("agent_id").alias("id"))
    return agents.unionByName(reads.registry(mapped.codes(spark, sf_dir), TENANT, "code").select(F.lit("code").alias("kind"), F.col("code").alias("id")))


@query
def activation_claims(spark, sf_dir):
    return reads.claims(mapped.claim_requests(spark, sf_dir), mapped.codes(spark, sf_dir))


@query
def activation_usage(spark, sf_dir):
    return reads.code_usage(mapped.codes(spark, sf_dir))


@query
def stream_parse(spark, sf_dir):
    path = work_dir(spark)
    rows = mapped.receipts(spark, sf_dir).select("ticket_id", "raw_text", "o_orderkey")
    _arriving(spark, rows, _orders(spark, sf_dir), path, lambda stream: jobs.transform_stream(stream, _parsed_tickets, f"{path}/out", f"{path}/log"))
    return spark.read.parquet(f"{path}/out").drop("batch")


def _arriving(spark: SparkSession, rows: DataFrame, within: DataFrame, path: str, run: Callable[[DataFrame], None]) -> None:
    """Hands rows to a job in three portions, in the order of the column of `within`; each is written when the job is through with those before."""
    portion = _portion(within)
    for k in range(3):
        rows.where(portion == k).write.mode("append").parquet(f"{path}/in")
        run(jobs.source(spark, f"{path}/in", rows.schema, 1000))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped.table(spark, sf_dir, "orders").select("o_orderkey")


def _portion(within: DataFrame):
    """Which third of its range, as a given table has it, a column's value is in."""
    by = within.columns[0]
    lo, hi = within.agg(F.min(by), F.max(by)).first()  # one row
    return F.floor((F.col(by) - F.lit(lo)) / ((hi - lo) // 3 + 1 if lo is not None else 1))


@query
def stream_dedup(spark, sf_dir):
    """Requests in order of arrival, in three portions."""
    path = work_dir(spark)
    rows = _accepted(spark, sf_dir)
    _arriving(spark, rows, mapped.table(spark, sf_dir, "events").select(F.col("event_id").alias("arrival_seq")), path, lambda stream: jobs.dedup_stream(stream, f"{path}/out", f"{path}/log"))
    keys = rows.select(*ingest.KEY, "arrival_seq")
    return jobs.read_table(spark, f"{path}/out", keys.schema, ("day",)).select(*keys.columns)


@query
def stream_claims(spark, sf_dir):
    path, codes = work_dir(spark), mapped.codes(spark, sf_dir)
    _arriving(spark, mapped.claim_requests(spark, sf_dir), mapped.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq")), path, lambda stream: jobs.claims_stream(stream, codes, f"{path}/out", f"{path}/log"))
    return spark.read.parquet(f"{path}/out/outcomes").drop("batch")


#: The given tables hold a few receipts for each day and tenant.
_FOLDERS = ("tenant", "year")


def _ticket_tables(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the change log of all tickets (`in`) and the tables that it makes (`out`), in three portions."""
    path, tenants = work_dir(spark), mapped.tenants(spark, sf_dir)
    _arriving(spark, mapped.change_events(spark, sf_dir), _orders(spark, sf_dir), path, lambda stream: jobs.ticket_stream(stream, tenants, None, f"{path}/out", f"{path}/log", _FOLDERS))
    return path


def _current(spark: SparkSession, out: str) -> DataFrame:
    return ingest.current_state(jobs.read_table(spark, f"{out}/tickets", jobs.OUTCOME, _FOLDERS).drop(*_FOLDERS, "batch"), *_STATE[2:])


_STATE = ("tenant_id", "ticket_id", "status", "parsed_by", "reason")


@query
def stream_tickets(spark, sf_dir):
    """The current state of all tickets."""
    return _current(spark, f"{_ticket_tables(spark, sf_dir)}/out").select(*_STATE)


@query
def stream_answers(spark, sf_dir):
    """The current state of all tickets, with a model's answers from a source of their own. Of the tickets that have one, a third each got it
    before they came themselves, with them, and two portions after."""
    path, tenants = work_dir(spark), mapped.tenants(spark, sf_dir)
    events = mapped.change_events(spark, sf_dir)
    at = _portion(_orders(spark, sf_dir)) + 1
    late = F.element_at(F.array(F.lit(-1), F.lit(0), F.lit(2)), (F.col("o_orderkey") % 3 * 2 + F.floor(F.col("o_orderkey") / 8)).cast("int") % 3 + 1)
    r = mapped.receipts(spark, sf_dir)
    answers = _answers(r.select("*", (at + late).alias("portion")), "portion")
    for k in range(6):
        events.where(at == k).write.mode("append").parquet(f"{path}/events")
        answers.where(F.col("portion") == k).drop("portion").write.mode("append").parquet(f"{path}/said")
        both = (jobs.source(spark, f"{path}/{x}", t.schema, 1000) for x, t in (("events", events), ("said", answers.drop("portion"))))
        jobs.answered_stream(*both, tenants, f"{path}/out", f"{path}/log", _FOLDERS)
    return _current(spark, f"{path}/out").select(*_STATE)


def _item_table(spark: SparkSession, out: str) -> DataFrame:
    jobs.items_stream(spark, out, f"{out}/items", f"{out}/items-log", _FOLDERS)
    schema = spark.createDataFrame([], decision.flatten(spark.createDataFrame([], jobs.OUTCOME)).schema).schema
    return spark.read.schema(schema).parquet(f"{out}/items")


_ITEM = ("tenant_id", "ticket_id", "description", "quantity", "subtotal", "voided", "discount", "tip", "total", "year", "month", "day")


@query
def stream_gold(spark, sf_dir):
    """The item table, by the stream that follows the outcomes; then every ninth ticket is parsed anew, from a text that is no
    receipt, and loses its items, all those of some folders among them."""
    path = _ticket_tables(spark, sf_dir)
    out = f"{path}/out"
    _item_table(spark, out)
    jobs.ticket_batch(_unreadable(spark.read.parquet(f"{path}/in")), 1000, mapped.tenants(spark, sf_dir), None, out, _FOLDERS)
    return _item_table(spark, out).select(*_ITEM)


def _unreadable(log: DataFrame) -> DataFrame:
    """Changes of the log once more, with another text: its own texts are not read, let alone made anew."""
    return log.where((F.col("o_orderkey") % 9 == 0) | _emptied()).withColumn("raw_text", F.lit("no receipt"))


def _emptied():
    """Tickets of one tenant's year."""
    return (F.col("tenant_id") == TENANT) & F.col("captured_at").startswith("1995")


@query
def stream_quarantine(spark, sf_dir):
    return spark.read.parquet(f"{_ticket_tables(spark, sf_dir)}/out/quarantine").select("tenant_id", "ticket_id", "reason")


@query
def requeue(spark, sf_dir):
    """The state of tickets that were quarantined, after parsers of five more versions, one of them twice, have tried; the first of them reads
    an amount that was unreadable. Five attempts at most."""
    path, tenants = work_dir(spark), mapped.tenants(spark, sf_dir)
    events = _written(mapped.change_events(spark, sf_dir), f"{path}/events")
    jobs.ticket_batch(events, 0, tenants, None, path, _FOLDERS)
    # the raw table of this replay: the texts of all tickets that are in the ledger, moved once
    payloads = jobs.pending(events).select(*ingest.KEY, "raw_text").join(jobs.attempts(spark, path).select(*ingest.KEY), ingest.KEY, "left_semi")
    payloads = _written(payloads.drop("captured_at"), f"{path}/raw")
    better = decision.PARSERS | {"columns38": lambda raw: parse_receipt(F.replace(raw, F.lit("$1,2,3"), F.lit("$10,00")))}
    for n, version in enumerate("abbcde", 1):
        jobs.requeue(spark, n, tenants, payloads, path, _FOLDERS, better, version)
    return jobs.attempts(spark, path).join(_current(spark, path), ingest.KEY).select(*_STATE, "attempts")
