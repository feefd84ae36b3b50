"""Receipt-shaped tables derived from the given star schema (orders, lineitem, part, customer, nation, supplier, events)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows over all cores, if they come in fewer splits: a small file is one split, however much is made of its rows. A table
    of many splits stays as it is."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.rdd().getNumPartitions() >= n else rows.repartition(n, *keys)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: the columns that a receipt has."""
    o, c = dealt(table(spark, sf_dir, "orders"), "o_orderkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    review = F.col("o_orderstatus") == "O"
    part = lambda every, share: F.when(F.col("o_orderkey") % every == 0, F.floor(F.col("o_totalprice") * share).cast("double"))
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("tenant"), F.col("o_orderkey").cast("string").alias("ticket_id"), "o_orderkey",
        F.date_format("o_orderdate", INSTANT).alias("captured_at"), F.concat(F.lit("COM"), F.substring("o_orderpriority", 1, 1)).alias("port"),
        F.when(review, "needs_review").otherwise("parsed").alias("status"), F.when(review, "model-fallback").otherwise("deterministic").alias("parsed_by"),
        part(4, 0.1).alias("discount"), part(5, 0.05).alias("tip"), F.col("o_totalprice").alias("total"),
    )


def ticket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table: one row per order line, the receipt's own columns repeated."""
    lines, part = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = tickets(spark, sf_dir).join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        "tenant", "ticket_id", "captured_at", "port", "status", "parsed_by", F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_extendedprice").alias("subtotal"), (F.col("l_returnflag") == "R").alias("voided"), "discount", "tip", "total",
    )


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that each order's rendered receipt shows, in whole units."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    q, u = F.floor("l_quantity").cast("long"), F.floor("p_retailprice").cast("long")
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.col("p_name").alias("name"), q.alias("q"), u.alias("u"), (q * u).alias("s"), (F.col("l_returnflag") == "R").alias("voided"))


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with lines as receipt text: tenant_id, ticket_id, captured_at, port, raw_text, and
    live (the sum that is due), discount, tip. o_orderkey % 8 picks the kind: 1 with a discount, 2 with a
    tip, 3 with a wrong total, 4 with an unreadable amount, 5 with an impossible date, 6 with carriage
    returns, 7 without a total."""
    line = F.concat_ws("", F.col("q").cast("string"), F.lit("  "), F.col("name"), F.lit("   "), F.col("u").cast("string"), F.lit("  "), F.col("s").cast("string"), F.when(F.col("voided"), "  *ANULADO*").otherwise(""))
    item = F.struct("l_linenumber", "l_partkey", "q", "voided", line.alias("line"))
    own = receipt_lines(spark, sf_dir).groupBy("o_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum(F.when(~F.col("voided"), F.col("s")).otherwise(0)).alias("live"))
    kind = F.col("o_orderkey") % 8
    rows = tickets(spark, sf_dir).select("tenant", "ticket_id", "o_orderkey", "captured_at", "port").join(own, "o_orderkey")
    rows = rows.withColumn("disc", F.when(kind == 1, 5).otherwise(0)).withColumn("tips", F.when(kind == 2, 7).otherwise(0))
    total = F.col("live") - F.col("disc") + F.col("tips") + F.when(kind == 3, 100).otherwise(0)
    shown = F.concat(F.lit("TOTAL: $"), F.when(kind == 4, F.lit("1,2,3")).otherwise(F.concat(F.replace(F.format_number(total, 0), F.lit(","), F.lit(".")), F.lit(",00"))))
    date = F.concat(F.lit("Fecha: 05/"), F.when(kind == 5, "13").otherwise("07"), F.lit("/2026   Hora: 21:40"))
    lines = F.concat(
        F.array(F.lit("   BAR EL CEIBO"), date, F.lit("")), F.transform("items", lambda x: x["line"]),
        F.when(kind == 1, F.array(F.lit("Descuento: -$ 5,00"))).otherwise(F.array().cast("array<string>")), F.when(kind == 2, F.array(F.lit("Propina: 7"))).otherwise(F.array().cast("array<string>")),
        F.when(kind == 7, F.array(F.lit("SUBTOTAL: 1"))).otherwise(F.array(F.lit("SUBTOTAL: 1"), shown)),
    )
    text = F.when(kind == 6, F.array_join(lines, "\r\n")).otherwise(F.array_join(lines, "\n"))
    return rows.select(F.col("tenant").alias("tenant_id"), "ticket_id", "o_orderkey", "captured_at", "port", text.alias("raw_text"), "live", "disc", "tips", total.alias("total"))


def wrapped_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with lines as a receipt in the second layout, with cents and names over several lines: ticket_id, tenant_id, captured_at,
    port, raw_text."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    q, u = F.floor("l_quantity").cast("long"), F.round(F.col("p_retailprice") * 100).cast("long")
    money = lambda cents: F.concat(F.replace(F.format_number(F.floor(cents / 100).cast("long"), 0), F.lit(","), F.lit(".")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    line = F.concat(F.replace("p_name", F.lit(" "), F.lit("\n  ")), F.lit("\n"), q.cast("string"), F.lit(" x "), money(u), F.lit("     "), money(q * u), F.when(F.col("l_returnflag") == "R", " ANULADO").otherwise(""))
    own = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", q.alias("q"), line.alias("line")))).alias("items"), F.sum(F.when(F.col("l_returnflag") != "R", q * u).otherwise(0)).alias("live"))
    text = F.concat(F.lit("BAR EL CEIBO\nCalle 7\n\n2026-07-05 21:40\n"), F.array_join(F.transform("items", lambda x: x["line"]), "\n"), F.lit("\nTOTAL $ "), money(F.col("live")), F.lit("\nGracias"))
    return tickets(spark, sf_dir).join(own, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("tenant").alias("tenant_id"), "ticket_id", "captured_at", "port", text.alias("raw_text"))


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation but the fourth is a tenant; every fifth has another parser, except on port COM1."""
    n = table(spark, sf_dir, "nation").where("n_nationkey != 3")
    other = F.col("n_nationkey") % 5 == 0
    return n.select(
        F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("tenant_id"), F.when(other, "columns80").otherwise("columns38").alias("parser_id"),
        F.when(other, F.create_map(F.lit("COM1"), F.lit("columns38"))).alias("port_parsers"), F.concat(F.lit("K"), F.col("n_nationkey").cast("string")).alias("api_key_id"),
    )


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.concat(F.lit("K"), (F.col("s_suppkey") % 60 + 20).cast("string"))
    own = [F.col("s_name").alias("name"), F.lit("2026-01-02").alias("created_at"), F.lit(None).cast("string").alias("last_seen_at")]
    return s.select(F.concat(F.lit("T"), F.col("s_nationkey").cast("string")).alias("tenant_id"), F.col("s_suppkey").cast("string").alias("agent_id"), key.alias("api_key_id"), *own)


#: Fields of an ingest request by event, as SQL that Spark and other engines read alike; every rule is broken by some.
REQUEST_FIELDS = """
  event_id AS arrival_seq,
  CASE WHEN event_id % 47 = 0 THEN NULL ELSE concat('K', CAST(user_id % 90 AS STRING)) END AS api_key_id,
  event_id % 43 = 0 AS corrupt,
  CASE WHEN event_id % 31 = 0 THEN 'not-a-uuid' ELSE concat('0000', lpad(CAST(event_id % 3000 AS STRING), 4, '0'), '-0000-4000-8000-00000000000A') END AS ticket_id,
  CASE event_id % 29 WHEN 0 THEN '' WHEN 1 THEN 'COM 3' WHEN 2 THEN repeat('p', 65) ELSE concat('COM', CAST(user_id % 9 AS STRING)) END AS port,
  CASE event_id % 37 WHEN 0 THEN '2026-02-31T00:00:00.000Z' WHEN 1 THEN '2026-01-01' ELSE concat('2026-01-', lpad(CAST(1 + event_id % 28 AS STRING), 2, '0'), 'T10:00:00.000Z') END AS captured_at,
  CASE event_id % 41 WHEN 0 THEN '' WHEN 1 THEN repeat('ñ', 32769) WHEN 2 THEN repeat('ñ', 32768) ELSE concat('receipt ', CAST(event_id AS STRING)) END AS raw_text,
  CASE event_id % 53 WHEN 0 THEN 'trailing' WHEN 1 THEN 'number' WHEN 2 THEN 'boolean' WHEN 3 THEN 'object' WHEN 4 THEN 'array' WHEN 5 THEN 'null' WHEN 6 THEN 'list' WHEN 7 THEN 'missing' WHEN 8 THEN 'repeated' ELSE 'whole' END AS form
"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """api_key_id, arrival_seq and the JSON body of each ingest request."""
    rows = dealt(table(spark, sf_dir, "events"), "event_id").selectExpr(*[x.strip() for x in _columns(REQUEST_FIELDS)])
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    other = lambda form, value, c: F.when(F.col("form") == form, F.lit(value)).otherwise(quoted(c))
    text = F.when(F.col("form") == "boolean", "true").when(F.col("form") == "object", '{"a": 7}').otherwise(quoted("raw_text"))
    members = F.concat(F.lit('"ticketId": '), other("array", "[1, 2]", "ticket_id"), F.lit(', "port": '), other("number", "5", "port"), F.lit(', "capturedAt": '), quoted("captured_at"))
    members = F.when(F.col("form") == "repeated", F.concat(F.lit('"port": 7, "rawText": null, '), members)).otherwise(members)
    members = F.when(F.col("form") == "missing", members).otherwise(F.concat(members, F.lit(', "rawText": '), text))
    body = F.concat(F.lit("{"), members, F.lit("}"), F.when(F.col("form") == "trailing", " and more").otherwise(""))
    body = F.when(F.col("form") == "null", "null").when(F.col("form") == "list", "[1]").otherwise(body)
    return rows.select("api_key_id", "arrival_seq", F.when(F.col("corrupt"), F.lit('{"ticketId": ')).otherwise(body).alias("body"))


def _columns(text: str) -> list[str]:
    return [line.strip().rstrip(",") for line in text.strip().split("\n")]


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An activation code for each customer, every third one used."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("tenant_id"), _code(F.col("c_custkey")).alias("code"), F.when(F.col("c_custkey") % 3 == 0, "used").otherwise("unused").alias("status"))


def _code(k):
    """A number in base 34, with the letters and digits that codes have, in two groups of five."""
    text = F.translate(F.lpad(F.conv(k.cast("string"), 10, 34), 10, "0"), "01", "YZ")
    return F.concat(F.substring(text, 1, 5), F.lit("-"), F.substring(text, 6, 5))


def claim_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for each purchase, on the code of the customer with the buyer's number; every eleventh malformed."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    code = F.when(F.col("event_id") % 11 == 0, "aaaaa-00000").otherwise(_code(F.col("user_id")))
    name = F.when(F.col("event_id") % 7 == 0, " ").when(F.col("event_id") % 3 == 0, F.concat(F.lit(" till "), F.col("event_id").cast("string")))
    return e.select(F.col("event_id").alias("claim_id"), F.col("event_id").alias("seq"), code.alias("code"), name.alias("name"), F.concat(F.lit("agent-"), F.col("event_id").cast("string")).alias("agent_id"))


#: Bodies of widgets by event: JSON that breaks each rule on shapes and types.
WIDGET_BODIES = """
  event_id AS widget,
  CASE event_id % 12 WHEN 0 THEN '7' WHEN 1 THEN '{"name": 5, "visualization": "kpi"}' WHEN 2 THEN '{"name": "w", "visualization": "kpi", "metric": "total"}' WHEN 3 THEN '{"name": "w", "visualization": "kpi", "metric": {"field": 1, "aggregation": "sum"}}'
    WHEN 4 THEN '{"name": "w", "visualization": "kpi", "metric": {"field": "total", "aggregation": "sum"}, "groupBy": null}' WHEN 5 THEN '{"name": "w", "visualization": "kpi", "metric": {"field": "total", "aggregation": "sum"}, "filters": null}'
    WHEN 6 THEN '{"name": "w", "visualization": "bar", "metric": {"field": "total", "aggregation": "sum"}, "groupBy": "port", "filters": {"dateFrom": 20260101}}' WHEN 7 THEN '{"name": "w", "visualization": "bar", "metric": {"field": "total", "aggregation": "sum"}, "groupBy": "port", "filters": {"port": "COM3", "status": 1}}'
    WHEN 8 THEN '{"name": "w"} trailing' WHEN 9 THEN '{"name": " \\\\t\\\\u00a0", "visualization": "kpi"}' WHEN 10 THEN '{"name": " w ", "visualization": "bar", "metric": {"field": "quantity", "aggregation": "avg"}, "groupBy": "description", "filters": {"dateTo": "2026-07-31"}}'
    ELSE concat('{"name": "', event_type, '", "visualization": "kpi", "metric": {"field": "total", "aggregation": "sum"}}') END AS body
"""


def widget_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON body of a request to store a widget for each event."""
    widget, body = WIDGET_BODIES.strip().split(",\n", 1)
    return table(spark, sf_dir, "events").selectExpr(widget, body)


def registry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The activation codes with the columns of the registry."""
    used = F.col("status") == "used"
    c = table(spark, sf_dir, "customer").select(_code(F.col("c_custkey")).alias("code"), F.concat(F.lit("agent-"), F.col("c_custkey").cast("string")).alias("by"))
    rows = codes(spark, sf_dir).join(c, "code").withColumns({"created_at": F.lit("2026-01-03"), "used_at": F.when(used, "2026-01-04"), "agent_id": F.when(used, F.col("by"))})
    return rows.drop("by")


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log of the ticket table: an INSERT of each receipt as pending, and changes that must not be parsed again."""
    other = F.lit("1  other   2  2\nTOTAL: 2")
    row = lambda text, event, status: F.struct(text.alias("raw_text"), F.lit(event).alias("event"), F.lit(status).alias("status"))
    new = row(F.col("raw_text"), "INSERT", "pending")
    rows = F.when(F.col("o_orderkey") % 4 == 1, F.array(new, row(other, "MODIFY", "pending"), row(other, "INSERT", "parsed"))).otherwise(F.array(new))
    return receipts(spark, sf_dir).select("tenant_id", "ticket_id", "o_orderkey", "captured_at", "port", F.explode(rows).alias("e")).select("tenant_id", "ticket_id", "o_orderkey", "captured_at", "port", "e.*")
