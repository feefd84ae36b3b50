"""Ingest: credential lookup, validation with the first failing rule, first-writer-wins dedup, latest payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions.text import once
from tillstream.sources.shared import sent

# fixed values: shapes and the largest text that is taken
UUID_SHAPE = r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
PORT_SHAPE = r"\A[A-Za-z0-9_.-]+\z"
INSTANT_SHAPE = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z\z"
MAX_PORT, MAX_BYTES = 64, 65_536
KEY = ["tenant_id", "captured_at", "ticket_id"]
BODY = "ticket_id string, port string, captured_at string, raw_text string"


def with_json(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the JSON value that a text is, as a VARIANT; NULL if it is none. The parser stops behind the first value, so
    the text is read as the only member of an array, and where it could close that early, of an object too: text
    behind the value fits one of them at most. Of a repeated key the last value counts; Spark has that as a setting of the session."""
    rows.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    t, inside = F.col(text), F.col(f"{name}_inside")
    rows = rows.withColumn(f"{name}_inside", F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))))
    closed = ~F.contains(t, F.lit("]")) | F.try_parse_json(F.concat(F.lit('{"a":'), t, F.lit("}"))).isNotNull()
    alone = closed & F.try_variant_get(inside, "$[1]", "variant").isNull()
    return rows.withColumn(name, F.when(alone, F.try_variant_get(inside, "$[0]", "variant"))).drop(f"{name}_inside")


def is_object(v: Column) -> Column:
    """An object or an array, which has no fields."""
    return F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)<"), F.lit(False))


def string_field(v: Column, path: str) -> Column:
    """A field's text; NULL where it is missing or of another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def decoded(requests: DataFrame) -> DataFrame:
    """requests (api_key_id, arrival_seq, body JSON) with the body's fields, read by type; `corrupt`: the body is no
    JSON value, `shapeless`: it is one without fields."""
    rows = with_json(requests, "body", "b")
    fields = [string_field(F.col("b"), f"$.{a}").alias(c) for a, c in (("ticketId", "ticket_id"), ("port", "port"), ("capturedAt", "captured_at"), ("rawText", "raw_text"))]
    read = F.struct(*fields, F.col("b").isNull().alias("corrupt"), (F.col("b").isNotNull() & ~is_object(F.col("b"))).alias("shapeless"))
    return rows.select("api_key_id", "arrival_seq", once(read).alias("read")).select("api_key_id", "arrival_seq", "read.*")


def resolve_tenant(requests: DataFrame, agents: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds tenant_id: that of the agent with the key, else of the tenant with it; NULL if neither."""
    a = agents.where("api_key_id is not null").groupBy("api_key_id").agg(F.min("tenant_id").alias("by_agent"))
    t = tenants.where("api_key_id is not null").groupBy("api_key_id").agg(F.min("tenant_id").alias("by_tenant"))
    # sent to the requests where they are few, as a shuffle by key would move all bodies
    out = requests.join(sent(a) or a, "api_key_id", "left").join(sent(t) or t, "api_key_id", "left")
    return out.withColumn("tenant_id", F.coalesce("by_agent", "by_tenant")).drop("by_agent", "by_tenant")


def reject_reason() -> Column:
    """The first rule that a request fails, or NULL."""
    text = F.coalesce("raw_text", F.lit(""))
    return (
        F.when(F.col("api_key_id").isNull(), "no_key").when(F.col("tenant_id").isNull(), "unknown_key").when(F.col("corrupt"), "no_json").when(F.col("shapeless"), "not_object")
        .when(~F.coalesce(F.col("ticket_id").rlike(UUID_SHAPE), F.lit(False)), "ticket_id")
        .when(~F.coalesce(F.col("port").rlike(PORT_SHAPE) & (F.length("port") <= MAX_PORT), F.lit(False)), "port")
        .when(~F.coalesce(F.col("captured_at").rlike(INSTANT_SHAPE) & F.try_to_timestamp("captured_at").isNotNull(), F.lit(False)), "captured_at")
        .when(text == "", "empty_text").when(F.octet_length(text) > MAX_BYTES, "text_too_long")
    )


def first_of_each(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Key and arrival_seq of the earliest arrival of each (tenant, instant, ticket) that is not in `seen`. Aggregated
    before the shuffle, so that a ticket sent over and over costs one row per task; payloads are not moved."""
    out = rows.groupBy(*KEY).agg(F.min("arrival_seq").alias("arrival_seq"))
    return out if seen is None else out.join(seen.select(*KEY), KEY, "left_anti")


def with_payload(tickets: DataFrame, payloads: DataFrame) -> DataFrame:
    """tickets with raw_text, looked up by (tenant, ticket); a missing payload is an empty text."""
    own = payloads.select("tenant_id", "ticket_id", "raw_text")
    return tickets.join(own, ["tenant_id", "ticket_id"], "left").withColumn("raw_text", F.coalesce("raw_text", F.lit("")))


def write_payloads(rows: DataFrame, path: str) -> None:
    """The raw table: the latest payload of each (tenant, ticket), in a folder per tenant; a retry replaces what was there."""
    out = latest_payload(rows).withColumn("tenant", F.col("tenant_id"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant").parquet(path)


def latest_payload(rows: DataFrame) -> DataFrame:
    """The text that was written last for each (tenant, ticket). Where these are few, the last arrivals are found first, without
    texts (they stay cached), and rows that arrived at other times go before their texts are read, sorted or moved."""
    last = rows.groupBy("tenant_id", "ticket_id").agg(F.max("arrival_seq").alias("last")).select("last").persist()
    few = sent(last)
    if few is None:
        last.unpersist()
    else:
        rows = rows.join(few, F.col("arrival_seq").eqNullSafe(F.col("last")), "left_semi")
    return rows.groupBy("tenant_id", "ticket_id").agg(F.max_by("raw_text", "arrival_seq").alias("raw_text"))


def current_state(outcomes: DataFrame, *only: str) -> DataFrame:
    """The latest outcome (by `version`) of each ticket, in one shuffle; one that was never decided has its first state. Of
    several with one version the same one is taken each time. With `only`, these columns alone are moved and given."""
    rest = [c for c in outcomes.columns if c not in KEY]
    order = F.struct("version", F.coalesce("status", F.lit("")).alias("s"), F.coalesce("reason", F.lit("")).alias("r"), F.xxhash64(*rest).alias("h"))
    rows = outcomes.select(*KEY, F.struct(*(only or rest)).alias("o"), order.alias("at"))  # the hash is taken before columns are left behind
    return rows.groupBy(*KEY).agg(F.max_by("o", "at").alias("o")).select(*KEY, "o.*")
