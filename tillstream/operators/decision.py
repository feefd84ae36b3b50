"""From raw receipts to outcomes: tenant and parser lookup, parsing, checks, and one decision per receipt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstream.functions.text import CANDIDATE, json_candidate, once, parse_receipt
from tillstream.functions.wrapped import parse_wrapped
from tillstream.operators.coherence import incoherence

#: Parsers by id: raw text to struct<candidate, poison>. Add one to plug in another layout.
PARSERS: dict[str, Callable[[Column], Column]] = {"columns38": parse_receipt, "wrapped": parse_wrapped}
#: Names the parsers as they are; what an earlier version could not read may be tried again by another.
VERSION = "2"


def with_parser(tickets: DataFrame, tenants: DataFrame) -> DataFrame:
    """Adds `known` (the tenant exists) and `parser`: that of the ticket's port, else the tenant's own.

    tenants: one row per tenant (tenant_id, parser_id, port_parsers map); kept by Spark's own choice
    of join, as the table may outgrow a broadcast."""
    t = tenants.select(F.col("tenant_id"), "parser_id", "port_parsers", F.lit(True).alias("known")).dropDuplicates(["tenant_id"])
    out = tickets.join(t, "tenant_id", "left")
    parser = F.coalesce(F.try_element_at("port_parsers", F.col("port")), F.col("parser_id"))
    return out.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("parser", parser).drop("parser_id", "port_parsers")


def parsed(tickets: DataFrame, parsers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Adds `own` = struct<candidate, poison> by each row's parser; a missing text is an empty one."""
    raw, chain = F.coalesce("raw_text", F.lit("")), None
    for name, parse in (parsers or PARSERS).items():
        chain = (F if chain is None else chain).when(F.col("parser") == name, parse(raw))
    return tickets.select("*", once(chain).alias("own"))


def _outcome(status: str, parsed_by: str | None = None, reason: Column | None = None) -> Column:
    no = F.lit(None).cast("string")
    reason = no if reason is None else reason
    return F.struct(F.lit(status).alias("status"), (F.lit(parsed_by) if parsed_by else no).cast("string").alias("parsed_by"), reason.cast("string").alias("reason"))


def decide(tickets: DataFrame, tenants: DataFrame, answers: DataFrame | None = None, parsers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """tickets (tenant_id, captured_at, ticket_id, port, raw_text) with status, parsed_by, reason and
    candidate. Poisoned receipts get status `quarantined`. With answers (the same three keys and
    response_text), a receipt that its own parser can't close is taken from there for review; without
    an answer row it stays `pending`."""
    known = F.col("known") & F.col("parser").isin(*(parsers or PARSERS))
    rows = parsed(with_parser(tickets, tenants), parsers).withColumn("own_reason", incoherence(F.col("own.candidate")))
    closes = F.col("own.candidate").isNotNull() & F.col("own_reason").isNull()
    if answers is None:
        rows = rows.withColumn("second", F.lit(None).cast(rows.schema["own"].dataType["candidate"].dataType)).withColumn("asked", F.lit(None).cast("boolean"))
    else:
        a = answers.select("tenant_id", "captured_at", "ticket_id", "response_text", F.lit(True).alias("asked")).dropDuplicates(["tenant_id", "captured_at", "ticket_id"])
        rows = rows.join(a, ["tenant_id", "captured_at", "ticket_id"], "left").withColumn("second", F.when(~closes, json_candidate(F.col("response_text")))).drop("response_text")
    rows = rows.withColumn("second_reason", incoherence(F.col("second")))
    second = F.col("second").isNotNull() & F.col("second_reason").isNull()
    why = F.coalesce(F.when(F.col("second").isNotNull(), F.col("second_reason")), F.when(F.col("own.candidate").isNotNull(), F.col("own_reason")))
    none = "no_parser_matched" if answers is None else "no_parser_matched_incl_fallback"
    case = (
        F.when(~F.col("known"), _outcome("failed", None, F.lit("tenant_not_found")))
        .when(~F.coalesce(known, F.lit(False)), _outcome("failed", None, F.lit("unknown_parser")))
        .when(F.col("own.poison").isNotNull(), _outcome("quarantined", None, F.col("own.poison")))
        .when(closes, _outcome("parsed", "deterministic"))
    )
    if answers is not None:
        case = case.when(F.col("asked").isNull(), _outcome("pending", None, F.lit("no_answer"))).when(second, _outcome("needs_review", "model-fallback"))
    case = case.when(why.isNotNull(), _outcome("failed", None, F.concat(F.lit("incoherent: "), why))).otherwise(_outcome("failed", None, F.lit(none)))
    out = rows.select("*", once(case).alias("d"))
    candidate = F.when(F.col("d.status") == "parsed", F.col("own.candidate")).when(F.col("d.status") == "needs_review", F.col("second"))
    return out.select("tenant_id", "captured_at", "ticket_id", "port", "d.status", "d.parsed_by", "d.reason", candidate.alias("candidate"))


def foldered(outcomes: DataFrame) -> DataFrame:
    """With the columns that item tables are partitioned by: tenant and the parts of the instant's day, as text."""
    at = F.col("captured_at")
    return outcomes.withColumns({"tenant": F.col("tenant_id"), "year": F.substring(at, 1, 4), "month": F.substring(at, 6, 2), "day": F.substring(at, 9, 2)})


def flatten(outcomes: DataFrame) -> DataFrame:
    """One row per item of accepted receipts, the receipt's own columns repeated, with the partition columns."""
    rows = foldered(outcomes).where(F.col("status").isin("parsed", "needs_review")).select("*", F.explode("candidate.items").alias("i"))
    return rows.select(
        "tenant_id", "ticket_id", "captured_at", "port", "status", "parsed_by", "i.description", "i.quantity", "i.unit_price", "i.subtotal", F.coalesce("i.voided", F.lit(False)).alias("voided"),
        "candidate.discount", "candidate.tip", "candidate.total", "tenant", "year", "month", "day",
    )


def quarantine(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("status = 'quarantined'").select("tenant_id", "captured_at", "ticket_id", "reason")
