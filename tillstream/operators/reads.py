"""Keyed reads: newest-first pages with cursors, registry lists, activation claims."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstream.functions.text import strip
from tillstream.sources.shared import folder, subfolders

# fixed values: page sizes, the shape of an activation code, states of a ticket, and what lists show
DEFAULT_PAGE, MAX_PAGE = 50, 100
STATUSES = ("pending", "parsed", "needs_review", "failed")
PUBLIC_TICKET = ("ticket_id", "port", "captured_at", "status", "parsed_at", "items", "total", "discount", "tip", "fail_reason", "parsed_by")
PUBLIC_WIDGET = ("widget_id", "name", "visualization", "metric", "group_by", "filters", "created_at")
PUBLIC_AGENT = ("agent_id", "name", "created_at", "last_seen_at")
PUBLIC_CODE = ("code", "status", "created_at", "used_at", "agent_id")
CODE_SHAPE = r"\A[A-Z2-9]{5}-[A-Z2-9]{5}\z"


def page_size(limit: object) -> int:
    """A whole number of 1 or more, 100 at most; anything else is 50."""
    text = str(limit).strip()
    n = float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text, re.A) else float("nan")
    return int(min(n, MAX_PAGE)) if n >= 1 and n.is_integer() else DEFAULT_PAGE


def cursor(captured_at: Column, ticket_id: Column) -> Column:
    """An opaque text that names a place in the order: URL-safe base64 without padding of JSON."""
    return F.translate(F.base64(F.to_json(F.struct(captured_at.alias("c"), ticket_id.alias("t"))).cast("binary")), "+/=", "-_")


def cursor_place(text: Column) -> Column:
    """struct<c, t> of a cursor; NULL if it is none."""
    padded = F.rpad(F.translate(text, "-_", "+/"), (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    place = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "c string, t string")
    return F.when(place["c"].isNotNull() & place["t"].isNotNull(), place)


def ticket_page(tickets: DataFrame, tenant: str, limit: object = None, status: str | None = None, after: tuple[str, str] | None = None) -> DataFrame:
    """A tenant's tickets, newest first by (captured_at, ticket_id), behind the place `after`; `more` tells of a next
    page, `next` in the last row is the cursor that asks for it. An unknown status is an error."""
    if status is not None and status not in STATUSES:
        raise ValueError(f"unknown status {status!r}")
    n, rows = page_size(limit), tickets.where(F.col("tenant_id") == tenant)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if after is not None:
        rows = rows.where((F.col("captured_at") < after[0]) | ((F.col("captured_at") == after[0]) & (F.col("ticket_id") < after[1])))
    top = rows.orderBy(F.desc("captured_at"), F.desc("ticket_id")).limit(n + 1)  # n + 1 tells if there is more
    numbered = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("captured_at"), F.desc("ticket_id"))))  # at most 101 rows
    paged = numbered.withColumn("more", F.max("place").over(Window.partitionBy(F.lit(1))) > n).where(F.col("place") <= n)
    return paged.withColumn("next", F.when(F.col("more") & (F.col("place") == n), cursor(F.col("captured_at"), F.col("ticket_id"))))


def newest_first(spark: SparkSession, path: str, folders: tuple[str, ...], upto: str | None = None) -> Iterator[tuple[str, ...]]:
    """The folders below a path (year, and perhaps month and day), newest first, listed as they are asked for. upto: the text
    of an instant behind which there is nothing to look for."""
    for value in subfolders(spark, path, folders[0]):
        size = 4 if folders[0] == "year" else 2
        if upto is not None and value > upto[:size]:
            continue
        if len(folders) == 1:
            yield (value,)
        else:
            rest = upto[size + 1 :] if upto is not None and value == upto[:size] else None
            yield from ((value, *x) for x in newest_first(spark, f"{path}/{folder(spark, folders[:1], (value,))}", folders[1:], rest))


def page_walk(
    spark: SparkSession, path: str, read: Callable[[list[str]], DataFrame], tenant: str, limit: object = None, status: str | None = None, after: tuple[str, str] | None = None, folders: tuple[str, ...] = ("year", "month", "day")
) -> DataFrame:
    """`ticket_page` of a table in folders by tenant and parts of the day: walks back from the newest folder, or the cursor's,
    and stops once there is a page and one row more. read: the current tickets in some folders, all of whose states lie there.
    Twice as many folders are taken in each step, so that a rare status takes few steps."""
    n, base = page_size(limit), f"{path}/{folder(spark, ('tenant',), (tenant,))}"
    walk, taken, step = newest_first(spark, base, folders, None if after is None else after[0]), [], 1
    while True:
        new = [f"{base}/{folder(spark, folders, x)}" for x in islice(walk, step)]
        taken += new
        page = ticket_page(read(taken), tenant, limit, status, after)
        if len(new) < step or (page.count() == n and page.where("more").limit(1).count()):
            return page
        step *= 2


def public_tickets(outcomes: DataFrame, tenant: str) -> DataFrame:
    """The 11 columns that a tenant sees of its decided tickets."""
    c, done = F.col("candidate"), F.col("status").isin("parsed", "needs_review")
    parsed_at = F.col("parsed_at") if "parsed_at" in outcomes.columns else F.lit(None).cast("timestamp")
    rows = outcomes.where(F.col("tenant_id") == tenant).withColumns({
        "parsed_at": F.when(done, parsed_at), "items": c["items"], "total": c["total"], "discount": c["discount"], "tip": c["tip"],
        "fail_reason": F.when(~done & (F.col("status") != "pending"), F.col("reason")),
    })
    return rows.select(*PUBLIC_TICKET)


def registry(rows: DataFrame, tenant: str, *columns: str) -> DataFrame:
    return rows.where(F.col("tenant_id") == tenant).select(*columns)


def claims(requests: DataFrame, codes: DataFrame) -> DataFrame:
    """Each claim with its outcome: `won`, or `rejected` (malformed name or code, unknown or used code,
    or a code that an earlier claim won). requests: claim_id, code, name, agent_id, seq."""
    named = (strip(F.coalesce("name", F.lit("x"))) != "") & (F.length(F.coalesce("name", F.lit("x"))) <= 100)
    valid = F.coalesce(F.col("code").rlike(CODE_SHAPE), F.lit(False)) & named
    free = codes.where("status = 'unused'").select("tenant_id", "code").dropDuplicates(["code"])
    ok = requests.where(valid).join(free, "code")
    first = ok.groupBy("code").agg(F.min(F.struct("seq", "claim_id")).alias("f")).select(F.col("f.claim_id").alias("claim_id"), F.lit(True).alias("won"))
    out = requests.join(first, "claim_id", "left").join(free, "code", "left")
    won = F.coalesce("won", F.lit(False))
    shown = F.coalesce(strip(F.col("name")), F.concat(F.lit("Robot "), F.substring("agent_id", 1, 8)))
    return out.select("claim_id", "code", F.when(won, F.col("tenant_id")).alias("tenant_id"), F.when(won, shown).alias("agent_name"), F.when(won, "won").otherwise("rejected").alias("outcome"))


def code_usage(codes: DataFrame) -> DataFrame:
    return codes.groupBy("tenant_id").agg(F.count_if(F.col("status") == "used").alias("used"), F.count("*").alias("total"))
