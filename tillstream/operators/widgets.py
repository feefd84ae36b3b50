"""The closed widget language: white-listed measures, groupings and filters over the item table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstream.functions.text import strip
from tillstream.operators.ingest import is_object, string_field, with_json

# fixed values: business name to column; which measures are per item and which per ticket
ITEM_FIELDS = {"quantity": "quantity", "unitPrice": "unit_price", "subtotal": "subtotal"}
TICKET_FIELDS = {"discount": "discount", "tip": "tip", "total": "total"}
GROUPS = {"port": "port", "status": "status", "parsedBy": "parsed_by", "description": "description"}
AGGREGATIONS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}
EVENTS = "event_count"
VISUALS, STATUSES = ("kpi", "bar", "donut"), ("pending", "parsed", "needs_review", "failed")
TOP, NO_LABEL = 50, "(sin dato)"
DATE_SHAPE = r"\A\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d{3})?Z?)?\z"
PORT_SHAPE = r"\A[A-Za-z0-9_.-]{1,64}\z"


@dataclass(frozen=True)
class Spec:
    """One widget. The grouping alone decides between one value and a table of them."""

    tenant: str
    field: str
    aggregation: str = "sum"
    group_by: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    port: str | None = None
    status: str | None = None

    def __post_init__(self) -> None:
        if self.field not in (*ITEM_FIELDS, *TICKET_FIELDS, EVENTS):
            raise ValueError(f"unknown field {self.field!r}")
        if self.aggregation not in AGGREGATIONS:
            raise ValueError(f"unknown aggregation {self.aggregation!r}")
        if self.group_by is not None and self.group_by not in GROUPS:
            raise ValueError(f"unknown grouping {self.group_by!r}")
        if self.group_by == "description" and self.field in TICKET_FIELDS:
            raise ValueError("a ticket's measure can't be grouped by its items")


def matching_rule(spec: Spec) -> Column:
    """Whether an item row is the tenant's and within the filters."""
    rules = [F.col("tenant") == spec.tenant] + [op(F.col("captured_at"), v) for v, op in ((spec.date_from, Column.__ge__), (spec.date_to, Column.__le__)) if v is not None]
    return F.coalesce(reduce(Column.__and__, rules + [F.col(c) == v for c, v in (("port", spec.port), ("status", spec.status)) if v is not None]), F.lit(False))


def matching(items: DataFrame, spec: Spec, folders: tuple[str, ...] = (), years: tuple[int, int] | None = None) -> DataFrame:
    """The tenant's rows within the filters. Bounds compare as text, inclusive, on purpose: a date-only
    upper bound leaves out that day. `folders`: which of year, month and day the table is partitioned by, in this
    order; bounds on them are implied, so that the scan leaves other folders out. years: those that are visible, all by default."""
    rules = [F.col("tenant") == spec.tenant]
    begin, digits = F.concat_ws("-", *folders), (0, 4, 7, 10)[len(folders)]
    if spec.date_from is not None:
        rules += [F.col("captured_at") >= spec.date_from] + [begin >= spec.date_from[:digits]] * bool(folders)
    if spec.date_to is not None:
        rules += [F.col("captured_at") <= spec.date_to] + [begin <= spec.date_to[:digits]] * bool(folders)
    if years is not None:
        rules.append((F.col("year") if "year" in items.columns else F.substring("captured_at", 1, 4)).between(*(f"{y:04d}" for y in years)))
    rules += [F.col(c) == v for c, v in (("port", spec.port), ("status", spec.status)) if v is not None]
    return items.where(reduce(Column.__and__, rules))


def shaped(rows: DataFrame, digits: int | None) -> DataFrame:
    """Null and NaN values are 0, a null label is written out."""
    value = F.coalesce(F.nanvl(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("value", value if digits is None else F.round(value, digits))
    return rows.withColumn("label", F.coalesce("label", F.lit(NO_LABEL))) if "label" in rows.columns else rows


def _ticket_grain(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ticket and keys: a ticket's measures are repeated on its items, the larger of unequal copies counts."""
    return rows.groupBy("tenant", "ticket_id", *keys).agg(*(F.max(c).alias(c) for c in TICKET_FIELDS.values()))


def widget_query(items: DataFrame, spec: Spec, digits: int | None = None) -> DataFrame:
    """(value), or (label, value) with the 50 largest groups; ties go by label. Rounded before the cut if digits are given."""
    rows = matching(items, spec)
    keys = [] if spec.group_by is None else [GROUPS[spec.group_by]]
    if spec.field == EVENTS:
        value = F.count_distinct("ticket_id")
    elif spec.field in TICKET_FIELDS:
        rows, value = _ticket_grain(rows, keys), AGGREGATIONS[spec.aggregation](TICKET_FIELDS[spec.field])
    else:
        value = AGGREGATIONS[spec.aggregation](ITEM_FIELDS[spec.field])
    if not keys:
        return shaped(rows.agg(value.alias("value")), digits)
    out = rows.groupBy(F.col(keys[0]).alias("label")).agg(value.alias("value"))
    return shaped(out, digits).orderBy(F.desc("value"), F.asc("label")).limit(TOP)


def one_values(items: DataFrame, specs: dict[str, Spec], digits: int | None = None) -> DataFrame:
    """(widget, value) of widgets with one value and known filters, in one pass: each is a condition within the same aggregation."""
    fits = {n: matching_rule(s) for n, s in specs.items()}
    rows = items.where(reduce(Column.__or__, fits.values())).withColumns({f"fits_{i}": f for i, f in enumerate(fits.values())})
    on_tickets = [i for i, s in enumerate(specs.values()) if s.field in TICKET_FIELDS or s.field == EVENTS]

    def values(rows: DataFrame, which: list[int], column: Callable[[int, Spec], Column]) -> DataFrame:
        own = list(enumerate(specs.items()))
        agg = lambda s, c: F.count(c) if s.field == EVENTS else AGGREGATIONS[s.aggregation](c)
        return rows.agg(F.array(*(F.struct(F.lit(n).alias("widget"), agg(s, column(i, s)).cast("double").alias("value")) for i, (n, s) in own if i in which)).alias("v"))

    parts = []
    if on_tickets:
        named = [F.max(F.when(F.col(f"fits_{i}"), F.col(TICKET_FIELDS[s.field]) if s.field != EVENTS else F.lit(1))).alias(f"v_{i}") for i, s in enumerate(specs.values()) if i in on_tickets]
        parts.append(values(rows.groupBy("tenant", "ticket_id").agg(*named), on_tickets, lambda i, s: F.col(f"v_{i}")))
    if len(on_tickets) < len(specs):
        rest = [i for i in range(len(specs)) if i not in on_tickets]
        parts.append(values(rows, rest, lambda i, s: F.when(F.col(f"fits_{i}"), F.col(ITEM_FIELDS[s.field]))))
    return shaped(reduce(DataFrame.unionByName, parts).select(F.explode("v").alias("v")).select("v.*"), digits)


def every_measure(items: DataFrame, fields: dict[str, str], group: str | None = None, digits: tuple[int, int] = (2, 4)) -> DataFrame:
    """(tenant, field, aggregation[, label], value) of all tenants and measures of a grain in one pass over the items; of groups the 50 largest each."""
    keys = [] if group is None else [GROUPS[group]]
    rows = _ticket_grain(items, keys) if fields is TICKET_FIELDS else items
    pairs = [(f, a) for f in fields for a in AGGREGATIONS]
    named = [F.struct(F.lit(f).alias("field"), F.lit(a).alias("aggregation"), F.round(AGGREGATIONS[a](fields[f]).cast("double"), digits[a == "avg"]).alias("value")) for f, a in pairs]
    by = ["tenant", *(["label"] if keys else [])]
    out = rows.groupBy("tenant", *(F.col(k).alias("label") for k in keys)).agg(F.array(*named).alias("m"))
    out = shaped(out.select(*by, F.explode("m").alias("m")).select(*by, "m.*"), None)
    return _largest(out, "tenant", "field", "aggregation") if keys else out


def _largest(rows: DataFrame, *per: str) -> DataFrame:
    """The TOP groups of each; groups are few beside the rows they come from, so a window by tenant holds little."""
    place = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("value"), F.asc("label")))
    return rows.withColumn("place", place).where(F.col("place") <= TOP).drop("place")


def every_event_count(items: DataFrame, group: str | None = None) -> DataFrame:
    """(tenant[, label], value): distinct tickets of all tenants; of groups the 50 largest of each tenant.

    Few items of a ticket have one label, so that telling them apart before they are shuffled makes a table of nearly all rows
    of a task: with a label they are dealt by ticket first, over all shuffle partitions."""
    if group is None:
        return shaped(items.groupBy("tenant").agg(F.count_distinct("ticket_id").alias("value")), None)
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = items.select("tenant", F.col(GROUPS[group]).alias("label"), "ticket_id").repartition(n, "tenant", "ticket_id")
    return _largest(shaped(pairs.groupBy("tenant", "label").agg(F.count_distinct("ticket_id").alias("value")), None), "tenant")


def widgets_batch(items: DataFrame, specs: DataFrame, digits: int = 4) -> DataFrame:
    """All widgets of all tenants in one job: tenant, widget_id, label (null for one value), value.

    specs: tenant, widget_id, field, aggregation, group_by, date_from, date_to, port, status. The item table is read once
    and reduced before widgets meet it: a tenant's bounds cut its time into stretches, and each stretch is added up by port,
    status and parser; by description or by ticket only for tenants whose widgets ask for that. One-value widgets
    without rows give 0."""
    on_tickets, by_name = ~F.col("field").isin(*ITEM_FIELDS), F.coalesce(F.col("group_by") == "description", F.lit(False))
    kind = F.concat(F.when(on_tickets, "ticket").otherwise("item"), F.when(by_name, "_name").otherwise(""))
    specs = specs.select("tenant", "widget_id", "field", "aggregation", "group_by", "date_from", "date_to", "port", "status", kind.alias("kind"))
    tenants = specs.groupBy("tenant").agg(F.sort_array(F.array_union(F.collect_set("date_from"), F.collect_set("date_to"))).alias("cuts"), F.collect_set("kind").alias("kinds"))
    wanted = specs.join(tenants.select("tenant", "cuts"), "tenant").withColumns({c: F.array_position("cuts", F.col(f"date_{c}")) for c in ("from", "to")}).drop("cuts")
    parts = _stretches(items, tenants)
    j = wanted.alias("s").join(parts.alias("p"), (F.col("s.tenant") == F.col("p.tenant")) & (F.col("s.kind") == F.col("p.kind")))
    for c, bound in (("from", F.col("p.upto") >= F.col("s.from")), ("to", F.col("p.below") < F.col("s.to")), ("port", F.col("p.port") == F.col("s.port")), ("status", F.col("p.status") == F.col("s.status"))):
        j = j.where(F.col(f"s.{c}").isNull() | bound)
    label = F.coalesce(*(F.when(F.col("s.group_by") == g, F.coalesce(F.col(f"p.{c}"), F.lit(NO_LABEL))) for g, c in GROUPS.items()))
    measure = lambda fields, stat: F.coalesce(*(F.when(F.col("s.field") == f, F.col(f"p.{c}_{stat}")) for f, c in fields.items()))
    keys = ["tenant", "widget_id", "label", "field", "aggregation"]
    j = j.select("s.tenant", "s.widget_id", label.alias("label"), "s.field", "s.aggregation", "p.ticket_id", *(measure(ITEM_FIELDS, x).alias(x) for x in ("sum", "count", "max", "min")), measure(TICKET_FIELDS, "max").alias("y"))
    # a ticket counts once, also where its rows lie in several stretches
    once = j.groupBy(*keys, "ticket_id").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.max("max").alias("max"), F.min("min").alias("min"), F.max("y").alias("y"))
    y = F.col("y")
    once = once.select(*keys, *(F.when(on_tickets, t).otherwise(F.col(x)).alias(x) for x, t in (("sum", y), ("count", y.isNotNull().cast("long")), ("max", y), ("min", y))))
    out = once.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.max("max").alias("max"), F.min("min").alias("min"), F.count("*").alias("rows"))
    value = (
        F.when(F.col("field") == EVENTS, F.col("rows").cast("double"))
        .when(F.col("aggregation") == "sum", F.col("sum")).when(F.col("aggregation") == "avg", F.col("sum") / F.nullif(F.col("count"), F.lit(0)))
        .when(F.col("aggregation") == "max", F.col("max")).when(F.col("aggregation") == "min", F.col("min")).otherwise(F.col("count").cast("double"))
    )
    out = _largest(out.select("tenant", "widget_id", "label", F.round(F.coalesce(value, F.lit(0.0)), digits).alias("value")), "tenant", "widget_id")
    shown = specs.select("tenant", "widget_id", "group_by").join(out, ["tenant", "widget_id"], "left").where("group_by is null or value is not null")
    return shown.select("tenant", "widget_id", "label", F.coalesce("value", F.lit(0.0)).alias("value"))


def _stretches(items: DataFrame, tenants: DataFrame) -> DataFrame:
    """Partial sums of the items: by tenant, what its widgets need (kind), stretch of time (how many of its cuts lie below an
    item's instant, and how many not above it), port, status, parser, and, for some kinds, description or ticket."""
    at = F.col("captured_at")
    count = lambda test: F.size(F.filter("cuts", test))
    rows = items.join(tenants, "tenant").withColumns({"below": F.when(at.isNull(), F.lit(2**31 - 1)).otherwise(count(lambda c: c < at)), "upto": F.when(at.isNull(), F.lit(0)).otherwise(count(lambda c: c <= at))})
    measures = [*ITEM_FIELDS.values(), *TICKET_FIELDS.values()]
    rows = rows.select("tenant", "below", "upto", "port", "status", "parsed_by", "description", "ticket_id", *measures, F.explode("kinds").alias("kind"))
    rows = rows.withColumns({"description": F.when(F.col("kind").endswith("_name"), F.col("description")), "ticket_id": F.when(F.col("kind").startswith("ticket"), F.col("ticket_id"))})
    stats = [f(c).alias(f"{c}_{x}") for c in ITEM_FIELDS.values() for x, f in (("sum", F.sum), ("count", F.count), ("max", F.max), ("min", F.min))]
    return rows.groupBy("tenant", "kind", "below", "upto", "port", "status", "parsed_by", "description", "ticket_id").agg(*stats, *(F.max(c).alias(f"{c}_max") for c in TICKET_FIELDS.values()))


def spec_reject(name: Column, visualization: Column, field: Column, aggregation: Column, group_by: Column, date_from: Column, date_to: Column, port: Column, status: Column) -> Column:
    """Why a widget can't be stored: the first rule that fails, or NULL."""
    fields, empty = (*ITEM_FIELDS, *TICKET_FIELDS, EVENTS), F.lit("")
    bad_date = lambda c: c.isNotNull() & ~c.rlike(DATE_SHAPE)
    return (
        F.when((strip(F.coalesce(name, empty)) == "") | (F.length(name) > 100), "name")
        .when(~F.coalesce(visualization, empty).isin(*VISUALS), "visualization")
        .when(~F.coalesce(field, empty).isin(*fields), "field")
        .when(~F.coalesce(aggregation, empty).isin(*AGGREGATIONS), "aggregation")
        .when((visualization == "kpi") & group_by.isNotNull(), "kpi_with_group")
        .when((visualization != "kpi") & ~F.coalesce(group_by, empty).isin(*GROUPS), "group")
        .when((group_by == "description") & field.isin(*TICKET_FIELDS), "group_grain")
        .when(bad_date(date_from), "date_from").when(bad_date(date_to), "date_to")
        .when(port.isNotNull() & ~port.rlike(PORT_SHAPE), "port")
        .when(status.isNotNull() & ~status.isin(*STATUSES), "status")
    )


SPEC_PATHS = {
    "name": "$.name", "visualization": "$.visualization", "field": "$.metric.field", "aggregation": "$.metric.aggregation", "group_by": "$.groupBy",
    "date_from": "$.filters.dateFrom", "date_to": "$.filters.dateTo", "port": "$.filters.port", "status": "$.filters.status",
}


def checked_bodies(rows: DataFrame, body: str = "body") -> DataFrame:
    """rows (without their body) with the reason why the widget it asks for can't be stored, or NULL and the widget's
    fields, the name trimmed. A field of another type than text is an invalid one; a null counts as one."""
    rows = with_json(rows, body, "v")
    there = lambda path: F.schema_of_variant(F.try_variant_get("v", path, "variant"))
    # what is there but no text stands as one that no rule takes
    fields = {c: F.when(there(path).isNotNull(), F.coalesce(string_field(F.col("v"), path), F.lit("\0"))) for c, path in SPEC_PATHS.items()}
    rows = rows.withColumns(fields).withColumns({"metric": is_object(F.try_variant_get("v", "$.metric", "variant")), "filters": there("$.filters").isNull() | is_object(F.try_variant_get("v", "$.filters", "variant"))})
    rows = rows.withColumn("name", F.when(F.col("name") != "\0", F.col("name")))
    first = spec_reject(*(F.col(c) for c in SPEC_PATHS))
    early = F.coalesce(first.isin("name", "visualization"), F.lit(False))
    reason = (
        F.when(F.col("v").isNull(), "no_json").when(~is_object(F.col("v")), "not_object").when(early, first).when(~F.col("metric"), "metric")
        .when(~F.col("filters") & (first.isNull() | first.isin("date_from", "date_to", "port", "status")), "filters").otherwise(first)
    )
    rows = rows.withColumn("reason", reason)
    kept = [c for c in rows.columns if c not in (body, "v", "metric", "filters", "reason", *SPEC_PATHS)]
    shown = {c: F.when(F.col("reason").isNull(), strip(F.col(c)) if c == "name" else F.col(c)).alias(c) for c in SPEC_PATHS}
    return rows.select(*kept, "reason", *shown.values())


def stored_widget(specs: DataFrame, tenant: str, widget_id: str) -> Spec:
    """The widget of a tenant with an id, checked anew: ValueError if its fields are invalid, KeyError if there is none."""
    names = ("field", "aggregation", "group_by", "date_from", "date_to", "port", "status")
    row = specs.where((F.col("tenant") == tenant) & (F.col("widget_id") == widget_id)).select(*names).first()  # one row
    if row is None:
        raise KeyError(f"no widget {widget_id!r}")
    return Spec(tenant, **row.asDict())


def field_catalogue(items: DataFrame) -> DataFrame:
    """kind, name and, for groupings, how many values the items have."""
    counted = items.agg(*(F.count_distinct(c).alias(g) for g, c in GROUPS.items()))
    groups = counted.select(F.explode(F.array(*(F.struct(F.lit("categorical").alias("kind"), F.lit(g).alias("name"), F.col(g).alias("values")) for g in GROUPS))).alias("x")).select("x.*")
    fixed = [("numeric", f) for f in (*ITEM_FIELDS, *TICKET_FIELDS, EVENTS)] + [("aggregation", a) for a in AGGREGATIONS]
    rest = items.sparkSession.createDataFrame(fixed, "kind string, name string").withColumn("values", F.lit(None).cast("long"))
    return groups.unionByName(rest)
