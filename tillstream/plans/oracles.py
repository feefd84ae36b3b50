"""DuckDB SQL for the registered queries, written from the base tables and independent of the operators."""

from __future__ import annotations

from tillstream.sources.mapped import REQUEST_FIELDS

ITEMS = """items AS (
  SELECT concat('T', c_nationkey) AS tenant, CAST(o_orderkey AS VARCHAR) AS ticket_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS captured_at,
    concat('COM', substr(o_orderpriority, 1, 1)) AS port, CASE WHEN o_orderstatus = 'O' THEN 'needs_review' ELSE 'parsed' END AS status,
    CASE WHEN o_orderstatus = 'O' THEN 'model-fallback' ELSE 'deterministic' END AS parsed_by, p_name AS description, l_quantity AS quantity,
    l_extendedprice / l_quantity AS unit_price, l_extendedprice AS subtotal, l_returnflag = 'R' AS voided,
    CASE WHEN o_orderkey % 4 = 0 THEN floor(o_totalprice * 0.1) END AS discount, CASE WHEN o_orderkey % 5 = 0 THEN floor(o_totalprice * 0.05) END AS tip, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
)"""
TICKETS = """tickets AS (
  SELECT concat('T', c_nationkey) AS tenant_id, CAST(o_orderkey AS VARCHAR) AS ticket_id, o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS captured_at,
    concat('COM', substr(o_orderpriority, 1, 1)) AS port, CASE WHEN o_orderstatus = 'O' THEN 'needs_review' ELSE 'parsed' END AS status, o_totalprice AS total
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
ITEM, TICKET = {"quantity": "quantity", "unitPrice": "unit_price", "subtotal": "subtotal"}, {"discount": "discount", "tip": "tip", "total": "total"}
AGGS = ("sum", "avg", "max", "min", "count")


def _value(agg: str, column: str, digits: int | None = None) -> str:
    return f"coalesce(round(CAST({agg}({column}) AS DOUBLE), {digits or (4 if agg == 'avg' else 2)}), 0)"


def kpi(fields: dict[str, str], ticket: bool) -> str:
    source = f"(SELECT tenant, ticket_id, {', '.join(f'max({c}) AS {c}' for c in fields.values())} FROM items GROUP BY ALL)" if ticket else "items"
    return f"WITH {ITEMS} " + " UNION ALL ".join(f"SELECT tenant, '{f}' AS field, '{a}' AS aggregation, {_value(a, c)} AS value FROM {source} GROUP BY tenant" for f, c in fields.items() for a in AGGS)


def grouped(fields: dict[str, str], ticket: bool, g: str) -> str:
    source = f"(SELECT tenant, ticket_id, {g}, {', '.join(f'max({c}) AS {c}' for c in fields.values())} FROM items GROUP BY ALL)" if ticket else "items"
    return f"WITH {ITEMS} " + " UNION ALL ".join(
        f"SELECT * FROM (SELECT tenant, coalesce({g}, '(sin dato)') AS label, '{f}' AS field, '{a}' AS aggregation, {_value(a, c)} AS value FROM {source} GROUP BY tenant, {g}) QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY value DESC, label) <= 50" for f, c in fields.items() for a in AGGS
    )


SPECS = """specs AS (
  SELECT concat('T', n_nationkey) AS tenant, s.* FROM nation CROSS JOIN (VALUES
    ('w1', 'total', 'sum', NULL, NULL, NULL, NULL, NULL), ('w2', 'total', 'avg', 'port', NULL, NULL, NULL, NULL), ('w3', 'subtotal', 'sum', 'description', NULL, NULL, NULL, NULL),
    ('w4', 'event_count', 'sum', 'status', NULL, NULL, NULL, NULL), ('w5', 'discount', 'max', 'parsedBy', NULL, NULL, NULL, NULL), ('w6', 'quantity', 'min', NULL, NULL, NULL, NULL, NULL),
    ('w7', 'tip', 'count', NULL, NULL, NULL, 'COM1', NULL), ('w8', 'subtotal', 'avg', 'port', '1994-01-01', '1996-06-30', NULL, 'parsed'), ('w9', 'total', 'sum', NULL, NULL, NULL, NULL, 'failed')
  ) s(widget_id, field, aggregation, group_by, date_from, date_to, port, status)
)"""

BATCH = f"""WITH {ITEMS}, {SPECS}, j AS (
  SELECT s.tenant, s.widget_id, s.field, s.aggregation, i.ticket_id,
    CASE s.group_by WHEN 'port' THEN i.port WHEN 'status' THEN i.status WHEN 'parsedBy' THEN i.parsed_by WHEN 'description' THEN i.description END AS label,
    CASE s.field WHEN 'quantity' THEN i.quantity WHEN 'unitPrice' THEN i.unit_price WHEN 'subtotal' THEN i.subtotal END AS x,
    CASE s.field WHEN 'discount' THEN i.discount WHEN 'tip' THEN i.tip WHEN 'total' THEN i.total END AS y
  FROM specs s JOIN items i ON i.tenant = s.tenant AND (s.date_from IS NULL OR i.captured_at >= s.date_from) AND (s.date_to IS NULL OR i.captured_at <= s.date_to)
    AND (s.port IS NULL OR i.port = s.port) AND (s.status IS NULL OR i.status = s.status)
), v AS (
  SELECT tenant, widget_id, field, aggregation, label, x AS v FROM j WHERE field IN ('quantity', 'unitPrice', 'subtotal')
  UNION ALL SELECT tenant, widget_id, field, aggregation, label, max(y) FROM j WHERE field NOT IN ('quantity', 'unitPrice', 'subtotal') GROUP BY tenant, widget_id, field, aggregation, label, ticket_id
), a AS (
  SELECT tenant, widget_id, label, coalesce(round(CASE WHEN field = 'event_count' THEN count(*) WHEN aggregation = 'sum' THEN sum(v) WHEN aggregation = 'avg' THEN avg(v) WHEN aggregation = 'max' THEN max(v) WHEN aggregation = 'min' THEN min(v) ELSE count(v) END, 4), 0) AS value
  FROM v GROUP BY tenant, widget_id, label, field, aggregation
)
SELECT tenant, widget_id, label, value FROM a QUALIFY row_number() OVER (PARTITION BY tenant, widget_id ORDER BY value DESC, label) <= 50
UNION ALL SELECT tenant, widget_id, NULL, 0.0 FROM specs s WHERE group_by IS NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.tenant = s.tenant AND a.widget_id = s.widget_id)"""

#: Widget fields by event, as SQL that Spark reads alike; every rule is broken by some.
SPEC_FIELDS = """
  event_id AS widget,
  CASE event_id % 17 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 101) ELSE event_type END AS name,
  CASE event_id % 5 WHEN 0 THEN 'kpi' WHEN 1 THEN 'bar' WHEN 2 THEN 'donut' WHEN 3 THEN 'bar' ELSE CASE WHEN event_id % 25 = 4 THEN 'pie' ELSE 'kpi' END END AS visualization,
  CASE event_id % 9 WHEN 0 THEN 'total' WHEN 1 THEN 'subtotal' WHEN 2 THEN 'event_count' WHEN 3 THEN 'tip' WHEN 4 THEN 'median' ELSE 'quantity' END AS field,
  CASE event_id % 13 WHEN 0 THEN 'median' WHEN 1 THEN 'avg' ELSE 'sum' END AS aggregation,
  CASE event_id % 7 WHEN 0 THEN 'port' WHEN 1 THEN 'description' WHEN 2 THEN 'tenant' ELSE NULL END AS group_by,
  CASE event_id % 19 WHEN 0 THEN '2026-1-1' WHEN 1 THEN '2026-99-99' ELSE NULL END AS date_from,
  CASE event_id % 23 WHEN 0 THEN '2026-07-31T10:00' WHEN 1 THEN '2026-07-31T10:00:00.000Z' ELSE NULL END AS date_to,
  CASE event_id % 21 WHEN 0 THEN 'COM 3' WHEN 1 THEN 'COM3' ELSE NULL END AS port,
  CASE event_id % 27 WHEN 0 THEN 'done' WHEN 1 THEN 'parsed' ELSE NULL END AS status
"""
SPEC_CHECK = f"""WITH s AS (SELECT {SPEC_FIELDS} FROM events)
SELECT widget, CASE WHEN trim(name) = '' OR length(name) > 100 THEN 'name' WHEN visualization = 'pie' THEN 'visualization' WHEN field = 'median' THEN 'field' WHEN aggregation = 'median' THEN 'aggregation'
  WHEN visualization = 'kpi' AND group_by IS NOT NULL THEN 'kpi_with_group' WHEN visualization <> 'kpi' AND (group_by IS NULL OR group_by = 'tenant') THEN 'group'
  WHEN group_by = 'description' AND field IN ('total', 'tip', 'discount') THEN 'group_grain' WHEN date_from = '2026-1-1' THEN 'date_from' WHEN date_to = '2026-07-31T10:00' THEN 'date_to'
  WHEN port = 'COM 3' THEN 'port' WHEN status = 'done' THEN 'status' END AS reason FROM s"""

BODY_CHECK = """SELECT event_id AS widget, CASE event_id % 12 WHEN 0 THEN 'not_object' WHEN 1 THEN 'name' WHEN 2 THEN 'metric' WHEN 3 THEN 'field' WHEN 4 THEN 'kpi_with_group' WHEN 5 THEN 'filters' WHEN 6 THEN 'date_from' WHEN 7 THEN 'status' WHEN 8 THEN 'no_json' WHEN 9 THEN 'name' END AS reason,
  CASE WHEN event_id % 12 = 10 THEN 'w' WHEN event_id % 12 = 11 THEN event_type END AS name FROM events"""

REQUESTS = f"""raw AS (SELECT {REQUEST_FIELDS} FROM events), keys AS (
  SELECT k, coalesce(min(t) FILTER (WHERE how = 1), min(t) FILTER (WHERE how = 2)) AS tenant_id FROM (
    SELECT concat('K', s_suppkey % 60 + 20) AS k, concat('T', s_nationkey) AS t, 1 AS how FROM supplier
    UNION ALL SELECT concat('K', n_nationkey), concat('T', n_nationkey), 2 FROM nation WHERE n_nationkey <> 3) GROUP BY k
), checked AS (
  SELECT raw.*, tenant_id, CASE WHEN api_key_id IS NULL THEN 'no_key' WHEN tenant_id IS NULL THEN 'unknown_key' WHEN corrupt OR form = 'trailing' THEN 'no_json' WHEN form = 'null' THEN 'not_object'
    WHEN ticket_id = 'not-a-uuid' OR form IN ('array', 'list') THEN 'ticket_id'
    WHEN port IN ('', 'COM 3') OR length(port) > 64 OR form = 'number' THEN 'port' WHEN captured_at IN ('2026-02-31T00:00:00.000Z', '2026-01-01') THEN 'captured_at'
    WHEN raw_text = '' OR form IN ('boolean', 'object', 'missing') THEN 'empty_text' WHEN strlen(raw_text) > 65536 THEN 'text_too_long' END AS reason
  FROM raw LEFT JOIN keys ON k = api_key_id
)"""

RECEIPTS = """shown AS (
  SELECT l_orderkey AS o_orderkey, p_name AS name, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(floor(p_retailprice) AS BIGINT) AS u, CAST(floor(l_quantity) AS BIGINT) * CAST(floor(p_retailprice) AS BIGINT) AS s, l_returnflag = 'R' AS voided
  FROM lineitem JOIN part ON l_partkey = p_partkey
), receipts AS (
  SELECT t.*, o_orderkey % 8 AS kind, n, live, CASE WHEN o_orderkey % 8 = 1 THEN 5 END AS disc, CASE WHEN o_orderkey % 8 = 2 THEN 7 END AS tips,
    live - CASE WHEN o_orderkey % 8 = 1 THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 8 = 2 THEN 7 ELSE 0 END + CASE WHEN o_orderkey % 8 = 3 THEN 100 ELSE 0 END AS shown_total
  FROM tickets t JOIN (SELECT o_orderkey, count(*) AS n, sum(CASE WHEN voided THEN 0 ELSE s END) AS live FROM shown GROUP BY 1) USING (o_orderkey)
), checked AS (
  SELECT *, CASE kind WHEN 4 THEN 'bad_amount' WHEN 5 THEN 'bad_date' END AS poison,
    CASE WHEN shown_total < 0 THEN 'T2' WHEN shown_total > 500000 THEN 'T3' WHEN n > 50 THEN 'N2' WHEN disc > live THEN 'D2' WHEN abs(shown_total - (live - coalesce(disc, 0) + coalesce(tips, 0))) > 1 THEN 'T4' END AS own_reason
  FROM receipts
), decided AS (
  SELECT *, CASE WHEN tenant_id = 'T3' THEN 'failed' WHEN CAST(substr(tenant_id, 2) AS INT) % 5 = 0 AND port <> 'COM1' THEN 'failed' WHEN poison IS NOT NULL THEN 'quarantined'
      WHEN kind <> 7 AND own_reason IS NULL THEN 'parsed' WHEN o_orderkey % 3 = 0 THEN 'pending' WHEN o_orderkey % 3 = 1 AND live BETWEEN 0 AND 500000 AND n <= 50 THEN 'needs_review' ELSE 'failed' END AS state
  FROM checked
)"""
_RECEIPTS = f"WITH {TICKETS}, {RECEIPTS} "
#: What a receipt's numbers, with the faults that the queries put in, are judged as; in the order of the rules.
JUDGED = """CASE WHEN o_orderkey % 101 = 0 THEN 'T1' WHEN shown_total < 0 THEN 'T2' WHEN shown_total > 500000 THEN 'T3' WHEN n > 50 THEN 'N2' WHEN o_orderkey % 97 = 0 THEN 'I3' WHEN o_orderkey % 89 = 0 THEN 'I1'
  WHEN o_orderkey % 83 = 0 THEN 'I7' WHEN disc > live THEN 'D2' WHEN o_orderkey % 79 = 0 THEN 'P1' ELSE own_reason END AS reason FROM checked WHERE poison IS NULL AND kind <> 7"""
#: The same with a fault for each rule, by the receipt's number (f); t: the total with the faults.
FAULTS = """CASE WHEN f = 0 THEN 'T1' WHEN t < 0 THEN 'T2' WHEN t > 500000 THEN 'T3' WHEN f = 3 THEN 'N1' WHEN f = 4 OR n > 50 THEN 'N2' WHEN f BETWEEN 5 AND 11 THEN concat('I', f - 4)
  WHEN f = 12 THEN 'D1' WHEN f = 13 OR disc > live THEN 'D2' WHEN f = 14 THEN 'P1' WHEN f = 15 THEN 'P2' WHEN abs(t - (live - coalesce(disc, 0) + coalesce(tips, 0))) > 1 THEN 'T4' END AS reason
  FROM (SELECT *, CASE f WHEN 1 THEN -1 WHEN 2 THEN 500001 WHEN 16 THEN shown_total + 2 ELSE shown_total END AS t FROM (SELECT *, o_orderkey // 8 % 40 AS f FROM checked WHERE poison IS NULL AND kind <> 7))"""
DECIDED = """SELECT tenant_id, ticket_id, state AS status, CASE state WHEN 'parsed' THEN 'deterministic' WHEN 'needs_review' THEN 'model-fallback' END AS parsed_by,
  CASE WHEN state IN ('parsed', 'needs_review') THEN NULL WHEN tenant_id = 'T3' THEN 'tenant_not_found' WHEN CAST(substr(tenant_id, 2) AS INT) % 5 = 0 AND port <> 'COM1' THEN 'unknown_parser' WHEN poison IS NOT NULL THEN poison
    WHEN state = 'pending' THEN 'no_answer' WHEN o_orderkey % 3 = 1 THEN concat('incoherent: ', CASE WHEN live > 500000 THEN 'T3' ELSE 'N2' END) WHEN kind = 7 THEN 'no_parser_matched_incl_fallback' ELSE concat('incoherent: ', own_reason) END AS reason FROM decided"""
#: Without a model's answers.
DETERMINISTIC = """SELECT tenant_id, ticket_id, CASE WHEN reason IS NULL THEN 'parsed' WHEN reason = poison THEN 'quarantined' ELSE 'failed' END AS status, CASE WHEN reason IS NULL THEN 'deterministic' END AS parsed_by, reason
  FROM (SELECT *, CASE WHEN tenant_id = 'T3' THEN 'tenant_not_found' WHEN CAST(substr(tenant_id, 2) AS INT) % 5 = 0 AND port <> 'COM1' THEN 'unknown_parser' WHEN poison IS NOT NULL THEN poison
    WHEN kind = 7 THEN 'no_parser_matched' WHEN own_reason IS NOT NULL THEN concat('incoherent: ', own_reason) END AS reason FROM checked)"""
FLAT = """SELECT tenant_id, ticket_id, name AS description, CAST(q AS DOUBLE) AS quantity, CAST(s AS DOUBLE) AS subtotal, voided, CAST(disc AS DOUBLE) AS discount, CAST(tips AS DOUBLE) AS tip, CAST(shown_total AS DOUBLE) AS total,
  substr(captured_at, 1, 4) AS year, substr(captured_at, 6, 2) AS month, substr(captured_at, 9, 2) AS day
  FROM (SELECT *, CASE WHEN tenant_id = 'T3' THEN 0 WHEN CAST(substr(tenant_id, 2) AS INT) % 5 = 0 AND port <> 'COM1' THEN 0 WHEN poison IS NULL AND kind <> 7 AND own_reason IS NULL THEN 1 ELSE 0 END AS ok FROM checked) JOIN shown USING (o_orderkey) WHERE ok = 1"""


def _code(k: str) -> str:
    text = f"translate(to_base({k}, 34, 10), '01', 'YZ')"
    return f"concat(substr({text}, 1, 5), '-', substr({text}, 6))"


_CLAIMS = f""", codes AS (
  SELECT concat('T', c_nationkey) AS tenant_id, {_code('c_custkey')} AS code, c_custkey % 3 = 0 AS used FROM customer
), asked AS (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'aaaaa-00000' ELSE {_code('user_id')} END AS code, event_id % 7 <> 0 AS named, event_id % 3 = 0 AS own_name FROM events WHERE event_type = 'purchase'
), fit AS (
  SELECT a.*, c.tenant_id, row_number() OVER (PARTITION BY a.code ORDER BY event_id) AS n FROM asked a JOIN codes c ON a.code = c.code AND NOT c.used WHERE named AND event_id % 11 <> 0
)"""
CLAIMS = f"WITH one AS (SELECT 1){_CLAIMS} SELECT a.event_id AS claim_id, a.code, CASE WHEN n = 1 THEN f.tenant_id END AS tenant_id, CASE WHEN n = 1 THEN CASE WHEN a.own_name THEN concat('till ', a.event_id) ELSE concat('Robot ', substr(concat('agent-', a.event_id), 1, 8)) END END AS agent_name, CASE WHEN n = 1 THEN 'won' ELSE 'rejected' END AS outcome FROM asked a LEFT JOIN fit f ON f.event_id = a.event_id"

_PAGE = "SELECT ticket_id, captured_at, status, place, n > {size} AS more, CASE WHEN n > {size} AND place = {size} THEN translate(base64(encode(concat('{{\"c\":\"', captured_at, '\",\"t\":\"', ticket_id, '\"}}'))), '+/=', '-_') END AS next FROM (SELECT *, row_number() OVER (ORDER BY captured_at DESC, ticket_id DESC) AS place, count(*) OVER () AS n FROM tickets WHERE {where}) WHERE place <= {size}"
_SUM = "round(CAST(sum(total) AS DOUBLE), 2)"

SQL: dict[str, str] = {
    "kpi_item_all": kpi(ITEM, False),
    "kpi_ticket_all": kpi(TICKET, True),
    "kpi_event_count": f"WITH {ITEMS} SELECT tenant, CAST(count(DISTINCT ticket_id) AS DOUBLE) AS value FROM items GROUP BY tenant",
    **{f"group_item_by_{c}": grouped(ITEM, False, c) for c in ("port", "status", "parsed_by", "description")},
    **{f"group_ticket_by_{c}": grouped(TICKET, True, c) for c in ("port", "status", "parsed_by")},
    "group_events_by_description": f"WITH {ITEMS} SELECT tenant, description AS label, CAST(count(DISTINCT ticket_id) AS DOUBLE) AS value FROM items GROUP BY tenant, description QUALIFY row_number() OVER (PARTITION BY tenant ORDER BY value DESC, label) <= 50",
    "group_unlabelled": f"WITH {ITEMS}, own AS (SELECT tenant, CASE WHEN CAST(ticket_id AS BIGINT) % 7 <> 0 THEN port END AS port, subtotal FROM items) SELECT tenant, coalesce(port, '(sin dato)') AS label, round(sum(subtotal), 2) AS value FROM own WHERE tenant = 'T7' GROUP BY ALL",
    "widget_empty": f"WITH {ITEMS} SELECT 'kpi' AS widget, count(*) AS points, sum(v) AS value FROM (SELECT coalesce(sum(quantity), 0.0) AS v FROM items WHERE tenant = 'T7' AND status = 'failed') UNION ALL SELECT 'ticket_kpi', count(*), sum(v) FROM (SELECT coalesce(sum(total), 0.0) AS v FROM items WHERE tenant = 'T7' AND port = 'none')"
    " UNION ALL SELECT 'grouped', count(*), coalesce(sum(v), 0.0) FROM (SELECT port, sum(quantity) AS v FROM items WHERE tenant = 'T7' AND status = 'failed' GROUP BY port)",
    "widget_by_id": f"WITH {ITEMS} SELECT port AS label, round(avg(t), 4) AS value FROM (SELECT port, ticket_id, max(total) AS t FROM items WHERE tenant = 'T7' GROUP BY ALL) GROUP BY port",
    "widget_filters": f"WITH {ITEMS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS widget, {'coalesce(round(sum(v), 2), 0)'} AS value FROM (SELECT max(total) AS v FROM items WHERE tenant = 'T7' AND {w} GROUP BY ticket_id)"
        for n, w in (("both_bounds", "captured_at >= '1994-01-01' AND captured_at <= '1996-06-30T12:00:00.000Z'"), ("day_bound", "captured_at <= '1995-03-15'"), ("port", "port = 'COM2'"), ("status", "status = 'needs_review'"), ("none", "status = 'failed'"))
    ),
    "widgets_batch": BATCH,
    "widget_spec_validation": SPEC_CHECK,
    "widget_body_validation": BODY_CHECK,
    "field_catalogue": f"WITH {ITEMS} "
    + " UNION ALL ".join([f"SELECT 'categorical' AS kind, '{g}' AS name, count(DISTINCT {c}) AS \"values\" FROM items" for g, c in (("port", "port"), ("status", "status"), ("parsedBy", "parsed_by"), ("description", "description"))])
    + " UNION ALL SELECT k, n, NULL FROM (VALUES ('numeric', 'quantity'), ('numeric', 'unitPrice'), ('numeric', 'subtotal'), ('numeric', 'discount'), ('numeric', 'tip'), ('numeric', 'total'), ('numeric', 'event_count'), ('aggregation', 'sum'), ('aggregation', 'avg'), ('aggregation', 'max'), ('aggregation', 'min'), ('aggregation', 'count')) t(k, n)",
    "ingest_validate": f"WITH {REQUESTS} SELECT arrival_seq, reason FROM checked",
    "ingest_tenant_resolve": f"WITH {REQUESTS} SELECT arrival_seq, tenant_id FROM checked",
    "ingest_dedup": f"WITH {REQUESTS} SELECT tenant_id, captured_at, ticket_id, min(arrival_seq) AS arrival_seq FROM checked WHERE reason IS NULL GROUP BY 1, 2, 3",
    "payload_lookup": f"WITH {REQUESTS}, {TICKETS}, last AS (SELECT tenant_id, ticket_id, arg_max(raw_text, arrival_seq) AS raw_text FROM checked WHERE reason IS NULL GROUP BY 1, 2), asked AS (SELECT DISTINCT tenant_id, ticket_id FROM last UNION ALL SELECT tenant_id, ticket_id FROM tickets)"
    " SELECT a.tenant_id, a.ticket_id, coalesce(raw_text, '') AS raw_text FROM asked a LEFT JOIN last l ON l.tenant_id = a.tenant_id AND l.ticket_id = a.ticket_id",
    "raw_latest_payload": f"WITH {REQUESTS} SELECT tenant_id, ticket_id, arg_max(raw_text, arrival_seq) AS raw_text FROM checked WHERE reason IS NULL GROUP BY 1, 2",
    "parse_money": "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 0 ELSE round(CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE 1 END * (floor(o_totalprice) + (o_orderkey % 100) / 100.0), 2) END AS value FROM orders",
    "parse_items": f"{_RECEIPTS} SELECT ticket_id, name AS description, CAST(q AS DOUBLE) AS quantity, CAST(u AS DOUBLE) AS unit_price, CAST(s AS DOUBLE) AS subtotal, voided FROM checked JOIN shown USING (o_orderkey) WHERE poison IS NULL AND kind <> 7",
    "parse_tickets": f"{_RECEIPTS} SELECT ticket_id, poison, CASE WHEN poison IS NULL AND kind <> 7 THEN n END AS n_items, CASE WHEN poison IS NULL AND kind <> 7 THEN CAST(disc AS DOUBLE) END AS discount, CASE WHEN poison IS NULL AND kind <> 7 THEN CAST(tips AS DOUBLE) END AS tip, CASE WHEN poison IS NULL AND kind <> 7 THEN CAST(shown_total AS DOUBLE) END AS total FROM checked",
    "parse_junk": "SELECT count(*) AS documents, 0 AS receipts FROM documents",
    "coherence": f"{_RECEIPTS} SELECT ticket_id, {JUDGED}",
    "coherence_all": f"{_RECEIPTS} SELECT ticket_id, {FAULTS}",
    "fallback_extract": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (1, 2, 3, 4) THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS total, CASE WHEN o_orderkey % 7 NOT IN (1, 2, 3, 4) AND o_orderkey % 2 = 0 THEN 5.0 END AS discount, CASE WHEN o_orderkey % 7 IN (1, 2, 3, 4) THEN NULL ELSE o_orderkey % 7 = 5 END AS voided FROM orders",
    "decide": _RECEIPTS + DECIDED,
    "decide_deterministic": _RECEIPTS + DETERMINISTIC,
    "quarantine": f"{_RECEIPTS} SELECT tenant_id, ticket_id, poison AS reason FROM decided WHERE state = 'quarantined'",
    "flatten_items": _RECEIPTS + FLAT,
    "sink_roundtrip": f"{_RECEIPTS}, flat AS ({FLAT}) SELECT tenant_id AS tenant, year, month, count(*) AS n_items, round(sum(subtotal), 2) AS subtotal FROM flat WHERE tenant_id = 'T7' AND concat_ws('-', year, month, day) BETWEEN '1994-01-01' AND '1995-12-31' GROUP BY 1, 2, 3",
    "ticket_page": f"WITH {TICKETS} " + _PAGE.format(size=50, where="tenant_id = 'T7'"),
    "ticket_page_status": f"WITH {TICKETS} " + _PAGE.format(size=100, where="tenant_id = 'T7' AND status = 'needs_review'"),
    "ticket_page_next": f"WITH {TICKETS}, last AS (SELECT captured_at AS c, ticket_id AS t FROM tickets WHERE tenant_id = 'T7' ORDER BY 1 DESC, 2 DESC LIMIT 1 OFFSET 19) " + _PAGE.format(size=20, where="tenant_id = 'T7' AND (captured_at, ticket_id) < (SELECT (c, t) FROM last)"),
    "public_tickets": _RECEIPTS + """SELECT d.ticket_id, d.port, captured_at, d.state AS status, CASE d.state WHEN 'parsed' THEN n WHEN 'needs_review' THEN 1 END AS n_items,
      CAST(CASE d.state WHEN 'parsed' THEN shown_total WHEN 'needs_review' THEN live END AS DOUBLE) AS total, CAST(CASE d.state WHEN 'parsed' THEN disc END AS DOUBLE) AS discount, CAST(CASE d.state WHEN 'parsed' THEN tips END AS DOUBLE) AS tip,
      CASE WHEN d.state NOT IN ('parsed', 'needs_review', 'pending') THEN r.reason END AS fail_reason, CASE d.state WHEN 'parsed' THEN 'deterministic' WHEN 'needs_review' THEN 'model-fallback' END AS parsed_by
      FROM decided d JOIN (""" + DECIDED + """) r ON r.tenant_id = d.tenant_id AND r.ticket_id = d.ticket_id WHERE d.tenant_id = 'T7'""",
    "registry_lists": f"SELECT 'agent' AS kind, CAST(s_suppkey AS VARCHAR) AS id FROM supplier WHERE s_nationkey = 7 UNION ALL SELECT 'code', {_code('c_custkey')} FROM customer WHERE c_nationkey = 7",
    "activation_claims": CLAIMS,
    "activation_usage": "SELECT concat('T', c_nationkey) AS tenant_id, count(*) FILTER (WHERE c_custkey % 3 = 0) AS used, count(*) AS total FROM customer GROUP BY 1",
}
SQL["parse_layouts"] = f"""{_RECEIPTS}, cents AS (
    SELECT l_orderkey, p_name, CAST(floor(l_quantity) AS BIGINT) AS q, CAST(round(p_retailprice * 100) AS BIGINT) AS u, l_returnflag = 'R' AS voided FROM lineitem JOIN part ON p_partkey = l_partkey
  ), due AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN voided THEN 0 ELSE q * u END) AS live FROM cents GROUP BY 1)
  SELECT CAST(l_orderkey AS VARCHAR) AS ticket_id, 'wrapped' AS parser, live / 100 AS total, CASE WHEN live > 50000000 THEN 'T3' WHEN n > 50 THEN 'N2' END AS reason, p_name AS description, CAST(q AS DOUBLE) AS quantity, u / 100 AS unit_price, q * u / 100 AS subtotal, voided FROM cents JOIN due USING (l_orderkey)
  UNION ALL SELECT ticket_id, 'columns38', CAST(shown_total AS DOUBLE), own_reason, name, CAST(q AS DOUBLE), CAST(u AS DOUBLE), CAST(s AS DOUBLE), voided FROM checked JOIN shown USING (o_orderkey) WHERE poison IS NULL AND kind <> 7"""
SQL["ticket_page_walk"] = f"{_RECEIPTS}, stated AS (SELECT r.tenant_id, r.ticket_id, r.captured_at, d.status FROM receipts r JOIN ({DETERMINISTIC}) d ON d.ticket_id = r.ticket_id) " + _PAGE.format(size=30, where="tenant_id = 'T7'").replace("FROM tickets", "FROM stated")
SQL["requeue"] = f"""{_RECEIPTS}, q AS (SELECT c.* FROM checked c JOIN ({DETERMINISTIC}) d ON d.ticket_id = c.ticket_id WHERE d.status = 'quarantined'), r AS (
    SELECT *, CASE WHEN kind = 5 THEN 'bad_date' WHEN n > 50 THEN 'incoherent: N2' WHEN abs(10 - live) > 1 THEN 'incoherent: T4' END AS why FROM q)
  SELECT tenant_id, ticket_id, CASE WHEN kind = 5 THEN 'quarantined' WHEN why IS NULL THEN 'parsed' ELSE 'failed' END AS status, CASE WHEN why IS NULL THEN 'deterministic' END AS parsed_by, why AS reason, CASE WHEN kind = 5 THEN 5 ELSE 1 END AS attempts FROM r"""
SQL["stream_parse"] = SQL["parse_tickets"]
SQL["stream_dedup"] = SQL["ingest_dedup"]
SQL["stream_claims"], SQL["stream_tickets"], SQL["stream_quarantine"], SQL["stream_answers"] = SQL["activation_claims"], SQL["decide_deterministic"], SQL["quarantine"], SQL["decide"]
SQL["stream_gold"] = f"SELECT * FROM ({SQL['flatten_items']}) WHERE CAST(ticket_id AS BIGINT) % 9 <> 0 AND NOT (tenant_id = 'T7' AND year = '1995')"
SQL["widget_years"] = f"WITH {ITEMS} SELECT port AS label, CAST(count(DISTINCT ticket_id) AS DOUBLE) AS value FROM items WHERE tenant = 'T7' AND substr(captured_at, 1, 4) BETWEEN '1994' AND '1996' GROUP BY 1"
SQL["registry_columns"] = f"""WITH {SPECS}
  SELECT 'widget' AS kind, widget_id AS id, concat_ws('|', upper(widget_id), CASE WHEN group_by IS NULL THEN 'kpi' ELSE 'bar' END, field, aggregation, group_by, date_from, date_to, port, status, '2026-01-01') AS shown FROM specs WHERE tenant = 'T7'
  UNION ALL SELECT 'agent', CAST(s_suppkey AS VARCHAR), concat_ws('|', s_name, '2026-01-02') FROM supplier WHERE s_nationkey = 7
  UNION ALL SELECT 'code', {_code('c_custkey')}, concat_ws('|', CASE WHEN c_custkey % 3 = 0 THEN 'used' ELSE 'unused' END, '2026-01-03', CASE WHEN c_custkey % 3 = 0 THEN concat('2026-01-04|agent-', c_custkey) END) FROM customer WHERE c_nationkey = 7"""
SQL["flagship"] = f"WITH {ITEMS} SELECT tenant, port AS label, round(sum(t), 2) AS value FROM (SELECT tenant, port, ticket_id, max(total) AS t FROM items WHERE tenant = 'T7' GROUP BY 1, 2, 3) GROUP BY 1, 2 ORDER BY 3 DESC, 2 LIMIT 50"
