r"""Receipt text as Column expressions: trimming, money, and whole-receipt parsing without a UDF.

White space follows the Unicode set that point-of-sale text may hold (no-break space, byte-order
mark and others), not Spark's blank alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BLANK_CHARS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ANY = r"[^\n\r\u2028\u2029]"
# fixed values: the receipt layout that a parser reads. An item line is quantity, description, two blanks or more, unit
# price, subtotal, and a mark if it is void. Where its numbers begin is looked for from behind, by the digit first, as few
# characters are one; there is one such place at most, and what is tried at others adds up to the line's length
VOID = r"\*ANULADO\*"
ITEM = rf"(?s)\A(\d++)(?={BLANKS})(.*(?=\d)(?<={BLANKS}{{2}}))(\d++){BLANKS}++(\d++)({BLANKS}++{VOID})?\z"
DATE_LINE = rf"Fecha:{BLANKS}*+(\d{{2}})/(\d{{2}})/(\d{{4}}){ANY}*Hora:{BLANKS}*+(\d{{2}}):(\d{{2}})"
TOTAL, DISCOUNT, TIP = "TOTAL:", "Descuento", "Propina"

ITEM_TYPE = "struct<description:string,quantity:double,unit_price:double,subtotal:double,voided:boolean>"
CANDIDATE = f"struct<items:array<{ITEM_TYPE}>,discount:double,tip:double,total:double,printed_at:timestamp>"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value planned and computed once. A fold over nothing hands its result on as it is; an element of a transformed
    array would ask for the type of the whole body, however deep, for each row."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda given, _: given, body)


def once(value: Column) -> Column:
    """value out of an explode, to be selected: later filters are not pushed below it, which would compute it for each use of its result."""
    return F.explode(F.array(value))


def money(text: Column) -> Column:
    """Argentine amounts: dots group, the first comma is the decimal point, a minus anywhere negates.
    No digits at all is 0; NULL where the rest is no number (two commas, a comma alone)."""

    def signed(value: Column) -> Column:
        return F.when(F.contains(text, F.lit("-")), -value).otherwise(value)

    def read(digits: Column) -> Column:
        point = F.when(F.contains(digits, F.lit(",")), F.overlay(digits, F.lit("."), F.instr(digits, F.lit(",")), F.lit(1))).otherwise(digits)
        return let(F.when(digits == "", 0.0).otherwise(point.try_cast("double")), signed)

    return let(F.replace(F.regexp_replace(text, r"[^0-9.,]++", ""), F.lit("."), F.lit("")), read)


def _after_colon(line: Column) -> Column:
    return F.regexp_replace(line, "^[^:]*:", "")


def parse_receipt(raw: Column) -> Column:
    """struct<candidate, poison>: the parsed receipt (NULL without a total or items), and why it could
    not be read at all (`bad_amount`, `bad_date`) or NULL. A line is what the first of these says it is:
    blank, date, item, total, discount, tip; of several total, discount or tip lines the last counts."""

    def tagged(line: Column) -> Column:
        date = F.when(F.contains(line, F.lit("Hora:")), F.regexp_extract(line, DATE_LINE, 0)).otherwise("")
        return let(date, lambda date: let(F.when(date == "", _item_parts(line)), lambda parts: _tag(line, date, parts)))

    lines = F.transform(F.split(raw, "\r?\n", -1), lambda x: let(strip(x), tagged))
    return let(lines, _assemble)


def _item_parts(line: Column) -> Column:
    """array<_, quantity, unit price, subtotal, void mark, description> of a trimmed line, or NULL if it is no item."""

    def with_name(parts: Column, middle: Column, name: Column) -> Column:
        breaks = [F.contains(name, F.lit(x)) for x in "\n\r\u2028\u2029"]
        is_item = F.when(name == "", F.length(middle) >= 4).otherwise(~(breaks[0] | breaks[1] | breaks[2] | breaks[3]))
        return F.when(is_item, F.concat(F.slice(parts, 1, 5), F.array(name)))

    def split(marked: Column) -> Column:
        parts = F.split(marked, "\u0001", 6)  # the last part is the rest, whatever it holds
        return F.when(marked.startswith("\u0001"), let(parts, lambda parts: let(strip(parts[5]), lambda name: with_name(parts, parts[5], name))))

    # a line that matches turns into its parts, with a mark in front; any other stays, and has a digit there
    marked = F.regexp_replace(line, ITEM, "\u0001$1\u0001$3\u0001$4\u0001$5\u0001$2")
    return F.when((line >= "0") & (line < ":"), let(marked, split))


def _printed_at(date: Column) -> Column:
    """The instant of a text that DATE_LINE matched, NULL if there is none such; what can't be one is told before it is tried, which is slow."""

    def made(day: Column) -> Column:
        number = lambda text, *at: F.substring(text, *at).try_cast("int")
        y, mo, d, h, mi = number(day, 7, 4), number(day, 4, 2), number(day, 1, 2), number(date, -5, 2), number(date, -2, 2)
        can_be = (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= 31) & (h < 24) & (mi < 60)
        return F.when(can_be, F.try_make_timestamp(y, mo, d, h, mi, F.lit(0)))

    return let(F.ltrim(F.substring(date, len("Fecha:") + 1, 1 << 30), F.lit(BLANK_CHARS)), made)


def _tag(line: Column, date: Column, parts: Column) -> Column:
    is_item, is_date = parts.isNotNull(), date != ""
    item = F.struct(
        parts[5].alias("description"), parts[1].try_cast("double").alias("quantity"), parts[2].try_cast("double").alias("unit_price"),
        parts[3].try_cast("double").alias("subtotal"), (parts[4] != "").alias("voided"),
    )
    kind = (
        F.when(is_item, "item").when(line == "", "blank").when(is_date, "date")
        .when(line.startswith(TOTAL), "total").when(line.startswith(DISCOUNT), "discount").when(line.startswith(TIP), "tip").otherwise("other")
    )
    amount = F.when(line.startswith(TOTAL) | line.startswith(DISCOUNT) | line.startswith(TIP), money(_after_colon(line)))
    return F.struct(kind.alias("kind"), F.when(is_item, item).alias("item"), amount.alias("amount"), F.when(is_date, _printed_at(date)).alias("at"))


def _assemble(lines: Column) -> Column:
    return assemble(lines, ("total", "discount", "tip"))


def assemble(lines: Column, amounts: tuple[str, ...]) -> Column:
    """struct<candidate, poison> of tagged lines (kind, item, amount, at), which may have kinds that are none."""
    last = lambda kind: F.try_element_at(F.filter(lines, lambda x: x["kind"] == kind), F.lit(-1))

    def whole(items: Column, total: Column) -> Column:
        parts = F.struct(items.alias("items"), F.abs(last("discount")["amount"]).alias("discount"), last("tip")["amount"].alias("tip"), total["amount"].alias("total"), last("date")["at"].alias("printed_at"))
        return F.when((F.size(items) > 0) & total.isNotNull(), parts)

    def outcome(poison: Column) -> Column:
        items = F.transform(F.filter(lines, lambda x: x["kind"] == "item"), lambda x: x["item"])
        candidate = F.when(poison.isNull(), let(items, lambda items: let(last("total"), lambda total: whole(items, total))))
        return F.struct(candidate.cast(CANDIDATE).alias("candidate"), poison.alias("poison"))

    lacks = lambda field, *kinds: F.exists(lines, lambda x: x[field].isNull() & F.coalesce(x["kind"].isin(*kinds), F.lit(False)))
    return let(F.when(lacks("at", "date"), "bad_date").when(lacks("amount", *amounts), "bad_amount"), outcome)


def json_candidate(text: Column) -> Column:
    """The receipt in a model's answer: the JSON from the first { to the last }, if it has the typed shape; else NULL."""
    return let(F.try_parse_json(F.regexp_extract(text, r"\{[\s\S]*\}", 0)), _typed)


def _typed(v: Column) -> Column:
    number = lambda x, p: F.when(F.schema_of_variant(F.try_variant_get(x, p, "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.try_variant_get(x, p, "double"))
    truthy = lambda x, p: F.coalesce(
        F.when(F.schema_of_variant(F.try_variant_get(x, p, "variant")) == "STRING", F.try_variant_get(x, p, "string") != "").when(number(x, p).isNotNull(), number(x, p) != 0).otherwise(F.try_variant_get(x, p, "boolean")), F.lit(False)
    )

    def item(x: Column) -> Column:
        name = F.when(F.schema_of_variant(F.try_variant_get(x, "$.description", "variant")) == "STRING", F.try_variant_get(x, "$.description", "string"))
        return F.struct(name.alias("description"), number(x, "$.quantity").alias("quantity"), number(x, "$.unitPrice").alias("unit_price"), number(x, "$.subtotal").alias("subtotal"), truthy(x, "$.voided").alias("voided"))

    def receipt(items: Column) -> Column:
        whole = F.forall(items, lambda i: i["description"].isNotNull() & i["quantity"].isNotNull() & i["unit_price"].isNotNull() & i["subtotal"].isNotNull())
        ok = F.try_variant_get(v, "$.unparseable", "variant").isNull() & (F.size(items) > 0) & whole & number(v, "$.total").isNotNull()
        shape = F.struct(items.alias("items"), number(v, "$.discount").alias("discount"), number(v, "$.tip").alias("tip"), number(v, "$.total").alias("total"), F.lit(None).cast("timestamp").alias("printed_at"))
        return F.when(ok, shape).cast(CANDIDATE)

    return let(F.transform(F.try_variant_get(v, "$.items", "array<variant>"), item), receipt)
