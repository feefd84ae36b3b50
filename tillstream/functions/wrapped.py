r"""A second receipt layout: amounts with cents, and names that go over several lines.

An item is one line or more of name and, below, one line of numbers: ``2 x 1.250,50   2.501,00`` (quantity,
which may have decimals, unit price, subtotal, and ``ANULADO`` if it is void). Other lines are ``TOTAL 2.501,00``,
``DESC. 5,00``, ``PROPINA 7,00``, ``2026-07-05 21:40`` and blank ones, which end a heading. All else is part of a name.

Names are put together by one pass over the text, which turns the line feed behind each line of a name into a mark:
what follows the last mark of a line says what it is, what stands before it is a name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillstream.functions.text import BLANKS, assemble, let, money, strip

# fixed values: the lines of the layout
AMOUNT = r"[0-9][0-9.]*+(?:,[0-9]++)?+"
NUMBERS = rf"({AMOUNT}) x (-?{AMOUNT}){BLANKS}++(-?{AMOUNT})(?:{BLANKS}++(ANULADO))?"
WORDS = {"total": "TOTAL", "discount": "DESC.", "tip": "PROPINA"}
DATE = r"([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2})"
MARK = "\u0001"


def _line(what: str) -> str:
    return rf"\A{what}\z"


def parse_wrapped(raw: Column) -> Column:
    """struct<candidate, poison>, as `parse_receipt` gives it; of several total, discount or tip lines the last counts. A total,
    discount or tip without a readable amount is `bad_amount`, a line like a date that is none `bad_date`."""
    text = F.regexp_replace(F.replace(raw, F.lit(MARK), F.lit(" ")), r"(?md)(?=[ \t\r\u00a0])(?<![ \t\r\u00a0])[ \t\r\u00a0]++$", "")
    known = rf"(?:{NUMBERS}|(?:{'|'.join(w.replace('.', '[.]') for w in WORDS.values())}) [^\n]*+|{DATE}|)"
    joined = F.regexp_replace(text, rf"(?md)^(?!{known}$)([^\n]*+)\n", f"$10{MARK}")
    lines = F.transform(F.split(joined, "\n", -1), lambda x: let(F.split(x, MARK, -1), _tagged))
    return let(lines, lambda lines: assemble(lines, tuple(WORDS)))


def _tagged(parts: Column) -> Column:
    line = F.element_at(parts, -1)
    # a line of numbers turns into its four parts, any other into one
    numbers = F.split(F.regexp_replace(line, _line(NUMBERS), f"$1{MARK}$2{MARK}$3{MARK}$4"), MARK, -1)
    return let(numbers, lambda numbers: let(_kind(line, numbers), lambda kind: _parts(line, numbers, kind, parts)))


def _kind(line: Column, numbers: Column) -> Column:
    kind = F.when(F.size(numbers) == 4, "item").when(line.rlike(_line(DATE)), "date")
    for name, word in WORDS.items():
        kind = kind.when(line.startswith(f"{word} "), name)
    return kind


def _parts(line: Column, numbers: Column, kind: Column, parts: Column) -> Column:
    name = strip(F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), strip), " "))
    item = F.struct(name.alias("description"), money(numbers[0]).alias("quantity"), money(numbers[1]).alias("unit_price"), money(numbers[2]).alias("subtotal"), (numbers[3] != "").alias("voided"))
    amount = let(F.regexp_replace(line, r"\A[^ ]++ ++", ""), lambda rest: F.when(rest.rlike(rf"\A-?\$? ?{AMOUNT}\z"), money(rest)))
    y, mo, d, h, mi = (F.regexp_extract(line, _line(DATE), k).try_cast("int") for k in (1, 2, 3, 4, 5))
    return F.struct(
        kind.alias("kind"), F.when(kind == "item", item).alias("item"), F.when(kind.isin(*WORDS), amount).alias("amount"),
        F.when(kind == "date", F.try_make_timestamp(y, mo, d, h, mi, F.lit(0))).alias("at"),
    )
