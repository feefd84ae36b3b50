"""Do a receipt's numbers close? The first rule that fails, as a stable code, or NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillstream.functions.text import let, strip

# fixed values: tolerance (inclusive), most items, largest amount
TOLERANCE, MAX_ITEMS, MAX_AMOUNT = 1.0, 50, 500_000.0


def finite(x: Column) -> Column:
    """False for NULL too. NaN must be asked for first: Spark orders it above all numbers."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def _first(*rules: tuple[str, Column]) -> Column:
    return reduce(lambda chain, r: chain.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))


def _item(x: Column) -> Column:
    q, u, s = x["quantity"], x["unit_price"], x["subtotal"]
    return _first(
        ("I1", F.coalesce(strip(x["description"]), F.lit("")) == ""), ("I2", ~(finite(q) & finite(u) & finite(s))), ("I3", q <= 0), ("I4", (u < 0) | (s < 0)),
        ("I5", u > MAX_AMOUNT), ("I6", s > MAX_AMOUNT), ("I7", F.abs(s - q * u) > TOLERANCE),
    )


def live_sum(items: Column) -> Column:
    """Sum of the subtotals that are not voided, in the order of the receipt."""
    return F.aggregate(F.filter(items, lambda x: ~F.coalesce(x["voided"], F.lit(False))), F.lit(0.0), lambda s, x: s + x["subtotal"])


def incoherence(c: Column) -> Column:
    """Code of the first failing rule of a candidate receipt; NULL if it closes. Total and item
    count first, then item by item, then discount, tip and the sum."""
    total, items, discount, tip = c["total"], c["items"], c["discount"], c["tip"]
    first_bad = F.get(F.filter(F.transform(items, _item), lambda r: r.isNotNull()), F.lit(0))
    n = F.coalesce(F.size(items), F.lit(0))

    def sums(live: Column) -> Column:
        expected = live - F.coalesce(discount, F.lit(0.0)) + F.coalesce(tip, F.lit(0.0))
        return (
            F.when(discount.isNotNull() & (~finite(discount) | (discount < 0)), "D1")
            .when((discount > MAX_AMOUNT) | (discount > live), "D2")
            .when(tip.isNotNull() & (~finite(tip) | (tip < 0)), "P1")
            .when(tip > MAX_AMOUNT, "P2")
            .when(F.abs(total - expected) > TOLERANCE, "T4")
        )

    rest = let(first_bad, lambda bad: F.coalesce(bad, let(live_sum(items), sums)))
    return _first(("T1", ~finite(total)), ("T2", total < 0), ("T3", total > MAX_AMOUNT), ("N1", n <= 0), ("N2", n > MAX_ITEMS)).otherwise(rest)
