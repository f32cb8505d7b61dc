"""Exact money: what sales realized as fractions, and in fifty digits.

A part of a sale is worth matched * amount / quantity, whose sum over an account has no finite
decimals. Parts are summed by quantity, so only whole numbers are added: amounts and matches
in units of their last digit, both cut in two limbs, whose four sums of products no number of
rows overflows. An account's fraction is then made of one number for each quantity.
"""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Context, Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ledger as L

#: Digits after the point of quantities and of amounts; significant digits of what is shown.
QUANTITY_SCALE, MONEY_SCALE, DIGITS = 6, 10, 50
LIMB = 10**12
MEASURES = ("money", "gross", "net")
SHOWN = Context(prec=DIGITS, rounding=ROUND_HALF_EVEN)
SUMS = [f"{a}_{b}" for a in ("high", "low") for b in ("high", "low")]


def shown(value: Fraction) -> str:
    """A fraction in fifty significant digits, half to even, without an exponent."""
    return format(SHOWN.divide(Decimal(value.numerator), Decimal(value.denominator)), "f")


def _total(parts: list, unit: int) -> Fraction:
    """The exact sum of parts (quantity and four sums of limb products), in units."""
    total = Fraction(0)
    for p in parts:
        high_high, high_low, low_high, low_low = (int(p[s]) for s in SUMS)
        total += Fraction(high_high * LIMB * LIMB + (high_low + low_high) * LIMB + low_low, int(p["quantity"]))
    return total / unit


def exact_profits(parts: DataFrame, quantity_scale: int = QUANTITY_SCALE, money_scale: int = MONEY_SCALE) -> DataFrame:
    """(kind, account, measure, numerator, denominator, profit): what each account's sales realized, exactly.

    ``parts`` are sides of trades as for ``ledger.fifo``, with amounts as decimals or doubles,
    which count as the decimals they print as. A measure (money, gross, net) sums the parts
    whose sale and lot both have it; one without any has no row. The fraction is in lowest
    terms, ``profit`` has fifty significant digits. One row of an account is as large as
    the number of its different quantities.
    """
    met = L.fifo(parts, quantity_scale)
    units = lambda c: F.floor(F.col(c).cast("decimal(38,18)") * F.lit(10**money_scale)).cast("decimal(38,0)")
    term = lambda m, side, sign: F.struct(F.lit(m).alias("measure"), F.col(f"{side}_quantity").alias("quantity"), (units(f"{side}_{m}") * F.lit(sign)).cast("decimal(38,0)").alias("amount"), (F.col(f"sale_{m}").isNotNull() & F.col(f"lot_{m}").isNotNull()).alias("known"))
    terms = met.select("kind", "account", "matched", F.explode(F.array(*(term(m, *s) for m in MEASURES for s in (("sale", 1), ("lot", -1))))).alias("t")).select("kind", "account", "matched", "t.*").where("known")
    limbs = lambda c: {"high": F.expr(f"{c} div {LIMB}").cast("decimal(18,0)"), "low": F.expr(f"{c} % {LIMB}").cast("decimal(18,0)")}
    of_match, of_amount = limbs("matched"), limbs("amount")
    sums = [F.sum((of_match[s.split("_")[0]] * of_amount[s.split("_")[1]]).cast("decimal(38,0)")).alias(s) for s in SUMS]
    by_quantity = terms.groupBy("kind", "account", "measure", "quantity").agg(*sums)
    listed = by_quantity.groupBy("kind", "account", "measure").agg(F.collect_list(F.struct("quantity", *SUMS)).alias("parts"))

    @F.pandas_udf("numerator string, denominator string, profit string")
    def added(parts: pd.Series) -> pd.DataFrame:
        totals = [_total(list(p), 10**money_scale) for p in parts]
        return pd.DataFrame({"numerator": [str(t.numerator) for t in totals], "denominator": [str(t.denominator) for t in totals], "profit": [shown(t) for t in totals]})

    return listed.select("kind", "account", "measure", added("parts").alias("x")).select("kind", "account", "measure", "x.*")
