"""Exact profits against a queue of fractions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal, localcontext
from fractions import Fraction

import pytest

from tidemark.operators import exact as E
from tidemark.operators import ledger as L

PARTS = "id long, created_at timestamp, item_code string, money decimal(28,10), quantity decimal(28,6), side string, kind string, account string, transaction_type string, gross decimal(28,10), net decimal(28,10), fee_known boolean"


def queue(rows: list[dict]) -> tuple[dict, dict]:
    """(profits by account and measure, matched by sale), a lot after the other in fractions."""
    profits, matched, held = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
        lots = held.setdefault((r["account"], r["item"]), [])
        known = r["quantity"] is not None and r["quantity"] > 0
        if r["side"] == "buy":
            if not lots or lots[-1] is not None:
                lots.append([Fraction(r["quantity"]), r] if known else None)
        elif not known:
            lots.clear()
        else:
            need = Fraction(r["quantity"])
            while need and lots and lots[0] is not None and lots[0][1]["at"] < r["at"]:
                lot, taken = lots[0][1], min(need, lots[0][0])
                matched[r["id"]] = matched.get(r["id"], 0) + taken
                for m in E.MEASURES:
                    if r[m] is not None and lot[m] is not None:
                        key = r["account"], m
                        profits[key] = profits.get(key, 0) + taken * (Fraction(r[m]) / Fraction(r["quantity"]) - Fraction(lot[m]) / Fraction(lot["quantity"]))
                need -= taken
                lots[0][0] -= taken
                if not lots[0][0]:
                    lots.pop(0)
    return profits, matched


def lots_and_sales(seed: int, rows: int, days: int, accounts: int, unknown: float) -> list[dict]:
    rng = random.Random(seed)
    amount = lambda: None if rng.random() < 0.1 else Decimal(rng.randrange(1, 10**15)) / 10**rng.choice([2, 6, 10])
    found = []
    for n in range(rows):
        quantity = rng.choice([None, Decimal(0)]) if rng.random() < unknown else Decimal(rng.randrange(1, 5_000_000)) / 10**rng.choice([0, 3, 6])
        found.append({"id": n, "at": datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(days * 24 * 6) * 10), "item": rng.choice("xy"), "account": f"a{rng.randrange(accounts)}", "side": rng.choice(["buy", "sell"]), "quantity": quantity, "money": amount(), "gross": amount(), "net": amount()})
    return found


def frame(spark, rows: list[dict]):
    return spark.createDataFrame([(r["id"], r["at"], r["item"], r["money"], r["quantity"], r["side"], "user", r["account"], "trading", r["gross"], r["net"], True) for r in rows], PARTS)


@pytest.mark.parametrize(("seed", "days", "unknown"), [(1, 1, 0.1), (2, 40, 0.03), (3, 400, 0.0)])
def test_profits_equal_fractions(spark, seed, days, unknown):
    rows = lots_and_sales(seed, 400, days, 3, unknown)
    profits, matched = queue(rows)
    got = {(r.account, r.measure): r for r in E.exact_profits(frame(spark, rows)).collect()}
    assert {k: Fraction(int(r.numerator), int(r.denominator)) for k, r in got.items()} == profits
    for key, r in got.items():
        with localcontext(E.SHOWN):
            assert Decimal(r.profit) == Decimal(profits[key].numerator) / Decimal(profits[key].denominator)
    found = L.fifo(frame(spark, rows), 6).groupBy("sale_id").sum("matched").collect()
    assert {r.sale_id: Fraction(r["sum(matched)"]) / 10**6 for r in found} == matched


def test_doubles_over_many_days_equal_the_queue(spark):
    rows = lots_and_sales(4, 600, 90, 2, 0.02)
    _, matched = queue(rows)
    doubles = frame(spark, rows).selectExpr("* except (quantity, money)", "cast(quantity as double) as quantity", "cast(money as double) as money")
    got = {r.sale_id: r["sum(matched)"] for r in L.fifo(doubles).groupBy("sale_id").sum("matched").collect()}
    assert got == pytest.approx({k: float(v) for k, v in matched.items()})


def test_one_account_is_spread(spark):
    """A single account and item over thirty days: no window sees more than a day's lots and sales."""
    rows = spark.range(60_000).selectExpr("id", "timestamp_seconds(1704067200 + id * 43) as created_at", "'x' as item_code", "cast(id % 97 as double) as money", "cast(1 + id * 7919 % 13 as double) as quantity", "if(id * 104729 % 5 < 3, 'buy', 'sell') as side", "'user' as kind", "'one' as account", "'trading' as transaction_type", "cast(null as double) as gross", "cast(null as double) as net", "true as fee_known")
    got = L.fifo(rows)
    plain = queue([{"id": r.id, "at": r.created_at, "item": "x", "account": "one", "side": r.side, "quantity": Decimal(r.quantity), "money": Decimal(r.money), "gross": None, "net": None} for r in rows.collect()])[1]
    assert {r.sale_id: r["sum(matched)"] for r in got.groupBy("sale_id").sum("matched").collect()} == {k: float(v) for k, v in plain.items()}
    assert "hashpartitioning(key" in got._jdf.queryExecution().toString()


def test_half_even_at_fifty_digits():
    assert E.shown(Fraction(2, 3)) == "0." + "6" * 49 + "7"
    assert E.shown(Fraction(10**50 * 2 + 1, 2)) == str(10**50)
    assert E.shown(Fraction(10**50 * 2 + 30, 2)) == str(10**50 + 20)
    assert E.shown(Fraction(-1, 4)) == "-0.25"
