"""First-in-first-out matching against a plain queue, and accounts on hand cases."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from tidemark.operators import ledger as L

PARTS = "id long, created_at timestamp, item_code string, money double, quantity double, side string, kind string, account string, transaction_type string, category string, actor string, gross double, net double, fee_known boolean"


def queue(rows):
    """Matched quantity and profit of each sale, walking one account's rows in order."""
    lots, barred, out = [], False, defaultdict(lambda: [0.0, 0.0])
    for rid, at, money, quantity, side in sorted(rows, key=lambda r: (r[1], r[0])):
        known = quantity is not None and quantity > 0
        if side == "buy":
            if not known:
                barred = True
            elif not barred:
                lots.append([at, quantity, money / quantity])
        elif not known:
            lots, barred = [], False
        else:
            left = quantity
            for lot in lots:
                if left <= 1e-12 or lot[0] >= at:
                    break
                take = min(left, lot[1])
                lot[1] -= take
                left -= take
                out[rid][0] += take
                out[rid][1] += take * (money / quantity - lot[2])
            lots = [x for x in lots if x[1] > 1e-12]
    return {k: v for k, v in out.items() if v[0] > 1e-9}


def test_fifo_equals_a_queue(spark):
    rng, start, rows, want = random.Random(5), datetime(2024, 1, 1), [], {}
    for a in range(150):
        own = []
        for _ in range(rng.randint(1, 14)):
            rid = len(rows) + len(own)
            quantity = rng.choice([1.0, 2.0, 3.0, 5.0, 5.0, 0.0, None]) if rng.random() < 0.4 else float(rng.randint(1, 6))
            own.append((rid, start + timedelta(hours=rng.randint(0, 9)), float(rng.randint(1, 50)), quantity, rng.choice(["buy", "sell"])))
        want |= queue(own)
        rows += [(r[0], r[1], "x", r[2], r[3], r[4], "user", f"u{a}", "trading", "x", None, r[2], None if r[0] % 7 == 0 else r[2] - 0.5, True) for r in own]
    matches = L.fifo(spark.createDataFrame(rows, PARTS))
    assert matches.where("not (net_profit <=> null) and (sale_id % 7 = 0 or lot_id % 7 = 0)").count() == 0 and matches.where("abs(gross_profit - profit) > 1e-9").count() == 0
    got = matches.groupBy("sale_id").sum("matched", "profit").collect()
    assert {r.sale_id for r in got} == set(want)
    for r in got:
        assert r["sum(matched)"] == pytest.approx(want[r.sale_id][0])
        assert r["sum(profit)"] == pytest.approx(want[r.sale_id][1], abs=1e-6)


def test_fifo_of_one_large_account(spark):
    """A single account's long history: matches stay as many as trades, where all overlaps would be millions."""
    rng, start = random.Random(9), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), "x", 2.0, float(rng.randint(1, 9)), rng.choice(["buy", "sell"]), "user", "one", "trading", "x", None, 2.0, 2.0, True) for i in range(20_000)]
    want = queue([(r[0], r[1], r[3], r[4], r[5]) for r in rows])
    got = {r.sale_id: r.matched for r in L.fifo(spark.createDataFrame(rows, PARTS)).groupBy("sale_id").agg({"matched": "sum"}).withColumnRenamed("sum(matched)", "matched").collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k][0]) < 1e-6 for k in got)


def test_realized_and_boards(spark):
    t = [datetime(2024, 1, 1, k) for k in range(6)]

    def row(i, at, side, account, money, quantity, net=True, kind="user"):
        return (i, t[at], "x", money, quantity, side, kind, account, "trading", "x", account, money, money if net else None, net)

    rows = [row(1, 0, "buy", "a", 10.0, 2.0), row(2, 1, "sell", "a", 16.0, 2.0), row(3, 0, "buy", "b", 10.0, 1.0), row(4, 1, "sell", "b", 8.0, 2.0), row(5, 0, "buy", "c", 5.0, 1.0, False), row(6, 1, "sell", "c", 9.0, 1.0, False), row(7, 3, "sell", "p", 9.0, 1.0, kind="party"), row(8, 4, "buy", "z", 0.0, 1.0)]
    parts = spark.createDataFrame(rows, PARTS)
    accounts = L.on_basis(L.account_ledger(parts))
    out = L.realized(parts, L.fifo(parts), accounts)
    assert {r.account: (r.net_profit, r.costing_status, r.uncosted_quantity, r.unknown_fee_quantity) for r in out.collect() if r.account in "abc"} == {"a": (6.0, "matched_sales", 0.0, 0.0), "b": (-6.0, "partial", 1.0, 1.0), "c": (None, "unavailable", 0.0, 1.0)}
    assert {(r.board, r.kind, r.rank, r.account) for r in L.boards(out).collect()} == {("losses", "user", 1, "b"), ("profits", "user", 1, "a"), ("volume", "user", 1, "a"), ("volume", "user", 2, "b"), ("volume", "user", 3, "c")}
    assert {r.board for r in L.boards(L.without_costing(accounts)).collect()} == {"volume"}
    cats = L.category_ledger(parts, L.money_basis(L.account_ledger(parts)))
    details = L.detail_prefix(cats)
    assert {r.account: (r.status, r.selected) for r in L.detail_status(accounts, details).collect()} == {"a": ("complete", 1), "b": ("complete", 1), "c": ("complete", 1), "p": ("complete", 1), "z": ("zero-total", 0)}


def test_top_categories_and_the_rest(spark):
    rows = [(i, datetime(2024, 1, 1), f"i{i}", float(v), 1.0, "buy", "user", "a", "trading", f"i{i}", "a", None, None, False) for i, v in enumerate([50, 20, 20, 6, 4])]
    parts = spark.createDataFrame(rows, PARTS)
    ranked = L.side_categories(L.category_ledger(parts), L.on_basis(L.account_ledger(parts)))
    got = {(r.place, r.category): (r.money, r.trades, round(r.share, 6)) for r in L.top_categories(ranked).collect()}
    assert got == {(1, "i0"): (50.0, 1, 0.5), (2, "i1"): (20.0, 1, 0.2), (3, "i2"): (20.0, 1, 0.2), (4, "other"): (10.0, 2, 0.1)}


def test_accounts(spark):
    cols = [f"{s}_{k}_id" for s in ("buy", "sell") for k in L.KINDS]
    cases = [("u1", None, None, None), ("u1", "m1", None, None), ("u1", "m1", "c1", None), (None, None, None, None), (" u1", None, None, None), ("u1", None, None, "p1")]
    rows = [(*c, "u1", None, None, None, 5.0) for c in cases]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols) + ", money double")
    got = [(r.buyer.kind, r.buyer.id, r.buyer.reason, r.self_trade) for r in L.attributed(df).collect()]
    assert got == [
        ("user", "u1", None, True), ("mu", "m1", None, False), (None, None, "conflicting_institutions", False),
        (None, None, "missing_reference", False), (None, None, "invalid_reference", False), (None, None, "unsupported_party", False),
    ]


def test_equipment_needs_a_verified_purchase_before(spark):
    t = [datetime(2024, 1, k) for k in (1, 2, 3, 4)]
    rows = [(1, t[0], "buy", "user", "a", "i", True, 5.0), (2, t[1], "sell", "user", "a", "i", True, 9.0), (3, t[2], "sell", "user", "a", "i", True, 9.0), (4, t[0], "buy", "user", "a", "j", False, 5.0), (5, t[1], "sell", "user", "a", "j", True, 9.0)]
    df = spark.createDataFrame(rows, "id int, created_at timestamp, side string, kind string, account string, instance_id string, lineage_verified boolean, money double")
    assert {r.id: (r.costed, r.profit) for r in L.equipment_lineage(df).collect()} == {2: (True, 4.0), 3: (False, None), 5: (False, None)}


def test_unknown_money_keeps_all_details(spark):
    rows = [("user", "a", f"i{k}", float(v) if v else None, 0.0) for k, v in enumerate([80, 15, 5])] + [("user", "b", "i0", None, 0.0), ("user", "b", "i1", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "kind string, account string, category string, buy_value double, sell_value double").selectExpr("*", "0 as buy_missing_money", "0 as sell_missing_money")
    got = sorted((r.account, r.category, r.status) for r in L.detail_prefix(df).collect())
    assert got == [("a", "i0", "complete"), ("b", "i0", "partial"), ("b", "i1", "partial")]


def test_equipment_by_instance(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    # (id, hour, instance, buyer, seller, verified, money, quantity)
    trades = [(1, 1, "i", "a", "z", True, 10.0, 1.0), (2, 2, "i", "b", "a", True, 16.0, 1.0), (3, 3, "i", "c", "b", False, 20.0, 1.0), (4, 4, "i", "d", "c", True, 30.0, 1.0), (5, 5, "i", "e", "x", True, 5.0, 1.0), (6, 6, "i", "f", "d", True, 9.0, 1.0), (7, 6, "j", "g", "y", True, 4.0, None), (8, 7, "j", "h", "g", True, 9.0, 1.0), (9, 8, "k", "g", "y", True, 4.0, 2.0), (10, 8, "k", "h", "g", True, 9.0, 1.0)]
    cols = "id long, hour int, instance_id string, buyer string, seller string, lineage_verified boolean, money double, quantity double"
    t = spark.createDataFrame(trades, cols).selectExpr("id", "make_timestamp(2024, 1, 1, hour, 0, 0) as created_at", "'itemMarket' as transaction_type", "'gear' as item_code", "instance_id", "lineage_verified", "money", "quantity", "buyer as buy_user_id", "seller as sell_user_id", *(f"cast(null as string) as {s}_{k}_id" for s in ("buy", "sell") for k in ("mu", "country", "party")), "true as settlement_verified", "'settled' as settlement_role", "0.0D as settlement_fee")
    rows = L.attributed(t)
    got = L.equipment_matches(rows, L.sides(rows)).collect()
    # Only a's sale follows its own verified purchase: later lines are broken by an unverified trade, a stranger's, an unknown size and an equal time.
    assert [(r.account, r.sale_id, r.lot_id, r.matched, r.profit, r.net_profit, r.sold_at) for r in got] == [("a", 2, 1, 1.0, 6.0, 6.0, at(2))]
    assert set(L.fifo(L.sides(rows)).columns) == set(L.equipment_matches(rows, L.sides(rows)).columns)


def test_realized_reads_events_once(spark, sf_dir):
    """Sides are made once for matches, totals and flags, and their cost is dealt by id, however few tasks the scan has."""
    from tidemark.plans import ledger as P
    from tidemark.sources import tables as T

    for made in (P._realized, P._with_gear):
        assert not [f for f in made(spark, sf_dir).inputFiles() if "events.parquet" in f]
    assert "REPARTITION_BY_COL" in T.ledger_trades(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
