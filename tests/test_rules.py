"""Rules on hand cases: boundaries, ties, missing evidence."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import context as C
from tidemark.functions import exprs as X
from tidemark.operators import books as B
from tidemark.operators import coverage as V
from tidemark.operators import guidance as G
from tidemark.operators import indexes as I
from tidemark.operators import resolve as R
from tidemark.operators import stats as S


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {t}" for k, (_, t) in values.items())
    return spark.createDataFrame([tuple(v for v, _ in values.values())], kinds).select(column.alias("x")).first()[0]


def d(v):
    return (v, "double")


@pytest.mark.parametrize(("value", "kept"), [("1.5", 1.5), ("0", None), ("-1", None), ("NaN", None), ("Infinity", None), ("x", None), (None, None)])
def test_positive_finite(spark, value, kept):
    assert one(spark, X.positive_finite("v"), v=(value, "string")) == kept


@pytest.mark.parametrize(("delta", "outcome"), [(0.001, "Flat"), (0.0011, "Up"), (-0.001, "Flat"), (-0.0011, "Down"), (0.0, "Flat")])
def test_bid_outcome_is_strict_about_the_tick(spark, delta, outcome):
    assert one(spark, X.bid_outcome("a", "b"), a=d(1.0), b=d(1.0 + delta)) == outcome


@pytest.mark.parametrize(("m", "g", "signal"), [(6.0, 0.0, "Up"), (0.99, 0.0, "No clear move"), (1.0, 2.0, "No clear move"), (None, -2.0, "Up"), (-6.0, -2.0, "Down"), (None, None, "No clear move")])
def test_direction(spark, m, g, signal):
    assert one(spark, X.direction_signal(X.direction_score("m", "g")), m=d(m), g=d(g)) == signal


@pytest.mark.parametrize(("c", "label"), [((1.0, 1.0, None), "Persistent rise"), ((1.0, -1.0, -1.0), "Rebound"), ((-1.0, 1.0, 1.0), "Pullback"), ((0.5, 0.0, None), "Flat"), ((1.0, None, None), "Insufficient history"), ((1.0, 1.0, -1.0), "Mixed")])
def test_trend_pattern(spark, c, label):
    assert one(spark, X.trend_pattern("a", "b", "c"), a=d(c[0]), b=d(c[1]), c=d(c[2])) == label


@pytest.mark.parametrize(("n", "acc", "base", "label"), [(29, 90.0, 50.0, "Insufficient"), (30, 50.0, 50.0, "Weak"), (30, 54.9, 50.0, "Limited"), (30, 55.0, 50.0, "Supported"), (30, None, None, "Weak")])
def test_evidence(spark, n, acc, base, label):
    assert one(spark, X.evidence_label("n", "a", "b"), n=(n, "long"), a=d(acc), b=d(base)) == label


def test_scalar_functions(spark):
    assert one(spark, X.inflation_class("c"), c=d(0.1)) == "Stable"
    assert one(spark, X.inflation_class("c"), c=d(None)) == "Insufficient data"
    assert one(spark, X.purchasing_power_pct("c"), c=d(25.0)) == pytest.approx(-20)
    assert one(spark, X.passive_limit("b", "a", 0.001), b=d(1.0), a=d(1.001)) == 1.0
    assert one(spark, X.passive_limit("b", "a", 0.001), b=d(1.0), a=d(1.5)) == pytest.approx(1.001)
    assert one(spark, X.passive_limit("b", "a", 0.001), b=d(2.0), a=d(1.5)) is None
    assert one(spark, X.range_position_pct("x", "l", "h"), x=d(5.0), l=d(1.0), h=d(3.0)) == 100
    assert one(spark, X.range_position_pct("x", "l", "h"), x=d(5.0), l=d(3.0), h=d(3.0)) is None
    assert one(spark, X.stable_fair("a", "b", "c"), a=d(10.0), b=d(None), c=d(20.0)) == pytest.approx((5 + 4) / 0.7)
    assert one(spark, X.spreadsheet_safe("t"), t=(" =1+1", "string")) == "' =1+1"
    assert one(spark, X.spreadsheet_safe("t"), t=("a=1", "string")) == "a=1"
    assert one(spark, X.display_name("t"), t=("lightAmmo", "string")) == "Light Ammo"
    assert one(spark, X.pressure_label("p"), p=d(5.1)) == "Buy-heavy"
    assert one(spark, X.position_label("p"), p=d(33.0)) == "Near floor"
    assert one(spark, X.production_points("c", {"lightammo": 2.0}), c=("Light-Ammo", "string")) == 2.0


def test_settlement(spark):
    row = one(spark, X.settlement("m", "v", "r", "f", "buy"), m=d(10.0), v=(True, "boolean"), r=("gross", "string"), f=d(1.0))
    assert (row.gross, row.net) == (10, 11)
    row = one(spark, X.settlement("m", "v", "r", "f", "sell"), m=d(10.0), v=(True, "boolean"), r=("settled", "string"), f=d(1.0))
    assert (row.gross, row.net) == (11, 10)
    row = one(spark, X.settlement("m", "v", "r", "f", "sell"), m=d(10.0), v=(False, "boolean"), r=("gross", "string"), f=d(1.0))
    assert (row.gross, row.net) == (None, None)


def test_cutoff(spark):
    t = spark.createDataFrame([(datetime(2024, 1, 2),), (datetime(2024, 1, 9),)], "ts timestamp")
    later, earlier, none = C.resolve(datetime(2025, 1, 1), (t, "ts")), C.resolve(datetime(2024, 1, 9), (t, "ts")), C.resolve(None, (t.limit(0), "ts"))
    assert t.where(later.window("ts", 7)).count() == 2
    assert (earlier.mode, t.where(earlier.window("ts", 7)).count()) == ("historical-exclusive", 1)
    assert none.mode == "unavailable" and t.where(none.window("ts", 7)).count() == 0


def test_weighted_median_is_the_lower_one(spark):
    t = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 1.0), ("a", 2.0, 0.0), ("a", -5.0, 9.0), ("b", 3.0, None)], "item_code string, unit_price double, quantity double")
    assert [(r.item_code, r.representative_price) for r in S.weighted_median(t, ["item_code"]).collect()] == [("a", 1.0)]


LEVELS = [("i", datetime(2024, 1, 1), "ask", 1.0, 5.0), ("i", datetime(2024, 1, 1), "ask", 2.0, 5.0), ("i", datetime(2024, 1, 1), "bid", 0.5, 3.0)]
BOOK = "item_code string, observed_at timestamp, side string, price double, quantity double"


def test_sweep_fills_outward_and_reports_what_is_left(spark):
    got = {r.side: r for r in B.sweep(spark.createDataFrame(LEVELS, BOOK), 8.0).collect()}
    assert (got["ask"].filled, got["ask"].vwap, got["ask"].worst, got["ask"].fully_filled) == (8, pytest.approx(11 / 8), 2, True)
    assert (got["bid"].filled, got["bid"].unfilled, got["bid"].fully_filled) == (3, 5, False)


def test_merged_levels_drop_zero_prices_and_reject_negative(spark):
    raw = [*LEVELS, ("i", datetime(2024, 1, 1), "ask", 1.0, 2.0), ("i", datetime(2024, 1, 1), "ask", 0.0, 2.0), ("i", datetime(2024, 1, 1), "ask", 1.5, -2.0)]
    got = {(r.side, r.price): r.quantity for r in B.merged_levels(spark.createDataFrame(raw, BOOK)).collect()}
    assert got == {("ask", 1.0): 7, ("ask", 2.0): 5, ("bid", 0.5): 3}


@pytest.mark.parametrize(("last", "name"), [(2.0, "within_normal_range"), (2.1, "meaningful_premium"), (0.9, "meaningful_discount"), (None, "insufficient_evidence")])
def test_dislocation_boundaries(spark, last, name):
    row = spark.createDataFrame([("x", last, 1.5, 1.0, 2.0)], "item_code string, last_trade_price double, stable_fair_price_7d double, price_p10_7d double, price_p90_7d double")
    assert G.dislocations(row).first().classification == name


def test_coverage(spark):
    t = spark.createDataFrame([("a", 0, 2), ("a", 2, 3), ("a", 5, 6), ("a", 1, 2)], "k string, start int, end int")
    assert sorted((r.start, r.end) for r in V.merged(t, ["k"]).collect()) == [(0, 3), (5, 6)]
    assert V.covers(t, ["k"], F.lit(0), F.lit(3)).first().covered and not V.covers(t, ["k"], F.lit(0), F.lit(4)).first().covered
    assert V.covers(t, ["k"], F.lit(9), F.lit(9)).first().covered
    assert V.reached(t, F.lit(1), ["k"]).first().reached == 3
    assert sorted((r.start, r.end) for r in V.clamped(t, F.lit(2)).collect()) == [(2, 3), (5, 6)]


def test_revisions(spark):
    log = [("1", "f", "old", 1, 0), ("1", "f", "new", 2, 1), ("1", "f", "late", 2, 2), ("1", "f", None, 9, 3), ("2", "f", "a", None, 0), ("2", "f", "b", None, 1), ("3", "f", "a", None, 0), ("3", "f", "b", 0, 1)]
    got = {r.id: r.value for r in R.latest_fields(spark.createDataFrame(log, "id string, field string, value string, revised_at int, arrival int")).collect()}
    # A newer null blanks the value: it was wrongly expected to say nothing.
    assert got == {"1": None, "2": "a", "3": "b"}


def test_basket_without_a_price_has_no_cost(spark):
    basket = spark.createDataFrame([("a", "x", 2.0), ("a", "y", 1.0), ("b", "x", 1.0)], "action string, item_code string, amount double")
    prices = spark.createDataFrame([("x", 3.0)], "item_code string, price double")
    got = {r.action: (r.cost, r.missing) for r in I.basket_costs(basket, prices).collect()}
    assert got == {"a": (None, "y"), "b": (3.0, "")}


def test_chained_index_does_not_jump_at_a_reset_and_breaks_for_good(spark):
    from datetime import date, timedelta

    start = date(2024, 1, 1)
    rows = [(i, start + timedelta(k), 10.0, 10.0 * (1 + 0.01 * k) * (2 if i == "b" else 1)) for k in range(25) for i in "ab" if not (i == "b" and k == 20)]
    daily = spark.createDataFrame(rows, "item_code string, day date, quantity double, turnover double")
    chain = I.Chain(("a", "b"), start + timedelta(4), start + timedelta(25), width=3)
    got = {r.day: r for r in I.chained(daily, chain).collect()}
    days = sorted(got)
    assert got[days[0]].level == 100
    both = [d for d in days if got[d].level is not None]
    steps = [got[b].level / got[a].level for a, b in zip(both, both[1:], strict=False) if (b - a).days == 1]
    assert all(1 < s < 1.02 for s in steps)
    assert got[date(2024, 1, 22)].level is not None or got[date(2024, 1, 22)].is_reset
    assert any(got[d].level is None for d in days)


# -- chained index against a plain loop ------------------------------------
def walk(facts, chain):
    """Levels day after day, as one would by hand."""
    from datetime import timedelta

    day = timedelta(days=1)
    first = {}
    for code, at in facts:
        first[code] = min(at, first.get(code, at))
    covered = lambda code, at: (code, at) in facts and at > first[code] and at < chain.as_of
    price = lambda code, at: facts[code, at - day][1] / facts[code, at - day][0] if covered(code, at - day) else None
    codes, admitted, held, broken, out, at = list(chain.members), None, {}, False, [], chain.inception
    while at <= chain.as_of:
        reset = at == chain.inception or at.weekday() == 0
        if reset and admitted is None and chain.late and all(covered(chain.late, at - k * day) for k in range(1, chain.width + 1)):
            admitted, codes = at, [*chain.members, chain.late]
        prices = {c: price(c, at) for c in codes}
        whole = None not in prices.values()
        full = all(covered(c, at - k * day) for c in codes for k in range(1, chain.width + 1))
        level, reason = None, None
        if broken:
            reason = "continuity_broken"
        elif not whole or reset and not full:
            reason, broken = "incomplete_prices" if not whole else "incomplete_window", reset
        else:
            level = 100.0 if at == chain.inception else sum(n * prices[c] for c, n in held.items())
            if reset:
                turnover = {c: sum(facts[c, at - k * day][1] for k in range(1, chain.width + 1)) for c in codes}
                held = {c: level * turnover[c] / sum(turnover.values()) / prices[c] for c in codes}
        out.append((at, level, reason, len(codes)))
        at += day
    return out


@pytest.mark.parametrize("holes", [[], [("a", 20)], [("a", 20), ("b", 20)], [("a", 3)], [("late", 33)], [("a", 49), ("late", 12)]])
@pytest.mark.parametrize("late", [None, "late"])
def test_chained_index_equals_a_plain_loop(spark, holes, late):
    import random
    from datetime import date, timedelta

    rng, start = random.Random(len(holes)), date(2024, 1, 1)
    facts = {(c, start + timedelta(days=k)): (float(rng.randint(1, 9)), float(rng.randint(5, 90))) for c in ("a", "b", "late") for k in range(60) if (c != "late" or k >= 10) and (c, k) not in holes}
    facts["other", start] = (1.0, 1.0)
    chain = I.Chain(("a", "b"), date(2024, 1, 10), date(2024, 2, 25), late, width=7)
    daily = spark.createDataFrame([(c, at, *v) for (c, at), v in facts.items()], "item_code string, day date, quantity double, turnover double")
    got = {r.day: (r.level, r.reason, r.members) for r in I.chained(daily, chain).collect()}
    for at, level, reason, members in walk(facts, chain):
        assert got.pop(at) == (level if level is None else pytest.approx(level), reason, members), at
    assert not got
    status = I.chain_status(I.chained(daily, chain), I.chain_weights(daily, chain), chain).first()
    valid = [level for at, level, _, _ in walk(facts, chain)[-chain.display:] if level is not None]
    assert status.coverage_status == ("complete" if len(valid) == chain.display else "partial" if valid else "unavailable")


def test_definitions_and_guard(spark):
    heads, parts = I.definition_tables(spark, list(I.DEFINITIONS))
    assert (heads.count(), parts.count()) == (9, 11)
    base = spark.createDataFrame([("steel", 4.0, 2, 5.0, 1.0), ("concrete", 0.0, 0, None, 2.0), ("paper", 1.0, 1, 2.0, None)], "item_code string, quantity double, trades int, base_price double, production_points double")
    rows = I.candidates(heads, parts, base)
    why = {(r.index_key, r.item_code): r.excluded_because for r in rows.collect()}
    assert why["industrial_expansion", "concrete"] == "too_few_trades" and why["base_pp", "paper"] == "missing_production_points" and why["broad_market", "paper"] is None
    assert ("market_equipment", "steel") not in why
    weights = {(r.index_key, r.item_code): r.weight for r in I.weights_of(rows).collect()}
    assert weights["broad_market", "steel"] == pytest.approx(20 / 22) and weights["equipment_inputs", "steel"] == 1.0
    levels = spark.createDataFrame([("x", 100.0)], "index_key string, level double")
    none = spark.createDataFrame([], "item_code string")
    assert I.guarded(levels, none).first().level == 100.0 and I.guarded(levels, spark.createDataFrame([("new",)], "item_code string")).first().level is None


@pytest.mark.parametrize(("names", "want"), [(("1D", "90d", "1y"), {"1D": 1, "90D": 90, "1Y": 365}), ((3, 1.5), {"3D": 3, "1.5D": 1.5}), (("x",), None), (("-2D",), None)])
def test_horizons(names, want):
    if want is None:
        with pytest.raises(ValueError):
            S.horizons(*names)
    else:
        assert S.horizons(*names) == want


def test_equipment_is_no_commodity(spark):
    rows = [(1, "x", "trading", datetime(2024, 1, 2), 1.0, 2.0, 2.0), (2, "x", "itemMarket", datetime(2024, 1, 2), 1.0, 900.0, 900.0), (3, "quiet", "trading", datetime(2023, 1, 1), 1.0, 5.0, 5.0)]
    t = spark.createDataFrame(rows, "id long, item_code string, transaction_type string, created_at timestamp, quantity double, money double, unit_price double")
    stats = {(r.item_code, r.horizon): r for r in S.window_stats(t, C.resolve(None, (t, "created_at"))).collect()}
    assert stats["x", "7D"].max == 2.0 and S.daily_last(t).where("item_code = 'x'").first().price == 2.0
    # An item without a trade in any window still has its rows.
    assert (stats["quiet", "30D"].trade_count, stats["quiet", "30D"].vwap, stats["quiet", "30D"].last_trade_price, stats["quiet", "30D"].tendency) == (0, None, None, "Thin")


def test_range_position_needs_a_last_price(spark):
    assert one(spark, X.range_position_pct("l", "a", "b"), l=d(None), a=d(1.0), b=d(2.0)) is None
    assert one(spark, X.range_position_pct("l", "a", "b"), l=d(3.0), a=d(1.0), b=d(2.0)) == 100.0


def test_sql_functions(spark):
    names = X.register(spark)
    assert "market_positive_finite" in names
    assert spark.sql("SELECT market_positive_finite(-1), market_close_to(1, 1 + 1e-13), market_price_gap_pct(11, 10), market_inflation_class(NULL)").first()[:] == (None, True, pytest.approx(10.0), "Insufficient data")
