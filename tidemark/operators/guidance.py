"""Row rules over item measures: metrics, dislocation, guidance, flips and report order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X


@dataclass(frozen=True)
class Assumptions:
    """What a trade is assumed to cost and how old a quote may be."""

    quantity: float = 1.0
    fee_pct: float = 0.0
    margin_pct: float = 1.0
    max_quote_age_minutes: float = 30.0
    tick: float = 0.001


def some(c: Column | str) -> Column:
    """Null for zero too: a zero is no measure here."""
    return F.nullif(X.number(c), F.lit(0.0))


def market_metrics(rows: DataFrame, tick: float = 0.001) -> DataFrame:
    """Spread, range, momentum and attractiveness of each item, with what is missing in words."""
    bid, ask, last = X.number("bid"), X.number("ask"), X.number("last_trade_price")
    trades = F.coalesce(X.number("trades_7d"), X.number("trades_24h") * 7)
    high, low, open_ = some("high_7d"), some("low_7d"), some("open_7d")
    close = F.coalesce(some("close_7d"), last)
    raw = ask - bid
    near = F.abs(raw - tick) <= 1e-9 * F.greatest(F.abs(raw), F.lit(tick))
    mid = (bid + ask) / 2
    needed = {"bid": bid, "ask": ask, "trades_7d": trades, "high_7d": high, "low_7d": low}
    missing = X.labels(*((c.isNull(), name) for name, c in needed.items()))
    out = rows.withColumns({
        "missing": missing, "mid_price": mid, "spread": F.when((raw <= tick) | near, 0.0).otherwise(raw - tick), "average_price": (high + low) / 2,
        "crossing_loss_pct": F.when(ask > 0, F.greatest(raw, F.lit(0.0)) / ask * 100), "trades": trades,
    })
    complete = F.size("missing") == 0
    out = out.withColumns({
        "spread_pct": F.when(F.col("mid_price") > 0, F.col("spread") / F.col("mid_price") * 100),
        "range_pct": F.when(complete & (F.col("average_price") > 0), (high - low) / F.col("average_price") * 100),
        "momentum_7d_pct": F.when(complete & (open_ > 0), (close - open_) / open_ * 100),
    })
    scored = (F.col("spread_pct") > 0) & (F.col("range_pct") > 0) & (F.col("trades") > 0)
    fair = F.coalesce(*(X.positive_finite(c) for c in ("stable_fair_price_7d", "vwap_7d", "median_7d")), F.coalesce(some("average_7d"), F.when(complete, F.col("average_price"))))
    return out.withColumns({
        "attractiveness": F.when(complete & scored, F.col("spread_pct") * F.col("trades") / F.col("range_pct")),
        "status": F.when(~complete, F.concat(F.lit("Missing: "), F.array_join("missing", ", "))).when(F.coalesce(scored, F.lit(False)), "OK").otherwise("Insufficient score data"),
        "fair_reference_7d": fair, "fair_gap_7d_pct": F.when(fair > 0, (last - fair) / fair * 100),
    })


def dislocations(rows: DataFrame, tick: float = 0.001) -> DataFrame:
    """Where the last trade stands against the normal range of seven days."""
    last, fair, low, high = (X.number(c) for c in ("last_trade_price", "stable_fair_price_7d", "price_p10_7d", "price_p90_7d"))
    t = F.lit(tick)
    ok = F.coalesce((last > 0) & (fair > 0) & (t > 0) & (low <= high), F.lit(False))
    scale = F.greatest(high - low, t)
    premium = X.strictly_greater(last, high) & X.at_least(last - fair, t)
    discount = X.strictly_less(last, low) & X.at_least(fair - last, t)
    rail = lambda v: F.when(ok, X.rail_position(v, low, high, scale))
    return rows.withColumns({
        "classification": F.when(~ok, "insufficient_evidence").when(premium, "meaningful_premium").when(discount, "meaningful_discount").otherwise("within_normal_range"),
        "severity": F.when(ok, F.when(premium, (last - high) / scale).when(discount, (low - last) / scale).otherwise(0.0)),
        "raw_gap_pct": X.price_gap_pct(last, fair), "band_width": F.when(ok, scale), "band_width_pct": F.when(ok, (high - low) / fair * 100),
        "band_start": rail(low), "band_end": rail(high), "fair_position": rail(fair), "last_position": rail(last),
    })


def highlights(rows: DataFrame, charted: DataFrame | None = None) -> DataFrame:
    """One discount and one premium, or the two worst of the only kind there is.

    Severity counts to twelve digits, then the code decides; ``charted`` limits the choice
    to items whose history can be drawn.
    """
    found = rows.where(F.col("classification").isin("meaningful_discount", "meaningful_premium"))
    if charted is not None:
        found = found.join(charted.select("item_code"), "item_code", "left_semi")
    digits = F.format_string("%.11e", "severity").cast("double")
    order = Window.partitionBy("classification").orderBy(F.desc(digits), "item_code")
    kinds = found.agg(F.count_distinct("classification").alias("kinds"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where("rank <= 2").join(F.broadcast(kinds))
    return ranked.where((F.col("rank") == 1) | (F.col("kinds") == 1)).drop("kinds")


def fair_value_guidance(rows: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    """Highest entry and rich exit from fair value, and what executable prices make of them."""
    fair = X.positive_finite("vwap_7d")
    fee, margin = a.fee_pct / 100, a.margin_pct / 100
    ask, bid = F.when(F.col("entry_full"), X.number("entry_vwap")), F.when(F.col("exit_full"), X.number("exit_vwap"))
    state = F.lower(F.coalesce("tendency_7d", F.lit("")))
    falling, volatile = state.contains("falling"), state.contains("volatile")
    entry = fair * (1 - fee) / ((1 + fee) * (1 + margin))
    capped = lambda cap: F.when(X.positive_finite(cap).isNotNull(), F.least(entry, X.positive_finite(cap)))
    most = F.when(falling & volatile, capped("price_p10_7d")).when(falling | volatile, capped("price_p25_7d")).otherwise(entry)
    by_margin, top = fair * (1 + margin), X.positive_finite("price_p90_7d")
    rich = F.when(top.isNotNull(), F.greatest(fair, F.least(top, by_margin))).otherwise(by_margin)
    out = rows.withColumns({"max_entry_price": F.when(fair.isNotNull(), most), "rich_exit_price": F.when(fair.isNotNull(), rich), "executable_ask": ask, "executable_bid": bid})
    cost = F.col("executable_ask") * (1 + fee)
    return out.withColumns({
        "entry_action": F.when(F.col("executable_ask") <= F.col("max_entry_price"), "BUY").otherwise("WAIT"),
        "holder_action": F.when((F.col("rich_exit_price") > 0) & (F.col("executable_bid") >= F.col("rich_exit_price")), "SELL").otherwise("HOLD"),
        "ask_gap_pct": (F.col("executable_ask") - fair) / fair * 100, "bid_gap_pct": (F.col("executable_bid") - fair) / fair * 100,
        "net_to_fair_pct": F.when(F.col("executable_ask") > 0, (fair * (1 - fee) - cost) / cost * 100),
    }).withColumn("guide_signal", F.when(F.col("entry_action") == "BUY", "BUY").when(F.col("holder_action") == "SELL", "SELL").otherwise("HOLD"))


def short_term(rows: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    """Whether quotes are fresh and fills whole, and the rank that follows: 0, 1 or 2."""
    age = X.number("quote_age_minutes")
    fresh = F.coalesce((age >= 0) & (age <= a.max_quote_age_minutes), F.lit(False))
    entry, leave = fresh & F.col("executable_ask").isNotNull(), fresh & F.col("executable_bid").isNotNull()
    return rows.withColumns({
        "quote_fresh": fresh, "entry_executable": entry, "exit_executable": leave, "short_term_rank": F.when(entry, 0).when(leave, 1).otherwise(2),
        "short_term_entry_action": F.lit("Wait to buy"), "short_term_setup_status": F.lit("Short-term setup unconfirmed"),
        "short_term_holder_action": F.when(leave & (F.col("holder_action") == "SELL"), "Sell now").otherwise("Hold / reassess"),
        "reference_return_pct": F.when(entry, F.col("net_to_fair_pct")),
    })


def flips(rows: DataFrame, a: Assumptions = Assumptions()) -> DataFrame:
    """Verdict on buying now and selling later; the first reason against it is the one given.

    Costs and margins are given only when nothing about the book or forecast is missing.
    """
    fee = a.fee_pct / 100
    bid, ask, age = X.number("best_bid"), X.number("best_ask"), X.number("quote_age_minutes")
    interval = [X.number(f"flip_return_{p}_pct") for p in ("p10", "median", "p90")]
    signal, evidence = F.coalesce("current_signal", F.lit("Unavailable")), F.coalesce("evidence", F.lit("Insufficient"))
    gross = X.number("entry_gross")
    total = gross * (1 + fee)
    exits = [gross * (1 + r / 100) / a.quantity for r in interval]
    profits = [e * a.quantity * (1 - fee) - total for e in exits]
    margins = [p / total * 100 for p in profits]
    even = total / (a.quantity * (1 - fee))
    unavailable = (
        F.when(bid.isNull() | ask.isNull() | F.col("entry_full").isNull(), "missing_order_book").when(age.isNull(), "missing_timestamp")
        .when(signal == "Unavailable", "missing_forecast").when(sum((r.isNull().cast("int") for r in interval), F.lit(0)) > 0, "missing_execution_interval")
    )
    refused = F.when(age > a.max_quote_age_minutes, "stale_quote").when(~F.col("entry_full"), "insufficient_ask_depth").when((bid <= 0) | (ask <= 0) | (bid >= ask) | (gross <= 0), "invalid_book")
    wrong = sum((F.coalesce((e <= 0).cast("int"), F.lit(0)) for e in [*exits, even]), F.lit(0)) > 0
    refused = refused.when(wrong, "invalid_book")
    out = rows.withColumns({"unavailable": unavailable, "refused": F.when(unavailable.isNull(), refused)})
    priced = F.col("unavailable").isNull() & F.col("refused").isNull()
    median = margins[1]
    reason = (
        F.when(F.col("unavailable").isNotNull(), F.col("unavailable")).when(F.col("refused").isNotNull(), F.col("refused")).when(median <= 0, "margin_non_positive")
        .when(evidence == "Insufficient", "forecast_insufficient").when(evidence.isin("Weak", "Limited"), "forecast_not_above_baseline")
        .when(median < a.margin_pct, "margin_below_threshold").when(evidence == "Supported", "supported_positive_margin").otherwise("forecast_not_above_baseline")
    )
    verdict = F.when(F.col("unavailable").isNotNull(), "Unavailable").when(F.col("refused").isNotNull() | (reason == "margin_non_positive"), "No trade").when(reason == "supported_positive_margin", "Potential flip").otherwise("Watch")
    shown = lambda c: F.when(priced, c)
    return out.withColumns({
        "verdict": verdict, "reason": reason, "total_entry_cost": shown(total), "break_even_exit": shown(even),
        **{f"exit_{p}": shown(e) for p, e in zip(("p10", "median", "p90"), exits, strict=True)},
        **{f"margin_{p}_pct": shown(m) for p, m in zip(("p10", "median", "p90"), margins, strict=True)},
        "profit_median": shown(profits[1]), "passive_limit": X.passive_limit("best_bid", "best_ask", a.tick),
    }).drop("unavailable", "refused")


def report_order(rows: DataFrame) -> DataFrame:
    """Rows numbered by readiness, then name and code in lower case."""
    order = Window.orderBy(F.coalesce("short_term_rank", F.lit(2)), F.lower(F.coalesce("item_name", F.lit("Unknown"))), F.lower(F.coalesce("item_code", F.lit(""))))
    return rows.withColumn("position", F.row_number().over(order))


def by_attractiveness(rows: DataFrame) -> DataFrame:
    """One row an item, numbered by attractiveness; those without one come last."""
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("attractiveness"), "item_code")))


def by_evidence(rows: DataFrame) -> DataFrame:
    """One row an item, numbered by what its forecast has shown."""
    rank = X.evidence_rank("evidence", "accuracy_pct", "baseline_pct", "evaluable_samples")
    return rows.withColumn("position", F.row_number().over(Window.orderBy(F.desc(rank), "item_code")))


def item_signals(stats: DataFrame, books: DataFrame, fills: DataFrame, forecast: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """The wide row of every item: seven-day measures, last trade and quote, book, fills and forecast.

    Every item of ``stats`` has a row, whether it traded lately or not. Every input has one
    row an item, so the joins stay as small as the number of items.
    """
    week = stats.where("horizon = '7D'").select(
        "item_code", "last_trade_price", "quote_price", "quote_gap_pct", "latest_spread", "latest_spread_pct", "depth_imbalance_pct", "liquidity", F.col("trade_count").alias("trades_7d"), F.col("min").alias("low_7d"), F.col("max").alias("high_7d"),
        F.col("open").alias("open_7d"), F.col("close").alias("close_7d"), F.col("vwap").alias("vwap_7d"), F.col("median").alias("median_7d"), F.col("average").alias("average_7d"), F.col("percent_change").alias("change_7d_pct"),
        F.col("price_p10").alias("price_p10_7d"), F.col("price_p25").alias("price_p25_7d"), F.col("price_p90").alias("price_p90_7d"), F.col("stable_fair_price").alias("stable_fair_price_7d"), F.array_join("tendency_labels", ",").alias("tendency_7d"),
    )
    day = stats.where("horizon = '1D'").select("item_code", F.col("trade_count").alias("trades_24h"), F.col("percent_change").alias("change_1d_pct"))
    out = week.join(day, "item_code", "left")
    for part in (books, fills, forecast, points):
        out = out if part is None else out.join(part, "item_code", "left")
    return out.withColumns({"item_name": X.display_name("item_code"), "bid": F.col("best_bid"), "ask": F.col("best_ask")})
