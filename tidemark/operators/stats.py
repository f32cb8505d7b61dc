"""Window statistics of a trade tape: daily facts, horizon measures, medians, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.context import ReportContext
from tidemark.functions import exprs as X

HORIZONS = {"1D": 1, "7D": 7, "30D": 30}
#: Days that the last trade and the latest quote may be old, if no horizon is longer.
DISPLAY_DAYS = 90
HUGE = 1e308


def commodities(trades: DataFrame) -> DataFrame:
    """Trades of commodities: equipment sells under the same codes and is never a commodity's price."""
    return trades.where(X.commodity()) if "transaction_type" in trades.columns else trades


def horizons(*names: str | float) -> dict[str, float]:
    """Windows by name: 1D, 7D, any other number of days, and 1Y; a bare number is one of days."""
    out: dict[str, float] = {}
    for name in names:
        text = f"{name:g}D" if isinstance(name, (int, float)) else name.strip().upper()
        if text != "1Y" and not text.endswith("D"):
            raise ValueError(f"No window: {name!r}")
        days = 365.0 if text == "1Y" else float(text[:-1])
        if not 0 <= days < float("inf"):
            raise ValueError(f"No window: {name!r}")
        out["1Y" if text == "1Y" else f"{days:g}D"] = days
    return out


def usable(price: str = "unit_price", quantity: str = "quantity") -> Column:
    return (F.col(price) > 0) & (F.col(price) < HUGE) & (F.col(quantity) > 0) & (F.col(quantity) < HUGE)


def daily_facts(trades: DataFrame) -> DataFrame:
    """Per item and UTC day: quantity, turnover, trades and last time of valid commodity trades."""
    rows = commodities(trades).where(usable())
    return rows.groupBy("item_code", F.to_date("created_at").alias("day")).agg(
        F.sum("quantity").alias("quantity"), F.sum(F.col("unit_price") * F.col("quantity")).alias("turnover"),
        F.count("*").alias("trades"), F.max("created_at").alias("last_at"),
    )


def by_horizon(rows: DataFrame, context: ReportContext, horizons: dict[str, float] = HORIZONS, ts: str = "created_at") -> DataFrame:
    """Each row once for every horizon that holds it; rows outside the longest are never read."""
    held = F.array(*(F.when(context.window(ts, days), name) for name, days in horizons.items()))
    inside = rows.where(context.window(ts, max(horizons.values())))
    return inside.withColumn("horizon", F.explode(F.filter(held, lambda x: x.isNotNull())))


def percentiles(rows: DataFrame, keys: list[str], price: str, ranks: list[float]) -> DataFrame:
    """Exact interpolated percentiles from counts by price, so equal prices are merged before the merge."""
    counts = rows.where(F.col(price).isNotNull()).groupBy(*keys, price).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.percentile(price, F.array(*map(F.lit, ranks)), F.col("n")).alias("p"))


def item_codes(trades: DataFrame, quotes: DataFrame | None = None, books: DataFrame | None = None) -> DataFrame:
    """Every item that has traded as a commodity or has a quote or a book."""
    parts = [p.select("item_code") for p in (commodities(trades), quotes, books) if p is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("item_code is not null").distinct()


def item_facts(trades: DataFrame, context: ReportContext, days: float, quotes: DataFrame | None = None, books: DataFrame | None = None) -> DataFrame:
    """What is the same for all horizons of an item: last trade, latest quote and latest book.

    The last trade and the quote are looked for in the longest window that is loaded; a
    quote older than that counts if there is no other.
    """
    recent = context.window("created_at", max(days, DISPLAY_DAYS))
    out = item_codes(trades, quotes, books)
    last = commodities(trades).where(recent & F.col("unit_price").isNotNull()).groupBy("item_code").agg(F.max_by("unit_price", F.struct("created_at", "id")).alias("last_trade_price"))
    out = out.join(last, "item_code", "left")
    if quotes is None:
        out = out.withColumn("quote_price", F.lit(None).cast("double"))
    else:
        order, new = F.struct("observed_at", "id"), F.col("current_price").isNotNull() & context.window("observed_at", max(days, DISPLAY_DAYS))
        found = quotes.groupBy("item_code").agg(F.coalesce(F.max_by("current_price", F.when(new, order)), F.max_by("current_price", order)).alias("quote_price"))
        out = out.join(found, "item_code", "left")
    names = ("best_bid", "best_ask", "bid_depth", "ask_depth", "spread_abs", "spread_pct")
    if books is None:
        out = out.withColumns({n: F.lit(None).cast("double") for n in names})
    else:
        newest = books.groupBy("item_code").agg(F.max_by(F.struct(*names), "observed_at").alias("b")).select("item_code", "b.*")
        out = out.join(newest, "item_code", "left")
    depth = F.greatest(F.coalesce("bid_depth", F.lit(0.0)), F.lit(0.0)) + F.greatest(F.coalesce("ask_depth", F.lit(0.0)), F.lit(0.0))
    return out.select(
        "item_code", "last_trade_price", F.col("last_trade_price").alias("latest_price"), F.col("last_trade_price").alias("current_price"), "quote_price", X.mid_price("best_bid", "best_ask").alias("mid_price"), X.quote_gap_pct("last_trade_price", "quote_price").alias("quote_gap_pct"),
        *(F.col(a).alias(b) for a, b in zip(names, ("latest_bid", "latest_ask", "latest_bid_depth", "latest_ask_depth", "latest_spread", "latest_spread_pct"), strict=True)),
        X.imbalance_pct(F.coalesce("bid_depth", F.lit(0.0)), F.coalesce("ask_depth", F.lit(0.0))).alias("depth_imbalance_pct"), X.liquidity(depth, "spread_pct").alias("liquidity"),
    )


def window_stats(trades: DataFrame, context: ReportContext, horizons: dict[str, float] = HORIZONS, quotes: DataFrame | None = None, books: DataFrame | None = None) -> DataFrame:
    """All measures of every item and horizon, also where nothing was traded.

    Sums and counts combine before the shuffle; percentiles go over counts by price; the
    last five prices are ranked with a limit that Spark pushes below the shuffle. ``books``
    are summaries of snapshots, ``quotes`` have (id, item_code, observed_at, current_price).
    """
    keys = ["item_code", "horizon"]
    rows = by_horizon(commodities(trades), context, horizons)
    priced = F.col("unit_price").isNotNull()
    order = F.struct("created_at", "id")
    first_last = lambda f: f(F.when(priced, F.col("unit_price")), F.when(priced, order))
    positive = F.when((F.col("quantity") > 0) & priced, F.col("quantity"))
    basic = rows.groupBy(*keys).agg(
        F.count("*").alias("trade_count"), F.count("unit_price").alias("priced_trade_count"),
        F.count_distinct(F.when(priced, F.date_trunc("second", "created_at"))).alias("distinct_trade_timestamp_count"),
        F.sum("quantity").alias("volume"), F.sum("money").alias("traded_value"),
        F.min("unit_price").alias("min"), F.max("unit_price").alias("max"), F.avg("unit_price").alias("average"),
        (F.sum(F.col("unit_price") * positive) / F.sum(positive)).alias("vwap"),
        first_last(F.min_by).alias("open"), first_last(F.max_by).alias("close"),
    )
    ranks = percentiles(rows, keys, "unit_price", [0.1, 0.25, 0.5, 0.9]).select(
        *keys, F.col("p")[0].alias("price_p10"), F.col("p")[1].alias("price_p25"), F.col("p")[2].alias("median"), F.col("p")[3].alias("price_p90")
    )
    last = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    rolling = rows.where(priced).withColumn("rn", F.row_number().over(last)).where("rn <= 5").groupBy(*keys).agg(F.avg("unit_price").alias("rolling_average"))
    # One row for each item and horizon: the other sides are joined to all there can be.
    out = item_facts(trades, context, max(horizons.values()), quotes, books).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    if books is None:
        spreads = out.select(*keys, F.lit(None).cast("double").alias("average_spread"), F.lit(None).cast("double").alias("average_spread_pct"))
    else:
        seen = by_horizon(books, context, horizons, "observed_at")
        spreads = seen.groupBy(*keys).agg(F.avg("spread_abs").alias("average_spread"), F.avg("spread_pct").alias("average_spread_pct"))
    for part in (basic, ranks, rolling, spreads):
        out = out.join(part, keys, "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("trade_count", "priced_trade_count", "distinct_trade_timestamp_count")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("volume", "traded_value")}
    out = out.withColumns(counts)
    enough = (F.col("priced_trade_count") >= 2) & (F.col("distinct_trade_timestamp_count") >= 2)
    out = out.withColumns({
        "traded_quantity": F.col("volume"),
        "stable_fair_price": X.stable_fair("vwap", "median", "rolling_average"),
        "stable_range_pct": F.when(F.col("median") > 0, (F.col("price_p90") - F.col("price_p10")) / F.col("median") * 100),
        "change_abs": F.col("close") - F.col("open"),
        "percent_change": F.when(enough, X.change_pct("close", "open")),
        "distance_from_rolling_average": F.col("close") - F.col("rolling_average"),
        "distance_from_rolling_average_pct": X.change_pct("close", "rolling_average"),
    })
    found = X.tendency_labels("open", "close", "min", "max", "average", "rolling_average", "trade_count", "volume", "stable_range_pct", "latest_spread_pct")
    return out.withColumn("tendency_labels", found).withColumn("tendency", F.col("tendency_labels")[0])


def weighted_median(rows: DataFrame, keys: list[str], price: str = "unit_price", quantity: str = "quantity") -> DataFrame:
    """Lower weighted median: the first price at which half of the quantity is reached."""
    merged = commodities(rows).where(usable(price, quantity)).groupBy(*keys, price).agg(F.sum(quantity).alias("q"))
    up, every = Window.partitionBy(*keys).orderBy(price), Window.partitionBy(*keys)
    running = merged.withColumn("cum", F.sum("q").over(up)).withColumn("total", F.sum("q").over(every))
    return running.where(F.col("cum") >= F.col("total") / 2).groupBy(*keys).agg(F.min(price).alias("representative_price"))


def period_prices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Representative price of each key with the evidence behind it."""
    ok, rows = F.coalesce(usable(), F.lit(False)), commodities(rows)
    evidence = rows.groupBy(*keys).agg(
        F.count_if(ok).alias("trades"), F.count_if(~ok).alias("excluded"), F.sum(F.when(ok, F.col("quantity"))).alias("quantity"),
        F.sum(F.when(ok, F.col("unit_price") * F.col("quantity"))).alias("value"), F.min(F.when(ok, F.col("created_at"))).alias("first_at"), F.max(F.when(ok, F.col("created_at"))).alias("last_at"),
    )
    return evidence.join(weighted_median(rows, keys), keys, "left")


def daily_last(trades: DataFrame) -> DataFrame:
    """The last price of each item and UTC day."""
    return commodities(trades).where(F.col("unit_price").isNotNull()).groupBy("item_code", F.to_date("created_at").alias("day")).agg(
        F.max_by("unit_price", F.struct("created_at", "id")).alias("price"), F.max("created_at").alias("at")
    )


def path_segments(points: DataFrame, gap_seconds: int = 86_400) -> DataFrame:
    """Number the runs of an item's points that no gap parts; runs of one point are dropped."""
    order = Window.partitionBy("item_code").orderBy("at")
    gap = F.unix_micros("at") - F.lag(F.unix_micros("at")).over(order) > gap_seconds * 1_000_000
    parts = points.withColumn("segment", F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(order))
    return parts.withColumn("points", F.count("*").over(Window.partitionBy("item_code", "segment"))).where("points >= 2")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last in a total order; combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(X.latest_by(rest, order).alias("x")).select(*keys, "x.*")


def activity(trades: DataFrame, context: ReportContext, points: DataFrame, days: float = 7, top: int | None = None) -> DataFrame:
    """Items by traded value in a window, with units, units times production points and each bar's share of the highest.

    Ties go by name and code; ``points`` have (item_code, points).
    """
    rows = commodities(trades).where(context.window("created_at", days)).groupBy("item_code").agg(F.coalesce(F.sum("money"), F.lit(0.0)).alias("value"), F.coalesce(F.sum("quantity"), F.lit(0.0)).alias("units"))
    rows = rows.join(points, "item_code", "left").withColumns({"point_volume": F.col("units") * F.col("points"), "item_name": X.display_name("item_code")})
    order = [F.desc("value"), F.lower("item_name"), F.asc("item_code")]
    # The highest value is a single row.
    out = rows.join(F.broadcast(rows.agg(F.max("value").alias("most")))).withColumn("bar_pct", F.when(F.col("most") > 0, F.col("value") / F.col("most") * 100)).drop("most")
    return out.orderBy(*order).limit(top) if top else out.orderBy(*order)


def inventory(rows: DataFrame, stream: str = "transaction_type", ts: str = "created_at") -> DataFrame:
    """Rows of each stream, how many have a price, and their first and last time."""
    return rows.groupBy(stream).agg(F.count("*").alias("n"), F.count("unit_price").alias("priced"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


def scan(rows: DataFrame, items: list[str] | DataFrame, start: Column, end: Column, ts: str = "created_at", transaction_type: str | None = None) -> DataFrame:
    """Rows of some items in [start, end): a list reaches the scan as a filter, a table is a semi join."""
    rows = rows.where(X.in_window(ts, start, end))
    if transaction_type is not None:
        rows = rows.where(F.col("transaction_type") == transaction_type)
    return rows.where(F.col("item_code").isin(items)) if isinstance(items, list) else rows.join(items.select("item_code").distinct(), "item_code", "left_semi")


def flatten_horizons(stats: DataFrame, measures: list[str], horizons: dict[str, int] = HORIZONS) -> DataFrame:
    """One row per item with a column measure_horizon for each measure and horizon."""
    cols = [F.max(F.when(F.col("horizon") == h, F.col(m))).alias(f"{m}_{h.lower()}") for m in measures for h in horizons]
    return stats.groupBy("item_code").agg(*cols)
