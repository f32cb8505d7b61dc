"""Price indexes: weights, fixed-weight levels and changes, basket costs, chained levels."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.stats import weighted_median

MIN_COVERAGE = 80.0
LEAST_TRADES, LEAST_QUANTITY = 1, 1e-12


def trailing_prices(trades: DataFrame, days: DataFrame, width: int = 7) -> DataFrame:
    """Weighted-median price of each item over the ``width`` days before every day of ``days``.

    A trade goes to the at most ``width`` days that it serves, so no range join is needed.
    """
    spread = trades.withColumn("as_of", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", width))))
    return weighted_median(spread.join(F.broadcast(days), "as_of", "left_semi"), ["item_code", "as_of"])


def normalized_weights(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Positive finite values over their total within each index."""
    good = rows.withColumn("raw", X.positive_finite(value)).where("raw is not null")
    return good.withColumn("weight", F.col("raw") / F.sum("raw").over(Window.partitionBy(*keys))).drop("raw")


def levels(weights: DataFrame, base: DataFrame, prices: DataFrame, least: float = MIN_COVERAGE) -> DataFrame:
    """Fixed-weight level of each index and day, null below the coverage of weights.

    weights (index_key, item_code, weight), base (item_code, base_price) and prices
    (item_code, as_of, price): all indexes go through one join.
    """
    rows = weights.join(base, "item_code").join(prices, "item_code")
    out = rows.groupBy("index_key", "as_of").agg((F.sum("weight") * 100).alias("coverage_pct"), F.sum(F.col("weight") * F.col("price") / F.col("base_price")).alias("x"), F.sum("weight").alias("w"), F.count("*").alias("components"))
    return out.select("index_key", "as_of", "coverage_pct", "components", F.when(F.col("coverage_pct") + X.TOLERANCE >= least, 100 * F.col("x") / F.col("w")).alias("level"))


def matched_changes(weights: DataFrame, base: DataFrame, prices: DataFrame, days: int, least: float = MIN_COVERAGE) -> DataFrame:
    """Change over so many days on components priced at both ends, with class and yearly rate."""
    earlier = prices.select("item_code", F.date_add("as_of", days).alias("as_of"), F.col("price").alias("price_before"))
    both = weights.join(base, "item_code").join(prices.join(earlier, ["item_code", "as_of"]), "item_code")
    now, before = (F.sum(F.col("weight") * F.col(p) / F.col("base_price")) for p in ("price", "price_before"))
    out = both.groupBy("index_key", "as_of").agg((F.sum("weight") * 100).alias("matched_pct"), now.alias("now"), before.alias("before"))
    out = out.withColumn("change_pct", F.when((F.col("matched_pct") + X.TOLERANCE >= least) & (F.col("before") > 0), (F.col("now") / F.col("before") - 1) * 100))
    return out.select("index_key", "as_of", "matched_pct", "change_pct", X.inflation_class("change_pct").alias("class"), X.purchasing_power_pct("change_pct").alias("purchasing_power_pct"), X.annualized_pct("change_pct", days).alias("annualized_pct"))


def matched_members(weights: DataFrame, base: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """Which members of each index are priced at both ends of every change, and which are missing.

    Each index has a row for every day whose earlier end lies in the span of the prices, also
    where no member is matched. Members without a base price are missing as well. Lists are
    sorted and no longer than the index has members.
    """
    span = prices.agg(F.date_add(F.min("as_of"), days).alias("first"), F.max("as_of").alias("last")).first()
    members = weights.groupBy("index_key").agg(F.sort_array(F.collect_set("item_code")).alias("members"))
    if span.first is None or span.first > span.last:
        return members.where("false").select("index_key", F.lit(None).cast("date").alias("as_of"), F.lit(0.0).alias("matched_pct"), F.col("members").alias("matched"), F.col("members").alias("missing"))
    ends = members.withColumn("as_of", F.explode(F.sequence(F.lit(span.first), F.lit(span.last))))
    earlier = prices.select("item_code", F.date_add("as_of", days).alias("as_of"), F.col("price").alias("price_before"))
    both = prices.join(earlier, ["item_code", "as_of"]).where("price > 0 and price_before > 0").join(base.where("base_price > 0").select("item_code"), "item_code")
    found = weights.join(both, "item_code").groupBy("index_key", "as_of").agg(F.sort_array(F.collect_set("item_code")).alias("matched"), (F.sum("weight") * 100).alias("matched_pct"))
    none = F.array().cast("array<string>")
    out = ends.join(found, ["index_key", "as_of"], "left").withColumns({"matched": F.coalesce("matched", none), "matched_pct": F.coalesce("matched_pct", F.lit(0.0))})
    return out.select("index_key", "as_of", "matched_pct", "matched", F.array_except("members", "matched").alias("missing"))


def contributions(weights: DataFrame, base: DataFrame, prices: DataFrame, days: int) -> DataFrame:
    """Each matched component's part of its index's change."""
    earlier = prices.select("item_code", F.date_add("as_of", days).alias("as_of"), F.col("price").alias("price_before"))
    both = weights.join(base, "item_code").join(prices.join(earlier, ["item_code", "as_of"]), "item_code")
    total = F.sum(F.col("weight") * F.col("price_before") / F.col("base_price")).over(Window.partitionBy("index_key", "as_of"))
    return both.withColumn("contribution_pct", F.col("weight") * (F.col("price") - F.col("price_before")) / F.col("base_price") / total * 100)


def basket_costs(basket: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each action, only if every component has a price; coverage counts components."""
    rows = basket.join(prices, "item_code", "left")
    return rows.groupBy("action").agg(
        F.count("*").alias("components"), F.count("price").alias("priced"), (F.count("price") / F.count("*") * 100).alias("coverage_pct"),
        F.when(F.count("price") == F.count("*"), F.sum(F.col("amount") * F.col("price"))).alias("cost"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("price").isNull(), F.col("item_code")))), ",").alias("missing"),
    )


def conflicting_prices(prices: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Items for which different representative prices were given."""
    return prices.groupBy("item_code").agg((F.max("price") - F.min("price")).alias("difference")).where(F.col("difference") > tolerance)


@dataclass(frozen=True)
class Chain:
    """What a chained index is made of: members from the start, one that may join late, and its dates.

    The inception is given and never moves with the data; both dates are UTC midnights.
    """

    members: tuple[str, ...]
    inception: date
    as_of: date
    late: str | None = None
    width: int = 28
    display: int = 30


def _covered(daily: DataFrame, chain: Chain) -> DataFrame:
    """Days of members with trades; an item's first one counts as no coverage, as it may be cut."""
    codes = [*chain.members, *([chain.late] if chain.late else [])]
    rows = daily.where(F.col("item_code").isin(codes) & (F.col("day") < F.lit(chain.as_of)) & (F.col("quantity") > 0) & (F.col("turnover") > 0))
    return rows.withColumn("first", F.min("day").over(Window.partitionBy("item_code"))).where("day > first").drop("first")


def _calendar(daily: DataFrame, chain: Chain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every day from inception on with what is known of it, the active weights of its resets, and prices.

    A calendar has a row a day, whatever the number of trades, so it may be broadcast.
    """
    covered = _covered(daily, chain)
    prices = covered.select("item_code", F.date_add("day", 1).alias("day"), (F.col("turnover") / F.col("quantity")).alias("price"))
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(F.lit(chain.inception), F.lit(chain.as_of))).alias("day"))
    days = days.withColumn("is_reset", (F.col("day") == F.lit(chain.inception)) | (F.dayofweek("day") == 2))
    resets = days.where("is_reset").select("day")
    spread = covered.withColumn("day", F.explode(F.sequence(F.date_add("day", 1), F.date_add("day", chain.width)))).join(F.broadcast(resets), "day", "left_semi")
    full = spread.groupBy("day", "item_code").agg(F.count("*").alias("days"), F.sum("turnover").alias("turnover")).where(F.col("days") == chain.width)
    # The late member joins at the first reset with a full window, and stays.
    joined = full.where(F.col("item_code") == F.lit(chain.late)).agg(F.min("day").alias("admitted"))
    days = days.join(F.broadcast(joined)).withColumn("members", F.lit(len(chain.members)) + F.coalesce((F.col("day") >= F.col("admitted")).cast("int"), F.lit(0)))
    active = F.col("item_code").isin(list(chain.members)) | F.coalesce(F.col("day") >= F.col("admitted"), F.lit(False))
    known = F.broadcast(days.select("day", "members", "admitted"))
    priced = prices.join(known, "day").where(active).groupBy("day").agg(F.count("*").alias("priced"))
    windowed = full.join(known, "day").where(active).withColumns({"total": F.sum("turnover").over(Window.partitionBy("day")), "windows": F.count("*").over(Window.partitionBy("day"))})
    weights = windowed.where((F.col("windows") == F.col("members")) & (F.col("total") > 0)).select("day", "item_code", (F.col("turnover") / F.col("total")).alias("weight"))
    days = days.join(F.broadcast(priced), "day", "left").join(F.broadcast(weights.select("day", F.lit(True).alias("weighted")).distinct()), "day", "left")
    days = days.withColumns({"priced": F.coalesce("priced", F.lit(0)), "weighted": F.coalesce("weighted", F.lit(False))}).withColumn("complete", F.col("priced") == F.col("members"))
    order = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    fails = F.col("is_reset") & ~(F.col("complete") & F.col("weighted"))
    days = days.withColumns({"reset": F.last(F.when(F.col("is_reset"), F.col("day")), ignorenulls=True).over(order), "fails": fails, "broken": F.coalesce(F.max(fails).over(order), F.lit(False))})
    return days, weights, prices


def chained(daily: DataFrame, chain: Chain) -> DataFrame:
    """Every day's level of an index whose holdings are reset at inception and every Monday.

    ``daily`` has (item_code, day, quantity, turnover). A day's price is the average of the
    day before. At a reset a member's weight is its share of the turnover of the ``width``
    days before, all of which must be covered. A level is 100 times the product of the
    factors of all whole segments and of the current one, so nothing is computed day after
    day. A day without all prices is a gap; a reset without all prices or windows ends the
    index for good, be it the first. Every day has a row, with the reason if it has no level.
    """
    days, weights, prices = _calendar(daily, chain)
    held = weights.join(prices.withColumnRenamed("price", "reset_price"), ["day", "item_code"]).withColumnRenamed("day", "reset")
    moved = days.select("day", "reset").join(held, "reset").join(prices, ["day", "item_code"]).groupBy("day").agg(F.sum(F.col("weight") * F.col("price") / F.col("reset_price")).alias("factor"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    out = days.join(F.broadcast(moved), "day", "left").withColumn("factor", F.when(F.col("complete"), F.col("factor")))
    whole = F.coalesce(F.sum(F.when(F.col("is_reset"), F.log("factor"))).over(before), F.lit(0.0))
    level = F.when(F.col("fails") | F.col("broken"), F.lit(None)).when(F.col("day") == F.lit(chain.inception), F.lit(100.0)).otherwise(100 * F.exp(whole) * F.col("factor"))
    reason = F.when(F.col("broken"), "continuity_broken").when(~F.col("complete"), "incomplete_prices").when(F.col("fails"), "incomplete_window")
    out = out.select("day", "is_reset", level.alias("level"), F.col("priced").cast("long").alias("priced"), F.col("members").cast("long").alias("members"), (F.col("priced") / F.col("members") * 100).alias("coverage_pct"), reason.alias("reason"), "admitted")
    earlier = lambda n: F.broadcast(out.select(F.date_add("day", n).alias("day"), F.col("level").alias(f"level_{n}")))
    both = out.join(earlier(1), "day", "left").join(earlier(7), "day", "left")
    return both.select(*out.columns, X.change_pct("level", "level_1").alias("change_1d_pct"), X.change_pct("level", "level_7").alias("change_7d_pct"))


def chain_weights(daily: DataFrame, chain: Chain) -> DataFrame:
    """Weights of every reset that took effect, their rank and the share of the top three."""
    days, weights, _ = _calendar(daily, chain)
    day, order = Window.partitionBy("day"), Window.partitionBy("day").orderBy(F.desc("weight"), "item_code")
    out = weights.join(F.broadcast(days.where("is_reset and not fails and not broken").select("day")), "day", "left_semi").withColumn("rank", F.row_number().over(order))
    return out.withColumn("top3", F.sum(F.when(F.col("rank") <= 3, F.col("weight"))).over(day)).select("day", F.date_sub("day", chain.width).alias("window_start"), "item_code", "weight", "rank", "top3")


def chain_status(levels: DataFrame, weights: DataFrame, chain: Chain) -> DataFrame:
    """One row: how many of the days on display have a level, the latest one, and how concentrated the index is."""
    shown = F.col("day") > F.date_sub(F.lit(chain.as_of), chain.display)
    seen = F.when(shown & F.col("level").isNotNull(), F.col("day"))
    out = levels.agg(
        F.count(seen).alias("valid_days"), F.min(seen).alias("first_valid"), F.max(seen).alias("last_valid"), F.max_by("level", "day").alias("latest_level"), F.max_by("reason", "day").alias("reason"), F.max("admitted").alias("admitted"),
        F.max_by("change_1d_pct", "day").alias("change_1d_pct"), F.max_by("change_7d_pct", "day").alias("change_7d_pct"),
    )
    newest = weights.agg(F.max_by(F.struct("weight", "top3"), F.struct("day", "weight")).alias("w")).select((F.col("w.weight") * 100).alias("top_weight_pct"), (F.col("w.top3") * 100).alias("top_three_weight_pct"))
    status = F.when(F.col("valid_days") == chain.display, "complete").when(F.col("valid_days") > 0, "partial").otherwise("unavailable")
    return out.join(F.broadcast(newest)).withColumn("coverage_status", status)


@dataclass(frozen=True)
class IndexDefinition:
    """A fixed-weight index: how it is weighted, what may be in it, and whether it is published."""

    key: str
    name: str
    #: "value": base quantity times base price; "effort": base quantity times production points.
    method: str = "value"
    #: Members; none stands for every traded item.
    members: tuple[str, ...] | None = None
    enabled: bool = True


#: The indexes that are published, with their members.
DEFINITIONS = (
    IndexDefinition("broad_market", "Broad Market Price Index"),
    IndexDefinition("industrial_expansion", "Industrial Expansion Index", members=("steel", "concrete")),
    IndexDefinition("standard_combat", "Standard Combat Index", members=("steak", "lightAmmo")),
    IndexDefinition("premium_combat", "Premium Combat Index", members=("cookedFish", "ammo", "heavyAmmo")),
    IndexDefinition("governance", "Governance and Battle Administration Index", members=("paper",)),
    IndexDefinition("infrastructure_operation", "Infrastructure Operation Index", members=("oil",)),
    IndexDefinition("equipment_inputs", "Crafted Equipment Input Index", members=("steel", "scraps")),
    IndexDefinition("base_pp", "Total Upstream PP Inflation Index", method="effort"),
    IndexDefinition("market_equipment", "Market Equipment Index", enabled=False),
)


def definition_tables(spark: SparkSession, definitions: list[IndexDefinition]) -> tuple[DataFrame, DataFrame]:
    """Definitions as parameter tables: (index_key, name, method, whole, enabled) and (index_key, item_code)."""
    heads = [(d.key, d.name, d.method, d.members is None, d.enabled) for d in definitions]
    parts = [(d.key, m) for d in definitions for m in d.members or ()]
    return spark.createDataFrame(heads, "index_key string, name string, method string, whole boolean, enabled boolean"), spark.createDataFrame(parts, "index_key string, item_code string")


def candidates(heads: DataFrame, parts: DataFrame, base: DataFrame, least_trades: int = LEAST_TRADES, least_quantity: float = LEAST_QUANTITY) -> DataFrame:
    """Each enabled index with its members' base evidence and why a member is left out.

    ``base`` has (item_code, quantity, trades, base_price, production_points); definitions are
    parameters, so both tables are small. Only an index of effort needs production points.
    """
    on = heads.where("enabled")
    rows = base.join(F.broadcast(on.where("whole").select("index_key", "method"))).unionByName(base.join(F.broadcast(on.where("not whole").select("index_key", "method").join(parts, "index_key")), "item_code"))
    effort = F.col("method") == "effort"
    reason = F.when(F.col("trades") < least_trades, "too_few_trades").when(~(F.col("quantity") >= least_quantity), "too_little_quantity").when(effort & F.col("production_points").isNull(), "missing_production_points").when(~effort & F.col("base_price").isNull(), "missing_price")
    value = F.col("quantity") * F.when(effort, F.col("production_points")).otherwise(F.col("base_price"))
    return rows.withColumns({"excluded_because": reason, "value": value})


def weights_of(rows: DataFrame) -> DataFrame:
    """Weights of the members that are not left out of ``candidates``."""
    return normalized_weights(rows.where("excluded_because is null"), ["index_key"], F.col("value")).select("index_key", "item_code", "weight")


def guarded(levels: DataFrame, unexpected: DataFrame) -> DataFrame:
    """Levels, all of them blank as soon as one item trades that is no known constituent."""
    count = unexpected.agg(F.count("*").alias("unexpected"))
    return levels.join(F.broadcast(count)).withColumn("level", F.when(F.col("unexpected") == 0, F.col("level")))


def unexpected_members(traded: DataFrame, members: DataFrame) -> DataFrame:
    """Codes that trade but are no constituents."""
    return traded.select("item_code").distinct().join(members.select("item_code"), "item_code", "left_anti")
