"""Order books: merged levels, summaries, depth and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

KEYS = ["item_code", "observed_at"]


def merged_levels(levels: DataFrame) -> DataFrame:
    """Quantities of equal prices added; prices of 0 dropped, negative or missing values rejected."""
    return levels.where((F.col("price") > 0) & (F.col("quantity") >= 0)).groupBy(*KEYS, "side", "price").agg(F.sum("quantity").alias("quantity")).where("quantity > 0")


def summaries(levels: DataFrame) -> DataFrame:
    """Best prices, depths, spread on the midpoint, imbalance and liquidity of each snapshot."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    value = F.col("price") * F.col("quantity")
    out = levels.groupBy(*KEYS).agg(
        F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"),
        F.coalesce(F.sum(F.when(bid, F.col("quantity"))), F.lit(0.0)).alias("bid_depth"), F.coalesce(F.sum(F.when(ask, F.col("quantity"))), F.lit(0.0)).alias("ask_depth"),
        F.coalesce(F.sum(F.when(bid, value)), F.lit(0.0)).alias("bid_value"), F.coalesce(F.sum(F.when(ask, value)), F.lit(0.0)).alias("ask_value"),
    )
    middle = X.mid_price("best_bid", "best_ask")
    return out.withColumns({
        "mid_price": middle, "spread_abs": F.col("best_ask") - F.col("best_bid"),
        "spread_pct": F.when(middle > 0, (F.col("best_ask") - F.col("best_bid")) / middle * 100),
        "imbalance_pct": X.imbalance_pct("bid_depth", "ask_depth"), "pressure_pct": X.imbalance_pct("bid_value", "ask_value"),
    }).withColumn("liquidity", X.liquidity(F.col("bid_depth") + F.col("ask_depth"), "spread_pct"))


def depth(levels: DataFrame) -> DataFrame:
    """Running quantity and value outward from the best price; the wall is the first largest level."""
    outward = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    keys = [*KEYS, "side"]
    order = Window.partitionBy(*keys).orderBy(outward)
    wall = Window.partitionBy(*keys).orderBy(F.desc("quantity"), "position")
    return levels.withColumn("position", F.row_number().over(order)).withColumns({
        "cum_quantity": F.sum("quantity").over(order), "cum_value": F.sum(F.col("price") * F.col("quantity")).over(order), "is_wall": F.row_number().over(wall) == 1,
    })


def sweep(levels: DataFrame, quantity: float) -> DataFrame:
    """What buying from the asks or selling to the bids of every snapshot would fill, and at what price."""
    d = depth(levels).withColumn("fill", F.greatest(F.lit(0.0), F.least(F.col("quantity"), F.lit(quantity) - (F.col("cum_quantity") - F.col("quantity")))))
    out = d.groupBy(*KEYS, "side").agg(
        F.sum("fill").alias("filled"), F.sum(F.col("fill") * F.col("price")).alias("gross"), F.min_by("price", "position").alias("best"),
        F.max_by("price", F.when(F.col("fill") > 0, F.col("position"))).alias("worst"),
    )
    vwap = F.when(F.col("filled") > 0, F.col("gross") / F.col("filled"))
    slip = F.when(F.col("side") == "ask", vwap - F.col("best")).otherwise(F.col("best") - vwap)
    return out.withColumns({
        "unfilled": F.lit(quantity) - F.col("filled"), "fully_filled": F.col("filled") >= quantity * (1 - X.TOLERANCE), "vwap": vwap,
        "slippage_abs": slip, "slippage_pct": F.when(F.col("best") > 0, slip / F.col("best") * 100),
    })


def nested(levels: DataFrame) -> DataFrame:
    """One row per snapshot with its bids and asks as arrays, best price first."""
    side = lambda s, desc: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("price", "quantity"))), asc=not desc)
    return levels.groupBy(*KEYS).agg(side("bid", True).alias("bids"), side("ask", False).alias("asks"))


def with_levels(snapshots: DataFrame, levels: DataFrame) -> DataFrame:
    """Every snapshot with its bids and asks by position, and whether it has any level at all.

    ``levels`` has (item_code, observed_at, side, position, price, quantity); levels without a
    positive price and quantity do not count. A snapshot that reported totals alone keeps its
    row, with empty sides. Levels are nested before the join, so each side of it has one row
    a snapshot.
    """
    good = levels.where("price > 0 and quantity > 0")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("position", "price", "quantity"))))
    sides = good.groupBy(*KEYS).agg(side("bid").alias("bids"), side("ask").alias("asks"), F.lit(True).alias("levels_available"))
    kind = "array<struct<position: {0}, price: {1}, quantity: {2}>>".format(*(levels.schema[c].dataType.simpleString() for c in ("position", "price", "quantity")))
    empty = F.array().cast(kind)
    return snapshots.join(sides, KEYS, "left").withColumns({"bids": F.coalesce("bids", empty), "asks": F.coalesce("asks", empty), "levels_available": F.coalesce("levels_available", F.lit(False))})


def latest_nested(levels: DataFrame) -> DataFrame:
    """The newest snapshot of each item with its levels; only that snapshot's levels are nested."""
    newest = levels.groupBy("item_code").agg(F.max("observed_at").alias("observed_at"))
    return nested(levels.join(newest, KEYS, "left_semi"))
