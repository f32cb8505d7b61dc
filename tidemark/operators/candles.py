"""Candles, moving averages and aligned series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.stats import commodities, usable

GATE_CANDLES, GATE_DAYS, SMA_LEAST = 12, 3, 6


def candles(trades: DataFrame, interval: str = "4 hours") -> DataFrame:
    """OHLCV of populated, epoch-aligned buckets; open and close by (time, id)."""
    order = F.struct("created_at", "id")
    return commodities(trades).where(usable()).groupBy("item_code", F.window("created_at", interval).alias("w")).agg(
        F.min_by("unit_price", order).alias("open"), F.max("unit_price").alias("high"), F.min("unit_price").alias("low"),
        F.max_by("unit_price", order).alias("close"), F.sum("quantity").alias("volume"),
    ).select("item_code", F.col("w.start").alias("candle_at"), "open", "high", "low", "close", "volume")


def chart_candles(trades: DataFrame, interval: str = "1 day", price: str = "unit_price") -> DataFrame:
    """Candles for charts: any readable price counts, missing volume is 1 and negative volume 0."""
    volume = F.greatest(F.coalesce(F.col("quantity"), F.lit(1.0)), F.lit(0.0))
    order = F.struct("created_at", "id")
    return commodities(trades).where(F.col(price).isNotNull()).groupBy("item_code", F.window("created_at", interval).alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"),
    ).select("item_code", F.col("w.start").alias("candle_at"), "open", "high", "low", "close", "volume")


def sufficient(bars: DataFrame, least: int = GATE_CANDLES, days: int = GATE_DAYS) -> DataFrame:
    """Items with enough candles on enough UTC days."""
    return bars.groupBy("item_code").agg(F.count("*").alias("candles"), F.count_distinct(F.to_date("candle_at")).alias("days")).where((F.col("candles") >= least) & (F.col("days") >= days))


def sma_7d(bars: DataFrame, least: int = SMA_LEAST) -> DataFrame:
    """Mean close over (t - 7 days, t], null below so many closes."""
    at = F.unix_micros("candle_at")
    frame = Window.partitionBy("item_code").orderBy(at).rangeBetween(-(7 * 86_400_000_000 - 1), 0)
    return bars.withColumn("sma_7d", F.when(F.count("close").over(frame) >= least, F.avg("close").over(frame)))


def crosses(bars: DataFrame, rows: int = 4) -> DataFrame:
    """Moving average of so many rows, and whether the close has crossed it; no evidence means no cross."""
    order = Window.partitionBy("item_code").orderBy("candle_at")
    frame = order.rowsBetween(-(rows - 1), 0)
    out = bars.withColumn("ma", F.when(F.count("close").over(frame) >= rows, F.avg("close").over(frame)))
    before, ma_before = F.lag("close").over(order), F.lag("ma").over(order)
    up = (before <= ma_before) & (F.col("close") > F.col("ma"))
    down = (before >= ma_before) & (F.col("close") < F.col("ma"))
    return out.withColumns({"cross_up": F.coalesce(up, F.lit(False)), "cross_down": F.coalesce(down, F.lit(False))})


def aligned_spread(bars: DataFrame, summaries: DataFrame, interval: str = "1 day") -> DataFrame:
    """Mean spread of each candle's bucket, carried forward over candles without one."""
    means = summaries.groupBy("item_code", F.window("observed_at", interval).alias("w")).agg(F.avg("spread_pct").alias("mean_spread_pct")).select("item_code", F.col("w.start").alias("candle_at"), "mean_spread_pct")
    order = Window.partitionBy("item_code").orderBy("candle_at").rowsBetween(Window.unboundedPreceding, 0)
    return bars.join(means, ["item_code", "candle_at"], "left").withColumn("spread_pct", F.last("mean_spread_pct", ignorenulls=True).over(order))


def normalized_ohlc(bars: DataFrame) -> DataFrame:
    """External candles under lower-case names, volume 0 where missing, rows without a price dropped."""
    out = bars.toDF(*(c.strip().lower() for c in bars.columns))
    if "volume" not in out.columns:
        out = out.withColumn("volume", F.lit(0.0))
    return out.withColumn("volume", F.coalesce("volume", F.lit(0.0))).na.drop(subset=["open", "high", "low", "close"])
