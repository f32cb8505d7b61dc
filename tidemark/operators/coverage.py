"""Coverage intervals and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import carried_max, part_of


def merged(intervals: DataFrame, keys: list[str], start: str = "start", end: str = "end", span: int = 1_000) -> DataFrame:
    """Overlapping and touching intervals of each key as one.

    An interval begins an island if it begins after all before it have ended, and belongs to
    the last island begun. Both are running maxima within days (``span`` units of numbers)
    that are carried from one to the next, so a stream of very many intervals is spread too.
    """
    rows = intervals.withColumn("part", F.coalesce(part_of(start, dict(intervals.dtypes)[start], span), F.lit(-(1 << 62))))
    rows = carried_max(rows, keys, "part", [start, end], "reach", F.col(end), upto=False)
    begins = F.when(F.coalesce(F.col(start) > F.col("reach"), F.lit(True)), F.col(start))
    rows = carried_max(rows, keys, "part", [start, end], "island", begins)
    return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def covers(intervals: DataFrame, keys: list[str], low: Column, high: Column, every: DataFrame | None = None) -> DataFrame:
    """Whether one merged interval holds [low, high); an empty window is covered.

    ``every`` lists the keys that are asked for: one without any interval is not covered.
    """
    out = merged(intervals, keys).groupBy(*keys).agg((F.max((F.col("start") <= low) & (F.col("end") >= high)) | F.lit(low >= high)).alias("covered"))
    return out if every is None else every.select(*keys).distinct().join(out, keys, "left").withColumn("covered", F.coalesce("covered", F.lit(low >= high)))


def reached(intervals: DataFrame, low: Column, keys: list[str]) -> DataFrame:
    """How far each key is covered without a gap from ``low``."""
    return merged(intervals, keys).where((F.col("start") <= low) & (F.col("end") > low)).groupBy(*keys).agg(F.max("end").alias("reached"))


def retained(rows: DataFrame, ts: str, cutoff: Column) -> DataFrame:
    """Rows not older than the cutoff."""
    return rows.where(F.col(ts) >= cutoff)


def clamped(intervals: DataFrame, cutoff: Column) -> DataFrame:
    """Intervals cut at a retention cutoff; those before it go."""
    return intervals.where(F.col("end") > cutoff).withColumn("start", F.greatest("start", cutoff))


def progress_after(progress: DataFrame, cutoff: Column, oldest: str = "oldest_at") -> DataFrame:
    """Scan progress after a retention: one that reached further back is partial and has no oldest trade."""
    cut = F.coalesce(F.col(oldest) < cutoff, F.lit(False))
    return progress.withColumns({"status": F.when(cut, "partial").otherwise(F.col("status")), oldest: F.when(~cut, F.col(oldest))})
