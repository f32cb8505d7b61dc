"""Running maxima in two levels, for keys of any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def part_of(ts: str, kind: str, span: int) -> Column:
    """The part of a line of times or numbers that a row falls in: a day of times, ``span`` units of numbers."""
    return F.unix_date(F.to_date(ts)).cast("long") if kind.startswith(("timestamp", "date")) else F.floor(F.col(ts) / span).cast("long")


def carried_max(rows: DataFrame, keys: list[str], part: str, order: list[str], name: str, value: Column, upto: bool = True) -> DataFrame:
    """Rows with the greatest ``value`` of their key up to them in ``order``, or only before them.

    ``part`` is a column, never null, that ascends with the order. Maxima are taken within the
    parts of a key and carried from part to part, a row each, so a key with very many rows
    is never in one task. Null keys are a key.
    """
    rows = rows.withColumn("_key", F.struct(*keys))
    start = Window.unboundedPreceding
    own = Window.partitionBy("_key", part).orderBy(*order).rowsBetween(start, 0 if upto else -1)
    tops = rows.groupBy("_key", part).agg(F.max(value).alias("_top"))
    before = tops.select("_key", part, F.max("_top").over(Window.partitionBy("_key").orderBy(part).rowsBetween(start, -1)).alias("_before"))
    found = rows.withColumn(name, F.max(value).over(own)).join(before, ["_key", part])
    return found.withColumn(name, F.greatest(name, "_before")).drop("_before", "_key")
