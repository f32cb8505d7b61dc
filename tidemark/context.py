"""The report boundary: windows end at a cutoff taken from the data, never from the wall clock."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import in_window

MICROSECOND = timedelta(microseconds=1)


@dataclass(frozen=True)
class ReportContext:
    """Analysis time, exclusive end and how they were found."""

    data_as_of: datetime | None
    analysis: datetime | None
    end: datetime | None
    mode: str

    def bounds(self, days: float) -> tuple[Column, Column]:
        """The start and the exclusive end of a window; null if there is nothing to report on."""
        start = None if self.analysis is None else self.analysis - timedelta(days=days)
        return F.lit(start).cast("timestamp"), F.lit(self.end).cast("timestamp")

    def window(self, ts: Column | str, days: float) -> Column:
        """Rows in [analysis - days, end)."""
        return F.lit(False) if self.analysis is None else in_window(ts, *self.bounds(days))


def data_clock(*facts: tuple[DataFrame, str]) -> DataFrame:
    """One row: the latest event time over all facts."""
    times = [df.select(F.max(ts).alias("ts")) for df, ts in facts]
    both = times[0]
    for t in times[1:]:
        both = both.unionByName(t)
    return both.agg(F.max("ts").alias("data_as_of"))


def resolve(requested: datetime | None, *facts: tuple[DataFrame, str]) -> ReportContext:
    """A requested cutoff up to the clock is exclusive; otherwise the clock itself is included."""
    clock = data_clock(*facts).first()[0]
    if clock is None:
        return ReportContext(None, None, None, "unavailable")
    if requested is not None and requested <= clock:
        return ReportContext(clock, requested, requested, "historical-exclusive")
    return ReportContext(clock, clock, clock + MICROSECOND, "database-inclusive")
