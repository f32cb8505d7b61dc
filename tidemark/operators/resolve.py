"""Resolving revisions of records: newer values and newer nulls win, absent ones never delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import carried_max, part_of


def field_log(arrivals: DataFrame) -> DataFrame:
    """(id, arrival, revised_at, field, value) of arrivals with their fields as a map.

    A field that an arrival has is a row, null or not; one that it lacks is none. An arrival
    without fields has one row without a field.
    """
    return arrivals.select("id", "arrival", "revised_at", F.explode_outer("fields").alias("field", "value"))


def latest_fields(log: DataFrame) -> DataFrame:
    """The value of each (id, field) of a log (id, field, value, revised_at, arrival).

    The newest revision wins and of equal ones the first to arrive, with its null too: a
    newer null blanks a value, and older values do not come back. Fields without any revision
    have the first value that is not null. An aggregate, so a much revised id does not meet
    in one task before it is combined.
    """
    revised, said = F.col("revised_at").isNotNull(), F.col("value").isNotNull()
    newest = F.max_by(F.struct("value"), F.when(revised, F.struct("revised_at", (-F.col("arrival")).alias("first"))))
    filled = F.min_by("value", F.when(~revised & said, F.col("arrival")))
    found = log.where("field is not null").groupBy("id", "field").agg(newest.alias("newest"), filled.alias("filled"), F.max("revised_at").alias("revised_at"), F.count("*").alias("revisions"))
    value = F.when(F.col("revised_at").isNull(), F.col("filled")).otherwise(F.col("newest.value"))
    return found.select("id", "field", value.alias("value"), value.isNull().alias("is_null"), "revised_at", "revisions")


def outcomes(log: DataFrame) -> DataFrame:
    """What each arrival of accepted records did to its record: inserted, enriched or unchanged.

    A field changes when it comes for the first time, with a newer revision, even of the
    same value, or with a value where only nulls without a revision were.
    """
    before = Window.partitionBy("id", "field").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen, prior, had = F.count("*").over(before) > 0, F.max("revised_at").over(before), F.count("value").over(before) > 0
    newer = F.col("revised_at").isNotNull() & (prior.isNull() | (F.col("revised_at") > prior))
    changes = F.col("field").isNotNull() & (~seen | newer | (F.col("value").isNotNull() & ~had & prior.isNull()))
    first = log.groupBy("id").agg(F.min("arrival").alias("first"))
    per = log.withColumn("changes", F.coalesce(changes, F.lit(False))).groupBy("id", "arrival").agg(F.max("changes").alias("changes"))
    outcome = F.when(F.col("arrival") == F.col("first"), "inserted").when(F.col("changes"), "enriched").otherwise("unchanged")
    return per.join(first, "id").select("id", "arrival", outcome.alias("outcome"))


def _marked(records: DataFrame, fields: list[str], optional: list[str] | None) -> DataFrame:
    """Records with ``conflict``: whether their identity differs from what first arrived under their id."""
    same = F.struct(*fields).eqNullSafe(F.col("first"))
    rows = records.join(records.groupBy("id").agg(F.min_by(F.struct(*fields), "arrival").alias("first")), "id", "left")
    wrong = ~same
    if optional:
        # First values of all optional fields come from one aggregate, made of what ``rows`` is made of.
        firsts = rows.where(same).groupBy("id").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(f"first_{n}") for n, c in enumerate(optional)))
        rows = rows.join(firsts, "id", "left")
        for n, c in enumerate(optional):
            wrong = wrong | F.coalesce(F.col(c) != F.col(f"first_{n}"), F.lit(False))
    return rows.select(*records.columns, (F.col("id").isNotNull() & wrong).alias("conflict"))


def identity_conflicts(records: DataFrame, fields: list[str], optional: list[str] | None = None) -> DataFrame:
    """Records whose identity differs from what first arrived under their id.

    ``optional`` fields conflict only where both sides have a value; the first value counts
    that came with the right ``fields``, even if a newer null has blanked it since.
    """
    return _marked(records, fields, optional).where("conflict").drop("conflict")


def by_identity(records: DataFrame, fields: list[str], optional: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, set aside): records of one identity each, and those in conflict with it.

    Both are read from records marked once, so what is set aside is not joined back.
    """
    rows = _marked(records, fields, optional)
    return rows.where("not conflict").drop("conflict"), rows.where("conflict").drop("conflict")


def valid_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that can be facts, and those set aside with a reason."""
    reason = F.when(F.col("id").isNull(), "missing_id").when(F.col("created_at").isNull(), "missing_time").when(~F.coalesce(F.col("money") >= 0, F.lit(False)), "invalid_money").when(~F.coalesce(F.col("quantity") >= 0, F.lit(False)), "invalid_quantity")
    marked = raw.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def page_faults(trades: DataFrame, stream: str | None = None) -> DataFrame:
    """Trades that break the order of a scan: (page, position) go newest first, across pages too.

    A trade later than the one before it, or of another stream than was asked for, is set
    aside with the reason; the scan's head has nothing before it. Pages are cut in runs, so
    each run is ordered by itself and only its ends meet those of the next.
    """
    us = F.unix_micros("created_at")
    within = Window.partitionBy("page").orderBy("position")
    ends = trades.groupBy("page").agg(F.min_by(us, "position").alias("head"), F.max_by(us, "position").alias("tail"))
    above = ends.select((F.col("page") + 1).alias("page"), F.col("tail").alias("before_page"))
    rows = trades.withColumns({"us": us, "before": F.lag(us).over(within)}).join(above, "page", "left")
    before = F.coalesce("before", "before_page")
    reason = F.when(F.col("us") > before, "not_descending")
    if stream is not None:
        reason = F.when(F.col("transaction_type") != stream, "wrong_stream").otherwise(reason)
    return rows.withColumn("reason", reason).where("reason is not null").drop("us", "before", "before_page")


def scan_coverage(pages: DataFrame, known: DataFrame, boundary: Column, cap: int) -> DataFrame:
    """What each scan has covered, and why it stopped there.

    ``pages`` have (stream, page, newest, oldest, has_next), ``known`` merged intervals of
    earlier scans (stream, start, end). A scan ends with its first page that is the last one,
    reaches past the boundary, lies wholly in known coverage, or is the capped one. A scan that
    stopped early has covered nothing at the oldest time itself, as more trades may share it.
    """
    # Intervals of one stream do not overlap, so only the last that begins by a page's oldest time can hold the page.
    begun = known.select("stream", F.col("start").alias("at"), F.lit(0).alias("rank"), F.struct("start", "end").alias("interval"))
    both = pages.withColumns({"at": F.col("oldest"), "rank": F.lit(1)}).unionByName(begun, allowMissingColumns=True)
    both = both.withColumn("part", F.coalesce(part_of("at", dict(both.dtypes)["at"], 1_000), F.lit(0)))
    rows = carried_max(both, ["stream"], "part", ["at", "rank"], "holder", F.col("interval")).where("rank = 1")
    rows = rows.withColumn("known", F.coalesce(F.col("newest") < F.col("holder.end"), F.lit(False))).drop("at", "rank", "part", "interval", "holder")
    reason = F.when(~F.col("has_next"), "api-exhausted").when(F.col("oldest") < boundary, "history-boundary").when(F.col("known"), "normalized-overlap").when(F.col("page") + 1 >= cap, "page-cap")
    rows = rows.withColumn("reason", reason)
    stop = rows.where("reason is not null").groupBy("stream").agg(F.min_by(F.struct("page", "reason", "oldest"), "page").alias("s"))
    head = rows.groupBy("stream").agg(F.max("newest").alias("anchor"))
    after = F.col("s.oldest") + F.expr("interval 1 microsecond")
    start = F.when(F.col("s.reason") == "api-exhausted", F.greatest("s.oldest", boundary)).when(F.col("s.reason") == "history-boundary", boundary).otherwise(after)
    status = F.when(F.col("s.reason") == "api-exhausted", "exhausted").when(F.col("s.reason") == "page-cap", "partial").otherwise("complete")
    return stop.join(head, "stream").select("stream", start.alias("start"), F.col("anchor").alias("end"), F.col("s.reason").alias("completion_reason"), (F.col("s.page") + 1).alias("pages"), status.alias("status"))
