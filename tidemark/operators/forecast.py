"""Direction forecasts evaluated walk-forward: features look back, targets look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators.books import summaries, sweep
from tidemark.operators.stats import commodities
from tidemark.session import stored

WINDOW_US, HOUR_US = 7 * 86_400_000_000, 3_600_000_000


#: Exact percentiles that a snapshot's week is described by.
PERCENTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p90": 0.9}


def _numbered(trades: DataFrame) -> DataFrame:
    """Priced trades of commodities, numbered from 1 for each item by time and id.

    Places are counted within days and moved up by the trades of the item's earlier days.
    """
    us = F.unix_micros("created_at")
    quantity = F.col("quantity").cast("double")
    rows = commodities(trades).where("unit_price is not null").select("item_code", us.alias("us"), F.floor(us / (24 * HOUR_US)).alias("day"), "id", F.col("unit_price").alias("price"), quantity.alias("quantity"))
    before = F.sum("count").over(Window.partitionBy("item_code").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = rows.groupBy("item_code", "day").count().select("item_code", "day", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("item_code", "day").orderBy("us", "id"))
    return rows.withColumn("place", place).join(days, ["item_code", "day"]).select("item_code", "us", "price", "quantity", (F.col("before") + F.col("place")).alias("no"))


def _counts(celled: DataFrame, marks: DataFrame) -> DataFrame:
    """For every mark and price cell: trades up to the mark, and counts and sums of its week.

    A cell's running sums at the mark less those at the week's start. Times are doubled, so
    that a start comes before the trades of its microsecond and an end after them.
    """
    sums = ("n", "volume", "traded", "value")
    sold = F.when(F.col("quantity") > 0, F.col("quantity")).otherwise(0.0)
    events = celled.select(
        "item_code", "chunk", "cell", (F.col("us") * 2).alias("at"), F.lit(None).cast("long").alias("mark"), F.lit(0).alias("sign"),
        F.lit(1).alias("n"), F.coalesce("quantity", F.lit(0.0)).alias("volume"), sold.alias("traded"), (sold * F.col("price")).alias("value"),
    )
    ends = F.array(F.struct((F.col("us") * 2 + 1).alias("at"), F.lit(1).alias("sign")), F.struct(((F.col("us") - WINDOW_US) * 2 - 1).alias("at"), F.lit(-1).alias("sign"))).cast("array<struct<at: long, sign: int>>")
    asked = marks.select("item_code", "chunk", "us", F.explode("cells").alias("cell"), ends.alias("ends")).select("item_code", "chunk", "cell", F.col("us").alias("mark"), F.explode("ends").alias("end"))
    asked = asked.select("item_code", "chunk", "cell", "end.at", "mark", "end.sign", F.lit(0).alias("n"), *(F.lit(0.0).alias(c) for c in sums[1:]))
    run = Window.partitionBy("item_code", "chunk", "cell").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = events.unionByName(asked).withColumns({c: F.sum(c).over(run) for c in sums}).where("sign != 0")
    return summed.groupBy("item_code", F.col("mark").alias("us"), "chunk", "cell").agg(F.sum(F.when(F.col("sign") > 0, F.col("n"))).alias("upto"), *(F.sum(F.col("sign") * F.col(c)).alias(c) for c in sums))


def _ranked(counts: DataFrame, celled: DataFrame) -> DataFrame:
    """(item_code, us, prices): the prices at the ranks, from 0, that the percentiles lie between.

    Prefix sums over cells tell the cell of each rank; only the week's trades of such cells
    are put in order.
    """
    week = Window.partitionBy("item_code", "us")
    last = F.sum("n").over(week) - 1
    below = F.sum("n").over(week.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranks = F.array_distinct(F.array(*(f(last * p).cast("long") for p in PERCENTILES.values() for f in (F.floor, F.ceil))))
    hits = counts.withColumns({"ranks": ranks, "below": below}).withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n"))))
    hits = hits.where(F.size("ranks") > 0).select("item_code", "chunk", "cell", F.col("us").alias("mark"), "ranks", "below")
    pairs = hits.join(celled.select("item_code", "chunk", "cell", "us", "price"), ["item_code", "chunk", "cell"]).where((F.col("us") <= F.col("mark")) & (F.col("us") >= F.col("mark") - WINDOW_US))
    rank = F.col("below") + F.row_number().over(Window.partitionBy("item_code", "mark", "cell").orderBy("price")) - 1
    found = pairs.withColumn("rank", rank).where(F.array_contains("ranks", F.col("rank")))
    return found.groupBy("item_code", F.col("mark").alias("us")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "price"))).alias("prices"))


def features(trades: DataFrame, books: DataFrame, chunk_days: int = 7, cells: int = 64) -> DataFrame:
    """Measures of the trades in [t - 7 days, t] for every snapshot of ``summaries``.

    Trades are dealt by item, chunk of days and cell of prices; a trade goes to each chunk
    that can see it. Cells are cut at approximate quantiles of the chunk, which decide the
    work only: results are exact. A snapshot costs two marks for each cell that has trades
    and the week's trades of the few cells its percentiles lie in, not its whole week; a hot
    item is spread over chunks and cells. Snapshots without a trade have a count of 0.
    """
    chunk = chunk_days * 24 * HOUR_US
    numbered = stored(_numbered(trades), "numbered")
    spread = numbered.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("us") / chunk), F.floor((F.col("us") + WINDOW_US) / chunk))))
    cuts = stored(spread.groupBy("item_code", "chunk").agg(F.array_distinct(F.percentile_approx("price", [i / cells for i in range(1, cells)])).alias("cuts"), (F.min("no") - 1).alias("base")), "cuts")
    # The number of cuts below the price, by halving.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(cells.bit_length()))))
    cell = F.aggregate(steps, F.lit(0), lambda i, step: i + F.when(F.get("cuts", i + step - 1) < F.col("price"), step).otherwise(0))
    celled = spread.join(cuts, ["item_code", "chunk"]).withColumn("cell", cell).drop("cuts", "base")
    celled = stored(celled, "cells")
    seen = books.select("item_code", F.unix_micros("observed_at").alias("us"), "observed_at", "best_bid", "best_ask", "spread_pct", "imbalance_pct")
    seen = stored(seen, "snapshots")
    marks = seen.select("item_code", "us", F.floor(F.col("us") / chunk).alias("chunk")).join(cuts, ["item_code", "chunk"])
    counts = stored(_counts(celled, marks.withColumn("cells", F.sequence(F.lit(0), F.size("cuts")))), "counts")
    whole = counts.groupBy("item_code", "us", "chunk").agg(F.sum("n").alias("trades"), F.sum("upto").alias("upto"), F.sum("volume").alias("volume"), F.when(F.sum("traded") > 0, F.sum("value") / F.sum("traded")).alias("vwap")).where("trades > 0")
    # The first and the last five of the week by number.
    wanted = whole.join(cuts.drop("cuts"), ["item_code", "chunk"]).withColumns({"last": F.col("base") + F.col("upto"), "first": F.col("base") + F.col("upto") - F.col("trades") + 1})
    wanted = wanted.select("item_code", F.col("us").alias("mark"), "first", "last", F.explode(F.array_distinct(F.concat(F.array("first"), F.sequence(F.greatest("first", F.col("last") - 4), F.col("last"))))).alias("no"))
    at = lambda n: F.max(F.when(F.col("no") == F.col(n), F.col("price")))
    ends = wanted.join(numbered.select("item_code", "no", "price"), ["item_code", "no"]).groupBy("item_code", F.col("mark").alias("us")).agg(at("first").alias("open"), at("last").alias("close"), F.avg(F.when(F.col("no") > F.col("last") - 5, F.col("price"))).alias("last5"))

    def percentile(p: float) -> Column:
        place = (F.col("trades") - 1) * p
        low, high = (F.element_at("prices", f(place).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    made = whole.drop("chunk", "upto").join(ends, ["item_code", "us"]).join(_ranked(counts, celled), ["item_code", "us"]).withColumns({n: percentile(p) for n, p in PERCENTILES.items()}).drop("prices")
    out = seen.join(made, ["item_code", "us"], "left").withColumn("trades", F.coalesce("trades", F.lit(0)))
    out = out.withColumns({"momentum_pct": F.when(F.col("trades") >= 2, X.change_pct("close", "open")), "fair": X.stable_fair("vwap", "median", "last5")})
    return out.withColumn("fair_gap_pct", X.change_pct("best_bid", "fair"))


def targets(books: DataFrame, horizon_hours: float = 24, lag_hours: float = 6, chunk_days: int = 2) -> DataFrame:
    """For every snapshot the first one at least the horizon later, if it comes within the lag.

    The first snapshot is taken even if it has no bid; the caller drops it then, without
    looking further. Snapshots are dealt by item and chunk of days, and what looks ahead goes
    to each chunk that its window touches, so a hot item spreads over its chunks.
    """
    ahead, lag, chunk = int(horizon_hours * HOUR_US), int(lag_hours * HOUR_US), chunk_days * 24 * HOUR_US
    us = F.unix_micros("observed_at")
    rows = books.select("item_code", us.alias("us"), F.struct(us.alias("us"), F.col("observed_at").alias("target_at"), F.col("best_bid").alias("target_bid")).alias("found"))
    seen = rows.select("item_code", F.col("us").alias("at"), F.lit(None).cast("long").alias("owner"), "found", F.floor(F.col("us") / chunk).alias("chunk"))
    start = F.col("us") + ahead
    look = rows.select("item_code", start.alias("at"), F.col("us").alias("owner"), F.lit(None).cast(rows.schema["found"].dataType).alias("found"), F.explode(F.sequence(F.floor(start / chunk), F.floor((start + lag) / chunk))).alias("chunk"))
    frame = Window.partitionBy("item_code", "chunk").orderBy("at").rangeBetween(0, lag)
    first = seen.unionByName(look).withColumn("first", F.first("found", ignorenulls=True).over(frame)).where("owner is not null")
    best = first.groupBy("item_code", F.timestamp_micros("owner").alias("observed_at")).agg(F.min("first").alias("t"))
    return books.join(best, ["item_code", "observed_at"]).select(*books.columns, "t.target_at", "t.target_bid")


def evaluations(trades: DataFrame, levels: DataFrame, quantity: float = 1.0, tick: float = 0.001, horizon_hours: float = 24, lag_hours: float = 6, seen: DataFrame | None = None) -> DataFrame:
    """Predictions and what came of them: snapshots with features, a bid, and a target with a bid."""
    books = summaries(levels)
    seen = features(trades, books) if seen is None else seen
    ahead = targets(books, horizon_hours, lag_hours).select("item_code", "observed_at", "target_at", "target_bid")
    rows = seen.where("best_bid > 0 and trades > 0").join(ahead, ["item_code", "observed_at"]).where("target_bid > 0")
    score = X.direction_score("momentum_pct", "fair_gap_pct")
    rows = rows.withColumns({"prediction": X.direction_signal(score), "outcome": X.bid_outcome("best_bid", "target_bid", tick), "return_pct": X.change_pct("target_bid", "best_bid")})
    fills = sweep(levels, quantity).where("fully_filled").select("item_code", "observed_at", "side", "vwap")
    entry = fills.where("side = 'ask'").select("item_code", "observed_at", F.col("vwap").alias("entry_vwap"))
    exit_ = fills.where("side = 'bid'").select("item_code", F.col("observed_at").alias("target_at"), F.col("vwap").alias("exit_vwap"))
    rows = rows.drop("vwap").join(entry, ["item_code", "observed_at"], "left").join(exit_, ["item_code", "target_at"], "left")
    return rows.withColumn("flip_return_pct", X.change_pct("exit_vwap", "entry_vwap"))


def forecast_summary(rows: DataFrame, current: DataFrame, least: int = 30, interval_least: int = 10) -> DataFrame:
    """Accuracy against the majority baseline, evidence and return intervals by item.

    ``current`` has (item_code, current_signal) of the newest snapshot with features.
    """
    ways = ["Up", "Down"]
    directional = F.col("prediction").isin(ways) & F.col("outcome").isin(ways)
    match = F.col("current_signal").isin(ways) & (F.col("prediction") == F.col("current_signal"))
    interval = lambda c: F.when(F.count(F.when(match, F.col(c))) >= interval_least, F.percentile(F.when(match, F.col(c)), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))))
    out = rows.join(current, "item_code").groupBy("item_code", "current_signal").agg(
        F.count("*").alias("candidate_samples"), F.count_if(directional).alias("evaluable_samples"), F.count("flip_return_pct").alias("execution_samples"),
        F.count_if(F.col("prediction") == "Up").alias("up_predictions"), F.count_if(F.col("prediction") == "Down").alias("down_predictions"),
        F.count_if(directional & (F.col("prediction") == F.col("outcome"))).alias("correct"),
        F.count_if(directional & (F.col("outcome") == "Up")).alias("ups"), F.count_if(directional & (F.col("outcome") == "Down")).alias("downs"),
        interval("return_pct").alias("r"), interval("flip_return_pct").alias("f"),
    )
    share = lambda c: F.when(F.col("evaluable_samples") > 0, c / F.col("evaluable_samples") * 100)
    out = out.withColumns({"accuracy_pct": share(F.col("correct")), "baseline_pct": share(F.greatest("ups", "downs"))})
    out = out.withColumn("evidence", X.evidence_label("evaluable_samples", "accuracy_pct", "baseline_pct", least))
    names = [("r", "return"), ("f", "flip_return")]
    return out.select("item_code", "current_signal", "candidate_samples", "evaluable_samples", "execution_samples", "up_predictions", "down_predictions", "correct", "accuracy_pct", "baseline_pct", "evidence", *(F.col(c)[i].alias(f"{n}_{p}_pct") for c, n in names for i, p in enumerate(("p10", "median", "p90"))))


def current_signals(seen: DataFrame) -> DataFrame:
    """The signal of each item's newest snapshot, only if that snapshot has features."""
    newest = seen.groupBy("item_code").agg(F.max_by(F.struct("trades", "momentum_pct", "fair_gap_pct", "observed_at"), "observed_at").alias("x")).select("item_code", "x.*").where("trades > 0")
    return newest.select("item_code", X.direction_signal(X.direction_score("momentum_pct", "fair_gap_pct")).alias("current_signal"))
