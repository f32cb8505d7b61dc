"""The tape as a stream: deduplication, candles, latest quotes, clocks and resolved records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.context import data_clock
from tidemark.operators.resolve import valid_records
from tidemark.operators.stats import usable


def landed(spark: SparkSession, path: str, schema: str, files: int | None = None) -> DataFrame:
    """Trades from landed Parquet pages; the checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def unique_trades(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of each id; state is kept no longer than trades may be late."""
    return stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])


def live_candles(stream: DataFrame, interval: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """OHLCV by item and bucket, final once the watermark has passed."""
    order = F.struct("created_at", "id")
    return stream.where(usable()).withWatermark("created_at", late).groupBy(F.window("created_at", interval).alias("w"), "item_code").agg(
        F.min_by("unit_price", order).alias("open"), F.max("unit_price").alias("high"), F.min("unit_price").alias("low"), F.max_by("unit_price", order).alias("close"), F.sum("quantity").alias("volume"),
    ).select("item_code", F.col("w.start").alias("candle_at"), "open", "high", "low", "close", "volume")


def latest_quotes(stream: DataFrame) -> DataFrame:
    """The newest quote of each item; one row of state an item."""
    return stream.groupBy("item_code").agg(F.max_by(F.struct("id", "observed_at", "current_price"), F.struct("observed_at", "id")).alias("q")).select("item_code", "q.*")


def live_clock(stream: DataFrame, ts: str = "created_at") -> DataFrame:
    return stream.agg(F.max(ts).alias("data_as_of"))


def stale_quotes(stream: DataFrame, minutes: int = 30) -> DataFrame:
    """(item_code, last_at, stale): a row for every new quote, and one when no other has followed in time."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"item_code": [key[0]], "last_at": [pd.Timestamp(last, unit="us")], "stale": [True]})
            return
        newest = max((int(b["us"].max()) for b in batches if len(b)), default=0)
        last = max(newest, state.get[0] if state.exists else 0)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + minutes * 60_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"item_code": [key[0]], "last_at": [pd.Timestamp(last, unit="us")], "stale": [False]})

    rows = stream.withWatermark("observed_at", "0 seconds").select("item_code", "observed_at", F.unix_micros("observed_at").alias("us"))
    return rows.groupBy("item_code").applyInPandasWithState(step, "item_code string, last_at timestamp, stale boolean", "us long", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(stream: DataFrame, clock_us: int, late_us: int) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and those older than the clock allows, for a side table."""
    old = F.unix_micros("created_at") < clock_us - late_us
    return stream.where(~old), stream.where(old)


def ingest(stream: DataFrame, facts: str, rejected: str, coverage: str, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """Append valid trades, set others aside and record what each batch covered.

    An id counts once, in its first batch: a batch looks its trades up among those of earlier
    batches within its own range of times, which prunes the files that are read. A batch that
    is run again after a failure overwrites its own files, so nothing is counted twice. Strict
    mode sets bad records aside and fails the whole batch, whose trades stay to be read again.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            good, bad = valid_records(batch)
            bad.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
            if strict and not bad.isEmpty():
                raise ValueError(f"Batch {number} has bad records; see {rejected}/batch={number}")
            new = good.dropDuplicates(["id"])
            if number > 0:
                low, high = good.agg(F.min("created_at"), F.max("created_at")).first()
                seen = batch.sparkSession.read.schema(f"id {good.schema['id'].dataType.simpleString()}, created_at timestamp, batch long").option("basePath", facts).parquet(facts)
                seen = seen.where((F.col("batch") < number) & F.col("created_at").between(low, high)) if low is not None else seen.limit(0)
                new = new.join(seen.select("id"), "id", "left_anti").select(*good.columns)
            new.write.mode("overwrite").parquet(f"{facts}/batch={number}")
            good.groupBy("transaction_type").agg(F.min("created_at").alias("start"), F.max("created_at").alias("end"), F.count("*").alias("trades")).write.mode("overwrite").parquet(f"{coverage}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recomputed_clock(spark: SparkSession, facts: str, *others: tuple[str, str]) -> DataFrame:
    """The clock from what is stored, after a correction or retention may have moved it back.

    ``others`` are further tables with the name of their time.
    """
    return data_clock((spark.read.parquet(facts), "created_at"), *((spark.read.parquet(path), ts) for path, ts in others))


def run_to_memory(df: DataFrame, name: str, mode: str, checkpoint: str, then: Callable[[], None] | None = None) -> DataFrame:
    """Run a stream over what has landed and read its result; for tests and small looks."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if then:
        then()
    return df.sparkSession.table(name)
