"""Choosing and nesting: item matches, annotations, trades with their children, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_items(rows: DataFrame, wanted: DataFrame, code: str = "item_code") -> DataFrame:
    """Rows of the wanted codes whatever their case; of equal ones the first asked for counts.

    ``wanted`` has (code, position); Spark broadcasts it if it is as small as a request should be.
    """
    first = wanted.groupBy(F.lower("code").alias("key")).agg(F.min_by("code", "position").alias("asked_as"), F.min("position").alias("position"))
    return rows.withColumn("key", F.lower(code)).join(first, "key").drop("key")


def live_annotations(notes: DataFrame, start: Column, end: Column, index_key: str | None = None) -> DataFrame:
    """Annotations that are live, of production, sourced and effective in the window, for one index if asked."""
    kept = notes.where((F.col("status") == "live") & (F.col("environment") == "production") & F.col("source").isNotNull() & (F.col("effective_at") >= start) & (F.col("effective_at") < end))
    return kept.where(F.array_contains("index_keys", index_key) | (F.size("index_keys") == 0)) if index_key else kept


def nest_trades(trades: DataFrame, parties: DataFrame, equipment: DataFrame, stats: DataFrame) -> DataFrame:
    """Trades with their parties as a map by side, their equipment and its stats; children are grouped before the join."""
    sides = parties.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("user_id", "mu_id", "country_id", "party_id")))).alias("parties"))
    skills = stats.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("skill", "value")))).alias("stats"))
    gear = equipment.join(skills, "id", "left").select("id", F.struct(*(c for c in equipment.columns if c != "id"), "stats").alias("equipment"))
    return trades.join(sides, "id", "left").join(gear, "id", "left")


def resolve_names(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """Each text as an entity: an exact id beats a name in any case; several candidates are ambiguous."""
    by_id = asked.join(entities, asked.text == entities.id).select("text", "kind", "id", F.lit(0).alias("way"))
    by_name = asked.join(entities, F.lower(asked.text) == F.lower(entities.name)).select("text", "kind", "id", F.lit(1).alias("way"))
    hits = by_id.unionByName(by_name).distinct()
    best = hits.withColumn("best", F.min("way").over(Window.partitionBy("text"))).where("way = best")
    found = best.groupBy("text").agg(F.count("*").alias("candidates"), F.min(F.struct("kind", "id")).alias("e"))
    return asked.join(found, "text", "left").select("text", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("candidates") == 1, F.col("e")).alias("entity"))


def summaries_of(asked: DataFrame, entities: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger row of each text that names one account, and how many candidates it has.

    A text without candidates is taken for an id that has no known name.
    """
    found = resolve_names(asked, entities)
    account = F.when(F.col("candidates") == 0, F.col("text")).otherwise(F.col("entity.id"))
    rows = found.select("text", "candidates", F.coalesce("entity.kind", F.lit("user")).alias("kind"), account.alias("account"))
    return rows.join(ledger, ["kind", "account"], "left")


def with_names(ledger: DataFrame, entities: DataFrame) -> DataFrame:
    """Ledger rows with the name of their entity and, for users, of the country they belong to."""
    own = entities.select("kind", F.col("id").alias("account"), "name", "citizenship_id")
    country = entities.where("kind = 'country'").select(F.col("id").alias("citizenship_id"), F.col("name").alias("country_name"))
    return ledger.join(own, ["kind", "account"], "left").join(country, "citizenship_id", "left")


def sync_status(streams: DataFrame, trades: DataFrame) -> DataFrame:
    """Retained and normalized trades of each stream beside its last known progress."""
    counts = trades.groupBy(F.col("transaction_type").alias("stream")).agg(F.count("*").alias("retained"), F.count_if(F.col("unit_price").isNotNull()).alias("normalized"))
    return streams.join(counts, "stream", "left").na.fill(0, ["retained", "normalized"])


def stream_coverage(reached: DataFrame, progress: DataFrame, until: Column) -> DataFrame:
    """Whether each stream was followed from the start to ``until`` without loss, and all of them."""
    ok = F.coalesce((F.col("reached") >= until) & F.col("status").isin("complete", "exhausted") & (F.col("rejected") == 0) & F.col("error").isNull(), F.lit(False))
    rows = progress.join(reached, "stream", "left").withColumn("covered", ok)
    return rows.withColumn("all_covered", F.min("covered").over(Window.partitionBy(F.lit(1))))
