"""The driver's tables in the engine's shapes: trades, books, quotes and the ledger's trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import unit_price


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intraday trades from events: five items, thirty days; every nineteenth is one of equipment."""
    return tape_of(read(spark, sf_dir, "events"))


def tape_of(events: DataFrame) -> DataFrame:
    """The same from events that may be a stream."""
    quantity = F.get_json_object("props", "$.k").cast("double")
    rows = events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("item_code"), F.when(F.col("event_id") % 19 == 0, "itemMarket").otherwise("trading").alias("transaction_type"),
        F.col("ts").cast("timestamp").alias("created_at"), quantity.alias("quantity"), (F.col("value") * quantity).alias("money"),
        F.col("user_id").alias("buy_user"), ((F.col("event_id") * 13) % 150).alias("sell_user"),
    )
    return rows.withColumn("unit_price", unit_price("money", "quantity"))


def long_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grain trades of several years from order lines: brands as items."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    rows = line.join(part.select("p_partkey", "p_brand"), line.l_partkey == part.p_partkey)
    return rows.select(
        F.col("p_brand").alias("item_code"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").cast("double").alias("quantity"),
        F.col("l_extendedprice").cast("double").alias("money"), F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("sell_user"),
    ).withColumn("unit_price", unit_price("money", "quantity"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Production points of the items that have traded: a number made of the code's length."""
    codes = read(spark, sf_dir, "events").select(F.col("event_type").alias("item_code")).distinct()
    return codes.select("item_code", F.length("item_code").cast("double").alias("points"))


def book_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw levels of hourly synthetic books; equal prices are not merged yet."""
    even = F.col("event_id") % 2 == 0
    return read(spark, sf_dir, "events").select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("observed_at"), F.col("event_type").alias("item_code"),
        F.when(even, "bid").otherwise("ask").alias("side"),
        (F.floor(F.when(even, 49.9 - F.col("value") % 10).otherwise(50.0 + F.col("value") % 10) * 10 + 0.5) / 10).alias("price"),
        (1 + F.col("user_id") % 50).cast("double").alias("quantity"), F.col("event_id").alias("order_id"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of each item and day."""
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("item_code"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("value").alias("current_price"))
    return rows.groupBy("item_code", F.to_date("observed_at").alias("day")).agg(F.max_by(F.struct("id", "observed_at", "current_price"), F.struct("observed_at", "id")).alias("q")).select("item_code", "q.*")


def line_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-grain trades of three items over years: lines by number, the third item from some day on."""
    line = read(spark, sf_dir, "lineitem")
    item = F.when(F.col("l_linenumber").isin(3, 5) & (F.col("l_shipdate") >= F.lit("1995-06-10").cast("timestamp")), "late").when(F.col("l_linenumber") % 2 == 0, "even").otherwise("odd")
    rows = line.select(item.alias("item_code"), F.lit("trading").alias("transaction_type"), F.col("l_shipdate").cast("timestamp").alias("created_at"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("money"))
    return rows.withColumn("unit_price", unit_price("money", "quantity"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants by name: customers as users of a country, suppliers as units, nations as countries."""
    of = lambda table, kind, key, name, country: read(spark, sf_dir, table).select(F.lit(kind).alias("kind"), F.concat(F.lit(kind[0]), F.col(key)).alias("id"), F.col(name).alias("name"), country.alias("citizenship_id"))
    nation = lambda c: F.concat(F.lit("c"), F.col(c))
    return of("customer", "user", "c_custkey", "c_name", nation("c_nationkey")).unionByName(of("supplier", "mu", "s_suppkey", "s_name", nation("s_nationkey"))).unionByName(of("nation", "country", "n_nationkey", "n_name", F.lit(None).cast("string")))


def ledger_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades with parties: some sides act for one institution, a few for two, some for none.

    Most settlements are verified, some amounts are missing, and trades of equipment carry it.
    """
    return ledger_trades_of(read(spark, sf_dir, "events"))


def ledger_trades_of(events: DataFrame) -> DataFrame:
    """The same from events that may be a stream.

    Events are few bytes a row, so a file of very many is one or two tasks' scan, while what
    follows costs far more than the scan: they are dealt by id first.
    """
    t = tape_of(events.repartition("event_id"))
    buy, sell, at = F.col("buy_user"), F.col("sell_user"), F.col("id")
    mu = lambda u: F.when(u % 7 == 0, F.concat(F.lit("m"), u % 5))
    country = lambda u: F.when(u % 11 == 0, F.concat(F.lit("c"), u % 3))
    user = lambda u: F.when(u % 13 != 5, F.concat(F.lit("u"), u))
    stats = F.when(at % 7 != 0, F.create_map(F.lit("attack"), at % 3, F.lit("armor"), at % 2))
    gear = F.struct(F.concat(F.lit("i"), at % 50).alias("instance_id"), F.concat(F.lit("gear"), at % 4).alias("equipment_code"), stats.alias("stats"), (at % 5).alias("state"), F.lit(10).cast("long").alias("max_state"))
    return t.select(
        "id", "item_code", "transaction_type", "created_at", F.when(at % 23 != 0, F.col("money")).alias("money"), F.when(at % 29 != 0, F.col("quantity")).alias("quantity"), "unit_price",
        user(buy).alias("buy_user_id"), mu(buy).alias("buy_mu_id"), country(buy).alias("buy_country_id"), F.lit(None).cast("string").alias("buy_party_id"),
        user(sell).alias("sell_user_id"), mu(sell).alias("sell_mu_id"), country(sell).alias("sell_country_id"), F.lit(None).cast("string").alias("sell_party_id"),
        (at % 4 != 0).alias("settlement_verified"), F.when(at % 3 == 0, "settled").otherwise("gross").alias("settlement_role"), F.when(at % 5 != 0, F.col("money") / 100).alias("settlement_fee"),
        F.when(F.col("transaction_type") == "itemMarket", gear).alias("equipment"),
    )


#: The same shapes for DuckDB.
TAPE_SQL = """all_trades AS (SELECT *, CASE WHEN quantity > 0 THEN money / quantity END AS unit_price FROM (
  SELECT event_id AS id, event_type AS item_code, CASE WHEN event_id % 19 = 0 THEN 'itemMarket' ELSE 'trading' END AS transaction_type, ts AS created_at,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity,
         value * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS money,
         user_id AS buy_user, (event_id * 13) % 150 AS sell_user FROM events)),
tape AS (SELECT * FROM all_trades WHERE transaction_type = 'trading')"""
LONG_TAPE_SQL = """long_tape AS (SELECT *, CASE WHEN quantity > 0 THEN money / quantity END AS unit_price FROM (
  SELECT p_brand AS item_code, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS DOUBLE) AS quantity,
         CAST(l_extendedprice AS DOUBLE) AS money, l_orderkey AS order_key, l_suppkey AS sell_user
  FROM lineitem JOIN part ON l_partkey = p_partkey))"""
BOOK_SQL = """book_levels AS (
  SELECT date_trunc('hour', ts) AS observed_at, event_type AS item_code,
         CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side,
         floor(CASE WHEN event_id % 2 = 0 THEN 49.9 - (value % 10) ELSE 50.0 + (value % 10) END * 10 + 0.5) / 10 AS price,
         CAST(1 + user_id % 50 AS DOUBLE) AS quantity, event_id AS order_id FROM events)"""
QUOTES_SQL = """quotes AS (SELECT item_code, id, observed_at, current_price FROM (
  SELECT event_type AS item_code, event_id AS id, ts AS observed_at, value AS current_price,
         row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""
LEDGER_SQL = TAPE_SQL + """, ledger_trades AS (SELECT id, item_code, transaction_type, created_at, CASE WHEN id % 23 <> 0 THEN money END AS money, CASE WHEN id % 29 <> 0 THEN quantity END AS quantity, unit_price,
  CASE WHEN buy_user % 13 <> 5 THEN 'u' || buy_user END AS buy_user_id, CASE WHEN buy_user % 7 = 0 THEN 'm' || (buy_user % 5) END AS buy_mu_id,
  CASE WHEN buy_user % 11 = 0 THEN 'c' || (buy_user % 3) END AS buy_country_id, CAST(NULL AS VARCHAR) AS buy_party_id,
  CASE WHEN sell_user % 13 <> 5 THEN 'u' || sell_user END AS sell_user_id, CASE WHEN sell_user % 7 = 0 THEN 'm' || (sell_user % 5) END AS sell_mu_id,
  CASE WHEN sell_user % 11 = 0 THEN 'c' || (sell_user % 3) END AS sell_country_id, CAST(NULL AS VARCHAR) AS sell_party_id,
  id % 4 <> 0 AS verified, CASE WHEN id % 3 = 0 THEN 'settled' ELSE 'gross' END AS role, CASE WHEN id % 5 <> 0 THEN money / 100 END AS fee,
  CASE WHEN transaction_type = 'itemMarket' THEN 'equipment-v1|gear' || (id % 4) || '|' || CASE WHEN id % 7 = 0 THEN '?' ELSE 'armor=' || (id % 2) || ',attack=' || (id % 3) END || '|' || (id % 5) || '|10' ELSE item_code END AS category
  FROM all_trades)"""
POINTS_SQL = "points AS (SELECT DISTINCT event_type AS item_code, CAST(length(event_type) AS DOUBLE) AS points FROM events)"
LINE_TAPE_SQL = """line_tape AS (SELECT CASE WHEN l_linenumber IN (3, 5) AND l_shipdate >= DATE '1995-06-10' THEN 'late' WHEN l_linenumber % 2 = 0 THEN 'even' ELSE 'odd' END AS item_code, CAST(l_shipdate AS DATE) AS day,
  CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS money FROM lineitem)"""
ENTITIES_SQL = """entities AS (SELECT 'user' AS kind, 'u' || c_custkey AS id, c_name AS name, 'c' || c_nationkey AS citizenship_id FROM customer
  UNION ALL SELECT 'mu', 'm' || s_suppkey, s_name, 'c' || s_nationkey FROM supplier UNION ALL SELECT 'country', 'c' || n_nationkey, n_name, NULL FROM nation)"""
