"""Intake, selection and publication queries over the driver's tables, each with the SQL that DuckDB runs.

Raw texts are made by Spark from the events, so they grow with them; SQL states what must
come out of them from the same events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import context as C
from tidemark.functions import exprs as X
from tidemark.operators import books as B
from tidemark.operators import candles as K
from tidemark.operators import coverage as V
from tidemark.operators import ledger as L
from tidemark.operators import resolve as R
from tidemark.operators import selection as N
from tidemark.operators import sinks as P
from tidemark.operators import stats as S
from tidemark.plans.market import SUMS, TAPE, r6, rounded, stamp
from tidemark.sources import readers as D
from tidemark.sources import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.read(spark, sf_dir, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "page": F.floor(F.col("event_id") / 100), "cents": F.round(F.col("value") * 100).cast("long")})


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages of a hundred trades; every seventh is cut short, every eleventh holds no list."""
    e, at = _events(spark, sf_dir), F.col("event_id")
    amount = F.concat((F.col("cents") / 100).cast("decimal(18,2)").cast("string"))
    trade = F.struct(
        F.when(at % 10 != 0, at.cast("string")).alias("_id"), F.when(at % 17 == 0, F.lit("none")).otherwise(amount).alias("money"), F.when(at % 13 != 0, (1 + at % 4).cast("string")).alias("quantity"), F.col("event_type").alias("itemCode"),
        F.lit("trading").alias("transactionType"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("createdAt"), F.concat(F.lit("u"), F.col("user_id")).alias("buyerId"),
    )
    rows = e.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), trade.alias("t")))).alias("items"))
    whole = F.to_json(F.struct(F.struct(F.struct(F.transform("items", lambda x: x["t"]).alias("items")).alias("data")).alias("result")))
    return rows.select("page", F.when(F.col("page") % 7 == 6, F.substring(whole, 1, 200)).when(F.col("page") % 11 == 10, F.lit('{"result": {"data": {}}}')).otherwise(whole).alias("raw"))


PAGES = "ev AS (SELECT *, event_id // 100 AS page, CAST(round(value * 100) AS BIGINT) AS cents FROM events), ok AS (SELECT * FROM ev WHERE page % 7 <> 6 AND page % 11 <> 10)"


@query("intake_trades", f"""WITH {PAGES} SELECT event_id % 10 = 0 AS derived_id, event_type AS item_code, count(*) AS n, count(*) FILTER (event_id % 17 <> 0) AS with_money, round(sum(CASE WHEN event_id % 17 <> 0 THEN cents / 100.0 END), 6) AS money, CAST(sum(CASE WHEN event_id % 13 <> 0 THEN 1 + event_id % 4 END) AS DOUBLE) AS quantity,
  {stamp('max(ts)')} AS last_at, count(*) FILTER (event_id % 17 <> 0) AS floats FROM ok GROUP BY ALL""")
def intake_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed facts of all readable pages, by item and whether the id had to be made."""
    t = D.trade_facts(_pages(spark, sf_dir))
    out = t.groupBy((F.length("id") == 64).alias("derived_id"), "item_code").agg(
        F.count("*").alias("n"), F.count("money").alias("with_money"), F.sum("money").cast("double").alias("money"), F.sum("quantity").cast("double").alias("quantity"), F.max("created_at").alias("last_at"), F.count_if((F.col("money_precision") == "decoded_float") & F.col("money").isNotNull()).alias("floats")
    )
    return r6(out)


@query("intake_mistyped", """WITH w AS (SELECT event_id // 100 AS page, CASE WHEN event_id % 19 = 0 THEN 'itemCode' END AS a, CASE WHEN event_id % 23 = 0 THEN 'buyerId' END AS b FROM events)
SELECT 'itemCode' AS field, 'BIGINT' AS found, count(a) AS n, count(DISTINCT page) FILTER (a IS NOT NULL) AS pages FROM w UNION ALL SELECT 'buyerId', 'BOOLEAN', count(b), count(DISTINCT page) FILTER (b IS NOT NULL) FROM w""")
def intake_mistyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text fields of raw trades that hold something else, by field and type; nulls and absent fields are none."""
    e, at = _events(spark, sf_dir), F.col("event_id")
    quoted = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    code = F.when(at % 19 == 0, at.cast("string")).otherwise(quoted(F.col("event_type")))
    buyer = F.when(at % 23 == 0, "true").when(at % 5 == 0, "null").otherwise(quoted(F.col("user_id")))
    item = F.concat(F.lit('{"_id":'), quoted(at), F.lit(',"money":1.5,"quantity":"2","itemCode":'), code, F.lit(',"buyerId":'), buyer, F.lit("}"))
    pages = e.groupBy(F.floor(at / 100).alias("page")).agg(F.concat(F.lit('{"result":{"data":{"items":['), F.array_join(F.collect_list(item), ","), F.lit("]}}}")).alias("raw"))
    return D.mistyped_trades(pages).groupBy("field", "found").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"))


@query("intake_rejected", f"""WITH {PAGES}, k AS (SELECT DISTINCT page FROM ev) SELECT 'page' AS what, CASE WHEN page % 7 = 6 THEN 'not_json' ELSE 'no_items' END AS reason, count(*) AS n FROM k WHERE page % 7 = 6 OR page % 11 = 10 GROUP BY ALL
UNION ALL SELECT 'trade', CASE WHEN event_id % 17 = 0 THEN 'invalid_money' ELSE 'invalid_quantity' END, count(*) FROM ok WHERE event_id % 17 = 0 OR event_id % 13 = 0 GROUP BY ALL""")
def intake_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was set aside, whole pages and single trades, by reason."""
    pages = _pages(spark, sf_dir)
    whole = D.malformed_pages(pages).select(F.lit("page").alias("what"), "reason")
    single = R.valid_records(D.trade_facts(pages))[1].select(F.lit("trade").alias("what"), "reason")
    return whole.unionByName(single).groupBy("what", "reason").agg(F.count("*").alias("n"))


@query("intake_leaves", """WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)
SELECT '/a~1b/deep/0/x' AS path, 'number' AS type, count(*) AS n, CAST(sum(cents) AS DOUBLE) AS total FROM e UNION ALL SELECT '/flag', 'boolean', count(*), NULL FROM e UNION ALL SELECT '/name', 'string', count(*), NULL FROM e UNION ALL SELECT '/none', 'null', count(*), NULL FROM e WHERE event_id % 3 = 0""")
def intake_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown scalars of nested texts, by path and type."""
    e = _events(spark, sf_dir)
    raw = F.concat(F.lit('{"a/b": {"deep": [{"x": '), "cents", F.lit('}]}, "__v": 3, "known": 1, "flag": true, "name": "'), "event_type", F.when(F.col("event_id") % 3 == 0, '", "none": null}').otherwise('"}'))
    leaves = D.extra_leaves(D.json_leaves(e.select(F.col("event_id").alias("id"), raw.alias("raw"))), ["/known"])
    return r6(leaves.groupBy("path", "type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("type") == "number", F.col("text").cast("double"))).alias("total")))


@query("intake_presence", "SELECT field, is_null, count(*) AS n FROM (SELECT 'equipment' AS field, event_id % 3 = 0 AS is_null FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT 'equipment.skills', event_id % 2 = 0 FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0) GROUP BY ALL")
def intake_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are there, null or not; what is missing has no row."""
    at = F.col("event_id")
    raw = F.when(at % 5 == 0, "{}").when(at % 3 == 0, '{"item": null}').when(at % 2 == 0, '{"item": {"skills": null}}').otherwise('{"item": {"skills": {"attack": 1}}}')
    found = D.field_presence(_events(spark, sf_dir).select(at.alias("id"), raw.alias("raw")), {"equipment": "$.item", "equipment.skills": "$.item.skills"})
    return found.groupBy("field", "is_null").agg(F.count("*").alias("n"))


@query("intake_books", """WITH o AS (SELECT event_id // 50 AS observation_id, CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, CAST(round(value * 100) AS BIGINT) / 100.0 AS price, 1 + user_id % 50 AS quantity FROM events WHERE event_id % 9 <> 0 AND event_id % 8 <> 7)
SELECT observation_id, side, count(*) AS orders, round(sum(price * quantity), 4) + 0.0 AS value FROM o GROUP BY ALL""")
def intake_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of raw books: those of another item or with a negative price do not count."""
    e, at = _events(spark, sf_dir), F.col("event_id")
    order = F.struct(at.cast("string").alias("_id"), F.when(at % 9 == 0, F.lit("-1")).otherwise((F.col("cents") / 100).cast("decimal(18,2)").cast("string")).alias("price"), (1 + F.col("user_id") % 50).cast("string").alias("quantity"), F.when(at % 8 == 7, "other").otherwise("x").alias("itemCode"))
    side = lambda odd: F.collect_list(F.when(at % 2 == odd, order))
    raw = e.groupBy(F.floor(at / 50).alias("observation_id")).agg(F.to_json(F.struct(F.struct(F.struct(side(0).alias("buyOrders"), side(1).alias("sellOrders")).alias("data")).alias("result"))).alias("raw"))
    out = D.book_orders(raw.withColumn("item_code", F.lit("x"))).groupBy("observation_id", "side").agg(F.count("*").alias("orders"), F.sum(F.col("price").cast("double") * F.col("quantity").cast("double")).alias("value"))
    return r6(out.withColumn("value", F.round("value", 4)))


@query("intake_quotes", f"""SELECT {stamp("date_trunc('day', ts)")} AS observed_at, event_type AS item_code, round(max(value), 6) AS current_price FROM events GROUP BY date_trunc('day', ts), event_type""")
def intake_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).groupBy(F.date_trunc("day", "ts").alias("observed_at"), "event_type").agg(F.max("value").alias("price"))
    payload = e.groupBy("observed_at").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "price"))).alias("prices"))
    return r6(D.quote_rows(payload))


@query("intake_points", "SELECT p_brand AS item_code, CASE WHEN min(p_size) % 3 <> 0 THEN CAST(min(p_size) AS DOUBLE) END AS points FROM part GROUP BY p_brand HAVING max(p_size) % 2 = 0")
def intake_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of tradable items; those without keep a row."""
    p = T.read(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_size").alias("low"), F.max("p_size").alias("high"))
    item = F.struct((F.col("high") % 2 == 0).alias("isTradable"), F.when(F.col("low") % 3 != 0, F.col("low").cast("double")).alias("productionPoints"))
    return D.production_points(p.select(F.create_map("p_brand", item).alias("items")))


@query("market_table", "SELECT p_name AS item_name, round(p_retailprice, 6) + 0.0 AS bid, round(p_retailprice + 1, 6) + 0.0 AS ask, CAST(p_size AS BIGINT) AS trades_7d FROM part")
def market_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of other names, and more than one for the same: the first name in the list counts."""
    p = T.read(spark, sf_dir, "part").select(F.col("p_type").alias("Title"), F.col("p_name").alias(" Item"), F.lit(0.0).alias("Buy Price"), F.col("p_retailprice").alias("Highest Bid"), (F.col("p_retailprice") + 1).alias("lowest-sell"), F.col("p_size").alias("Weekly Trades"), F.lit(1.0).alias("price"))
    out = D.with_aliases(p.toDF(*(D.column_name(c, True) for c in p.columns)))
    return r6(out.select("item_name", "bid", "ask", "trades_7d"))


@query("scan_page_faults", """WITH p AS (SELECT event_id, event_id // 100 AS page, event_id % 100 AS position, TIMESTAMP '2024-02-01' - to_seconds(CAST(event_id - CASE WHEN event_id % 250 = 0 AND event_id > 0 THEN 40 ELSE 0 END AS BIGINT)) AS created_at, CASE WHEN event_id % 333 = 5 THEN 'itemMarket' ELSE 'trading' END AS transaction_type FROM events),
l AS (SELECT *, lag(created_at) OVER (ORDER BY page, position) AS before FROM p) SELECT event_id AS id, CASE WHEN transaction_type <> 'trading' THEN 'wrong_stream' ELSE 'not_descending' END AS reason FROM l WHERE created_at > before OR transaction_type <> 'trading'""")
def scan_page_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    us = F.lit(1_706_745_600) - (at - F.when((at % 250 == 0) & (at > 0), 40).otherwise(0))
    rows = _events(spark, sf_dir).select(at.alias("id"), "page", (at % 100).alias("position"), F.timestamp_seconds(us).alias("created_at"), F.when(at % 333 == 5, "itemMarket").otherwise("trading").alias("transaction_type"))
    return R.page_faults(rows, "trading").select("id", "reason")


@query("scan_completion", f"""WITH p AS (SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC) - 1 AS page, min(ts) AS oldest, max(ts) AS newest FROM events GROUP BY event_type, CAST(ts AS DATE)),
q AS (SELECT *, CASE WHEN stream = 'click' THEN 4 WHEN stream = 'view' THEN 99 ELSE 12 END AS cap, page = max(page) OVER (PARTITION BY stream) AS is_last, max(newest) OVER (PARTITION BY stream) AS anchor FROM p),
r AS (SELECT *, CASE WHEN is_last THEN 'api-exhausted' WHEN stream <> 'view' AND oldest < TIMESTAMP '2024-01-22' THEN 'history-boundary' WHEN stream = 'purchase' AND page >= 2 THEN 'normalized-overlap' WHEN page + 1 >= 5 AND stream = 'click' THEN 'page-cap' END AS reason FROM q)
SELECT stream, reason AS completion_reason, CAST(page + 1 AS BIGINT) AS pages, CASE reason WHEN 'api-exhausted' THEN 'exhausted' WHEN 'page-cap' THEN 'partial' ELSE 'complete' END AS status, {stamp('anchor')} AS "end" FROM r WHERE reason IS NOT NULL QUALIFY page = min(page) OVER (PARTITION BY stream)""")
def scan_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page a day: one scan ends in known coverage, one at its cap, one at the end, others at the boundary."""
    e, day = _events(spark, sf_dir), F.to_date("ts")
    from pyspark.sql import Window

    pages = e.groupBy(F.col("event_type").alias("stream"), day.alias("day")).agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    order = Window.partitionBy("stream").orderBy(F.desc("day"))
    pages = pages.withColumn("page", F.row_number().over(order) - 1).withColumn("has_next", F.col("page") < F.max("page").over(Window.partitionBy("stream")))
    third = pages.where("stream = 'purchase' and page = 2").select("stream", F.lit("2000-01-01").cast("timestamp").alias("start"), (F.col("newest") + F.expr("interval 1 microsecond")).alias("end"))
    parts = [("stream = 'view'", "1990-01-01", 99), ("stream = 'click'", "2024-01-22", 5), ("stream not in ('view', 'click')", "2024-01-22", 999)]
    out = None
    for some, boundary, cap in parts:
        one = R.scan_coverage(pages.where(some), third, F.lit(boundary).cast("timestamp"), cap)
        out = one if out is None else out.unionByName(one)
    return r6(out.select("stream", "completion_reason", F.col("pages").cast("long").alias("pages"), "status", "end"))


# -- selection -------------------------------------------------------------
@query("matched_items", f"WITH {TAPE} SELECT item_code, CASE item_code WHEN 'click' THEN 'CLICK' ELSE 'View' END AS asked_as, count(*) AS n FROM tape WHERE item_code IN ('click', 'view') GROUP BY item_code")
def matched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items asked for in any case; of two that are the same the first counts."""
    t = S.commodities(T.tape(spark, sf_dir))
    asked = spark.createDataFrame([("CLICK", 0), ("View", 1), ("click", 2)], "code string, position int")
    return N.match_items(t, asked).groupBy("item_code", "asked_as").agg(F.count("*").alias("n"))


@query("nested_trades", f"""WITH {T.LEDGER_SQL} SELECT id, CASE WHEN buy_user_id IS NOT NULL THEN buy_user_id END AS buyer, sell_mu_id AS seller_mu, CASE WHEN transaction_type = 'itemMarket' THEN 'gear' || (id % 4) END AS equipment_code, CASE WHEN transaction_type = 'itemMarket' AND id % 7 <> 0 THEN id % 3 END AS attack FROM ledger_trades""")
def nested_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades put together again from their child tables."""
    t = T.ledger_trades(spark, sf_dir)
    side = lambda s: t.select("id", F.lit(s).alias("side"), *(F.col(f"{s}_{k}_id").alias(f"{k}_id") for k in L.KINDS))
    gear = t.where("equipment is not null").select("id", "equipment.equipment_code", "equipment.state")
    stats = t.where("equipment.stats is not null").select("id", F.explode("equipment.stats").alias("skill", "value"))
    out = N.nest_trades(t.select("id", "created_at"), side("buy").unionByName(side("sell")), gear, stats)
    return out.select("id", F.col("parties")["buy"]["user_id"].alias("buyer"), F.col("parties")["sell"]["mu_id"].alias("seller_mu"), F.col("equipment.equipment_code").alias("equipment_code"), F.col("equipment.stats")["attack"].alias("attack"))


@query("live_annotations", "SELECT event_id AS id FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND (event_id % 4 = 0 OR event_id % 7 = 0)")
def live_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("event_id")
    notes = _events(spark, sf_dir).select(at.alias("id"), F.when(at % 2 == 0, "live").otherwise("draft").alias("status"), F.when(at % 3 != 0, "production").otherwise("test").alias("environment"), F.when(at % 5 != 0, "x").alias("source"), F.col("ts").alias("effective_at"), F.when(at % 4 == 0, F.array(F.lit("broad"))).when(at % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("other"))).alias("index_keys"))
    return N.live_annotations(notes, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"), "broad").select("id")


@query("stream_status", f"""WITH {TAPE}, r AS (SELECT transaction_type AS stream, count(*) AS retained, count(unit_price) AS normalized, max(created_at) AS last FROM all_trades GROUP BY 1)
SELECT stream, retained, normalized, stream = 'trading' AS covered, false AS all_covered FROM r""")
def stream_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each stream, and whether it was followed without loss: one had a rejected record."""
    t = T.tape(spark, sf_dir)
    streams = t.groupBy(F.col("transaction_type").alias("stream")).agg(F.min("created_at").alias("start"), F.max("created_at").alias("end"))
    progress = streams.select("stream", F.lit("complete").alias("status"), (F.col("stream") == "itemMarket").cast("int").alias("rejected"), F.lit(None).cast("string").alias("error"))
    low, high = F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")
    out = N.stream_coverage(V.reached(streams, low, ["stream"]), N.sync_status(progress, t), high)
    return out.select("stream", "retained", "normalized", "covered", "all_covered")


@query("coverage_of_asked", """WITH s AS (SELECT DISTINCT event_type AS item_code, date_trunc('hour', ts) AS h FROM events WHERE extract(hour FROM ts) <> 5), a AS (SELECT DISTINCT event_type AS item_code FROM events UNION SELECT DISTINCT n_name FROM nation)
SELECT item_code, count(h) = 3 AS covered FROM a LEFT JOIN (SELECT * FROM s WHERE h IN (TIMESTAMP '2024-01-10 07:00:00', TIMESTAMP '2024-01-10 08:00:00', TIMESTAMP '2024-01-10 09:00:00')) USING (item_code) GROUP BY item_code""")
def coverage_of_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without any interval are asked for too: they are not covered."""
    e = _events(spark, sf_dir).where(F.hour("ts") != 5)
    hour = F.date_trunc("hour", "ts")
    scans = e.select(F.col("event_type").alias("item_code"), hour.alias("start"), (hour + F.expr("interval 1 hour")).alias("end")).distinct()
    asked = e.select(F.col("event_type").alias("item_code")).union(T.read(spark, sf_dir, "nation").select("n_name"))
    return V.covers(scans, ["item_code"], F.lit("2024-01-10 07:00:00").cast("timestamp"), F.lit("2024-01-10 10:00:00").cast("timestamp"), asked)


# -- rules and publication -------------------------------------------------
@query("settlements", f"""WITH {T.LEDGER_SQL} SELECT id, round(CASE WHEN verified THEN CASE role WHEN 'gross' THEN money ELSE money - fee END END, 6) + 0.0 AS buy_gross, round(CASE WHEN verified THEN CASE role WHEN 'settled' THEN money ELSE money + fee END END, 6) + 0.0 AS buy_net,
  round(CASE WHEN verified THEN CASE role WHEN 'gross' THEN money ELSE money + fee END END, 6) + 0.0 AS sell_gross, round(CASE WHEN verified THEN CASE role WHEN 'settled' THEN money ELSE money - fee END END, 6) + 0.0 AS sell_net, verified AND (role = 'settled' OR fee IS NOT NULL) AS fee_known FROM ledger_trades""")
def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    paid = lambda s: X.settlement("money", "settlement_verified", "settlement_role", "settlement_fee", s)
    t = T.ledger_trades(spark, sf_dir).withColumns({"b": paid("buy"), "s": paid("sell")})
    return r6(t.select("id", F.col("b.gross").alias("buy_gross"), F.col("b.net").alias("buy_net"), F.col("s.gross").alias("sell_gross"), F.col("s.net").alias("sell_net"), X.fee_known("settlement_verified", "settlement_role", "settlement_fee").alias("fee_known")))


@query("book_labels", f"""WITH {SUMS} SELECT item_code, {stamp('observed_at')} AS observed_at, CASE WHEN pressure_pct IS NULL THEN '—' WHEN pressure_pct > 5 THEN 'Buy-heavy' WHEN pressure_pct < -5 THEN 'Sell-heavy' ELSE 'Balanced' END AS pressure,
  CASE WHEN best_ask > best_bid THEN CASE WHEN (mid_price - 45) / 10 * 100 <= 33 THEN 'Near floor' WHEN (mid_price - 45) / 10 * 100 <= 66 THEN 'Middle' ELSE 'Near ceiling' END ELSE 'N/A' END AS place, CASE WHEN imbalance_pct > 0.5 THEN '▲' WHEN imbalance_pct < -0.5 THEN '▼' WHEN imbalance_pct IS NULL THEN 'N/A' ELSE '●' END AS arrow FROM sums""")
def book_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.summaries(B.merged_levels(T.book_levels(spark, sf_dir)))
    place = X.position_label(X.range_position_pct(F.when(F.col("best_ask") > F.col("best_bid"), F.col("mid_price")), F.lit(45.0), F.lit(55.0)))
    return r6(s.select("item_code", "observed_at", X.pressure_label("pressure_pct").alias("pressure"), place.alias("place"), X.change_arrow("imbalance_pct").alias("arrow")))


@query("sql_rules", "SELECT p_partkey, CASE WHEN p_retailprice > 0 THEN (p_retailprice / 1000 - 1) * 100 END > 10 AS dear, CASE WHEN p_size - 25 > 0.1 THEN 'Inflation' WHEN p_size - 25 < -0.1 THEN 'Deflation' ELSE 'Stable' END AS class FROM part")
def sql_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as functions of a SQL text."""
    X.register(spark)
    return spark.sql("SELECT p_partkey, market_price_gap_pct(p_retailprice, 1000) > 10 AS dear, market_inflation_class(p_size - 25) AS class FROM {part}", part=T.read(spark, sf_dir, "part"))


@query("external_candles", "SELECT p_partkey AS id, round(p_retailprice, 6) + 0.0 AS open, round(p_retailprice + 1, 6) + 0.0 AS close, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 0 END AS volume FROM part WHERE p_partkey % 5 <> 0")
def external_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles from elsewhere: names in any case, volume 0 where missing, rows without a price dropped."""
    p = T.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ID"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("Open"), F.col("p_retailprice").alias("HIGH"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 1).alias(" Close"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("double")).alias("Volume"))
    return r6(K.normalized_ohlc(p).select("id", "open", "close", "volume"))


@query("published_text", "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '''=' || event_type WHEN event_id % 3 = 1 THEN ''' +' || event_type ELSE event_type END AS s_text, CAST(-event_id AS BIGINT) AS s_number FROM events")
def published_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested rows as they are published: flat, and no text that a spreadsheet would run."""
    at, kind = F.col("event_id"), F.col("event_type")
    text = F.when(at % 3 == 0, F.concat(F.lit("="), kind)).when(at % 3 == 1, F.concat(F.lit(" +"), kind)).otherwise(kind)
    return P.publishable(_events(spark, sf_dir).select(at.alias("id"), F.struct(text.alias("text"), (-at).alias("number")).alias("s")))


@query("publication_check", f"""WITH {TAPE}, d AS (SELECT item_code, round(sum(money), 4) AS money FROM tape GROUP BY item_code) SELECT 'rows' AS what, item_code, CASE WHEN b THEN 'published' ELSE 'source' END AS only_in FROM (SELECT item_code, unnest([true, false]) AS b FROM d WHERE item_code = 'view') UNION ALL SELECT 'totals', 'view', NULL""")
def publication_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table with one wrong row: it is found by rows and by totals."""
    source = S.commodities(T.tape(spark, sf_dir)).groupBy("item_code").agg(F.round(F.sum("money"), 4).alias("money"))
    published = source.withColumn("money", F.when(F.col("item_code") == "view", F.col("money") + 1).otherwise(F.col("money")))
    rows = P.differences(published, source).select(F.lit("rows").alias("what"), "item_code", "only_in")
    totals = P.account_totals(published, source, ["item_code"], "money").select(F.lit("totals").alias("what"), "item_code", F.lit(None).cast("string").alias("only_in"))
    return rows.unionByName(totals)


@query("retention_progress", f"""WITH p AS (SELECT event_type AS stream, min(ts) AS oldest FROM events GROUP BY event_type) SELECT stream, CASE WHEN oldest < TIMESTAMP '2024-01-01 01:00:00' THEN 'partial' ELSE 'complete' END AS status, CASE WHEN oldest >= TIMESTAMP '2024-01-01 01:00:00' THEN {stamp('oldest')} END AS oldest_at FROM p""")
def retention_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _events(spark, sf_dir).groupBy(F.col("event_type").alias("stream")).agg(F.min("ts").alias("oldest_at")).withColumn("status", F.lit("complete"))
    return r6(V.progress_after(p, F.lit("2024-01-01 01:00:00").cast("timestamp")).select("stream", "status", "oldest_at"))


@query("upstream_points", "SELECT item_code, CASE WHEN item_code IN ('Brand#1', 'Brand#25') THEN CASE item_code WHEN 'Brand#1' THEN 10.0 ELSE 20.0 END END AS points FROM (SELECT DISTINCT p_brand AS item_code FROM part)")
def upstream_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by code whatever its marks and case, from a table of any length."""
    codes = T.read(spark, sf_dir, "part").select(F.col("p_brand").alias("item_code")).distinct()
    return codes.select("item_code", X.production_points("item_code", {"brand1": 10, "brand25": 20}).alias("points"))
