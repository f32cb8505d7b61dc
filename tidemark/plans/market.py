"""Market queries over the driver's tables, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import context as C
from tidemark.functions import exprs as X
from tidemark.operators import books as B
from tidemark.operators import candles as K
from tidemark.operators import forecast as P
from tidemark.operators import stats as S
from tidemark.session import stored
from tidemark.sources import tables as T

QUERIES, SQL = {}, {}
TAPE, LONG, BOOK, QUOTES = T.TAPE_SQL, T.LONG_TAPE_SQL, T.BOOK_SQL, T.QUOTES_SQL
#: Merged levels, summaries and ends of windows for DuckDB.
LEVELS = BOOK + """, levels AS (SELECT item_code, observed_at, side, price, sum(quantity) AS quantity FROM book_levels
  WHERE price > 0 AND quantity >= 0 GROUP BY ALL HAVING sum(quantity) > 0)"""
SUMS = LEVELS + """, sums AS (SELECT *, (best_bid + best_ask) / 2 AS mid_price, best_ask - best_bid AS spread_abs,
  CASE WHEN (best_bid + best_ask) / 2 > 0 THEN (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 100 END AS spread_pct,
  CASE WHEN bid_depth + ask_depth > 0 THEN (bid_depth - ask_depth) / (bid_depth + ask_depth) * 100 END AS imbalance_pct,
  CASE WHEN bid_value + ask_value > 0 THEN (bid_value - ask_value) / (bid_value + ask_value) * 100 END AS pressure_pct
  FROM (SELECT item_code, observed_at, max(CASE WHEN side = 'bid' THEN price END) AS best_bid, min(CASE WHEN side = 'ask' THEN price END) AS best_ask,
    coalesce(sum(CASE WHEN side = 'bid' THEN quantity END), 0) AS bid_depth, coalesce(sum(CASE WHEN side = 'ask' THEN quantity END), 0) AS ask_depth,
    coalesce(sum(CASE WHEN side = 'bid' THEN price * quantity END), 0) AS bid_value, coalesce(sum(CASE WHEN side = 'ask' THEN price * quantity END), 0) AS ask_value
    FROM levels GROUP BY ALL))"""
CLOCK = "clock AS (SELECT max(created_at) AS c FROM all_trades)"
CANDLES = TAPE + """, bars AS (SELECT item_code, time_bucket(INTERVAL '4 hours', created_at, TIMESTAMP '1970-01-01') AS candle_at,
  arg_min(unit_price, (created_at, id)) AS open, max(unit_price) AS high, min(unit_price) AS low, arg_max(unit_price, (created_at, id)) AS close, sum(quantity) AS volume
  FROM tape WHERE unit_price > 0 AND unit_price < 1e308 AND quantity > 0 AND quantity < 1e308 GROUP BY ALL)"""


def query(name: str, sql: str | None = None):
    """Register a query; its SQL is DuckDB's."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, counts as long, times as text: the same on both engines."""
    def cast(field) -> Column:
        kind, c = field.dataType.simpleString(), F.col(field.name)
        if kind in {"double", "float"}:
            return (F.round(c, 6) + F.lit(0.0)).alias(field.name)
        if kind in {"int", "smallint", "tinyint"}:
            return c.cast("long").alias(field.name)
        if kind == "timestamp":
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(field.name)
        if kind == "date":
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        return c
    return df.select(*map(cast, df.schema.fields))


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


# -- statistics ------------------------------------------------------------
@query("daily_facts", f"""WITH {TAPE} SELECT item_code, {day('CAST(created_at AS DATE)')} AS day, round(sum(quantity), 6) AS quantity, round(sum(unit_price * quantity), 6) AS turnover,
  count(*) AS trades, {stamp('max(created_at)')} AS last_at FROM tape WHERE unit_price > 0 AND unit_price < 1e308 AND quantity > 0 AND quantity < 1e308 GROUP BY item_code, CAST(created_at AS DATE)""")
def daily_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.daily_facts(T.tape(spark, sf_dir)))


#: What follows the tape and the book summaries; every item has a row for every horizon.
STATS_TAIL = f"""{CLOCK}, {QUOTES}, h AS (SELECT * FROM (VALUES ('1D', 1), ('7D', 7), ('30D', 30)) v(horizon, days)),
item_list AS (SELECT item_code FROM tape UNION SELECT item_code FROM quotes UNION SELECT item_code FROM sums),
rows_ AS (SELECT h.horizon, t.* FROM tape t, clock, h WHERE created_at >= c - to_days(CAST(days AS INTEGER)) AND created_at <= c),
last5 AS (SELECT item_code, horizon, avg(unit_price) AS rolling_average FROM (SELECT *, row_number() OVER (PARTITION BY item_code, horizon ORDER BY created_at DESC, id DESC) AS rn FROM rows_ WHERE unit_price IS NOT NULL) WHERE rn <= 5 GROUP BY ALL),
traded AS (SELECT item_code, horizon, count(*) AS n_all, count(unit_price) AS n_priced, count(DISTINCT CASE WHEN unit_price IS NOT NULL THEN date_trunc('second', created_at) END) AS n_times,
  sum(quantity) AS q_all, sum(money) AS m_all, min(unit_price) AS min, max(unit_price) AS max, avg(unit_price) AS average,
  sum(CASE WHEN quantity > 0 THEN unit_price * quantity END) / sum(CASE WHEN quantity > 0 AND unit_price IS NOT NULL THEN quantity END) AS vwap,
  arg_min(unit_price, (created_at, id)) FILTER (WHERE unit_price IS NOT NULL) AS open, arg_max(unit_price, (created_at, id)) FILTER (WHERE unit_price IS NOT NULL) AS close,
  quantile_cont(unit_price, 0.1) AS price_p10, quantile_cont(unit_price, 0.25) AS price_p25, quantile_cont(unit_price, 0.5) AS median, quantile_cont(unit_price, 0.9) AS price_p90 FROM rows_ GROUP BY item_code, horizon),
lastp AS (SELECT item_code, arg_max(unit_price, (created_at, id)) AS last_trade_price FROM tape, clock WHERE unit_price IS NOT NULL AND created_at >= c - INTERVAL 90 DAYS GROUP BY item_code),
lastq AS (SELECT item_code, arg_max(current_price, (observed_at, id)) AS quote_price FROM quotes GROUP BY item_code),
lastb AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY item_code ORDER BY observed_at DESC) = 1),
spreads AS (SELECT item_code, horizon, avg(spread_abs) AS average_spread, avg(spread_pct) AS average_spread_pct FROM sums, clock, h WHERE observed_at >= c - to_days(CAST(days AS INTEGER)) AND observed_at <= c GROUP BY ALL),
base AS (SELECT i.item_code, h.horizon, coalesce(n_all, 0) AS trade_count, coalesce(n_priced, 0) AS priced_trade_count, coalesce(n_times, 0) AS distinct_trade_timestamp_count, coalesce(q_all, 0) AS volume, coalesce(m_all, 0) AS traded_value,
  min, max, average, vwap, open, close, price_p10, price_p25, median, price_p90, rolling_average, last_trade_price, quote_price, average_spread, average_spread_pct, best_bid AS latest_bid, best_ask AS latest_ask, bid_depth AS latest_bid_depth, ask_depth AS latest_ask_depth, b.spread_abs AS latest_spread, b.spread_pct AS latest_spread_pct,
  (best_bid + best_ask) / 2 AS mid_price, CASE WHEN last_trade_price <> 0 THEN (quote_price - last_trade_price) / last_trade_price * 100 END AS quote_gap_pct, CASE WHEN coalesce(bid_depth, 0) + coalesce(ask_depth, 0) > 0 THEN (coalesce(bid_depth, 0) - coalesce(ask_depth, 0)) / (coalesce(bid_depth, 0) + coalesce(ask_depth, 0)) * 100 END AS depth_imbalance_pct,
  CASE WHEN coalesce(bid_depth, 0) + coalesce(ask_depth, 0) > 0 THEN (coalesce(bid_depth, 0) + coalesce(ask_depth, 0)) / (1 + greatest(coalesce(b.spread_pct, 0), 0.5) / 100) ELSE 0 END AS liquidity
  FROM item_list i CROSS JOIN h LEFT JOIN traded t ON t.item_code = i.item_code AND t.horizon = h.horizon LEFT JOIN last5 l ON l.item_code = i.item_code AND l.horizon = h.horizon LEFT JOIN spreads s ON s.item_code = i.item_code AND s.horizon = h.horizon
  LEFT JOIN lastp p ON p.item_code = i.item_code LEFT JOIN lastq q ON q.item_code = i.item_code LEFT JOIN lastb b ON b.item_code = i.item_code),
stats AS (SELECT *, volume AS traded_quantity, last_trade_price AS latest_price, last_trade_price AS current_price, (close - open) AS change_abs, CASE WHEN priced_trade_count >= 2 AND distinct_trade_timestamp_count >= 2 AND open > 0 THEN (close - open) / open * 100 END AS percent_change,
  close - rolling_average AS distance_from_rolling_average, CASE WHEN rolling_average > 0 THEN (close - rolling_average) / rolling_average * 100 END AS distance_from_rolling_average_pct,
  (coalesce(0.5 * vwap, 0) + coalesce(0.3 * median, 0) + coalesce(0.2 * rolling_average, 0)) / nullif(CASE WHEN vwap IS NULL THEN 0 ELSE 0.5 END + CASE WHEN median IS NULL THEN 0 ELSE 0.3 END + CASE WHEN rolling_average IS NULL THEN 0 ELSE 0.2 END, 0) AS stable_fair_price,
  CASE WHEN median > 0 THEN (price_p90 - price_p10) / median * 100 END AS stable_range_pct FROM base),
labelled AS (SELECT *, CASE WHEN len(found) > 0 THEN array_to_string(found, ',') ELSE 'Stable' END AS tendency_labels, CASE WHEN len(found) > 0 THEN found[1] ELSE 'Stable' END AS tendency FROM (SELECT *, list_filter([
  CASE WHEN trade_count < 3 OR volume <= 0 THEN 'Thin' END, CASE WHEN (close - open) / open * 100 >= 2 AND close >= rolling_average THEN 'Rising' END,
  CASE WHEN (close - open) / open * 100 <= -2 AND close <= rolling_average THEN 'Falling' END, CASE WHEN stable_range_pct >= 12 THEN 'Volatile' END,
  CASE WHEN stable_range_pct <= 3 THEN 'Range-bound' END, CASE WHEN stable_range_pct <= 3 AND trade_count >= 3 AND volume > 0 AND coalesce(latest_spread_pct <= 3, true) THEN 'Stable' END], lambda x: x IS NOT NULL) AS found FROM stats))"""
STATS = f"{TAPE}, {SUMS}, {STATS_TAIL}"
COUNTS = ("trade_count", "priced_trade_count", "distinct_trade_timestamp_count")
MEASURES = (
    "volume", "traded_quantity", "traded_value", "min", "max", "average", "vwap", "open", "close", "price_p10", "price_p25", "median", "price_p90", "rolling_average", "change_abs", "percent_change", "distance_from_rolling_average", "distance_from_rolling_average_pct", "stable_fair_price", "stable_range_pct",
    "last_trade_price", "latest_price", "current_price", "quote_price", "mid_price", "quote_gap_pct", "latest_bid", "latest_ask", "latest_bid_depth", "latest_ask_depth", "latest_spread", "latest_spread_pct", "depth_imbalance_pct", "average_spread", "average_spread_pct", "liquidity",
)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tape(spark, sf_dir)
    return S.window_stats(t, C.resolve(None, (t, "created_at")), quotes=T.quotes(spark, sf_dir), books=B.summaries(B.merged_levels(T.book_levels(spark, sf_dir))))


@query("window_stats", f"WITH {STATS} SELECT item_code, horizon, {', '.join(COUNTS)}, {rounded(*MEASURES)}, tendency, tendency_labels FROM labelled")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _stats(spark, sf_dir).withColumn("tendency_labels", F.array_join("tendency_labels", ","))
    return r6(out.select("item_code", "horizon", *COUNTS, *MEASURES, "tendency", "tendency_labels"))


@query("window_stats_long", f"""WITH {TAPE}, {CLOCK}, h AS (SELECT * FROM (VALUES ('3D', 3), ('90D', 90), ('1Y', 365)) v(horizon, days)), i AS (SELECT DISTINCT item_code FROM tape),
r AS (SELECT item_code, horizon, count(*) AS n, sum(money) AS v FROM tape, clock, h WHERE created_at >= c - to_days(CAST(days AS INTEGER)) GROUP BY ALL)
SELECT item_code, horizon, coalesce(n, 0) AS trade_count, round(coalesce(v, 0), 6) AS traded_value FROM i CROSS JOIN h LEFT JOIN r USING (item_code, horizon)""")
def window_stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tape(spark, sf_dir)
    return r6(S.window_stats(t, C.resolve(None, (t, "created_at")), S.horizons(3, "90d", "1Y")).select("item_code", "horizon", "trade_count", "traded_value"))


FLAT = ("vwap", "median", "percent_change", "trade_count")


@query("window_stats_flat", f"WITH {STATS} SELECT item_code, " + ", ".join(f"round(CAST(max(CASE WHEN horizon = '{h}' THEN {m} END) AS DOUBLE), 6) + 0.0 AS {m}_{h.lower()}" for m in FLAT for h in S.HORIZONS) + " FROM stats GROUP BY item_code")
def window_stats_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = S.flatten_horizons(_stats(spark, sf_dir), list(FLAT))
    return r6(flat.select("item_code", *(F.col(c).cast("double") for c in flat.columns if c != "item_code")))


@query("trend_patterns", f"""WITH {STATS}, p AS (SELECT item_code, max(CASE WHEN horizon = '1D' THEN percent_change END) AS a, max(CASE WHEN horizon = '7D' THEN percent_change END) AS b, max(CASE WHEN horizon = '30D' THEN percent_change END) AS c FROM stats GROUP BY item_code),
w AS (SELECT item_code, list_filter([a, b, c], lambda x: x IS NOT NULL) AS u, a, list_filter([b, c], lambda x: x IS NOT NULL) AS l FROM p),
n AS (SELECT *, len(u) AS k, len(list_filter(u, lambda x: x > 0.5)) AS ups, len(list_filter(u, lambda x: x < -0.5)) AS downs, len(list_filter(l, lambda x: x > 0.5)) AS lu, len(list_filter(l, lambda x: x < -0.5)) AS ld FROM w)
SELECT item_code, CASE WHEN k < 2 THEN 'Insufficient history' WHEN ups + downs = 0 THEN 'Flat' WHEN ups >= 2 AND downs = 0 THEN 'Persistent rise' WHEN downs >= 2 AND ups = 0 THEN 'Persistent fall'
  WHEN a > 0.5 AND ld > 0 AND lu = 0 THEN 'Rebound' WHEN a < -0.5 AND lu > 0 AND ld = 0 THEN 'Pullback' ELSE 'Mixed' END AS pattern FROM n""")
def trend_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = S.flatten_horizons(_stats(spark, sf_dir), ["percent_change"])
    return flat.select("item_code", X.trend_pattern("percent_change_1d", "percent_change_7d", "percent_change_30d").alias("pattern"))


@query("weighted_median", f"""WITH {LONG}, m AS (SELECT item_code, unit_price, sum(quantity) AS q FROM long_tape WHERE unit_price > 0 AND quantity > 0 GROUP BY ALL),
c AS (SELECT *, sum(q) OVER (PARTITION BY item_code ORDER BY unit_price) AS cum, sum(q) OVER (PARTITION BY item_code) AS total FROM m)
SELECT item_code, round(min(unit_price), 6) AS representative_price FROM c WHERE cum >= total / 2 GROUP BY item_code""")
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.weighted_median(T.long_tape(spark, sf_dir), ["item_code"]))


@query("period_prices", f"""WITH {TAPE}, e AS (SELECT item_code, CAST(created_at AS DATE) AS d, coalesce(unit_price > 0 AND quantity > 0, false) AS ok, * EXCLUDE (item_code) FROM tape),
m AS (SELECT item_code, d, unit_price, sum(quantity) AS q FROM e WHERE ok GROUP BY ALL),
c AS (SELECT *, sum(q) OVER (PARTITION BY item_code, d ORDER BY unit_price) AS cum, sum(q) OVER (PARTITION BY item_code, d) AS total FROM m),
w AS (SELECT item_code, d, min(unit_price) AS representative_price FROM c WHERE cum >= total / 2 GROUP BY ALL)
SELECT item_code, {day('d')} AS day, count(*) FILTER (ok) AS trades, count(*) FILTER (NOT ok) AS excluded, round(sum(quantity) FILTER (ok), 6) AS quantity, round(sum(unit_price * quantity) FILTER (ok), 6) AS value,
  {stamp('min(created_at) FILTER (ok)')} AS first_at, {stamp('max(created_at) FILTER (ok)')} AS last_at, round(any_value(representative_price), 6) AS representative_price FROM e LEFT JOIN w USING (item_code, d) GROUP BY item_code, d""")
def period_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tape(spark, sf_dir).withColumn("day", F.to_date("created_at"))
    return r6(S.period_prices(t, ["item_code", "day"]))


@query("daily_last_price", f"WITH {TAPE} SELECT item_code, {day('CAST(created_at AS DATE)')} AS day, round(arg_max(unit_price, (created_at, id)), 6) AS price, {stamp('max(created_at)')} AS at FROM tape WHERE unit_price IS NOT NULL GROUP BY item_code, CAST(created_at AS DATE)")
def daily_last_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.daily_last(T.tape(spark, sf_dir)))


@query("path_segments", f"""WITH {TAPE}, p AS (SELECT item_code, created_at AS "at" FROM tape WHERE unit_price IS NOT NULL),
l AS (SELECT item_code, max("at") AS "at" FROM p GROUP BY item_code, CAST("at" AS DATE)),
g AS (SELECT *, CASE WHEN epoch_us("at") - lag(epoch_us("at")) OVER (PARTITION BY item_code ORDER BY "at") > 86400000000 THEN 1 ELSE 0 END AS b FROM l),
s AS (SELECT *, sum(b) OVER (PARTITION BY item_code ORDER BY "at") AS segment FROM g)
SELECT item_code, CAST(segment AS BIGINT) AS segment, count(*) AS points, {stamp('min("at")')} AS first_at, {stamp('max("at")')} AS last_at FROM s GROUP BY item_code, segment HAVING count(*) >= 2""")
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = S.path_segments(S.daily_last(T.tape(spark, sf_dir)))
    return r6(out.groupBy("item_code", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("points"), F.min("at").alias("first_at"), F.max("at").alias("last_at")))


# -- candles ---------------------------------------------------------------
BAR = rounded("open", "high", "low", "close", "volume")


@query("candles_4h", f"WITH {CANDLES} SELECT item_code, {stamp('candle_at')} AS candle_at, {BAR} FROM bars")
def candles_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(K.candles(T.tape(spark, sf_dir)))


@query("chart_candles_1d", f"""WITH {TAPE} SELECT item_code, {stamp("date_trunc('day', created_at)")} AS candle_at, round(arg_min(unit_price, (created_at, id)), 6) AS open, round(max(unit_price), 6) AS high, round(min(unit_price), 6) AS low,
  round(arg_max(unit_price, (created_at, id)), 6) AS close, round(sum(greatest(coalesce(quantity, 1), 0)), 6) AS volume FROM tape WHERE unit_price IS NOT NULL GROUP BY item_code, date_trunc('day', created_at)""")
def chart_candles_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(K.chart_candles(T.tape(spark, sf_dir)))


@query("candle_gate", f"WITH {CANDLES} SELECT item_code, count(*) AS candles, count(DISTINCT CAST(candle_at AS DATE)) AS days FROM bars GROUP BY item_code HAVING count(*) >= 12 AND count(DISTINCT CAST(candle_at AS DATE)) >= 3")
def candle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sufficient(K.candles(T.tape(spark, sf_dir)))


@query("sma_7d", f"""WITH {CANDLES} SELECT item_code, {stamp('candle_at')} AS candle_at, round(CASE WHEN count(close) OVER w >= 6 THEN avg(close) OVER w END, 6) + 0.0 AS sma_7d FROM bars
  WINDOW w AS (PARTITION BY item_code ORDER BY candle_at RANGE BETWEEN INTERVAL '604799999999 microseconds' PRECEDING AND CURRENT ROW)""")
def sma_7d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(K.sma_7d(K.candles(T.tape(spark, sf_dir))).select("item_code", "candle_at", "sma_7d"))


@query("ma_crosses", f"""WITH {CANDLES}, m AS (SELECT *, CASE WHEN count(close) OVER w >= 4 THEN avg(close) OVER w END AS ma FROM bars WINDOW w AS (PARTITION BY item_code ORDER BY candle_at ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
l AS (SELECT *, lag(close) OVER (PARTITION BY item_code ORDER BY candle_at) AS pc, lag(ma) OVER (PARTITION BY item_code ORDER BY candle_at) AS pm FROM m)
SELECT item_code, {stamp('candle_at')} AS candle_at, round(ma, 6) + 0.0 AS ma, coalesce(pc <= pm AND close > ma, false) AS cross_up, coalesce(pc >= pm AND close < ma, false) AS cross_down FROM l""")
def ma_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(K.crosses(K.candles(T.tape(spark, sf_dir))).select("item_code", "candle_at", "ma", "cross_up", "cross_down"))


@query("spread_on_candles", f"""WITH {CANDLES}, {SUMS}, m AS (SELECT item_code, time_bucket(INTERVAL '4 hours', observed_at, TIMESTAMP '1970-01-01') AS candle_at, avg(spread_pct) AS s FROM sums GROUP BY ALL)
SELECT item_code, {stamp('candle_at')} AS candle_at, round(last_value(s IGNORE NULLS) OVER (PARTITION BY item_code ORDER BY candle_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS spread_pct FROM bars LEFT JOIN m USING (item_code, candle_at)""")
def spread_on_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, sums = K.candles(T.tape(spark, sf_dir)), B.summaries(B.merged_levels(T.book_levels(spark, sf_dir)))
    return r6(K.aligned_spread(bars, sums, "4 hours").select("item_code", "candle_at", "spread_pct"))


# -- books -----------------------------------------------------------------
def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.merged_levels(T.book_levels(spark, sf_dir))


@query("book_levels_merged", f"WITH {LEVELS} SELECT item_code, {stamp('observed_at')} AS observed_at, side, {rounded('price', 'quantity')} FROM levels")
def book_levels_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_levels(spark, sf_dir))


BOOK_COLS = ("best_bid", "best_ask", "bid_depth", "ask_depth", "bid_value", "ask_value", "mid_price", "spread_abs", "spread_pct", "imbalance_pct", "pressure_pct")


@query("book_summaries", f"""WITH {SUMS} SELECT item_code, {stamp('observed_at')} AS observed_at, {rounded(*BOOK_COLS)},
  round(CASE WHEN bid_depth + ask_depth > 0 THEN (bid_depth + ask_depth) / (1 + greatest(coalesce(spread_pct, 0.5), 0.5) / 100) ELSE 0 END, 6) + 0.0 AS liquidity FROM sums""")
def book_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(B.summaries(_levels(spark, sf_dir)).select("item_code", "observed_at", *BOOK_COLS, "liquidity"))


DEPTH = SUMS + """, d AS (SELECT *, row_number() OVER w AS position, sum(quantity) OVER w AS cum_quantity, sum(price * quantity) OVER w AS cum_value FROM levels
  WINDOW w AS (PARTITION BY item_code, observed_at, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("book_depth", f"""WITH {DEPTH} SELECT item_code, {stamp('observed_at')} AS observed_at, side, CAST(position AS BIGINT) AS position, {rounded('price', 'cum_quantity', 'cum_value')},
  row_number() OVER (PARTITION BY item_code, observed_at, side ORDER BY quantity DESC, position) = 1 AS is_wall FROM d""")
def book_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(B.depth(_levels(spark, sf_dir)).select("item_code", "observed_at", "side", "position", "price", "cum_quantity", "cum_value", "is_wall"))


SWEEP = DEPTH + """, sw AS (SELECT *, CASE WHEN filled > 0 THEN gross / filled END AS vwap FROM (SELECT item_code, observed_at, side, sum(fill) AS filled, sum(fill * price) AS gross, arg_min(price, position) AS best,
  arg_max(price, position) FILTER (fill > 0) AS worst FROM (SELECT *, greatest(0, least(quantity, 40 - (cum_quantity - quantity))) AS fill FROM d) GROUP BY ALL))"""


@query("book_sweep", f"""WITH {SWEEP} SELECT item_code, {stamp('observed_at')} AS observed_at, side, {rounded('filled', 'vwap', 'best', 'worst')}, round(40 - filled, 6) + 0.0 AS unfilled, filled >= 40 * (1 - 1e-12) AS fully_filled,
  round(CASE WHEN side = 'ask' THEN vwap - best ELSE best - vwap END, 6) + 0.0 AS slippage_abs, round(CASE WHEN side = 'ask' THEN vwap - best ELSE best - vwap END / best * 100, 6) + 0.0 AS slippage_pct FROM sw""")
def book_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(B.sweep(_levels(spark, sf_dir), 40.0).select("item_code", "observed_at", "side", "filled", "vwap", "best", "worst", "unfilled", "fully_filled", "slippage_abs", "slippage_pct"))


@query("book_nested", f"""WITH {LEVELS} SELECT item_code, {stamp('observed_at')} AS observed_at,
  coalesce(string_agg(CASE WHEN side = 'bid' THEN CAST(CAST(round(price * 10) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) END, ' ' ORDER BY price DESC), '') AS bids,
  coalesce(string_agg(CASE WHEN side = 'ask' THEN CAST(CAST(round(price * 10) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) END, ' ' ORDER BY price), '') AS asks FROM levels GROUP BY ALL""")
def book_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.round(x["price"] * 10).cast("long").cast("string"), F.lit("x"), x["quantity"].cast("long").cast("string"))), " ").alias(c)
    return r6(B.nested(_levels(spark, sf_dir)).select("item_code", "observed_at", text("bids"), text("asks")))


@query("book_history", f"""WITH {DEPTH}, kept AS (SELECT * FROM d WHERE hour(observed_at) % 4 <> 0) SELECT s.item_code, {stamp('s.observed_at')} AS observed_at, round(any_value(best_bid), 6) + 0.0 AS best_bid, round(any_value(bid_depth), 6) + 0.0 AS bid_depth, count(k.price) > 0 AS levels_available,
  coalesce(string_agg(CASE WHEN side = 'bid' THEN position || ':' || CAST(CAST(round(price * 10) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) END, ' ' ORDER BY position), '') AS bids,
  coalesce(string_agg(CASE WHEN side = 'ask' THEN position || ':' || CAST(CAST(round(price * 10) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(quantity AS BIGINT) AS VARCHAR) END, ' ' ORDER BY position), '') AS asks
  FROM sums s LEFT JOIN kept k ON k.item_code = s.item_code AND k.observed_at = s.observed_at GROUP BY s.item_code, s.observed_at""")
def book_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with totals; those of every fourth hour were stored without levels."""
    levels = _levels(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%d:%dx%d", x["position"], F.round(x["price"] * 10).cast("long"), x["quantity"].cast("long"))), " ").alias(c)
    snapshots = B.summaries(levels).select("item_code", "observed_at", "best_bid", "bid_depth")
    out = B.with_levels(snapshots, B.depth(levels).where(F.hour("observed_at") % 4 != 0))
    return r6(out.select("item_code", "observed_at", "best_bid", "bid_depth", "levels_available", text("bids"), text("asks")))


@query("latest_book", f"""WITH {LEVELS}, n AS (SELECT * FROM levels QUALIFY observed_at = max(observed_at) OVER (PARTITION BY item_code)) SELECT item_code, {stamp('max(observed_at)')} AS observed_at, count(*) FILTER (side = 'bid') AS bids, count(*) FILTER (side = 'ask') AS asks,
  round(max(price) FILTER (side = 'bid'), 6) + 0.0 AS best_bid, round(min(price) FILTER (side = 'ask'), 6) + 0.0 AS best_ask FROM n GROUP BY item_code""")
def latest_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.latest_nested(_levels(spark, sf_dir))
    return r6(out.select("item_code", "observed_at", F.size("bids").alias("bids"), F.size("asks").alias("asks"), F.get("bids", F.lit(0))["price"].alias("best_bid"), F.get("asks", F.lit(0))["price"].alias("best_ask")))


@query("latest_execution", f"""WITH {SWEEP}, l AS (SELECT item_code, max(observed_at) AS observed_at FROM levels GROUP BY item_code), c AS (SELECT max(ts) AS now FROM events)
SELECT item_code, {stamp('observed_at')} AS observed_at, side, {rounded('filled', 'vwap')}, round(greatest(0, epoch_us(now) - epoch_us(observed_at)) / 60000000.0, 6) AS age_minutes FROM sw JOIN l USING (item_code, observed_at), c""")
def latest_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, t = _levels(spark, sf_dir), T.tape(spark, sf_dir)
    now = C.data_clock((t, "created_at")).select(F.unix_micros("data_as_of").alias("now"))
    last = levels.groupBy("item_code").agg(F.max("observed_at").alias("observed_at"))
    # One snapshot an item: the clock is a single row.
    fills = B.sweep(levels.join(last, B.KEYS, "left_semi"), 40.0).join(F.broadcast(now))
    age = F.greatest(F.lit(0), F.col("now") - F.unix_micros("observed_at")) / 60_000_000
    return r6(fills.select("item_code", "observed_at", "side", "filled", "vwap", age.alias("age_minutes")))


@query("latest_quotes", f"WITH {QUOTES} SELECT item_code, arg_max(id, (observed_at, id)) AS id, round(arg_max(current_price, (observed_at, id)), 6) AS current_price FROM quotes GROUP BY item_code")
def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.latest(T.quotes(spark, sf_dir), ["item_code"], ["observed_at", "id"]).select("item_code", "id", "current_price"))


# -- forecasts -------------------------------------------------------------
FEATURES = TAPE + ", " + SUMS + """, j AS (SELECT s.item_code, s.observed_at, t.created_at, t.id, t.unit_price, t.quantity, row_number() OVER (PARTITION BY s.item_code, s.observed_at ORDER BY t.created_at DESC, t.id DESC) AS rn
  FROM sums s JOIN tape t ON t.item_code = s.item_code AND t.unit_price IS NOT NULL AND t.created_at >= s.observed_at - INTERVAL 7 DAYS AND t.created_at <= s.observed_at),
f AS (SELECT item_code, observed_at, count(*) AS trades, sum(quantity) AS volume, arg_min(unit_price, (created_at, id)) AS open, arg_max(unit_price, (created_at, id)) AS close,
  sum(unit_price * quantity) / sum(quantity) AS vwap, quantile_cont(unit_price, 0.1) AS p10, quantile_cont(unit_price, 0.25) AS p25, quantile_cont(unit_price, 0.5) AS median, quantile_cont(unit_price, 0.9) AS p90, avg(unit_price) FILTER (rn <= 5) AS last5 FROM j GROUP BY ALL),
feats AS (SELECT *, CASE WHEN fair > 0 THEN (best_bid - fair) / fair * 100 END AS fair_gap_pct FROM (SELECT s.item_code, s.observed_at, s.best_bid, s.best_ask, s.spread_pct, s.imbalance_pct, coalesce(f.trades, 0) AS trades, f.* EXCLUDE (item_code, observed_at, trades),
  CASE WHEN f.trades >= 2 AND open > 0 THEN (close - open) / open * 100 END AS momentum_pct, 0.5 * vwap + 0.3 * median + 0.2 * last5 AS fair FROM sums s LEFT JOIN f USING (item_code, observed_at))),
scored AS (SELECT *, CASE WHEN momentum_pct >= 6 THEN 2 WHEN momentum_pct >= 1 THEN 1 WHEN momentum_pct <= -6 THEN -2 WHEN momentum_pct <= -1 THEN -1 ELSE 0 END + CASE WHEN fair_gap_pct <= -2 THEN 1 WHEN fair_gap_pct >= 2 THEN -1 ELSE 0 END AS score FROM feats)"""
FEATURE_COLS = ("volume", "open", "close", "vwap", "p10", "p25", "median", "p90", "last5", "momentum_pct", "fair", "fair_gap_pct")


@query("forecast_features", f"WITH {FEATURES} SELECT item_code, {stamp('observed_at')} AS observed_at, trades, {rounded(*FEATURE_COLS)} FROM feats")
def forecast_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(P.features(T.tape(spark, sf_dir), B.summaries(_levels(spark, sf_dir))).select("item_code", "observed_at", "trades", *FEATURE_COLS))


AHEAD = """, ahead AS (SELECT a.item_code, a.observed_at, b.observed_at AS target_at, b.best_bid AS target_bid FROM sums a ASOF LEFT JOIN sums b ON a.item_code = b.item_code AND b.observed_at >= a.observed_at + INTERVAL 24 HOURS)"""


@query("direction_reasons", f"""WITH {FEATURES} SELECT item_code, {stamp('observed_at')} AS observed_at, array_to_string(list_filter([CASE WHEN momentum_pct >= 6 THEN 'strong_positive_momentum' END, CASE WHEN momentum_pct >= 1 AND momentum_pct < 6 THEN 'positive_momentum' END, CASE WHEN momentum_pct <= -6 THEN 'strong_negative_momentum' END,
  CASE WHEN momentum_pct <= -1 AND momentum_pct > -6 THEN 'negative_momentum' END, CASE WHEN fair_gap_pct <= -2 THEN 'below_fair' END, CASE WHEN fair_gap_pct >= 2 THEN 'above_fair' END], lambda x: x IS NOT NULL), ',') AS reasons FROM feats""")
def direction_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = P.features(T.tape(spark, sf_dir), B.summaries(_levels(spark, sf_dir)))
    return r6(seen.select("item_code", "observed_at", F.array_join(X.direction_reasons("momentum_pct", "fair_gap_pct"), ",").alias("reasons")))


@query("forecast_targets", f"""WITH {SUMS}{AHEAD} SELECT item_code, {stamp('observed_at')} AS observed_at, CASE WHEN target_at <= observed_at + INTERVAL 30 HOURS THEN {stamp('target_at')} END AS target_at,
  round(CASE WHEN target_at <= observed_at + INTERVAL 30 HOURS THEN target_bid END, 6) + 0.0 AS target_bid FROM ahead""")
def forecast_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(P.targets(B.summaries(_levels(spark, sf_dir))).select("item_code", "observed_at", "target_at", "target_bid"))


EVALS = FEATURES + AHEAD + """, """ + SWEEP.removeprefix(SUMS).removeprefix(", ").replace("40", "1") + """, e AS (SELECT s.*, target_at, target_bid, (target_bid - best_bid) / best_bid * 100 AS return_pct, CASE WHEN score >= 1 THEN 'Up' WHEN score <= -1 THEN 'Down' ELSE 'No clear move' END AS prediction,
  CASE WHEN target_bid - best_bid > 0.001 THEN 'Up' WHEN target_bid - best_bid < -0.001 THEN 'Down' ELSE 'Flat' END AS outcome FROM scored s JOIN ahead a USING (item_code, observed_at) WHERE best_bid > 0 AND trades > 0 AND target_bid > 0 AND target_at <= observed_at + INTERVAL 30 HOURS),
flips AS (SELECT e.*, CASE WHEN x.vwap > 0 THEN (y.vwap - x.vwap) / x.vwap * 100 END AS flip_return_pct FROM e LEFT JOIN sw x ON x.item_code = e.item_code AND x.observed_at = e.observed_at AND x.side = 'ask' AND x.filled >= 1
  LEFT JOIN sw y ON y.item_code = e.item_code AND y.observed_at = e.target_at AND y.side = 'bid' AND y.filled >= 1),
cur AS (SELECT item_code, CASE WHEN arg_max(score, observed_at) >= 1 THEN 'Up' WHEN arg_max(score, observed_at) <= -1 THEN 'Down' ELSE 'No clear move' END AS current_signal FROM scored GROUP BY item_code HAVING arg_max(trades, observed_at) > 0)"""


@query("forecast_evaluations", f"WITH {EVALS} SELECT item_code, {stamp('observed_at')} AS observed_at, {stamp('target_at')} AS target_at, prediction, outcome, {rounded('return_pct', 'flip_return_pct')} FROM flips")
def forecast_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(P.evaluations(T.tape(spark, sf_dir), _levels(spark, sf_dir)).select("item_code", "observed_at", "target_at", "prediction", "outcome", "return_pct", "flip_return_pct"))


SUMMARY = f"""{EVALS}, fs AS (SELECT item_code, any_value(current_signal) AS current_signal, count(*) AS candidate_samples, count(*) FILTER (d) AS evaluable_samples, count(flip_return_pct) AS execution_samples, count(*) FILTER (prediction = 'Up') AS up_predictions,
  count(*) FILTER (prediction = 'Down') AS down_predictions, count(*) FILTER (d AND prediction = outcome) AS correct, count(*) FILTER (d AND outcome = 'Up') AS ups, count(*) FILTER (d AND outcome = 'Down') AS downs,
  CASE WHEN count(return_pct) FILTER (m) >= 10 THEN quantile_cont(return_pct, [0.1, 0.5, 0.9]) FILTER (m) END AS r, CASE WHEN count(flip_return_pct) FILTER (m) >= 10 THEN quantile_cont(flip_return_pct, [0.1, 0.5, 0.9]) FILTER (m) END AS f
  FROM (SELECT flips.*, current_signal, prediction IN ('Up', 'Down') AND outcome IN ('Up', 'Down') AS d, current_signal IN ('Up', 'Down') AND prediction = current_signal AS m FROM flips JOIN cur USING (item_code)) GROUP BY item_code),
fsum AS (SELECT *, correct / evaluable_samples * 100 AS accuracy_pct, greatest(ups, downs) / evaluable_samples * 100 AS baseline_pct FROM fs)"""


@query("forecast_summary", f"""WITH {SUMMARY} SELECT item_code, current_signal, candidate_samples, evaluable_samples, execution_samples, up_predictions, down_predictions, correct, {rounded('accuracy_pct', 'baseline_pct')},
  CASE WHEN evaluable_samples < 30 THEN 'Insufficient' WHEN accuracy_pct <= baseline_pct THEN 'Weak' WHEN accuracy_pct - baseline_pct < 5 THEN 'Limited' ELSE 'Supported' END AS evidence,
  round(r[1], 6) AS return_p10_pct, round(r[2], 6) AS return_median_pct, round(r[3], 6) AS return_p90_pct, round(f[1], 6) AS flip_return_p10_pct, round(f[2], 6) AS flip_return_median_pct, round(f[3], 6) AS flip_return_p90_pct FROM fsum""")
def forecast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, levels = T.tape(spark, sf_dir), _levels(spark, sf_dir)
    seen = stored(P.features(t, B.summaries(levels)), "features")
    return r6(P.forecast_summary(P.evaluations(t, levels, seen=seen), P.current_signals(seen)))
