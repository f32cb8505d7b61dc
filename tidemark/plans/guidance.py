"""Item signals and what follows from them, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import context as C
from tidemark.operators import books as B
from tidemark.operators import forecast as P
from tidemark.operators import guidance as G
from tidemark.operators import stats as S
from tidemark.plans.market import STATS_TAIL, SUMMARY, r6, rounded
from tidemark.session import stored
from tidemark.sources import tables as T

QUERIES, SQL = {}, {}
#: A stale quote would refuse every flip on hourly books, so two hours are allowed.
ASSUMED = G.Assumptions(quantity=1.0, fee_pct=0.5, margin_pct=1.0, max_quote_age_minutes=120.0)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


SIGNALS = SUMMARY + ", " + STATS_TAIL + """,
wk AS (SELECT item_code, last_trade_price, quote_price, quote_gap_pct, liquidity, trade_count AS trades_7d, min AS low_7d, max AS high_7d, open AS open_7d, close AS close_7d, vwap AS vwap_7d, median AS median_7d, average AS average_7d, price_p10 AS price_p10_7d, price_p25 AS price_p25_7d, price_p90 AS price_p90_7d, stable_fair_price AS stable_fair_price_7d, tendency_labels AS tendency_7d FROM labelled WHERE horizon = '7D'),
lb AS (SELECT item_code, max(observed_at) AS observed_at FROM sums GROUP BY item_code),
en AS (SELECT item_code, vwap AS entry_vwap, gross AS entry_gross, filled >= 1 * (1 - 1e-12) AS entry_full FROM sw JOIN lb USING (item_code, observed_at) WHERE side = 'ask'),
ex AS (SELECT item_code, vwap AS exit_vwap, filled >= 1 * (1 - 1e-12) AS exit_full FROM sw JOIN lb USING (item_code, observed_at) WHERE side = 'bid'),
sig AS (SELECT *, f[1] AS flip_p10, f[2] AS flip_median, f[3] AS flip_p90, CASE WHEN evaluable_samples < 30 THEN 'Insufficient' WHEN accuracy_pct <= baseline_pct THEN 'Weak' WHEN accuracy_pct - baseline_pct < 5 THEN 'Limited' ELSE 'Supported' END AS evidence,
  greatest(0, epoch_us((SELECT c FROM clock)) - epoch_us(observed_at)) / 60000000.0 AS quote_age_minutes
  FROM wk LEFT JOIN (SELECT s.* FROM sums s JOIN lb USING (item_code, observed_at)) USING (item_code) LEFT JOIN en USING (item_code) LEFT JOIN ex USING (item_code) LEFT JOIN fsum USING (item_code))"""


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The tape and the merged levels, made once for all the parts of a report.

    A file of very many events is a few tasks' scan, so they are dealt by id before their
    properties are read.
    """
    events = T.read(spark, sf_dir, "events").repartition("event_id")
    return stored(T.tape_of(events).drop("buy_user", "sell_user"), "tape"), stored(B.merged_levels(T.book_levels(spark, sf_dir)), "levels")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, levels = _sources(spark, sf_dir)
    context = C.resolve(None, (t, "created_at"))
    sums = stored(B.summaries(levels), "summaries")
    last = sums.groupBy("item_code").agg(F.max_by(F.struct("observed_at", "best_bid", "best_ask", "bid_depth", "ask_depth"), "observed_at").alias("x")).select("item_code", "x.*")
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(context.analysis).cast("timestamp")) - F.unix_micros("observed_at")) / 60_000_000)
    latest_levels = levels.join(last.select(*B.KEYS), B.KEYS, "left_semi")
    fills = B.sweep(latest_levels, ASSUMED.quantity)
    pick = lambda side, names: fills.where(F.col("side") == side).select("item_code", *(F.col(a).alias(b) for a, b in names.items()))
    entry, leave = pick("ask", {"vwap": "entry_vwap", "gross": "entry_gross", "fully_filled": "entry_full"}), pick("bid", {"vwap": "exit_vwap", "fully_filled": "exit_full"})
    # Two parts read the features, each with filters of its own.
    seen = stored(P.features(t, sums), "features")
    forecast = P.forecast_summary(P.evaluations(t, levels, ASSUMED.quantity, seen=seen), P.current_signals(seen))
    stats = S.window_stats(t, context, quotes=T.quotes(spark, sf_dir), books=sums)
    return G.item_signals(stats, last.withColumn("quote_age_minutes", age), entry.join(leave, "item_code", "full"), forecast, T.points(spark, sf_dir))


#: As in the rules, a zero among the week's prices is no measure, and a missing close is the last trade.
MEASURED = """z AS (SELECT * REPLACE (nullif(high_7d, 0) AS high_7d, nullif(low_7d, 0) AS low_7d, nullif(open_7d, 0) AS open_7d, coalesce(nullif(close_7d, 0), last_trade_price) AS close_7d) FROM sig)"""
METRICS = ("mid_price", "spread", "spread_pct", "crossing_loss_pct", "range_pct", "momentum_7d_pct", "attractiveness", "fair_reference_7d", "fair_gap_7d_pct")


@query("market_metrics", f"""WITH {SIGNALS}, {MEASURED}, m AS (SELECT *, best_ask - best_bid AS raw, (high_7d + low_7d) / 2 AS ap, concat_ws(', ', CASE WHEN best_bid IS NULL THEN 'bid' END, CASE WHEN best_ask IS NULL THEN 'ask' END, CASE WHEN trades_7d IS NULL THEN 'trades_7d' END, CASE WHEN high_7d IS NULL THEN 'high_7d' END, CASE WHEN low_7d IS NULL THEN 'low_7d' END) AS missing FROM z),
n AS (SELECT *, CASE WHEN raw <= 0.001 THEN 0 ELSE raw - 0.001 END AS spread, CASE WHEN best_ask > 0 THEN greatest(raw, 0) / best_ask * 100 END AS crossing_loss_pct, CASE WHEN missing = '' AND ap > 0 THEN (high_7d - low_7d) / ap * 100 END AS range_pct,
  CASE WHEN missing = '' AND open_7d > 0 THEN (close_7d - open_7d) / open_7d * 100 END AS momentum_7d_pct, coalesce(CASE WHEN stable_fair_price_7d > 0 THEN stable_fair_price_7d END, CASE WHEN vwap_7d > 0 THEN vwap_7d END, CASE WHEN median_7d > 0 THEN median_7d END, nullif(average_7d, 0), CASE WHEN missing = '' THEN ap END) AS fair_reference_7d, CASE WHEN fair_reference_7d > 0 THEN (last_trade_price - fair_reference_7d) / fair_reference_7d * 100 END AS fair_gap_7d_pct FROM m),
o AS (SELECT * EXCLUDE (spread_pct), spread / mid_price * 100 AS spread_pct FROM n), p AS (SELECT *, CASE WHEN missing = '' AND spread_pct > 0 AND range_pct > 0 AND trades_7d > 0 THEN spread_pct * trades_7d / range_pct END AS attractiveness FROM o)
SELECT item_code, {rounded(*METRICS)}, CASE WHEN missing <> '' THEN 'Missing: ' || missing WHEN attractiveness IS NOT NULL THEN 'OK' ELSE 'Insufficient score data' END AS status FROM p""")
def market_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(G.market_metrics(_signals(spark, sf_dir)).select("item_code", *METRICS, "status"))


DISLOCATED = ("severity", "raw_gap_pct", "band_width", "band_width_pct", "band_start", "band_end", "fair_position", "last_position")
DIS_SQL = SIGNALS + """, dis AS (SELECT *, CASE WHEN last_trade_price > price_p90_7d AND last_trade_price - stable_fair_price_7d >= 0.001 THEN 'meaningful_premium' WHEN last_trade_price < price_p10_7d AND stable_fair_price_7d - last_trade_price >= 0.001 THEN 'meaningful_discount' ELSE 'within_normal_range' END AS classification,
  greatest(price_p90_7d - price_p10_7d, 0.001) AS band_width, (price_p90_7d - price_p10_7d) / stable_fair_price_7d * 100 AS band_width_pct, (last_trade_price / stable_fair_price_7d - 1) * 100 AS raw_gap_pct, (price_p10_7d + price_p90_7d) / 2 AS middle FROM sig),
dis2 AS (SELECT *, CASE classification WHEN 'meaningful_premium' THEN (last_trade_price - price_p90_7d) / band_width WHEN 'meaningful_discount' THEN (price_p10_7d - last_trade_price) / band_width ELSE 0 END AS severity,
  least(100, greatest(0, 50 + (price_p10_7d - middle) / band_width * 60)) AS band_start, least(100, greatest(0, 50 + (price_p90_7d - middle) / band_width * 60)) AS band_end, least(100, greatest(0, 50 + (stable_fair_price_7d - middle) / band_width * 60)) AS fair_position, least(100, greatest(0, 50 + (last_trade_price - middle) / band_width * 60)) AS last_position FROM dis)"""


@query("price_dislocations", f"WITH {DIS_SQL} SELECT item_code, classification, {rounded(*DISLOCATED)} FROM dis2")
def price_dislocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(G.dislocations(_signals(spark, sf_dir)).select("item_code", "classification", *DISLOCATED))


@query("highlighted_items", f"""WITH {DIS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY classification ORDER BY severity DESC, item_code) AS rank, (SELECT count(DISTINCT classification) FROM dis2 WHERE classification LIKE 'meaningful%') AS kinds FROM dis2 WHERE classification LIKE 'meaningful%')
SELECT item_code, classification, CAST(rank AS BIGINT) AS rank, {rounded('severity')} FROM k WHERE rank = 1 OR (rank = 2 AND kinds = 1)""")
def highlighted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(G.highlights(G.dislocations(_signals(spark, sf_dir))).select("item_code", "classification", "rank", "severity"))


GUIDE = ("max_entry_price", "rich_exit_price", "ask_gap_pct", "bid_gap_pct", "net_to_fair_pct")
GUIDE_SQL = SIGNALS + """, g0 AS (SELECT *, vwap_7d * (1 - 0.005) / ((1 + 0.005) * (1 + 0.01)) AS e0, CASE WHEN entry_full THEN entry_vwap END AS ask_x, CASE WHEN exit_full THEN exit_vwap END AS bid_x FROM sig),
g1 AS (SELECT *, CASE WHEN contains(tendency_7d, 'Falling') AND contains(tendency_7d, 'Volatile') THEN least(e0, price_p10_7d) WHEN contains(tendency_7d, 'Falling') OR contains(tendency_7d, 'Volatile') THEN least(e0, price_p25_7d) ELSE e0 END AS max_entry_price,
  greatest(vwap_7d, least(price_p90_7d, vwap_7d * 1.01)) AS rich_exit_price, (ask_x - vwap_7d) / vwap_7d * 100 AS ask_gap_pct, (bid_x - vwap_7d) / vwap_7d * 100 AS bid_gap_pct, (vwap_7d * (1 - 0.005) - ask_x * (1 + 0.005)) / (ask_x * (1 + 0.005)) * 100 AS net_to_fair_pct FROM g0),
g2 AS (SELECT *, CASE WHEN ask_x <= max_entry_price THEN 'BUY' ELSE 'WAIT' END AS entry_action, CASE WHEN bid_x >= rich_exit_price THEN 'SELL' ELSE 'HOLD' END AS holder_action, coalesce(quote_age_minutes BETWEEN 0 AND 120, false) AS quote_fresh FROM g1)"""


@query("fair_value_guidance", f"""WITH {GUIDE_SQL} SELECT item_code, entry_action, holder_action, {rounded(*GUIDE)}, quote_fresh, CASE WHEN entry_action = 'BUY' THEN 'BUY' WHEN holder_action = 'SELL' THEN 'SELL' ELSE 'HOLD' END AS guide_signal,
  CAST(CASE WHEN quote_fresh AND ask_x IS NOT NULL THEN 0 WHEN quote_fresh AND bid_x IS NOT NULL THEN 1 ELSE 2 END AS BIGINT) AS short_term_rank FROM g2""")
def fair_value_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.short_term(G.fair_value_guidance(_signals(spark, sf_dir), ASSUMED), ASSUMED)
    return r6(out.select("item_code", "entry_action", "holder_action", *GUIDE, "quote_fresh", "guide_signal", "short_term_rank"))


FLIP = ("total_entry_cost", "break_even_exit", "exit_p10", "exit_median", "exit_p90", "margin_p10_pct", "margin_median_pct", "margin_p90_pct", "profit_median")
FLIP_SQL = SIGNALS + """, u AS (SELECT *, CASE WHEN best_bid IS NULL OR best_ask IS NULL OR entry_full IS NULL THEN 'missing_order_book' WHEN quote_age_minutes IS NULL THEN 'missing_timestamp' WHEN current_signal IS NULL THEN 'missing_forecast' WHEN flip_p10 IS NULL THEN 'missing_execution_interval' END AS unav,
  entry_gross * 1.005 AS tot FROM sig),
u2 AS (SELECT *, CASE WHEN unav IS NULL THEN CASE WHEN quote_age_minutes > 120 THEN 'stale_quote' WHEN NOT entry_full THEN 'insufficient_ask_depth' WHEN best_bid >= best_ask OR entry_gross <= 0 THEN 'invalid_book' WHEN entry_gross * (1 + flip_p10 / 100) <= 0 OR entry_gross * (1 + flip_median / 100) <= 0 OR entry_gross * (1 + flip_p90 / 100) <= 0 THEN 'invalid_book' END END AS ref FROM u),
u3 AS (SELECT *, unav IS NULL AND ref IS NULL AS ok, tot / 0.995 AS even, entry_gross * (1 + flip_p10 / 100) AS x1, entry_gross * (1 + flip_median / 100) AS x2, entry_gross * (1 + flip_p90 / 100) AS x3 FROM u2),
u4 AS (SELECT *, (x2 * 0.995 - tot) / tot * 100 AS mm FROM u3),
u5 AS (SELECT *, coalesce(unav, ref, CASE WHEN mm <= 0 THEN 'margin_non_positive' WHEN evidence = 'Insufficient' THEN 'forecast_insufficient' WHEN evidence IN ('Weak', 'Limited') THEN 'forecast_not_above_baseline' WHEN mm < 1 THEN 'margin_below_threshold' WHEN evidence = 'Supported' THEN 'supported_positive_margin' ELSE 'forecast_not_above_baseline' END) AS reason FROM u4)"""
FLIP_SHOWN = ", ".join(f"round(CASE WHEN ok THEN {e} END, 6) + 0.0 AS {n}" for n, e in zip(FLIP, ("tot", "even", "x1", "x2", "x3", "(x1 * 0.995 - tot) / tot * 100", "mm", "(x3 * 0.995 - tot) / tot * 100", "x2 * 0.995 - tot"), strict=True))


@query("flip_opportunities", f"""WITH {FLIP_SQL} SELECT item_code, CASE WHEN unav IS NOT NULL THEN 'Unavailable' WHEN ref IS NOT NULL OR reason = 'margin_non_positive' THEN 'No trade' WHEN reason = 'supported_positive_margin' THEN 'Potential flip' ELSE 'Watch' END AS verdict, reason, {FLIP_SHOWN},
  round(CASE WHEN best_bid < best_ask THEN CASE WHEN best_bid + 0.001 < best_ask THEN best_bid + 0.001 ELSE best_bid END END, 6) + 0.0 AS passive_limit FROM u5""")
def flip_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(G.flips(_signals(spark, sf_dir), ASSUMED).select("item_code", "verdict", "reason", *FLIP, "passive_limit"))


@query("report_order", f"""WITH {GUIDE_SQL} SELECT CAST(row_number() OVER (ORDER BY CASE WHEN quote_fresh AND ask_x IS NOT NULL THEN 0 WHEN quote_fresh AND bid_x IS NOT NULL THEN 1 ELSE 2 END, lower(item_code)) AS BIGINT) AS position, item_code, upper(item_code[1]) || item_code[2:] AS item_name FROM g2""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.short_term(G.fair_value_guidance(_signals(spark, sf_dir), ASSUMED), ASSUMED)
    return r6(G.report_order(out).select("position", "item_code", "item_name"))


SIGNAL_COLS = ("last_trade_price", "quote_price", "quote_gap_pct", "liquidity", "low_7d", "high_7d", "vwap_7d", "stable_fair_price_7d", "best_bid", "best_ask", "quote_age_minutes", "entry_vwap", "exit_vwap", "accuracy_pct", "baseline_pct")


@query("item_signals", f"""WITH {SIGNALS}, {T.POINTS_SQL} SELECT item_code, upper(item_code[1]) || item_code[2:] AS item_name, trades_7d, {rounded(*SIGNAL_COLS)}, tendency_7d, current_signal, CASE WHEN current_signal IS NOT NULL THEN evidence END AS evidence, points FROM sig LEFT JOIN points USING (item_code)""")
def item_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship table: every item's wide row."""
    return r6(_signals(spark, sf_dir).select("item_code", "item_name", "trades_7d", *SIGNAL_COLS, "tendency_7d", "current_signal", "evidence", "points"))


@query("market_scores", f"""WITH {SIGNALS}, {MEASURED}, m AS (SELECT item_code, best_bid, best_ask, mid_price, trades_7d, high_7d, low_7d, best_ask - best_bid AS raw FROM z), n AS (SELECT item_code, CASE WHEN raw <= 0.001 THEN 0 ELSE raw - 0.001 END / mid_price * 100 AS sp, (high_7d - low_7d) / ((high_7d + low_7d) / 2) * 100 AS rp, trades_7d FROM m),
o AS (SELECT item_code, CASE WHEN sp > 0 AND rp > 0 AND trades_7d > 0 THEN sp * trades_7d / rp END AS a FROM n) SELECT CAST(row_number() OVER (ORDER BY a DESC NULLS LAST, item_code) AS BIGINT) AS position, item_code, round(a, 6) + 0.0 AS attractiveness FROM o""")
def market_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(G.by_attractiveness(G.market_metrics(_signals(spark, sf_dir))).select("position", "item_code", "attractiveness"))


@query("forecast_order", f"""WITH {SUMMARY}, r AS (SELECT item_code, CASE WHEN evaluable_samples < 30 THEN 0 WHEN accuracy_pct <= baseline_pct THEN 1 WHEN accuracy_pct - baseline_pct < 5 THEN 2 ELSE 3 END AS e, coalesce(accuracy_pct - baseline_pct, '-infinity'::DOUBLE) AS edge, evaluable_samples AS n FROM fsum)
SELECT CAST(row_number() OVER (ORDER BY e DESC, edge DESC, n DESC, item_code) AS BIGINT) AS position, item_code FROM r""")
def forecast_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, levels = _sources(spark, sf_dir)
    seen = stored(P.features(t, B.summaries(levels)), "features")
    return r6(G.by_evidence(P.forecast_summary(P.evaluations(t, levels, seen=seen), P.current_signals(seen))).select("position", "item_code"))
