"""Index, coverage, resolution and scan queries, each with the SQL that DuckDB runs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import context as C
from tidemark.functions import exprs as X
from tidemark.operators import coverage as V
from tidemark.operators import indexes as I
from tidemark.operators import resolve as R
from tidemark.operators import selection as N
from tidemark.operators import sinks as K
from tidemark.operators import stats as S
from tidemark.plans.market import BOOK, CLOCK, QUOTES, TAPE, day, r6, rounded, stamp
from tidemark.sources import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TRAIL = T.LONG_TAPE_SQL + """, lim AS (SELECT max(day) + 1 AS last FROM long_tape), sp AS (SELECT item_code, unit_price, quantity, CAST(day + CAST(k AS INTEGER) AS DATE) AS as_of FROM long_tape, range(1, 8) r(k) WHERE unit_price > 0 AND quantity > 0),
tm AS (SELECT item_code, as_of, unit_price, sum(quantity) AS q FROM sp, lim WHERE as_of BETWEEN CAST(last - 90 AS DATE) AND CAST(last AS DATE) GROUP BY ALL),
tc AS (SELECT *, sum(q) OVER (PARTITION BY item_code, as_of ORDER BY unit_price) AS cum, sum(q) OVER (PARTITION BY item_code, as_of) AS total FROM tm),
prices AS (SELECT item_code, as_of, min(unit_price) AS price FROM tc WHERE cum >= total / 2 GROUP BY ALL),
base AS (SELECT l.item_code, sum(quantity) AS quantity, count(*) AS trades FROM long_tape l, lim WHERE day >= last - 97 AND day < last - 90 AND unit_price > 0 AND quantity > 0 GROUP BY ALL),
pts AS (SELECT p_brand AS item_code, min(1 + p_size % 20) AS production_points FROM part GROUP BY ALL),
bp AS (SELECT item_code, price AS base_price FROM prices, lim WHERE as_of = CAST(last - 90 AS DATE)),
def AS (SELECT 'broad' AS index_key, item_code, quantity * base_price AS raw FROM base JOIN bp USING (item_code) UNION ALL SELECT 'effort', item_code, quantity * production_points FROM base JOIN pts USING (item_code)
  UNION ALL SELECT 'basket_' || substr(item_code, 7, 1), item_code, quantity * base_price FROM base JOIN bp USING (item_code)),
weights AS (SELECT index_key, item_code, raw / sum(raw) OVER (PARTITION BY index_key) AS weight FROM def WHERE raw > 0)"""


#: Parameters over the driver's brands: everything, everything by effort, a basket for each first digit, one switched off.
DEFINITIONS = [I.IndexDefinition("broad", "Broad market"), I.IndexDefinition("effort", "Embodied effort", "effort"), I.IndexDefinition("off", "Not published", enabled=False)] + [
    I.IndexDefinition(f"basket_{k}", f"Basket {k}", members=tuple(f"Brand#{n}" for n in range(1, 26) if str(n).startswith(str(k)))) for k in range(1, 10)
]


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base evidence, base prices, trailing prices) of the last 90 days of the long tape."""
    tape = T.long_tape(spark, sf_dir).where(S.usable())
    last = tape.agg(F.date_add(F.max("day"), 1).alias("last")).first()[0]
    days = spark.range(91).select(F.date_sub(F.lit(last), F.col("id").cast("int")).alias("as_of"))
    start = F.date_sub(F.lit(last), 97)
    recent = tape.where(F.col("day") >= start)
    prices = I.trailing_prices(recent, days).withColumnRenamed("representative_price", "price")
    base = recent.where(F.col("day") < F.date_sub(F.lit(last), 90)).groupBy("item_code").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("trades"))
    first = prices.where(F.col("as_of") == F.date_sub(F.lit(last), 90)).select("item_code", F.col("price").alias("base_price"))
    points = T.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("item_code")).agg(F.min(1 + F.col("p_size") % 20).alias("production_points"))
    return base.join(first, "item_code", "left").join(points, "item_code", "left"), first, prices


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base, first, prices = _base(spark, sf_dir)
    return I.weights_of(I.candidates(*I.definition_tables(spark, DEFINITIONS), base)), first, prices


@query("index_weights", f"WITH {TRAIL} SELECT index_key, item_code, {rounded('weight')} FROM weights")
def index_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_index(spark, sf_dir)[0])


@query("index_eligibility", f"""WITH {TRAIL}, keys AS (SELECT item_code, unnest(['broad', 'effort', 'basket_' || substr(item_code, 7, 1)]) AS index_key FROM base)
SELECT index_key, item_code, trades, {rounded('quantity')}, CASE WHEN trades < 3 THEN 'too_few_trades' WHEN NOT quantity >= 60 THEN 'too_little_quantity' WHEN index_key = 'effort' AND production_points IS NULL THEN 'missing_production_points' WHEN index_key <> 'effort' AND base_price IS NULL THEN 'missing_price' END AS excluded_because
  FROM keys JOIN base USING (item_code) LEFT JOIN pts USING (item_code) LEFT JOIN bp USING (item_code)""")
def index_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.candidates(*I.definition_tables(spark, DEFINITIONS), _base(spark, sf_dir)[0], 3, 60.0)
    return r6(rows.select("index_key", "item_code", "trades", "quantity", "excluded_because"))


#: Codes that the driver's brands stand for, by number.
CODES = ("steel", "concrete", "steak", "lightAmmo", "cookedFish", "ammo", "heavyAmmo", "paper", "oil", "scraps")


@query("published_indexes", f"""WITH {T.LONG_TAPE_SQL}, b AS (SELECT [{', '.join(f"'{c}'" for c in CODES)}][CAST(substr(item_code, 7) AS INTEGER) % 10 + 1] AS item_code, sum(quantity) AS quantity, count(*) AS trades, sum(money) / sum(quantity) AS price FROM long_tape WHERE unit_price > 0 AND quantity > 0 GROUP BY 1),
pts(item_code, points) AS (VALUES ('steel', 20.0), ('concrete', 20.0), ('steak', 40.0), ('lightAmmo', 2.0), ('cookedFish', 80.0), ('ammo', 8.0), ('heavyAmmo', 32.0), ('paper', 2.0), ('oil', 2.0)),
m(index_key, item_code) AS (VALUES ('industrial_expansion', 'steel'), ('industrial_expansion', 'concrete'), ('standard_combat', 'steak'), ('standard_combat', 'lightAmmo'), ('premium_combat', 'cookedFish'), ('premium_combat', 'ammo'), ('premium_combat', 'heavyAmmo'), ('governance', 'paper'), ('infrastructure_operation', 'oil'), ('equipment_inputs', 'steel'), ('equipment_inputs', 'scraps')),
k AS (SELECT index_key, b.*, points FROM (SELECT * FROM m UNION ALL SELECT x, item_code FROM b, (VALUES ('broad_market'), ('base_pp')) t(x)) JOIN b USING (item_code) LEFT JOIN pts USING (item_code)),
c AS (SELECT *, quantity * CASE WHEN index_key = 'base_pp' THEN points ELSE price END AS value FROM k)
SELECT index_key, item_code, CASE WHEN value IS NULL THEN 'missing_production_points' END AS excluded_because, round(value / sum(value) OVER (PARTITION BY index_key), 6) + 0.0 AS weight FROM c""")
def published_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members, reasons of exclusion and weights of the fixed indexes, with the fixed production points."""
    tape = T.long_tape(spark, sf_dir).where(S.usable())
    code = F.element_at(F.array(*map(F.lit, CODES)), F.substring("item_code", 7, 9).cast("int") % 10 + 1)
    base = tape.groupBy(code.alias("item_code")).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("trades"), (F.sum("money") / F.sum("quantity")).alias("base_price"))
    rows = I.candidates(*I.definition_tables(spark, I.DEFINITIONS), base.withColumn("production_points", X.production_points("item_code")))
    return r6(rows.join(I.weights_of(rows), ["index_key", "item_code"], "left").select("index_key", "item_code", "excluded_because", "weight"))


@query("index_levels", f"""WITH {TRAIL}, l AS (SELECT index_key, as_of, sum(weight) * 100 AS coverage_pct, count(*) AS components, sum(weight * price / base_price) AS x, sum(weight) AS w FROM weights JOIN bp USING (item_code) JOIN prices USING (item_code) GROUP BY ALL)
SELECT index_key, {day('as_of')} AS as_of, components, {rounded('coverage_pct')}, round(CASE WHEN coverage_pct + 1e-12 >= 80 THEN 100 * x / w END, 6) + 0.0 AS level FROM l""")
def index_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b, p = _index(spark, sf_dir)
    return r6(I.levels(w, b, p).select("index_key", "as_of", "components", "coverage_pct", "level"))


CHANGE = TRAIL + """, b2 AS (SELECT p.item_code, p.as_of, p.price, q.price AS price_before FROM prices p JOIN prices q ON p.item_code = q.item_code AND p.as_of = q.as_of + 30),
ch AS (SELECT index_key, as_of, sum(weight) * 100 AS matched_pct, sum(weight * price / base_price) AS now, sum(weight * price_before / base_price) AS before FROM weights JOIN bp USING (item_code) JOIN b2 USING (item_code) GROUP BY ALL),
cc AS (SELECT *, CASE WHEN matched_pct + 1e-12 >= 80 AND before > 0 THEN (now / before - 1) * 100 END AS change_pct FROM ch)"""


@query("index_changes_30d", f"""WITH {CHANGE} SELECT index_key, {day('as_of')} AS as_of, {rounded('matched_pct', 'change_pct')}, CASE WHEN change_pct IS NULL THEN 'Insufficient data' WHEN change_pct > 0.1 THEN 'Inflation' WHEN change_pct < -0.1 THEN 'Deflation' ELSE 'Stable' END AS class,
  round((1 / (1 + change_pct / 100) - 1) * 100, 6) + 0.0 AS purchasing_power_pct, round((pow(1 + change_pct / 100, 365.0 / 30) - 1) * 100, 2) + 0.0 AS annualized_pct FROM cc""")
def index_changes_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b, p = _index(spark, sf_dir)
    return r6(I.matched_changes(w, b, p, 30).withColumn("annualized_pct", F.round("annualized_pct", 2)))


@query("index_members", f"""WITH {CHANGE}, ends AS (SELECT CAST(last - CAST(k AS INTEGER) AS DATE) AS as_of FROM lim, range(0, 61) r(k)), seen AS (SELECT b2.item_code, b2.as_of FROM b2 JOIN bp USING (item_code))
SELECT w.index_key, {day('e.as_of')} AS as_of, round(coalesce(sum(weight) FILTER (s.item_code IS NOT NULL), 0) * 100, 6) + 0.0 AS matched_pct, count(s.item_code) AS matched,
  coalesce(string_agg(CASE WHEN s.item_code IS NULL THEN w.item_code END, ',' ORDER BY w.item_code), '') AS missing
  FROM weights w CROSS JOIN ends e LEFT JOIN seen s ON s.item_code = w.item_code AND s.as_of = e.as_of GROUP BY w.index_key, e.as_of""")
def index_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many members each 30-day change rests on, and those that it lacks."""
    w, b, p = _index(spark, sf_dir)
    return r6(I.matched_members(w, b, p, 30).select("index_key", "as_of", "matched_pct", F.size("matched").cast("long").alias("matched"), F.array_join("missing", ",").alias("missing")))


@query("index_contributions", f"""WITH {CHANGE} SELECT index_key, {day('b2.as_of')} AS as_of, item_code, round(weight * (price - price_before) / base_price / sum(weight * price_before / base_price) OVER (PARTITION BY index_key, b2.as_of) * 100, 6) + 0.0 AS contribution_pct
  FROM weights JOIN bp USING (item_code) JOIN b2 USING (item_code)""")
def index_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b, p = _index(spark, sf_dir)
    return r6(I.contributions(w, b, p, 30).select("index_key", "as_of", "item_code", "contribution_pct"))


BASKET = """basket AS (SELECT 'size_' || (p_size % 5) AS action, p_brand AS item_code, CAST(count(*) AS DOUBLE) AS amount FROM part GROUP BY ALL UNION ALL SELECT 'unpriced', 'Brand#none', 1.0),
  nowp AS (SELECT item_code, price FROM prices, lim WHERE as_of = CAST(last AS DATE))"""


@query("basket_costs", f"""WITH {TRAIL}, {BASKET}
SELECT action, count(*) AS components, count(price) AS priced, round(count(price) / count(*) * 100, 6) AS coverage_pct, round(CASE WHEN count(price) = count(*) THEN sum(amount * price) END, 6) AS cost,
  coalesce(string_agg(CASE WHEN price IS NULL THEN item_code END, ',' ORDER BY item_code), '') AS missing FROM basket LEFT JOIN nowp USING (item_code) GROUP BY action""")
def basket_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(I.basket_costs(*_basket(spark, sf_dir)))


def _basket(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What each action needs, and the prices of the last day."""
    part, prices = T.read(spark, sf_dir, "part"), _base(spark, sf_dir)[2]
    basket = part.groupBy(F.concat(F.lit("size_"), (F.col("p_size") % 5).cast("string")).alias("action"), F.col("p_brand").alias("item_code")).agg(F.count("*").cast("double").alias("amount"))
    none = part.limit(1).select(F.lit("unpriced").alias("action"), F.lit("Brand#none").alias("item_code"), F.lit(1.0).alias("amount"))
    now = prices.join(F.broadcast(prices.agg(F.max("as_of").alias("as_of"))), "as_of").select("item_code", "price")
    return basket.unionByName(none), now


@query("market_action_costs", f"""WITH {TRAIL}, {BASKET}, c AS (SELECT action, count(price) / count(*) * 100 AS coverage_pct, CASE WHEN count(price) = count(*) THEN sum(amount * price) END AS cost FROM basket LEFT JOIN nowp USING (item_code) GROUP BY action)
SELECT action, item_code, {rounded('amount', 'price', 'coverage_pct', 'cost')}, round(amount * price, 6) + 0.0 AS component_cost, CASE WHEN price IS NULL THEN 'missing' ELSE 'available' END AS component_status, CASE WHEN cost IS NULL THEN 'unavailable' ELSE 'available' END AS availability_status FROM basket LEFT JOIN nowp USING (item_code) JOIN c USING (action)""")
def market_action_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    basket, now = _basket(spark, sf_dir)
    out = K.action_costs(basket, I.basket_costs(basket, now), now)
    return r6(out.select("action", "item_code", "amount", "price", "coverage_pct", "cost", "component_cost", "component_status", "availability_status"))


@query("conflicting_prices", f"WITH {TRAIL} SELECT item_code, round(max(price) - min(price), 6) + 0.0 AS difference FROM prices GROUP BY item_code HAVING max(price) - min(price) > 200")
def conflicting_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check over prices of several days, which differ by more than is allowed."""
    return r6(I.conflicting_prices(_base(spark, sf_dir)[2], 200.0))


#: Changes over several periods beside every level.
INFLATION = TRAIL + """, l AS (SELECT index_key, as_of, sum(weight) * 100 AS coverage_pct, sum(weight * price / base_price) AS x, sum(weight) AS w FROM weights JOIN bp USING (item_code) JOIN prices USING (item_code) GROUP BY ALL),
pair AS (SELECT n.days, p.item_code, p.as_of, p.price, q.price AS price_before FROM prices p, (VALUES (7), (30), (90)) n(days), prices q WHERE p.item_code = q.item_code AND p.as_of = q.as_of + CAST(n.days AS INTEGER)),
chg AS (SELECT index_key, as_of, days, sum(weight) * 100 AS matched_pct, (sum(weight * price / base_price) / sum(weight * price_before / base_price) - 1) * 100 AS c FROM weights JOIN bp USING (item_code) JOIN pair USING (item_code) GROUP BY ALL),
chg2 AS (SELECT *, CASE WHEN matched_pct + 1e-12 >= 80 THEN c END AS change_pct FROM chg),
published AS (SELECT unnest(['broad', 'effort']) AS index_key UNION ALL SELECT 'basket_' || k FROM range(1, 10) r(k)),
infl AS (SELECT l.index_key, l.as_of, CASE WHEN l.coverage_pct + 1e-12 >= 80 THEN 100 * x / w END AS level, days || 'D' AS period_label, change_pct FROM l LEFT JOIN chg2 USING (index_key, as_of)
  UNION ALL SELECT index_key, NULL, NULL, n.days || 'D', NULL FROM published, (VALUES (7), (30), (90)) n(days) WHERE index_key NOT IN (SELECT index_key FROM l))"""


@query("market_inflation", f"""WITH {INFLATION} SELECT index_key, {day('as_of')} AS as_of, period_label, {rounded('level', 'change_pct')}, CASE WHEN change_pct IS NULL THEN 'Insufficient data' WHEN change_pct > 0.1 THEN 'Inflation' WHEN change_pct < -0.1 THEN 'Deflation' ELSE 'Stable' END AS classification,
  CASE WHEN as_of IS NULL THEN 'definition_unavailable' WHEN level IS NULL THEN 'level_unavailable' WHEN change_pct IS NULL THEN 'comparison_unavailable' ELSE 'available' END AS availability_status FROM infl""")
def market_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, b, p = _index(spark, sf_dir)
    changes = None
    for days in (7, 30, 90):
        part = I.matched_changes(w, b, p, days).withColumn("period_label", F.lit(f"{days}D"))
        changes = part if changes is None else changes.unionByName(part)
    heads = I.definition_tables(spark, DEFINITIONS)[0].where("enabled").select("index_key")
    out = K.inflation(heads, I.levels(w, b, p), changes, ["7D", "30D", "90D"])
    return r6(out.select("index_key", "as_of", "period_label", "level", "change_pct", "classification", "availability_status"))


#: A dense tape and one with a hole; a third item joins late. The inception is a Monday.
CHAIN = I.Chain(("even", "odd"), date(1995, 2, 6), date(2001, 11, 4), "late")
DAILY = T.LINE_TAPE_SQL + """, daily AS (SELECT item_code, day, sum(quantity) AS quantity, sum(money) AS turnover FROM line_tape WHERE money / quantity > 0 AND quantity > 0 AND {hole} GROUP BY ALL)"""
WALK = """, cov AS (SELECT * FROM daily QUALIFY day > min(day) OVER (PARTITION BY item_code)), cov2 AS (SELECT * FROM cov WHERE day < DATE '2001-11-04'),
px AS (SELECT item_code, CAST(day + 1 AS DATE) AS day, turnover / quantity AS price FROM cov2),
cal AS (SELECT CAST(d AS DATE) AS day, d = DATE '1995-02-06' OR isodow(d) = 1 AS is_reset FROM generate_series(TIMESTAMP '1995-02-06', TIMESTAMP '2001-11-04', INTERVAL 1 DAY) g(d)),
win AS (SELECT c.day, v.item_code, sum(turnover) AS turnover FROM cal c JOIN cov2 v ON v.day >= c.day - 28 AND v.day < c.day WHERE is_reset GROUP BY ALL HAVING count(*) = 28),
adm AS (SELECT min(day) AS admitted FROM win WHERE item_code = 'late'),
act AS (SELECT day, is_reset, 'even' AS item_code FROM cal UNION ALL SELECT day, is_reset, 'odd' FROM cal UNION ALL SELECT day, is_reset, 'late' FROM cal, adm WHERE day >= admitted),
d0 AS (SELECT a.day, any_value(is_reset) AS is_reset, count(*) AS members, count(price) AS priced, count(turnover) AS windows FROM act a LEFT JOIN px USING (day, item_code) LEFT JOIN win USING (day, item_code) GROUP BY a.day),
wts AS (SELECT a.day, item_code, turnover / sum(turnover) OVER (PARTITION BY a.day) AS weight FROM act a JOIN win w USING (day, item_code) JOIN d0 USING (day) WHERE windows = members),
fac AS (SELECT c.day, r.day AS reset, sum(weight * p.price / q.price) AS factor FROM cal c JOIN cal r ON r.is_reset AND r.day < c.day AND r.day >= c.day - 7 JOIN wts w ON w.day = r.day JOIN px q ON q.day = r.day AND q.item_code = w.item_code JOIN px p ON p.day = c.day AND p.item_code = w.item_code GROUP BY ALL),
walk AS (SELECT day, CASE WHEN priced = members AND windows = members THEN CAST(100 AS DOUBLE) END AS level, CASE WHEN priced = members AND windows = members THEN CAST(100 AS DOUBLE) END AS base_level, day AS base_reset, NOT (priced = members AND windows = members) AS broken, CASE WHEN priced <> members THEN 'incomplete_prices' WHEN windows <> members THEN 'incomplete_window' END AS reason FROM d0 WHERE day = DATE '1995-02-06'
  UNION ALL SELECT n.day, lv, CASE WHEN n.is_reset AND lv IS NOT NULL THEN lv ELSE n.base_level END, CASE WHEN n.is_reset AND lv IS NOT NULL THEN n.day ELSE n.base_reset END, n.was OR (n.is_reset AND NOT (priced = members AND windows = members)), CASE WHEN n.was THEN 'continuity_broken' WHEN priced <> members THEN 'incomplete_prices' WHEN n.is_reset AND windows <> members THEN 'incomplete_window' END
  FROM (SELECT d.*, w.broken AS was, w.base_level, w.base_reset, CASE WHEN w.broken OR priced <> members OR (d.is_reset AND windows <> members) THEN NULL ELSE w.base_level * f.factor END AS lv FROM walk w JOIN d0 d ON d.day = w.day + 1 LEFT JOIN fac f ON f.day = d.day AND f.reset = w.base_reset) n),
lv AS (SELECT w.*, is_reset, priced, members FROM walk w JOIN d0 USING (day))"""
CHAIN_ROWS = f"""SELECT {day('a.day')} AS day, a.is_reset, round(a.level, 6) + 0.0 AS level, a.priced, a.members, a.reason, round(CASE WHEN b.level > 0 THEN (a.level - b.level) / b.level * 100 END, 6) + 0.0 AS change_1d_pct,
  round(CASE WHEN c.level > 0 THEN (a.level - c.level) / c.level * 100 END, 6) + 0.0 AS change_7d_pct FROM lv a LEFT JOIN lv b ON b.day = a.day - 1 LEFT JOIN lv c ON c.day = a.day - 7"""
CHAIN_COLS = ("day", "is_reset", "level", "priced", "members", "reason", "change_1d_pct", "change_7d_pct")


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.daily_facts(T.line_tape(spark, sf_dir))


@query("chained_index", "WITH RECURSIVE " + DAILY.format(hole="true") + WALK + " " + CHAIN_ROWS)
def chained_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(I.chained(_chain(spark, sf_dir), CHAIN).select(*CHAIN_COLS))


@query("chained_index_gapped", "WITH RECURSIVE " + DAILY.format(hole="NOT (item_code = 'even' AND day = DATE '1995-08-16')") + WALK + " " + CHAIN_ROWS)
def chained_index_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item does not trade on one Wednesday: the next day is a gap and the next Monday ends the chain."""
    daily = _chain(spark, sf_dir).where("not (item_code = 'even' and day = date'1995-08-16')")
    return r6(I.chained(daily, CHAIN).select(*CHAIN_COLS))


@query("chained_weights", "WITH RECURSIVE " + DAILY.format(hole="true") + WALK + f""", k AS (SELECT w.*, row_number() OVER (PARTITION BY w.day ORDER BY weight DESC, item_code) AS rank FROM wts w JOIN lv ON lv.day = w.day AND lv.level IS NOT NULL)
SELECT {day('day')} AS day, {day('CAST(day - 28 AS DATE)')} AS window_start, item_code, CAST(rank AS BIGINT) AS rank, {rounded('weight')}, round(sum(CASE WHEN rank <= 3 THEN weight END) OVER (PARTITION BY day), 6) AS top3 FROM k""")
def chained_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(I.chain_weights(_chain(spark, sf_dir), CHAIN))


@query("chained_status", "WITH RECURSIVE " + DAILY.format(hole="true") + WALK + f""", s AS (SELECT count(level) FILTER (day > DATE '2001-11-04' - 30) AS valid_days, min(day) FILTER (level IS NOT NULL AND day > DATE '2001-11-04' - 30) AS first_valid, arg_max(reason, day) FILTER (reason IS NOT NULL AND day = DATE '2001-11-04') AS reason, max(level) FILTER (day = DATE '2001-11-04') AS latest_level FROM lv),
t AS (SELECT max(weight) * 100 AS top_weight_pct FROM wts WHERE day = (SELECT max(w.day) FROM wts w JOIN lv ON lv.day = w.day AND lv.level IS NOT NULL))
SELECT valid_days, {day('first_valid')} AS first_valid, reason, round(latest_level, 6) + 0.0 AS latest_level, {day('admitted')} AS admitted, round(top_weight_pct, 6) + 0.0 AS top_weight_pct, CASE WHEN valid_days = 30 THEN 'complete' WHEN valid_days > 0 THEN 'partial' ELSE 'unavailable' END AS coverage_status FROM s, adm, t""")
def chained_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _chain(spark, sf_dir)
    out = I.chain_status(I.chained(daily, CHAIN), I.chain_weights(daily, CHAIN), CHAIN)
    return r6(out.select("valid_days", "first_valid", "reason", "latest_level", "admitted", "top_weight_pct", "coverage_status"))


@query("guarded_index", "WITH RECURSIVE " + DAILY.format(hole="true") + WALK + f""" SELECT {day('day')} AS day, CAST(NULL AS DOUBLE) AS level, CAST(1 AS BIGINT) AS unexpected FROM lv""")
def guarded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item trades that is no constituent: every level is blank."""
    daily = _chain(spark, sf_dir)
    known = daily.where(F.col("item_code").isin("even", "odd"))
    return r6(I.guarded(I.chained(daily, CHAIN), I.unexpected_members(daily, known)).select("day", "level", "unexpected"))


@query("unexpected_members", f"WITH {TAPE} SELECT DISTINCT item_code FROM tape WHERE item_code NOT IN ('click', 'view')")
def unexpected_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tape(spark, sf_dir)
    return I.unexpected_members(t, t.where(F.col("item_code").isin("click", "view")))


# -- coverage and resolution ----------------------------------------------
SCANS = """scans AS (SELECT DISTINCT event_type AS item_code, date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end" FROM events WHERE extract(hour FROM ts) <> 5)"""


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    rows = T.read(spark, sf_dir, "events").where(F.hour(F.col("ts").cast("timestamp")) != 5)
    return rows.select(F.col("event_type").alias("item_code"), hour.alias("start"), (hour + F.expr("interval 1 hour")).alias("end")).distinct()


@query("coverage_merged", f"""WITH {SCANS}, o AS (SELECT *, max("end") OVER (PARTITION BY item_code ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM scans),
i AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY item_code ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o)
SELECT item_code, {stamp('min(start)')} AS start, {stamp('max("end")')} AS "end" FROM i GROUP BY item_code, island""")
def coverage_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(V.merged(_scans(spark, sf_dir), ["item_code"]))


@query("coverage_of_window", f"""WITH {SCANS}, o AS (SELECT *, max("end") OVER (PARTITION BY item_code ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM scans),
i AS (SELECT *, sum(CASE WHEN start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY item_code ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM o),
m AS (SELECT item_code, min(start) AS s, max("end") AS e FROM i GROUP BY item_code, island)
SELECT item_code, max(s <= TIMESTAMP '2024-01-10 07:00:00' AND e >= TIMESTAMP '2024-01-10 20:00:00') AS covered FROM m GROUP BY item_code""")
def coverage_of_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp")
    return V.covers(_scans(spark, sf_dir), ["item_code"], at("2024-01-10 07:00:00"), at("2024-01-10 20:00:00"))


@query("retention", f"""WITH {SCANS}, c AS (SELECT max(ts) - INTERVAL 10 DAYS AS cutoff FROM events) SELECT item_code, {stamp('greatest(start, cutoff)')} AS start, {stamp('"end"')} AS "end" FROM (SELECT DISTINCT * FROM scans), c WHERE "end" > cutoff""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    cutoff = C.resolve(None, (T.tape(spark, sf_dir), "created_at")).analysis
    return r6(V.clamped(_scans(spark, sf_dir), F.lit(cutoff).cast("timestamp") - F.expr("interval 10 days")))


@query("identity_conflicts", """WITH r AS (SELECT event_id % 2000 AS id, event_type AS item_code, event_id AS arrival FROM events), f AS (SELECT id, arg_min(item_code, arrival) AS first FROM r GROUP BY id)
SELECT item_code, count(*) AS n FROM r JOIN f USING (id) WHERE item_code <> first GROUP BY item_code""")
def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.read(spark, sf_dir, "events").select((F.col("event_id") % 2000).alias("id"), F.col("event_type").alias("item_code"), F.col("event_id").alias("arrival"))
    return R.identity_conflicts(r, ["item_code"]).groupBy("item_code").agg(F.count("*").alias("n"))


# -- scans, sets and tables ------------------------------------------------
@query("scan_item_window", f"WITH {TAPE} SELECT id, {stamp('created_at')} AS created_at, {rounded('unit_price', 'quantity')} FROM tape WHERE item_code = 'purchase' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12'")
def scan_item_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scan(T.tape(spark, sf_dir), ["purchase"], AT("2024-01-05"), AT("2024-01-12"), transaction_type="trading")
    return r6(rows.select("id", "created_at", "unit_price", "quantity"))


def AT(text: str):
    return F.lit(text).cast("timestamp")


@query("scan_items_period", f"WITH {TAPE} SELECT item_code, id, {stamp('created_at')} AS created_at FROM tape WHERE item_code IN (SELECT item_code FROM tape GROUP BY item_code HAVING min(id) < 3) AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-08'")
def scan_items_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several items, given as a table."""
    t = T.tape(spark, sf_dir)
    wanted = S.commodities(t).groupBy("item_code").agg(F.min("id").alias("least")).where("least < 3")
    return r6(S.scan(t, wanted, AT("2024-01-05"), AT("2024-01-08"), transaction_type="trading").select("item_code", "id", "created_at"))


@query("scan_quotes_window", f"WITH {QUOTES} SELECT item_code, id, round(current_price, 6) + 0.0 AS current_price FROM quotes WHERE item_code IN ('click', 'view') AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-12'")
def scan_quotes_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.scan(T.quotes(spark, sf_dir), ["click", "view"], AT("2024-01-05"), AT("2024-01-12"), "observed_at").select("item_code", "id", "current_price"))


@query("scan_books_window", f"WITH {BOOK} SELECT item_code, {stamp('observed_at')} AS observed_at, count(*) AS levels FROM book_levels WHERE item_code = 'click' AND observed_at >= TIMESTAMP '2024-01-05' AND observed_at < TIMESTAMP '2024-01-12' GROUP BY ALL")
def scan_books_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.scan(T.book_levels(spark, sf_dir), ["click"], AT("2024-01-05"), AT("2024-01-12"), "observed_at")
    return r6(rows.groupBy("item_code", "observed_at").agg(F.count("*").alias("levels")))


@query("item_discovery", f"WITH {TAPE}, {BOOK}, {QUOTES} SELECT item_code FROM tape UNION SELECT item_code FROM book_levels UNION SELECT item_code FROM quotes")
def item_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir).select("item_code") for f in (T.tape, T.book_levels, T.quotes)]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("data_clock", f"WITH {TAPE}, {QUOTES}, {BOOK} SELECT {stamp('max(x)')} AS data_as_of, {stamp("date_trunc('day', max(x))")} AS last_midnight FROM (SELECT max(created_at) AS x FROM all_trades UNION ALL SELECT max(observed_at) FROM quotes UNION ALL SELECT max(observed_at) FROM book_levels)")
def data_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = C.data_clock((T.tape(spark, sf_dir), "created_at"), (T.quotes(spark, sf_dir), "observed_at"), (T.book_levels(spark, sf_dir), "observed_at"))
    return r6(clock.withColumn("last_midnight", X.complete_midnight("data_as_of")))


@query("table_inventory", f"WITH {TAPE} SELECT transaction_type, count(*) AS n, count(unit_price) AS priced, {stamp('min(created_at)')} AS first_at, {stamp('max(created_at)')} AS last_at FROM all_trades GROUP BY transaction_type")
def table_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.inventory(T.tape(spark, sf_dir)))


@query("history_coverage", f"WITH {TAPE} SELECT item_code, count(*) AS n, {stamp('min(created_at)')} AS first_at, {stamp('max(created_at)')} AS last_at FROM tape GROUP BY item_code")
def history_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(S.inventory(S.commodities(T.tape(spark, sf_dir)), "item_code").drop("priced"))


@query("activity_board", f"""WITH {TAPE}, {CLOCK}, {T.POINTS_SQL}, v AS (SELECT item_code, sum(money) AS value, sum(quantity) AS units FROM tape, clock WHERE created_at >= c - INTERVAL 7 DAYS GROUP BY item_code)
SELECT item_code, {rounded('value', 'units')}, round(units * points, 6) + 0.0 AS point_volume, round(value / max(value) OVER () * 100, 6) AS bar_pct FROM v JOIN points USING (item_code) ORDER BY value DESC, item_code LIMIT 3""")
def activity_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.tape(spark, sf_dir)
    out = S.activity(t, C.resolve(None, (t, "created_at")), T.points(spark, sf_dir), top=3)
    return r6(out.select("item_code", "value", "units", "point_volume", "bar_pct"))


@query("names_of_entities", f"""WITH {T.ENTITIES_SQL}, asked AS (SELECT DISTINCT upper(name) AS text FROM entities UNION SELECT id FROM entities WHERE kind = 'country' UNION SELECT DISTINCT o_orderpriority FROM orders),
hits AS (SELECT text, kind, id, 0 AS way FROM asked JOIN entities ON text = id UNION SELECT text, kind, id, 1 FROM asked JOIN entities ON lower(text) = lower(name)),
best AS (SELECT * FROM hits QUALIFY way = min(way) OVER (PARTITION BY text))
SELECT text, count(id) AS candidates, CASE WHEN count(id) = 1 THEN min(kind || ':' || id) END AS entity FROM asked LEFT JOIN best USING (text) GROUP BY text""")
def names_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity by its name in capitals, every country by its id too, and texts that name nobody."""
    e = T.entities(spark, sf_dir)
    asked = e.select(F.upper("name").alias("text")).union(e.where("kind = 'country'").select("id")).union(T.read(spark, sf_dir, "orders").select("o_orderpriority")).distinct()
    found = N.resolve_names(asked, e)
    return found.select("text", "candidates", F.concat("entity.kind", F.lit(":"), "entity.id").alias("entity"))
