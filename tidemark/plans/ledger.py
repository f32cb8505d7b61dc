"""Ledger queries over the driver's tables, each with the SQL that DuckDB runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import context as C
from tidemark.operators import ledger as L
from tidemark.operators import selection as N
from tidemark.operators import sinks as K
from tidemark.plans.market import r6, rounded, stamp
from tidemark.session import stored
from tidemark.sources import tables as T

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _account(side: str) -> str:
    inst = f"((CASE WHEN {side}_mu_id IS NULL THEN 0 ELSE 1 END) + (CASE WHEN {side}_country_id IS NULL THEN 0 ELSE 1 END) + (CASE WHEN {side}_party_id IS NULL THEN 0 ELSE 1 END))"
    ident = f"coalesce({side}_mu_id, {side}_country_id, {side}_party_id, {side}_user_id)"
    reason = f"CASE WHEN {inst} > 1 THEN 'conflicting_institutions' WHEN {ident} IS NULL THEN 'missing_reference' WHEN {side}_party_id IS NOT NULL THEN 'unsupported_party' END"
    kind = f"CASE WHEN {side}_mu_id IS NOT NULL THEN 'mu' WHEN {side}_country_id IS NOT NULL THEN 'country' ELSE 'user' END"
    return f"{reason} AS {side}_reason, CASE WHEN {reason} IS NULL THEN {kind} END AS {side}_kind, CASE WHEN {reason} IS NULL THEN {ident} END AS {side}_account"


def _side(side: str) -> str:
    """One side's rows: a settled amount already holds fees, a gross one does not."""
    plus, minus = ("+", "-") if side == "buy" else ("-", "+")
    return f"""SELECT id, created_at, transaction_type, item_code, category, money, quantity, '{side}' AS side, {side}_kind AS kind, {side}_account AS account, {side}_user_id AS actor,
  CASE WHEN verified THEN CASE role WHEN 'gross' THEN money ELSE money {minus} fee END END AS gross, CASE WHEN verified THEN CASE role WHEN 'settled' THEN money ELSE money {plus} fee END END AS net,
  verified AND (role = 'settled' OR fee IS NOT NULL) AS fee_known FROM att WHERE NOT self_trade AND {side}_account IS NOT NULL"""


ROWS = T.LEDGER_SQL + f""", acc AS (SELECT *, {_account('buy')}, {_account('sell')} FROM ledger_trades),
att AS (SELECT *, coalesce(buy_kind = sell_kind AND buy_account = sell_account, false) AS self_trade FROM acc),
since AS (SELECT max(created_at) - INTERVAL 7 DAYS AS t FROM all_trades),
win AS (SELECT * FROM att WHERE created_at >= (SELECT t FROM since)),
parts_all AS ({_side('buy')} UNION ALL {_side('sell')}),
parts AS (SELECT * FROM parts_all WHERE created_at >= (SELECT t FROM since))"""


def _sum(side: str, value: str) -> str:
    return f"coalesce(sum({value}) FILTER (side = '{side}'), 0)"


def _whole(side: str, value: str) -> str:
    return f"CASE WHEN count(*) FILTER (side = '{side}') = count({value}) FILTER (side = '{side}') THEN {_sum(side, value)} END"


ACCS = ROWS + f""", a0 AS (SELECT kind, account, {_sum('buy', 'money')} AS source_buy, {_sum('sell', 'money')} AS source_sell, {_whole('buy', 'gross')} AS gross_buy, {_whole('sell', 'gross')} AS gross_sell, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells,
  count(*) FILTER (money IS NULL) AS missing_money, count(*) FILTER (quantity IS NULL OR quantity = 0) AS invalid_quantity, count(DISTINCT actor) AS actors FROM parts GROUP BY kind, account),
basis AS (SELECT CASE WHEN bool_and(gross_buy IS NOT NULL AND gross_sell IS NOT NULL) THEN 'gross' ELSE 'source' END AS basis FROM a0),
accs AS (SELECT a0.*, basis, CASE WHEN basis = 'gross' THEN gross_buy ELSE source_buy END AS buy_value, CASE WHEN basis = 'gross' THEN gross_sell ELSE source_sell END AS sell_value,
  CASE WHEN basis = 'gross' THEN gross_buy + gross_sell ELSE source_buy + source_sell END AS turnover FROM a0, basis)"""
CATS = ACCS + f""", c0 AS (SELECT kind, account, category, min(item_code) AS item_code, min(transaction_type) AS market_type, {_sum('buy', 'quantity')} AS buy_quantity, {_sum('sell', 'quantity')} AS sell_quantity, {_sum('buy', 'money')} AS buy_source, {_sum('sell', 'money')} AS sell_source,
  {_whole('buy', 'gross')} AS buy_gross, {_whole('sell', 'gross')} AS sell_gross, count(*) FILTER (side = 'buy') AS buys, count(*) FILTER (side = 'sell') AS sells,
  count(*) FILTER (side = 'buy' AND money IS NULL) AS bmm, count(*) FILTER (side = 'buy' AND quantity IS NULL) AS bmq, count(*) FILTER (side = 'sell' AND money IS NULL) AS smm, count(*) FILTER (side = 'sell' AND quantity IS NULL) AS smq FROM parts GROUP BY kind, account, category),
c1 AS (SELECT c0.*, CASE WHEN basis = 'gross' THEN buy_gross ELSE buy_source END AS buy_value, CASE WHEN basis = 'gross' THEN sell_gross ELSE sell_source END AS sell_value FROM c0, basis),
c2 AS (SELECT *, CASE WHEN buy_quantity > 0 AND bmm + bmq = 0 THEN buy_value / buy_quantity END AS average_buy, CASE WHEN sell_quantity > 0 AND smm + smq = 0 THEN sell_value / sell_quantity END AS average_sell, CASE WHEN bmq + smq = 0 THEN least(buy_quantity, sell_quantity) END AS matched_quantity FROM c1),
cats AS (SELECT *, CASE WHEN matched_quantity > 0 THEN matched_quantity * (average_sell - average_buy) END AS comparison, buy_quantity - matched_quantity AS unmatched_buy, sell_quantity - matched_quantity AS unmatched_sell, CASE WHEN bmq + smq = 0 THEN buy_quantity - sell_quantity END AS net_quantity FROM c2)"""


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All attributed trades, and those of the seven days before the clock."""
    t = T.ledger_trades(spark, sf_dir)
    rows = L.attributed(t)
    return rows, rows.where(C.resolve(None, (t, "created_at")).window("created_at", L.WINDOW_DAYS))


def _accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The window's sides and its accounts on one basis."""
    parts = L.sides(_rows(spark, sf_dir)[1])
    return parts, L.on_basis(L.account_ledger(parts))


def _categories(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts, accounts = _accounts(spark, sf_dir)
    return accounts, L.category_ledger(parts, L.money_basis(L.account_ledger(parts)))


@query("ledger_attribution", f"""WITH {ROWS}, r AS (SELECT 'market' AS what, money FROM win UNION ALL SELECT 'self_trade', money FROM win WHERE self_trade
  UNION ALL SELECT buy_reason, money FROM win WHERE buy_reason IS NOT NULL AND NOT self_trade UNION ALL SELECT sell_reason, money FROM win WHERE sell_reason IS NOT NULL AND NOT self_trade)
  SELECT what, count(*) AS n, round(coalesce(sum(money), 0), 6) AS value, count(*) - count(money) AS missing_money FROM r GROUP BY what""")
def ledger_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(L.attribution_totals(_rows(spark, sf_dir)[1]))


ACC_COLS = ("source_buy", "source_sell", "gross_buy", "gross_sell", "buy_value", "sell_value", "turnover")


@query("ledger_accounts", f"WITH {ACCS} SELECT kind, account, basis, buys, sells, missing_money, invalid_quantity, actors, {rounded(*ACC_COLS)} FROM accs")
def ledger_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_accounts(spark, sf_dir)[1].select("kind", "account", "basis", "buys", "sells", "missing_money", "invalid_quantity", "actors", *ACC_COLS))


@query("ledger_gross_basis", f"""WITH {ACCS}, v AS (SELECT kind, account, {_whole('buy', 'gross')} AS gross_buy, {_whole('sell', 'gross')} AS gross_sell FROM parts WHERE gross IS NOT NULL GROUP BY kind, account)
SELECT kind, account, 'gross' AS basis, round(gross_buy + gross_sell, 6) + 0.0 AS turnover FROM v""")
def ledger_gross_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every amount is verified the whole report is on gross amounts."""
    parts = L.sides(_rows(spark, sf_dir)[1]).where("gross is not null")
    return r6(L.on_basis(L.account_ledger(parts)).select("kind", "account", "basis", "turnover"))


CAT_COLS = ("buy_value", "sell_value", "buy_quantity", "sell_quantity", "average_buy", "average_sell", "matched_quantity", "comparison", "unmatched_buy", "unmatched_sell", "net_quantity")


@query("ledger_categories", f"WITH {CATS} SELECT kind, account, category, market_type, buys, sells, {rounded(*CAT_COLS)} FROM cats")
def ledger_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_categories(spark, sf_dir)[1].select("kind", "account", "category", "market_type", "buys", "sells", *CAT_COLS))


SIDE_CATS = CATS + """, sc0 AS (SELECT kind, account, category, item_code, market_type, 'buy' AS side, buy_value AS money, buy_quantity AS quantity, buys AS trades, average_buy AS average_price FROM cats WHERE buys > 0
  UNION ALL SELECT kind, account, category, item_code, market_type, 'sell', sell_value, sell_quantity, sells, average_sell FROM cats WHERE sells > 0),
sc AS (SELECT s.*, row_number() OVER (PARTITION BY kind, account, side ORDER BY money DESC, category) AS rank, CASE WHEN missing_money = 0 AND CASE side WHEN 'buy' THEN buy_value ELSE sell_value END > 0 THEN money / CASE side WHEN 'buy' THEN buy_value ELSE sell_value END END AS share FROM sc0 s JOIN accs a USING (kind, account))"""


@query("participant_trade_breakdown", f"WITH {SIDE_CATS} SELECT kind, account, side, CAST(rank AS BIGINT) AS category_index, category, market_type, trades, {rounded('money', 'quantity', 'average_price', 'share')} FROM sc")
def participant_trade_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts, categories = _categories(spark, sf_dir)
    return r6(L.side_categories(categories, accounts).select("kind", "account", "side", F.col("rank").alias("category_index"), "category", "market_type", "trades", "money", "quantity", "average_price", "share"))


@query("participant_top_categories", f"""WITH {SIDE_CATS} SELECT kind, account, side, CAST(least(rank, 4) AS BIGINT) AS place, CASE WHEN rank <= 3 THEN category ELSE 'other' END AS category, round(sum(money), 6) + 0.0 AS money, CAST(sum(trades) AS BIGINT) AS trades, round(sum(share), 6) + 0.0 AS share FROM sc GROUP BY ALL""")
def participant_top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts, categories = _categories(spark, sf_dir)
    return r6(L.top_categories(L.side_categories(categories, accounts)).select("kind", "account", "side", "place", "category", "money", "trades", "share"))


@query("participant_items", f"""WITH {CATS} SELECT kind, account, CAST(row_number() OVER (PARTITION BY kind, account ORDER BY coalesce(buy_value, 0) + coalesce(sell_value, 0) DESC, category) AS BIGINT) AS item_index, category, item_code, market_type, {rounded('net_quantity', 'comparison')},
  'window averages; not realized P&L' AS comparison_basis FROM cats""")
def participant_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(K.participant_items(_categories(spark, sf_dir)[1]).select("kind", "account", "item_index", "category", "item_code", "market_type", "net_quantity", "comparison", "comparison_basis"))


@query("ledger_details", f"""WITH {CATS}, t AS (SELECT *, coalesce(buy_value, 0) + coalesce(sell_value, 0) AS turnover, buy_value IS NULL OR sell_value IS NULL OR bmm + smm > 0 AS unknown FROM cats),
w AS (SELECT *, sum(turnover) OVER (PARTITION BY kind, account) AS total, bool_or(unknown) OVER (PARTITION BY kind, account) AS partial, sum(turnover) OVER o AS cum, row_number() OVER o AS position FROM t WINDOW o AS (PARTITION BY kind, account ORDER BY turnover DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT kind, account, category, CAST(position AS BIGINT) AS position, {rounded('turnover')}, CASE WHEN partial THEN 'partial' ELSE 'complete' END AS status FROM w WHERE partial OR (total > 0 AND cum - turnover < 0.8 * total)""")
def ledger_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(L.detail_prefix(_categories(spark, sf_dir)[1]).select("kind", "account", "category", "position", "turnover", "status"))


@query("ledger_history_ids", f"""WITH {ROWS}, refs AS (SELECT id, created_at, unnest([struct_pack(k := 'user', r := buy_user_id), struct_pack(k := 'mu', r := buy_mu_id), struct_pack(k := 'country', r := buy_country_id), struct_pack(k := 'user', r := sell_user_id), struct_pack(k := 'mu', r := sell_mu_id), struct_pack(k := 'country', r := sell_country_id)]) AS x FROM att),
hour AS (SELECT * FROM refs WHERE created_at >= (SELECT max(created_at) FROM all_trades) - INTERVAL 3 HOURS)
SELECT DISTINCT id FROM refs WHERE x.r IS NOT NULL AND (x.k, x.r) IN (SELECT (x.k, x.r) FROM hour WHERE x.r IS NOT NULL)""")
def ledger_history_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.ledger_trades(spark, sf_dir)
    return L.active_history(t, t.where(C.resolve(None, (t, "created_at")).window("created_at", 3 / 24))).select("id")


#: A queue told another way: a lot's and a sale's places on the line of quantities, met by overlap.
FIFO = ROWS + """, x0 AS (SELECT *, epoch_us(created_at) AS us, NOT coalesce(quantity > 0, false) AS unknown, count(*) OVER (PARTITION BY kind, account, item_code, created_at) > 1 AS tied FROM parts_all WHERE transaction_type = 'trading'),
x1 AS (SELECT *, coalesce(sum(CASE WHEN side = 'sell' AND unknown THEN 1 ELSE 0 END) OVER (PARTITION BY kind, account, item_code ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM x0),
x2 AS (SELECT *, sum(CASE WHEN side = 'buy' AND unknown THEN 1 ELSE 0 END) OVER (PARTITION BY kind, account, item_code, segment ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 0 AS barred FROM x1),
x3 AS (SELECT *, CASE WHEN side = 'buy' AND NOT unknown AND NOT barred THEN quantity ELSE 0 END AS bought, CASE WHEN side = 'sell' AND NOT unknown THEN quantity ELSE 0 END AS sold FROM x2),
x4 AS (SELECT *, sum(sold) OVER o AS s, sum(bought) OVER o AS lot_high, coalesce(sum(bought) OVER (PARTITION BY kind, account, item_code, segment ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM x3
  WINDOW o AS (PARTITION BY kind, account, item_code, segment ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
x5 AS (SELECT *, s - greatest(0, coalesce(max(CASE WHEN sold > 0 THEN s - b END) OVER (PARTITION BY kind, account, item_code, segment ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS m FROM x4),
sales AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY kind, account, item_code, segment ORDER BY us, id), 0) AS low FROM x5 WHERE side = 'sell'),
met AS (SELECT s.kind, s.account, s.item_code, s.id AS sale_id, s.created_at AS sold_at, l.id AS lot_id, least(s.m, l.lot_high) - greatest(s.low, l.lot_high - l.bought) AS matched, s.money / s.quantity - l.money / l.quantity AS d, s.net / s.quantity - l.net / l.quantity AS dn, s.gross / s.quantity - l.gross / l.quantity AS dg,
  l.gross IS NOT NULL OR l.net IS NOT NULL AS costed, s.fee_known AND l.fee_known AS fees_known, l.tied AS lot_tied, s.quantity AS sq, s.money AS sm
  FROM sales s JOIN x5 l ON l.bought > 0 AND s.kind = l.kind AND s.account = l.account AND s.item_code = l.item_code AND s.segment = l.segment AND l.lot_high - l.bought < s.m AND s.low < l.lot_high WHERE s.m > s.low)"""


@query("ledger_fifo", f"WITH {FIFO} SELECT kind, account, item_code, sale_id, lot_id, {rounded('matched')}, round(matched * d, 6) + 0.0 AS profit, round(matched * dn, 6) + 0.0 AS net_profit, costed, fees_known FROM met WHERE matched > 1e-9")
def ledger_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(L.fifo(L.sides(_rows(spark, sf_dir)[0])).select("kind", "account", "item_code", "sale_id", "lot_id", "matched", "profit", "net_profit", "costed", "fees_known"))


REALIZED = FIFO + ACCS.removeprefix(ROWS) + """, f AS (SELECT kind, account, sum(matched * dn) AS net_profit, sum(matched * dg) AS gross_profit, sum(CASE WHEN costed THEN matched END) AS mq, sum(CASE WHEN dn IS NOT NULL THEN matched END) AS nmq, sum(CASE WHEN fees_known THEN matched END) AS fq, sum(CASE WHEN costed THEN coalesce(sm, 0) * matched / sq END) AS mv, bool_or(lot_tied) AS lot_tied
  FROM met WHERE matched > 1e-9 AND sold_at >= (SELECT t FROM since) GROUP BY kind, account),
sold AS (SELECT kind, account, sum(quantity) FILTER (side = 'sell' AND quantity > 0) AS sold FROM parts GROUP BY kind, account),
eq AS (SELECT kind, account, bool_or(n > 1) AS tied FROM (SELECT kind, account, count(*) AS n FROM parts GROUP BY kind, account, transaction_type, item_code, created_at) GROUP BY kind, account),
real AS (SELECT a.*, f.net_profit, f.gross_profit, coalesce(mq, 0) AS matched_quantity, coalesce(nmq, 0) AS net_matched_quantity, coalesce(sold, 0) - coalesce(mq, 0) AS uncosted_quantity, coalesce(sold, 0) - coalesce(fq, 0) AS unknown_fee_quantity, tied OR coalesce(lot_tied, false) AS equal_time,
  CASE WHEN source_sell > 0 AND missing_money = 0 THEN coalesce(mv, 0) / source_sell END AS matched_source_coverage FROM accs a LEFT JOIN f USING (kind, account) LEFT JOIN sold USING (kind, account) LEFT JOIN eq USING (kind, account))"""


def _realized(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.ledger_trades(spark, sf_dir)
    window = C.resolve(None, (T.tape(spark, sf_dir), "created_at"))
    every = stored(L.sides(L.attributed(t)), "every")
    parts = every.where(window.window("created_at", L.WINDOW_DAYS))
    matches = L.fifo(every).where(window.window("sold_at", L.WINDOW_DAYS))
    return L.realized(parts, matches, L.on_basis(L.account_ledger(parts)))


REAL_COLS = ("net_profit", "gross_profit", "matched_quantity", "net_matched_quantity", "uncosted_quantity", "unknown_fee_quantity", "matched_source_coverage")


@query("ledger_realized", f"""WITH {REALIZED} SELECT kind, account, {rounded(*REAL_COLS)}, equal_time, CASE WHEN net_profit IS NULL THEN 'unavailable' WHEN uncosted_quantity > 1e-9 OR unknown_fee_quantity > 1e-9 OR invalid_quantity + missing_money > 0 OR equal_time THEN 'partial' ELSE 'matched_sales' END AS costing_status FROM real""")
def ledger_realized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_realized(spark, sf_dir).select("kind", "account", *REAL_COLS, "equal_time", "costing_status"))


BOARDS = REALIZED + """, bd AS (SELECT 'losses' AS board, row_number() OVER (PARTITION BY kind ORDER BY net_profit, turnover DESC, account) AS rank, * FROM real WHERE net_profit < 0 UNION ALL
  SELECT 'profits', row_number() OVER (PARTITION BY kind ORDER BY net_profit DESC, turnover DESC, account), * FROM real WHERE net_profit > 0 UNION ALL
  SELECT 'volume', row_number() OVER (PARTITION BY kind ORDER BY turnover DESC, account), * FROM real WHERE turnover > 0)"""


@query("ledger_boards", f"WITH {BOARDS} SELECT board, kind, CAST(rank AS BIGINT) AS rank, account, {rounded('net_profit', 'turnover')} FROM bd WHERE rank <= 10 AND kind IN ('user', 'mu', 'country')")
def ledger_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(L.boards(_realized(spark, sf_dir)))


@query("participant_rankings", f"""WITH {BOARDS}, {T.ENTITIES_SQL} SELECT board AS ranking_kind, b.kind AS entity_kind, account AS entity_id, coalesce(e.name, account) AS name, c.name AS citizenship_name, CAST(rank AS BIGINT) AS rank, {rounded('net_profit', 'turnover')}
  FROM bd b LEFT JOIN entities e ON e.kind = b.kind AND e.id = account LEFT JOIN entities c ON c.kind = 'country' AND c.id = e.citizenship_id WHERE rank <= 10""")
def participant_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = N.with_names(L.boards(_realized(spark, sf_dir)), T.entities(spark, sf_dir))
    return r6(K.participant_rankings(named).select("ranking_kind", "entity_kind", "entity_id", "name", "citizenship_name", "rank", "net_profit", "turnover"))


def one_account(spark: SparkSession, sf_dir: str, kind: str, account: str) -> DataFrame:
    """An account's totals in the window from its own trades alone."""
    t = T.ledger_trades(spark, sf_dir)
    own = L.attributed(L.of_entity(t.where(C.resolve(None, (t, "created_at")).window("created_at", L.WINDOW_DAYS)), kind, account))
    return L.account_ledger(L.sides(own).where((F.col("kind") == kind) & (F.col("account") == account)))


ONE_COLS = ("source_buy", "source_sell", "source_turnover")


@query("ledger_one_account", f"""WITH {ACCS}, top AS (SELECT kind, account FROM accs WHERE kind IN ('user', 'mu', 'country') QUALIFY row_number() OVER (PARTITION BY kind ORDER BY turnover DESC, account) = 1)
SELECT kind, account, buys, sells, {rounded('source_buy', 'source_sell')}, round(source_buy + source_sell, 6) + 0.0 AS source_turnover FROM accs JOIN top USING (kind, account)""")
def ledger_one_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targeted path for the first account of each kind's volume board: three names, asked for one by one."""
    first = L.boards(L.without_costing(_accounts(spark, sf_dir)[1]), 1).where("board = 'volume'").select("kind", "account").collect()
    out = None
    for r in first:
        one = one_account(spark, sf_dir, r.kind, r.account)
        out = one if out is None else out.unionByName(one)
    return r6(out.select("kind", "account", "buys", "sells", *ONE_COLS))


@query("ledger_equal_time", f"""WITH {ROWS} SELECT kind, account, bool_or(n > 1) AS equal_time FROM (SELECT kind, account, count(*) AS n FROM parts GROUP BY kind, account, transaction_type, item_code, created_at) GROUP BY ALL""")
def ledger_equal_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.equal_time(L.sides(_rows(spark, sf_dir)[1]))


@query("ledger_out_of_order", f"WITH {T.TAPE_SQL}, d AS (SELECT id % 9000 AS id, created_at FROM all_trades) SELECT id, count(*) AS n, count(DISTINCT created_at) AS times FROM d GROUP BY id HAVING count(*) > 1")
def ledger_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.out_of_order(T.tape(spark, sf_dir).withColumn("id", F.col("id") % 9000))


@query("equipment_sales", f"""WITH {ROWS} SELECT id, {stamp('created_at')} AS created_at, item_code, {rounded('money', 'quantity')}, 'gear' || (id % 4) AS equipment_code, id % 5 AS state, CAST(10 AS BIGINT) AS max_state, CASE WHEN id % 7 = 0 THEN 'unknown' ELSE 'observed' END AS equipment_stats_status,
  'unverified_equipment_lineage' AS basis_status, 'unverified' AS fee_status FROM ledger_trades WHERE transaction_type = 'itemMarket' AND created_at >= (SELECT t FROM since)""")
def equipment_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_gear(spark, sf_dir).select("id", "created_at", "item_code", "money", "quantity", "equipment.equipment_code", "equipment.state", "equipment.max_state", "equipment_stats_status", "basis_status", "fee_status"))


def _gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.ledger_trades(spark, sf_dir)
    return L.equipment_sales(t, *C.resolve(None, (t, "created_at")).bounds(L.WINDOW_DAYS))


@query("equipment_sale_stats", f"""WITH {ROWS}, g AS (SELECT id FROM ledger_trades WHERE transaction_type = 'itemMarket' AND created_at >= (SELECT t FROM since) AND id % 7 <> 0) SELECT id, 'armor' AS skill, id % 2 AS value FROM g UNION ALL SELECT id, 'attack', id % 3 FROM g""")
def equipment_sale_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stat_rows(_gear(spark, sf_dir).select("id", "equipment.stats"))


@query("equipment_lineage", f"""WITH {ROWS}, p AS (SELECT *, 'i' || (id % 50) AS instance, id % 3 <> 0 AS lineage FROM parts_all WHERE transaction_type = 'itemMarket'),
h AS (SELECT *, lag(kind) OVER o AS hk, lag(account) OVER o AS ha, lag(side) OVER o AS hs, lag(lineage) OVER o AS hl, lag(money) OVER o AS hm FROM p WINDOW o AS (PARTITION BY instance ORDER BY created_at, id, side DESC)),
c AS (SELECT *, coalesce(hs = 'buy' AND hl AND hk = kind AND ha = account, false) AS costed FROM h WHERE side = 'sell')
SELECT id, kind, account, costed, round(CASE WHEN costed THEN money - hm END, 6) + 0.0 AS profit FROM c""")
def equipment_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = L.sides(_rows(spark, sf_dir)[0]).where("transaction_type = 'itemMarket'").withColumns({"instance_id": F.concat(F.lit("i"), F.col("id") % 50), "lineage_verified": F.col("id") % 3 != 0})
    return r6(L.equipment_lineage(parts).select("id", "kind", "account", "costed", "profit"))


#: The matches of commodities and of instances whose line of verified trades is unbroken.
GEAR = REALIZED.replace("FROM met WHERE matched > 1e-9", "FROM met_all WHERE matched > 1e-9").replace(", f AS (SELECT kind, account, sum(matched * dn)", """, ev AS (SELECT id, 'i' || (id % 50) AS instance, id % 3 <> 0 AS verified, lag(id) OVER (PARTITION BY 'i' || (id % 50) ORDER BY created_at, id) AS before FROM att WHERE transaction_type = 'itemMarket' AND NOT self_trade),
gear_all AS (SELECT *, count(*) OVER (PARTITION BY 'i' || (id % 50), kind, account, created_at) > 1 AS tied FROM parts_all WHERE transaction_type = 'itemMarket'),
met_all AS (SELECT kind, account, sale_id, sold_at, matched, d, dn, dg, costed, fees_known, lot_tied, sq, sm FROM met
  UNION ALL SELECT s.kind, s.account, s.id, s.created_at, least(s.quantity, l.quantity), s.money / s.quantity - l.money / l.quantity, s.net / s.quantity - l.net / l.quantity, s.gross / s.quantity - l.gross / l.quantity, l.gross IS NOT NULL OR l.net IS NOT NULL, s.fee_known AND l.fee_known, l.tied, s.quantity, s.money
  FROM ev JOIN gear_all s ON s.id = ev.id AND s.side = 'sell' JOIN gear_all l ON l.id = ev.before AND l.side = 'buy' AND l.kind = s.kind AND l.account = s.account
  WHERE ev.verified AND ev.before % 3 <> 0 AND s.quantity > 0 AND l.quantity > 0 AND l.created_at < s.created_at), f AS (SELECT kind, account, sum(matched * dn)""")


def _with_gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.ledger_trades(spark, sf_dir).withColumns({"instance_id": F.col("equipment.instance_id"), "lineage_verified": F.col("id") % 3 != 0})
    rows, window = L.attributed(t), C.resolve(None, (T.tape(spark, sf_dir), "created_at"))
    every = stored(L.sides(rows), "every")
    gear = stored(rows.where("transaction_type = 'itemMarket'").select("id", "created_at", "transaction_type", "self_trade", "instance_id", "lineage_verified"), "gear")
    parts = every.where(window.window("created_at", L.WINDOW_DAYS))
    matches = L.fifo(every).unionByName(L.equipment_matches(gear, every)).where(window.window("sold_at", L.WINDOW_DAYS))
    return L.realized(parts, matches, L.on_basis(L.account_ledger(parts)))


@query("realized_with_equipment", f"""WITH {GEAR} SELECT kind, account, {rounded(*REAL_COLS)}, equal_time, CASE WHEN net_profit IS NULL THEN 'unavailable' WHEN uncosted_quantity > 1e-9 OR unknown_fee_quantity > 1e-9 OR invalid_quantity + missing_money > 0 OR equal_time THEN 'partial' ELSE 'matched_sales' END AS costing_status FROM real""")
def realized_with_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(_with_gear(spark, sf_dir).select("kind", "account", *REAL_COLS, "equal_time", "costing_status"))


@query("boards_with_equipment", f"WITH {BOARDS.replace(REALIZED, GEAR)} SELECT board, kind, CAST(rank AS BIGINT) AS rank, account, {rounded('net_profit', 'turnover')} FROM bd WHERE rank <= 10 AND kind IN ('user', 'mu', 'country')")
def boards_with_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(L.boards(_with_gear(spark, sf_dir)))


@query("entity_summaries", f"""WITH {ACCS}, {T.ENTITIES_SQL}, asked AS (SELECT name AS text FROM entities UNION SELECT 'u149' UNION SELECT 'nobody'), hits AS (SELECT text, kind, id, 0 AS way FROM asked JOIN entities ON text = id UNION SELECT text, kind, id, 1 FROM asked JOIN entities ON lower(text) = lower(name)),
one AS (SELECT text, count(id) AS candidates, CASE WHEN count(id) = 1 THEN min(kind) ELSE 'user' END AS kind, CASE WHEN count(id) = 1 THEN min(id) WHEN count(id) = 0 THEN text END AS account FROM asked LEFT JOIN (SELECT * FROM hits QUALIFY way = min(way) OVER (PARTITION BY text)) USING (text) GROUP BY text)
SELECT text, candidates, kind, account, buys, sells, round(turnover, 6) + 0.0 AS turnover FROM one LEFT JOIN accs USING (kind, account)""")
def entity_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every known entity asked for by name, one id without a name and a name of nobody."""
    e = T.entities(spark, sf_dir)
    more = e.limit(1).select(F.explode(F.array(F.lit("u149"), F.lit("nobody"))).alias("text"))
    out = N.summaries_of(e.select(F.col("name").alias("text")).union(more).distinct(), e, _accounts(spark, sf_dir)[1])
    return r6(out.select("text", "candidates", "kind", "account", "buys", "sells", "turnover"))
