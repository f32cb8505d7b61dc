"""Participant ledgers: accounts, window totals, boards and first-in-first-out matching.

Amounts are exact only as far as evidence goes. A source amount is what a trade records; a
gross or net amount needs a verified settlement. Sums of source amounts count what is known
beside a count of what is missing; a gross sum is null as soon as one amount is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.session import stored

KINDS = ("user", "mu", "country", "party")
#: Kinds of accounts that have boards.
RANKED = ("user", "mu", "country")
#: Share of a participant's turnover that its listed categories must reach, categories on top, and rows of a board.
DETAIL_SHARE, TOP, BOARD = 0.8, 3, 10
WINDOW_DAYS = 7
#: Digits after the point that quantities are matched in.
QUANTITY_DIGITS = 9


def account(side: str) -> Column:
    """Struct (kind, id, reason): the one institution a side acts for, or else its user."""
    refs = {k: F.col(f"{side}_{k}_id") for k in KINDS}
    wrong = lambda c: c.isNotNull() & ((F.trim(c) != c) | (F.length(F.trim(c)) == 0))
    invalid = F.coalesce(sum((wrong(c).cast("int") for c in refs.values()), F.lit(0)) > 0, F.lit(False))
    several = sum((refs[k].isNotNull().cast("int") for k in KINDS[1:]), F.lit(0))
    kind = F.when(several > 1, F.lit(None)).when(refs["mu"].isNotNull(), "mu").when(refs["country"].isNotNull(), "country").when(refs["party"].isNotNull(), "party").otherwise("user")
    ident = F.coalesce(refs["mu"], refs["country"], refs["party"], refs["user"])
    reason = F.when(invalid, "invalid_reference").when(several > 1, "conflicting_institutions").when(ident.isNull(), "missing_reference").when(refs["party"].isNotNull(), "unsupported_party")
    return F.struct(F.when(reason.isNull(), kind).alias("kind"), F.when(reason.isNull(), ident).alias("id"), reason.alias("reason"), refs["user"].alias("actor"))


def category(columns: list[str]) -> Column:
    """What a trade is about, as text: a commodity's code, or what equipment is alike by."""
    if "equipment" not in columns:
        return F.col("item_code")
    e = F.col("equipment")
    stats = F.when(e["stats"].isNull(), "?").otherwise(F.array_join(F.transform(F.array_sort(F.map_entries(e["stats"])), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ","))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    gear = F.concat_ws("|", F.lit("equipment-v1"), F.coalesce(e["equipment_code"], F.col("item_code")), stats, blank(e["state"]), blank(e["max_state"]))
    return F.when(F.col("transaction_type") == "itemMarket", gear).otherwise(F.col("item_code"))


def known(c: Column | str) -> Column:
    """A finite amount that is not below zero, or null."""
    x = X.number(c)
    return F.when(x >= 0, x)


def attributed(trades: DataFrame) -> DataFrame:
    """Trades with both accounts, what they are about, and whether both accounts are the same one."""
    rows = trades.withColumns({"buyer": account("buy"), "seller": account("sell"), **({"category": category(trades.columns)} if "item_code" in trades.columns else {})})
    same = F.col("buyer.id").isNotNull() & (F.col("buyer.kind") == F.col("seller.kind")) & (F.col("buyer.id") == F.col("seller.id"))
    return rows.withColumn("self_trade", F.coalesce(same, F.lit(False)))


def of_entity(trades: DataFrame, kind: str, entity_id: str) -> DataFrame:
    """The trades that name an entity on either side; a filter that reaches the scan."""
    return trades.where((F.col(f"buy_{kind}_id") == entity_id) | (F.col(f"sell_{kind}_id") == entity_id))


def sides(rows: DataFrame) -> DataFrame:
    """Two rows a trade, one for each side with an account; self trades are left out.

    Gross and net amounts come from the columns settlement_verified, settlement_role and
    settlement_fee, if there are any.
    """
    # Amounts are columns before they are used, several times, in what follows: as one expression they outgrow what is compiled.
    rows = rows.withColumns({"money": known("money"), "quantity": known("quantity")})
    if "settlement_verified" in rows.columns:
        rows = rows.withColumn("settlement_fee", known("settlement_fee"))
        evidence = ("settlement_verified", "settlement_role", "settlement_fee")
        paid = {f"{name}_paid": X.settlement("money", *evidence, name) for name in ("buy", "sell")} | {"fee_known": X.fee_known(*evidence)}
    else:
        paid = {f"{name}_paid": F.lit(None).cast("struct<gross:double,net:double>") for name in ("buy", "sell")} | {"fee_known": F.lit(False)}
    rows = rows.withColumns(paid)
    side = lambda name, who: F.struct(F.lit(name).alias("side"), F.col(f"{who}.kind").alias("kind"), F.when(~F.col("self_trade"), F.col(f"{who}.id")).alias("account"), F.col(f"{who}.actor").alias("actor"), F.col(f"{name}_paid.gross").alias("gross"), F.col(f"{name}_paid.net").alias("net"))
    # Self trades go with the sides without an account: a filter before would carry all of the above down to the scan.
    both = rows.withColumn("s", F.explode(F.array(side("buy", "buyer"), side("sell", "seller"))))
    return both.select("id", "created_at", "transaction_type", "item_code", "category", "money", "quantity", "s.*", "fee_known").where("account is not null")


def attribution_totals(rows: DataFrame) -> DataFrame:
    """Market totals, self trades and sides without an account by reason, from one pass."""
    some = F.array(
        F.struct(F.lit("market").alias("what"), F.lit(True).alias("counts")), F.struct(F.lit("self_trade").alias("what"), F.col("self_trade").alias("counts")),
        *(F.struct(F.col(f"{who}.reason").alias("what"), (F.col(f"{who}.reason").isNotNull() & ~F.col("self_trade")).alias("counts")) for who in ("buyer", "seller")),
    )
    marks = rows.select(known("money").alias("money"), F.explode(some).alias("x")).where("x.counts")
    return marks.groupBy("x.what").agg(F.count("*").alias("n"), F.coalesce(F.sum("money"), F.lit(0.0)).alias("value"), F.count_if(F.col("money").isNull()).alias("missing_money"))


def _of(side: str) -> Column:
    return F.col("side") == side


def _total(side: str, value: str) -> Column:
    """The sum of what is known."""
    return F.coalesce(F.sum(F.when(_of(side), F.col(value))), F.lit(0.0))


def _whole(side: str, value: str) -> Column:
    """A sum that is null as soon as one amount is unknown."""
    return F.when(F.count_if(_of(side) & F.col(value).isNull()) == 0, _total(side, value))


def account_ledger(parts: DataFrame) -> DataFrame:
    """Totals of each account: source and gross values, counts, actors and turnover."""
    out = parts.groupBy("kind", "account").agg(
        *(_total(s, "money").alias(f"source_{s}") for s in ("buy", "sell")), *(_whole(s, "gross").alias(f"gross_{s}") for s in ("buy", "sell")),
        F.count_if(_of("buy")).alias("buys"), F.count_if(_of("sell")).alias("sells"), F.count_if(F.col("money").isNull()).alias("missing_money"),
        F.count_if(~F.coalesce(F.col("quantity") > 0, F.lit(False))).alias("invalid_quantity"), F.count_distinct("actor").alias("actors"),
    )
    return out.withColumns({"source_turnover": F.col("source_buy") + F.col("source_sell"), "gross_turnover": F.col("gross_buy") + F.col("gross_sell")})


def money_basis(accounts: DataFrame) -> DataFrame:
    """One row: gross if every account has gross amounts on both sides, else source."""
    whole = F.coalesce(F.min(F.col("gross_buy").isNotNull() & F.col("gross_sell").isNotNull()), F.lit(False))
    return accounts.agg(F.when(whole, "gross").otherwise("source").alias("basis"))


def on_basis(accounts: DataFrame) -> DataFrame:
    """Accounts with their values and turnover on the one basis that the whole report has; it is a single row."""
    rows = accounts.join(F.broadcast(money_basis(accounts)))
    pick = lambda name: F.when(F.col("basis") == "gross", F.col(f"gross_{name}")).otherwise(F.col(f"source_{name}"))
    return rows.withColumns({"buy_value": pick("buy"), "sell_value": pick("sell"), "turnover": pick("turnover")})


def category_ledger(parts: DataFrame, basis: DataFrame | None = None) -> DataFrame:
    """Buys and sells of each account and category, with average prices and what they compare to.

    The comparison values the quantity both bought and sold at the difference of average
    prices; it is not a realized profit. ``basis`` is the one row of ``money_basis``; without
    it amounts are the source's.
    """
    out = parts.groupBy("kind", "account", "category").agg(
        F.min("item_code").alias("item_code"), F.min("transaction_type").alias("market_type"),
        *(_total(s, "quantity").alias(f"{s}_quantity") for s in ("buy", "sell")), *(_total(s, "money").alias(f"{s}_source") for s in ("buy", "sell")), *(_whole(s, "gross").alias(f"{s}_gross") for s in ("buy", "sell")),
        F.count_if(_of("buy")).alias("buys"), F.count_if(_of("sell")).alias("sells"),
        *(F.count_if(_of(s) & F.col(v).isNull()).alias(f"{s}_missing_{v}") for s in ("buy", "sell") for v in ("money", "quantity")),
    )
    if basis is None:
        out = out.withColumns({f"{s}_value": F.col(f"{s}_source") for s in ("buy", "sell")})
    else:
        out = out.join(F.broadcast(basis)).withColumns({f"{s}_value": F.when(F.col("basis") == "gross", F.col(f"{s}_gross")).otherwise(F.col(f"{s}_source")) for s in ("buy", "sell")}).drop("basis")
    average = lambda s: F.when((F.col(f"{s}_quantity") > 0) & (F.col(f"{s}_missing_money") == 0) & (F.col(f"{s}_missing_quantity") == 0), F.col(f"{s}_value") / F.col(f"{s}_quantity"))
    measured = (F.col("buy_missing_quantity") == 0) & (F.col("sell_missing_quantity") == 0)
    out = out.withColumns({"average_buy": average("buy"), "average_sell": average("sell"), "matched_quantity": F.when(measured, F.least("buy_quantity", "sell_quantity"))})
    return out.withColumns({
        "comparison": F.when(F.col("matched_quantity") > 0, F.col("matched_quantity") * (F.col("average_sell") - F.col("average_buy"))),
        "unmatched_buy": F.col("buy_quantity") - F.col("matched_quantity"), "unmatched_sell": F.col("sell_quantity") - F.col("matched_quantity"),
        "net_quantity": F.when(measured, F.col("buy_quantity") - F.col("sell_quantity")),
    })


def side_categories(categories: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row for each account, side and category that has trades, ranked by value, with its share of the side.

    ``accounts`` are those of ``on_basis``. A share is unknown while an amount of the account is missing.
    """
    one = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_value").alias("money"), F.col(f"{s}_quantity").alias("quantity"), F.col(f"{s}s").alias("trades"), F.col(f"average_{s}").alias("average_price"))
    rows = categories.select("kind", "account", "category", "item_code", "market_type", F.explode(F.array(one("buy"), one("sell"))).alias("s")).select("kind", "account", "category", "item_code", "market_type", "s.*").where("trades > 0")
    total = accounts.select("kind", "account", "buy_value", "sell_value", "missing_money")
    rows = rows.join(total, ["kind", "account"]).withColumn("total", F.when(F.col("side") == "buy", F.col("buy_value")).otherwise(F.col("sell_value")))
    order = Window.partitionBy("kind", "account", "side").orderBy(F.desc("money"), "category")
    return rows.withColumns({"rank": F.row_number().over(order), "share": F.when((F.col("total") > 0) & (F.col("missing_money") == 0), F.col("money") / F.col("total"))}).drop("buy_value", "sell_value", "missing_money", "total")


def top_categories(ranked: DataFrame, top: int = TOP) -> DataFrame:
    """The first categories of each account and side, and one row "other" for what is left."""
    name = F.when(F.col("rank") <= top, F.col("category")).otherwise("other")
    rows = ranked.withColumns({"name": name, "place": F.least("rank", F.lit(top + 1))})
    return rows.groupBy("kind", "account", "side", "place", F.col("name").alias("category")).agg(F.sum("money").alias("money"), F.sum("trades").alias("trades"), F.sum("share").alias("share"))


def boards(accounts: DataFrame, top: int = BOARD) -> DataFrame:
    """The first accounts of each kind by realized loss, realized profit and turnover; ties by turnover, then id.

    ``accounts`` have turnover and ``net_profit`` of matched sales, null where no sale has a
    known cost. Parties have no boards, nor has an account without turnover one by volume.
    """
    net, none = F.col("net_profit"), F.lit(None).cast("double")
    place = lambda name, holds, key: F.when(holds, F.struct(F.lit(name).alias("board"), key.alias("key")))
    lists = F.array(place("losses", net < 0, net), place("profits", net > 0, -net), place("volume", F.col("turnover") > 0, none))
    rows = accounts.where(F.col("kind").isin(*RANKED)).select("kind", "account", "net_profit", "turnover", F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("b"))
    order = Window.partitionBy("b.board", "kind").orderBy("b.key", F.desc("turnover"), "account")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("b.board", "kind", "rank", "account", "net_profit", "turnover")


def detail_prefix(categories: DataFrame, share: float = DETAIL_SHARE) -> DataFrame:
    """The fewest categories, by turnover, that reach the share; all of them where money is unknown."""
    rows = categories.withColumn("turnover", F.coalesce("buy_value", F.lit(0.0)) + F.coalesce("sell_value", F.lit(0.0)))
    rows = rows.withColumn("unknown", F.col("buy_value").isNull() | F.col("sell_value").isNull() | (F.col("buy_missing_money") + F.col("sell_missing_money") > 0))
    every, order = Window.partitionBy("kind", "account"), Window.partitionBy("kind", "account").orderBy(F.desc("turnover"), "category")
    rows = rows.withColumns({"total": F.sum("turnover").over(every), "partial": F.max("unknown").over(every), "cum": F.sum("turnover").over(order.rowsBetween(Window.unboundedPreceding, 0)), "position": F.row_number().over(order)})
    status = F.when(F.col("partial"), "partial").when(F.col("total") == 0, "zero-total").otherwise("complete")
    return rows.withColumn("status", status).where(F.col("partial") | ((F.col("total") > 0) & (F.col("cum") - F.col("turnover") < share * F.col("total"))))


def detail_status(accounts: DataFrame, details: DataFrame) -> DataFrame:
    """How each account's details cover it: partial, empty, zero-total or complete."""
    chosen = details.groupBy("kind", "account").agg(F.count("*").alias("selected"), F.sum("turnover").alias("selected_turnover"), F.max("partial").alias("partial"))
    out = accounts.join(chosen, ["kind", "account"], "left")
    partial = F.coalesce("partial", F.lit(False)) | (F.col("missing_money") > 0) | F.col("turnover").isNull()
    status = F.when(partial, "partial").when(F.col("buys") + F.col("sells") == 0, "empty").when(F.col("turnover") == 0, "zero-total").otherwise("complete")
    return out.select("kind", "account", status.alias("status"), F.coalesce("selected", F.lit(0)).alias("selected"), F.when((status == "complete"), F.col("selected_turnover") / F.col("turnover")).alias("selected_share"))


def fifo(parts: DataFrame, scale: int | None = None) -> DataFrame:
    """Sales of commodities matched with the oldest purchases of strictly earlier time.

    Sold and bought quantities are laid end to end; a sale owns the interval between what
    was matched before and after it, a lot the interval of its quantity. A sale of unknown
    quantity clears what was held and begins a new segment, a purchase of unknown quantity
    bars later lots until then. Quantities are whole numbers of units, of nine digits after
    the point or of ``scale``, so what is matched is exact. With a ``scale``, quantities stay in
    units and amounts as they are given, for ``exact``; else they are doubles beside profits.

    One account's one item is never in one task: running sums and maxima are taken within
    days and carried from day to day (a row each). The line of quantities is cut where a day's
    purchases or its matched sales end, so a cell has lots of one day and sales of one day, and
    only what lies across a cut is in two cells. In a cell the ends of both are put in one
    order, where each piece between two ends has at most one sale and one lot, those whose
    end comes next: so matches are as many as ends, whatever overlaps.
    """
    unit, kind = 10 ** (QUANTITY_DIGITS if scale is None else scale), "decimal(38,0)"
    # Whole quantities whose units fit a long need no decimals; the result is the same.
    whole = (F.col("quantity") == F.floor("quantity")) & (F.abs("quantity") <= F.lit(9 * 10**18 // unit))
    amount = F.when(whole, (F.col("quantity").cast("long") * F.lit(unit)).cast(kind)).otherwise(F.floor(F.col("quantity").cast("decimal(38,18)") * F.lit(unit)).cast(kind))
    number = lambda c: F.coalesce(c, F.lit(0)).cast(kind)
    place, bought, sold = F.struct("us", "id"), F.col("bought"), F.col("sold")
    rows = parts.where("transaction_type = 'trading'").withColumns({"key": F.struct("kind", "account", "item_code"), "us": F.unix_micros("created_at"), "quantity": amount})
    rows = stored(rows.select("key", F.expr("us div 86400000000").alias("day"), "us", "id", "side", "quantity", "money", "gross", "net", "fee_known"), "parts")
    rows = rows.withColumn("unknown", ~F.coalesce(F.col("quantity") > 0, F.lit(False)))
    clears, bars = F.when((F.col("side") == "sell") & F.col("unknown"), place), F.when((F.col("side") == "buy") & F.col("unknown"), place)

    # The last clearing sale before each row and the last barring purchase up to it.
    of_day = Window.partitionBy("key", "day").orderBy("us", "id")
    past = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("key", "day").agg(F.max(clears).alias("clear"), F.max(bars).alias("bar"))
    days = days.select("key", "day", F.max("clear").over(past).alias("clear_before"), F.max("bar").over(past).alias("bar_before"))
    rows = rows.withColumns({
        "clear": F.max(clears).over(of_day.rowsBetween(Window.unboundedPreceding, -1)), "bar": F.max(bars).over(of_day.rowsBetween(Window.unboundedPreceding, 0)),
        "equal_time": F.count("*").over(Window.partitionBy("key", "day", "us")) > 1,
    }).join(days, ["key", "day"])
    rows = rows.withColumns({"clear": F.coalesce("clear", "clear_before"), "bar": F.coalesce("bar", "bar_before")})
    barred = F.col("bar").isNotNull() & F.coalesce(F.col("bar") > F.col("clear"), F.lit(True))
    rows = rows.withColumns({"segment": F.struct("clear"), "bought": number(F.when((F.col("side") == "buy") & ~F.col("unknown") & ~barred, F.col("quantity"))), "sold": number(F.when((F.col("side") == "sell") & ~F.col("unknown"), F.col("quantity")))})

    # Quantities sold and bought up to each row of a day, and by how much its sales ran short of earlier purchases.
    at = ["key", "segment", "day"]
    order = Window.partitionBy(*at).orderBy("us", "id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*at).orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"own_sold": F.sum("sold").over(upto), "own_bought": F.sum("bought").over(upto), "own_earlier": number(F.sum("bought").over(earlier))})
    rows = rows.withColumn("short", F.when(sold > 0, F.col("own_sold") - F.col("own_earlier")))
    rows = rows.withColumns({"own_top": F.max("short").over(upto), "own_top_before": F.max("short").over(order.rowsBetween(Window.unboundedPreceding, -1))})
    rows = stored(rows.select(*at, "us", "id", "quantity", "money", "gross", "net", "fee_known", "equal_time", "bought", "sold", "own_sold", "own_bought", "short", "own_top", "own_top_before"), "sides")

    # The same from day to day, and where each day's purchases and matched sales end.
    past = Window.partitionBy("key", "segment").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*at).agg(F.sum("sold").alias("day_sold"), F.sum("bought").alias("day_bought"), F.max("short").alias("day_short"))
    days = days.withColumns({"sold_before": number(F.sum("day_sold").over(past)), "bought_before": number(F.sum("day_bought").over(past))})
    days = days.withColumn("day_top", F.col("sold_before") - F.col("bought_before") + F.col("day_short"))
    days = days.withColumn("top_before", number(F.greatest(F.lit(0).cast(kind), F.max("day_top").over(past))))
    days = days.withColumns({"lots_end": F.col("bought_before") + F.col("day_bought"), "sales_begin": F.col("sold_before") - F.col("top_before"), "sales_end": F.col("sold_before") + F.col("day_sold") - F.greatest("top_before", "day_top")})
    days = stored(days, "days")
    cuts = days.where("day_bought > 0").select("key", "segment", F.col("lots_end").alias("point"), F.col("day").alias("lot_day"), F.lit(None).cast("long").alias("sale_day"))
    cuts = cuts.unionByName(days.where("sales_end > sales_begin").select("key", "segment", F.col("sales_end").alias("point"), F.lit(None).cast("long").alias("lot_day"), F.col("day").alias("sale_day")))
    cuts = cuts.groupBy("key", "segment", "point").agg(F.min("lot_day").alias("lot_day"), F.min("sale_day").alias("sale_day"))
    line = Window.partitionBy("key", "segment").orderBy("point")
    rest = Window.partitionBy("key", "segment").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, 0)
    cells = cuts.select("key", "segment", F.struct(number(F.lag("point").over(line)).alias("low"), F.col("point").alias("high")).alias("cell"), F.last("lot_day", ignorenulls=True).over(rest).alias("lot_day"), F.last("sale_day", ignorenulls=True).over(rest).alias("sale_day"))
    cells = cells.where("lot_day is not null and sale_day is not null")
    of_lots = cells.groupBy("key", "segment", F.col("lot_day").alias("day")).agg(F.collect_list("cell").alias("lot_cells"))
    of_sales = cells.groupBy("key", "segment", F.col("sale_day").alias("day")).agg(F.collect_list("cell").alias("sale_cells"))

    rows = rows.join(days, at).join(of_lots, at, "left").join(of_sales, at, "left")
    ahead = F.col("sold_before") - F.col("bought_before")
    top = lambda own: F.greatest("top_before", ahead + F.col(own))
    upper = F.when(sold > 0, F.col("sold_before") + F.col("own_sold") - top("own_top")).otherwise(F.col("bought_before") + F.col("own_bought"))
    lower = F.when(sold > 0, F.col("sold_before") + F.col("own_sold") - sold - top("own_top_before")).otherwise(F.col("bought_before") + F.col("own_bought") - bought)
    rows = rows.withColumns({"upper": upper, "lower": lower}).where(((sold > 0) | (bought > 0)) & (F.col("upper") > F.col("lower")))
    facts = F.struct("id", "us", "quantity", "money", "gross", "net", "fee_known", "equal_time")
    nothing = F.lit(None).cast(rows.select(facts.alias("x")).schema["x"].dataType)
    across = F.filter(F.when(sold > 0, F.col("sale_cells")).otherwise(F.col("lot_cells")), lambda c: (c["low"] < F.col("upper")) & (c["high"] > F.col("lower")))
    ends = rows.select("key", "segment", "us", "id", "upper", F.when(sold > 0, facts).otherwise(nothing).alias("sale"), F.when(sold > 0, nothing).otherwise(facts).alias("lot"), F.explode(across).alias("cell"))
    ends = ends.withColumn("point", F.least("upper", "cell.high"))
    forward = Window.partitionBy("key", "segment", "cell").orderBy("point", "us", "id")
    back = Window.partitionBy("key", "segment", "cell").orderBy(F.desc("point"), F.desc("us"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("low", F.coalesce(F.lag("point").over(forward), F.col("cell.low")))
    ends = ends.withColumns({"sale": F.last("sale", ignorenulls=True).over(back), "lot": F.last("lot", ignorenulls=True).over(back)})
    met = ends.where("sale is not null and lot is not null and point > low").withColumn("taken", F.col("point") - F.col("low"))
    share = lambda side: F.col("taken").cast("double") / F.col(f"{side}.quantity").cast("double")
    if scale is None:
        whole = lambda c: F.col(c).cast("double") / unit
        amounts = [(share("sale") * F.col(f"sale.{v}") - share("lot") * F.col(f"lot.{v}")).alias(name) for v, name in (("money", "profit"), ("gross", "gross_profit"), ("net", "net_profit"))]
    else:
        whole = F.col
        amounts = [F.col("lot.quantity").alias("lot_quantity"), *(F.col(f"lot.{v}").alias(f"lot_{v}") for v in ("money", "gross", "net")), F.col("sale.net").alias("sale_net")]
    return met.select(
        "key.*", F.col("sale.id").alias("sale_id"), F.timestamp_micros("sale.us").alias("sold_at"), F.col("lot.id").alias("lot_id"), whole("taken").alias("matched"), *amounts,
        whole("sale.quantity").alias("sale_quantity"), F.col("sale.money").alias("sale_money"), F.col("sale.gross").alias("sale_gross"), (F.col("lot.gross").isNotNull() | F.col("lot.net").isNotNull()).alias("costed"),
        (F.col("sale.fee_known") & F.col("lot.fee_known")).alias("fees_known"), F.col("lot.equal_time").alias("lot_equal_time"),
    )


def realized(parts: DataFrame, matches: DataFrame, accounts: DataFrame) -> DataFrame:
    """Each account of the window with what its sales realized and how far that is evidence.

    ``parts`` and ``accounts`` are those of the window, ``matches`` those of ``fifo`` and of
    ``equipment_matches`` whose sale lies in it. Profits are null where no sale has a known cost.
    """
    sales = parts.where("side = 'sell'")
    sold = sales.groupBy("kind", "account").agg(F.sum(F.when(F.col("quantity") > 0, F.col("quantity"))).alias("sold"))
    share = F.col("matched") / F.col("sale_quantity")
    costed, net = F.col("costed"), F.col("net_profit").isNotNull()
    found = matches.groupBy("kind", "account").agg(
        F.sum("net_profit").alias("net_profit"), F.sum("gross_profit").alias("gross_profit"), F.sum(F.when(costed, F.col("matched"))).alias("matched_quantity"), F.sum(F.when(net, F.col("matched"))).alias("net_matched_quantity"),
        F.sum(F.when(costed, F.coalesce("sale_money", F.lit(0.0)) * share)).alias("matched_source_value"), F.sum(F.when(F.col("fees_known"), F.col("matched"))).alias("fee_known_quantity"), F.max("lot_equal_time").alias("lot_equal_time"),
    )
    flags = equal_time(parts)
    out = accounts.join(sold, ["kind", "account"], "left").join(found, ["kind", "account"], "left").join(flags, ["kind", "account"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = out.withColumns({c: zero(c) for c in ("sold", "matched_quantity", "net_matched_quantity", "matched_source_value", "fee_known_quantity")})
    out = out.withColumns({
        "uncosted_quantity": F.col("sold") - F.col("matched_quantity"), "unknown_fee_quantity": F.col("sold") - F.col("fee_known_quantity"), "equal_time": F.coalesce("equal_time", F.lit(False)) | F.coalesce("lot_equal_time", F.lit(False)),
        "matched_source_coverage": F.when((F.col("source_sell") > 0) & (F.col("missing_money") == 0), F.col("matched_source_value") / F.col("source_sell")),
    })
    loose = (F.col("uncosted_quantity") > 1e-9) | (F.col("unknown_fee_quantity") > 1e-9) | (F.col("invalid_quantity") > 0) | (F.col("missing_money") > 0) | F.col("equal_time")
    return out.withColumn("costing_status", F.when(F.col("net_profit").isNull(), "unavailable").when(loose, "partial").otherwise("matched_sales")).drop("lot_equal_time", "fee_known_quantity")


def without_costing(accounts: DataFrame) -> DataFrame:
    """Accounts of a window report, where sales are not matched at all."""
    return accounts.withColumns({"net_profit": F.lit(None).cast("double"), "matched_quantity": F.lit(None).cast("double"), "costing_status": F.lit("not_calculated")})


def equipment_lineage(parts: DataFrame) -> DataFrame:
    """Sales of single instances whose event before was a verified purchase by the same account."""
    order = Window.partitionBy("instance_id").orderBy("created_at", "id", F.desc("side"))
    held = F.lag(F.struct("kind", "account", "side", "lineage_verified", "money")).over(order)
    rows = parts.withColumn("held", held)
    match = (F.col("side") == "sell") & (F.col("held.side") == "buy") & F.col("held.lineage_verified") & (F.col("held.kind") == F.col("kind")) & (F.col("held.account") == F.col("account"))
    return rows.where("side = 'sell'").withColumns({"costed": F.coalesce(match, F.lit(False))}).withColumn("profit", F.when(F.col("costed"), F.col("money") - F.col("held.money")))


def equipment_matches(trades: DataFrame, parts: DataFrame) -> DataFrame:
    """Sales of single instances matched with the verified purchase just before, in the columns of ``fifo``.

    ``trades`` are attributed, with instance_id and lineage_verified. Any trade of an instance
    but a self trade ends what was held of it, whoever traded; a sale is matched only if it
    is verified itself, later in time, and by the account that bought.
    """
    events = trades.where("transaction_type = 'itemMarket' and not self_trade and instance_id is not null and trim(instance_id) <> ''").select("id", "instance_id", "created_at", "lineage_verified")
    order = Window.partitionBy("instance_id").orderBy("created_at", "id")
    linked = events.withColumn("held", F.lag(F.struct("id", "lineage_verified")).over(order)).where("lineage_verified and held.lineage_verified")
    linked = linked.select(F.col("id").alias("sale_id"), F.col("held.id").alias("lot_id"))
    own = parts.where("transaction_type = 'itemMarket'").join(events.select("id", "instance_id"), "id")
    own = own.withColumn("equal_time", F.count("*").over(Window.partitionBy("instance_id", "kind", "account", "created_at")) > 1).where("quantity > 0")
    facts = F.struct("created_at", "item_code", "quantity", "money", "gross", "net", "fee_known", "equal_time")
    sales = own.where("side = 'sell'").select("kind", "account", F.col("id").alias("sale_id"), facts.alias("sale"))
    lots = own.where("side = 'buy'").select("kind", "account", F.col("id").alias("lot_id"), facts.alias("lot"))
    met = sales.join(linked, "sale_id").join(lots, ["lot_id", "kind", "account"]).where("lot.created_at < sale.created_at").withColumn("matched", F.least("sale.quantity", "lot.quantity"))
    part = lambda v: F.col("matched") / F.col("sale.quantity") * F.col(f"sale.{v}") - F.col("matched") / F.col("lot.quantity") * F.col(f"lot.{v}")
    return met.select(
        "kind", "account", "sale.item_code", "sale_id", F.col("sale.created_at").alias("sold_at"), "lot_id", "matched", part("money").alias("profit"), part("gross").alias("gross_profit"), part("net").alias("net_profit"),
        F.col("sale.quantity").alias("sale_quantity"), F.col("sale.money").alias("sale_money"), F.col("sale.gross").alias("sale_gross"), (F.col("lot.gross").isNotNull() | F.col("lot.net").isNotNull()).alias("costed"),
        (F.col("sale.fee_known") & F.col("lot.fee_known")).alias("fees_known"), F.col("lot.equal_time").alias("lot_equal_time"),
    )


def equal_time(parts: DataFrame) -> DataFrame:
    """Accounts whose order within an item rests on ids, as times are equal."""
    same = parts.groupBy("kind", "account", "transaction_type", "item_code", "created_at").agg(F.count("*").alias("n"))
    return same.groupBy("kind", "account").agg(F.max(F.col("n") > 1).alias("equal_time"))


def out_of_order(trades: DataFrame) -> DataFrame:
    """Trades whose id or whose place in time and id is not their own: no order of them would be total."""
    return trades.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("created_at").alias("times")).where("n > 1")


def active_history(trades: DataFrame, window: DataFrame) -> DataFrame:
    """All trades, ever, of the parties that traded in the window."""
    refs = lambda df: df.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{s}_{k}_id").alias("ref")) for s in ("buy", "sell") for k in KINDS))).alias("r")).select("id", "r.*").where("ref is not null")
    active = refs(window).select("kind", "ref").distinct()
    ids = refs(trades).join(active, ["kind", "ref"], "left_semi").select("id").distinct()
    return trades.join(ids, "id", "left_semi")


def equipment_sales(trades: DataFrame, start: Column, end: Column) -> DataFrame:
    """Sales of equipment in a window, each with its own condition; nothing about costs or fees is claimed."""
    rows = trades.where((F.col("transaction_type") == "itemMarket") & X.in_window("created_at", start, end))
    return rows.withColumns({
        "equipment_stats_status": F.when(F.col("equipment.stats").isNull(), "unknown").otherwise("observed"), "net_realized_pnl": F.lit(None).cast("double"),
        "basis_status": F.lit("unverified_equipment_lineage"), "fee_status": F.lit("unverified"), "money_basis": F.lit("source-money"),
    })
