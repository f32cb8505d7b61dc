"""Readers of files: item tables, nested JSON, trade pages, books, quotes and points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stored

#: Canonical columns and the names that fill them, the first one there is.
ALIASES = {
    "item_name": ("item_name", "item", "name", "item_title", "title"),
    "bid": ("bid", "bid_price", "best_bid", "highest_bid", "buy", "buy_price", "highest_buy"),
    "ask": ("ask", "ask_price", "best_ask", "lowest_ask", "sell", "sell_price", "lowest_sell"),
    "last_trade_price": ("last_trade_price",),
    "trades_7d": ("trades_7d", "seven_day_trades", "trades_week", "weekly_trades", "volume_7d"),
    "trades_24h": ("trades_24h", "daily_trades", "volume_24h"),
    "high_7d": ("high_7d", "seven_day_high", "week_high", "high"),
    "low_7d": ("low_7d", "seven_day_low", "week_low", "low"),
    "open_7d": ("open_7d", "seven_day_open", "week_open", "open"),
    "close_7d": ("close_7d", "seven_day_close", "week_close", "close"),
}
#: Levels of JSON that are unfolded in one go.
LEVELS = 8
LISTS = ("data", "results", "items", "markets", "records")
ENTRY = "array<struct<_id:string,user:string,mu:string,country:string,party:string,itemCode:string,type:string,quantity:string,price:string,offerAt:string>>"
TRADE = (
    "_id string, money string, itemCode string, quantity string, sellerId string, buyerId string, sellerMuId string, buyerMuId string, sellerCountryId string, buyerCountryId string, "
    "sellerPartyId string, buyerPartyId string, transactionType string, createdAt string, updatedAt string, "
    "item struct<_id:string,type:string,code:string,skills:map<string,string>,state:string,maxState:string,quantity:string,lastAcquisitionAt:string>"
)


def column_name(name: str, dotted: bool = False) -> str:
    """A column's normal name; names from JSON also lose dots and dashes."""
    name = name.strip().lower().replace(" ", "_")
    return re.sub("[.-]", "_", name) if dotted else name


def normalized(df: DataFrame) -> DataFrame:
    return df.toDF(*map(column_name, df.columns))


def with_aliases(df: DataFrame) -> DataFrame:
    """Canonical columns from the first alias there is; a column that is there keeps its nulls."""
    found = {name: next((a for a in names if a in df.columns), None) for name, names in ALIASES.items()}
    return df.withColumns({name: F.col(f"`{a}`") for name, a in found.items() if a and a != name})


def read_market_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV table under normal names; without a schema every column is text."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    return normalized((reader.schema(schema) if schema else reader).csv(path))


def _fields(kind: T.StructType, path: str = "") -> list[Column]:
    out: list[Column] = []
    for f in kind.fields:
        at = f"{path}`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += _fields(f.dataType, f"{at}.")
        else:
            out.append(F.col(at).alias(column_name(re.sub("`", "", at), True)))
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as a_b_c, to any depth."""
    return df.select(*_fields(df.schema))


def read_market_json(spark: SparkSession, path: str, records: str | None = None) -> DataFrame:
    """Records of a nested JSON file: those at a dotted path of names and list positions, or all.

    What is found there is a list of records, an object with such a list under a usual name,
    or one record.
    """
    raw = spark.read.option("multiLine", True).json(path)
    found, kind = F.struct(*(F.col(f"`{c}`") for c in raw.columns)), raw.schema
    for step in records.split(".") if records else ():
        if isinstance(kind, T.ArrayType):
            found, kind = F.get(found, int(step)), kind.elementType
        else:
            found, kind = found[step], kind[step].dataType
    if isinstance(kind, T.StructType):
        name = next((n for n in LISTS if n in kind.names and isinstance(kind[n].dataType, T.ArrayType)), None)
        if name is not None:
            found, kind = found[name], kind[name].dataType
    rows = raw.select((F.explode(found) if isinstance(kind, T.ArrayType) else found).alias("record"))
    return with_aliases(flatten(rows.select("record.*")))


def exact(c: Column) -> Column:
    """A decimal from text; anything else is null."""
    return c.try_cast("decimal(38,18)")


def iso_time(c: Column) -> Column:
    """A time from ISO text; text without an offset is UTC, whatever the session's zone."""
    offset = c.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.try_to_timestamp(F.when(offset | ~c.contains(":"), c).otherwise(F.concat(c, F.lit("Z"))))


def plain_number(c: Column) -> Column:
    """The canonical text of a decimal: no exponent and no zeros at its end."""
    text = exact(c).cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def precision(c: Column) -> Column:
    """Whether a number was written as a float or as a decimal; null if there is none."""
    return F.when(c.rlike("[.eE]"), "decoded_float").when(c.isNotNull(), "decimal")


def _page(raw: str) -> Column:
    return F.from_json(raw, f"result struct<data:struct<items:array<struct<{TRADE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>>>")


def malformed_pages(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Pages that give no trades to look at, whole and with the reason: no JSON at all, or no list of items in it."""
    items = _page(raw)["result"]["data"]["items"]
    reason = F.when(F.col(raw).isNull() | F.try_parse_json(raw).isNull(), "not_json").when(items.isNull(), "no_items")
    return pages.withColumn("reason", reason).where("reason is not null")


#: Fields of a trade that must be text or null.
TEXTS = [f.split()[0] for f in TRADE.split("item struct")[0].strip(", ").split(", ") if f.split()[0] not in ("money", "quantity")]


def mistyped_trades(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """Trades of readable pages with a text field that is neither text nor null: (…, item, field, found).

    One row for each such field, by its name and the type found there, beside the whole trade
    as JSON. A field that is missing is not mistyped; money and quantities may be numbers or
    text and are checked when they are read.
    """
    carry = [c for c in pages.columns if c != raw]
    items = F.try_variant_get(F.try_parse_json(raw), "$.result.data.items", "array<variant>")
    trades = pages.select(*carry, F.explode(items).alias("item"))
    kinds = [F.struct(F.lit(n).alias("field"), F.schema_of_variant(F.try_variant_get("item", f"$.{n}", "variant")).alias("found")) for n in TEXTS]
    wrong = F.filter(F.array(*kinds), lambda x: x["found"].isNotNull() & ~x["found"].isin("STRING", "VOID"))
    return trades.select(*carry, F.to_json("item").alias("item"), F.explode(wrong).alias("x")).select(*carry, "item", "x.field", "x.found")


def trade_facts(pages: DataFrame, item_code: str | None = None, kind: str | None = None, raw: str = "raw") -> DataFrame:
    """Trades from raw JSON pages, one row each, with a derived id where none is given.

    Bad values become null; ``resolve.valid_records`` sets such rows aside. Pages without a
    list of items have no rows here; ``malformed_pages`` keeps them.
    """
    carry = [c for c in pages.columns if c != raw]
    t = pages.select(*carry, F.explode(_page(raw)["result"]["data"]["items"]).alias("t")).select(*carry, "t.*")
    money, quantity = exact(F.col("money")), exact(F.col("quantity"))
    item, transaction = F.coalesce("itemCode", F.lit(item_code)), F.coalesce("transactionType", F.lit(kind))
    stamp = F.date_format(iso_time(F.col("createdAt")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    derived = F.sha2(F.concat_ws("|", item, stamp, F.col("transactionType"), plain_number(F.col("money")), plain_number(F.col("quantity"))), 256)
    return t.select(
        *carry, F.coalesce("_id", derived).alias("id"), item.alias("item_code"), transaction.alias("transaction_type"), iso_time(F.col("createdAt")).alias("created_at"), iso_time(F.col("updatedAt")).alias("updated_at"),
        money.alias("money"), quantity.alias("quantity"), F.when(quantity > 0, money.cast("double") / quantity.cast("double")).alias("unit_price"),
        precision(F.col("money")).alias("money_precision"), precision(F.col("quantity")).alias("quantity_precision"),
        *(F.col(f"{w}er{k}Id").alias(f"{s}_{n}_id") for s, w in (("buy", "buy"), ("sell", "sell")) for k, n in (("", "user"), ("Mu", "mu"), ("Country", "country"), ("Party", "party"))),
        F.struct(F.col("item._id").alias("instance_id"), F.col("item.type").alias("type"), F.col("item.code").alias("equipment_code"), F.map_filter("item.skills", lambda k, v: k != "__v").alias("stats"), exact(F.col("item.state")).alias("state"), exact(F.col("item.maxState")).alias("max_state")).alias("equipment"),
    )


def _unfolded(rows: DataFrame, key: str, levels: int) -> DataFrame:
    """(key, path, type, text) of rows (key, path, v) with up to ``levels`` levels unfolded; what is nested deeper has no type and its JSON as text.

    A row goes through all levels in one chain: a scalar stays as it is, an object or list
    becomes a row for each of its parts.
    """
    spark = rows.sparkSession
    for _ in range(levels):
        parts = spark.tvf.variant_explode_outer(F.col("v").outer()).toDF("pos", "name", "inner")
        step = F.replace(F.replace(F.coalesce("name", F.col("pos").cast("string")), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        nested = F.col("pos").isNotNull()
        rows = rows.lateralJoin(parts).where("not (name <=> '__v')").select(key, F.when(nested, F.concat("path", F.lit("/"), step)).otherwise(F.col("path")).alias("path"), F.when(nested, F.col("inner")).otherwise(F.col("v")).alias("v"))
    # What is left of an object or list has its shape looked at here only, once for all these levels.
    rows = rows.select(key, "path", F.schema_of_variant("v").alias("kind"), F.col("v").cast("string").alias("text"))
    container = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    name = F.when(F.col("kind") == "VOID", "null").when(F.col("kind") == "STRING", "string").when(F.col("kind") == "BOOLEAN", "boolean").when(~container, "number")
    return rows.where(~(container & F.col("text").isin("{}", "[]"))).select(key, "path", name.alias("type"), "text")


def json_leaves(df: DataFrame, raw: str = "raw", key: str = "id", levels: int = LEVELS) -> DataFrame:
    """(key, path, type, text) of every scalar of a JSON text, paths escaped as JSON pointers.

    Texts are unfolded by ``levels`` levels at a time, and only what is nested deeper goes on,
    so a few deep texts among many flat ones cost their own further rounds and nothing else.
    A text that is no JSON has no leaves.
    """
    rows, out = df.select(F.col(key).alias(key), F.lit("").alias("path"), F.col(raw).alias("text")), None
    while True:
        parsed = rows.select(key, "path", F.try_parse_json("text").alias("v")).where("v is not null")
        done = stored(_unfolded(parsed, key, levels), "leaves")
        leaves = done.where("type is not null")
        out = leaves if out is None else out.unionByName(leaves)
        rows = done.where("type is null").select(key, "path", "text")
        if rows.isEmpty():
            return out


def field_presence(df: DataFrame, paths: dict[str, str], raw: str = "raw", key: str = "id") -> DataFrame:
    """(key, field, is_null) of fields that a JSON text has; a field that is missing has no row.

    ``paths`` gives each field's variant path: a field that is null is not the same as none.
    """
    v = F.try_parse_json(raw)
    found = F.array(*(F.struct(F.lit(name).alias("field"), F.try_variant_get(v, path, "variant").alias("x")) for name, path in paths.items()))
    return df.select(key, F.explode(found).alias("f")).where("f.x is not null").select(key, "f.field", F.is_variant_null("f.x").alias("is_null"))


def extra_leaves(leaves: DataFrame, known: list[str]) -> DataFrame:
    return leaves.where(~F.col("path").isin(known))


def book_orders(books: DataFrame, raw: str = "raw") -> DataFrame:
    """Orders of raw books (observation_id, item_code, raw): side, position, price and quantity.

    Orders of another item, of the other side's type, or with missing or negative numbers
    are left out.
    """
    book = F.from_json(raw, f"result struct<data:struct<buyOrders:{ENTRY},sellOrders:{ENTRY}>>")
    rows = books.select("observation_id", "item_code", book["result"]["data"].alias("b"))
    side = lambda name, field: rows.select("observation_id", "item_code", F.lit(name).alias("side"), F.posexplode(f"b.{field}").alias("position", "o"))
    both = side("bid", "buyOrders").unionByName(side("ask", "sellOrders"))
    out = both.withColumns({"price": exact(F.col("o.price")), "quantity": exact(F.col("o.quantity")), "expects": F.when(F.col("side") == "bid", "buy").otherwise("sell")})
    fits = F.coalesce(F.col("o.itemCode") == F.col("item_code"), F.lit(True)) & F.coalesce(F.lower("o.type") == F.col("expects"), F.lit(True))
    return out.where(fits & (F.col("price") >= 0) & (F.col("quantity") >= 0)).select("observation_id", "item_code", "side", "position", F.col("o._id").alias("order_id"), F.col("o.user").alias("user_id"), "price", "quantity", iso_time(F.col("o.offerAt")).alias("offer_at"))


def quote_rows(payload: DataFrame, prices: str = "prices", observed_at: str = "observed_at") -> DataFrame:
    """One row for each item of a map of prices."""
    return payload.select(F.col(observed_at).alias("observed_at"), F.explode(prices).alias("item_code", "current_price")).where("current_price is not null")


def production_points(payload: DataFrame, items: str = "items") -> DataFrame:
    """Points of tradable items; missing points stay null, points not above zero are left out."""
    rows = payload.select(F.explode(items).alias("item_code", "x")).where("x.isTradable")
    return rows.select("item_code", F.col("x.productionPoints").cast("double").alias("points")).where("points is null or points > 0")
