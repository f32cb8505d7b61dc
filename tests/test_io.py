"""Readers, sinks and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resolve as R
from tidemark.operators import sinks as K
from tidemark.sources import readers as D
from tidemark.streaming import live as W


def test_csv_and_aliases(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Item Name , Best Bid,Ask\nx,1.5,2\n")
    df = D.with_aliases(D.read_market_csv(spark, str(tmp_path / "m.csv")))
    assert (df.first().item_name, df.first().bid, df.first().ask) == ("x", "1.5", "2")


def test_nested_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"result": {"data": [{"name": "x", "book": {"Best Bid": 1}}]}}))
    for records in (None, "result.data"):
        df = D.read_market_json(spark, str(tmp_path / "m.json"), records or "result")
        assert (df.first()["name"], df.first()["book_best_bid"]) == ("x", 1)


def test_trade_pages(spark):
    items = [{"_id": "1", "money": 10, "quantity": 4, "itemCode": "x", "buyerId": "u", "createdAt": "2024-01-01T00:00:00Z"}, {"money": "x", "quantity": 1, "createdAt": "2024-01-01T02:00:00+02:00", "itemCode": "x"}]
    raw = spark.createDataFrame([(json.dumps({"result": {"data": {"items": items}}}),)], "raw string")
    rows = D.trade_facts(raw, kind="trading").collect()
    assert (rows[0].id, rows[0].unit_price, rows[0].buy_user_id, rows[0].created_at) == ("1", 2.5, "u", datetime(2024, 1, 1))
    assert len(rows[1].id) == 64 and rows[1].money is None and rows[1].created_at == datetime(2024, 1, 1)
    good, bad = R.valid_records(D.trade_facts(raw, kind="trading"))
    assert (good.count(), bad.first().reason) == (1, "invalid_money")


def test_books_quotes_points(spark):
    orders = {"buyOrders": [{"_id": "a", "price": 1, "quantity": 2, "itemCode": "x", "type": "buy"}, {"price": -1, "quantity": 2}, {"price": 1, "quantity": 2, "itemCode": "y"}], "sellOrders": [{"price": 3, "quantity": 1}]}
    raw = spark.createDataFrame([(7, "x", json.dumps({"result": {"data": orders}}))], "observation_id int, item_code string, raw string")
    assert sorted((r.side, float(r.price)) for r in D.book_orders(raw).collect()) == [("ask", 3.0), ("bid", 1.0)]
    q = spark.createDataFrame([({"x": 1.0, "y": None}, datetime(2024, 1, 1))], "prices map<string,double>, observed_at timestamp")
    assert [r.item_code for r in D.quote_rows(q).collect()] == ["x"]
    p = spark.createDataFrame([({"x": (True, 2.0), "y": (False, 2.0), "z": (True, None), "w": (True, 0.0)},)], "items map<string,struct<isTradable:boolean,productionPoints:double>>")
    assert sorted(r.item_code for r in D.production_points(p).collect()) == ["x", "z"]


def test_json_leaves(spark):
    raw = spark.createDataFrame([(1, json.dumps({"a": {"b/c": 1}, "__v": 0, "l": ["x"]}))], "id int, raw string")
    leaves = D.json_leaves(raw)
    assert {r.path: r.text for r in leaves.collect()} == {"/a/b~1c": "1", "/l/0": "x"}
    assert D.extra_leaves(leaves, ["/l/0"]).count() == 1


def test_publication(spark, tmp_path):
    df = spark.range(2).select("id", F.struct(F.lit("=x").alias("t")).alias("s"), F.array(F.lit(1)).alias("a"))
    out = K.publishable(df)
    assert (out.columns, out.first().s_t) == (["id", "s_t", "a"], "'=x")
    K.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    K.write_table(df, str(tmp_path / "p"), ["id"])
    assert K.differences(spark.read.parquet(str(tmp_path / "p")).select(*df.columns), df.withColumn("id", F.col("id").cast("int"))).count() == 0
    assert K.differences(df.limit(1), df).count() == 1


SCHEMA = "id string, item_code string, transaction_type string, created_at timestamp, unit_price double, quantity double, money double"


def landed(spark, tmp_path):
    rows = [("1", "x", "trading", datetime(2024, 1, 1, 0, 1), 2.0, 1.0, 2.0), ("2", "x", "trading", datetime(2024, 1, 1, 0, 2), 3.0, 1.0, 3.0), ("2", "x", "trading", datetime(2024, 1, 1, 0, 2), 3.0, 1.0, 3.0), ("3", "x", "trading", datetime(2024, 1, 3), 4.0, 1.0, 4.0), (None, "x", "trading", datetime(2024, 1, 3), 4.0, 1.0, 4.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    return W.landed(spark, str(tmp_path / "in"), SCHEMA)


def test_streams(spark, tmp_path):
    stream = landed(spark, tmp_path)
    assert W.run_to_memory(W.unique_trades(stream.where("id is not null")), "unique_trades", "append", str(tmp_path / "c1")).count() == 3
    bars = W.run_to_memory(W.live_candles(W.landed(spark, str(tmp_path / "in"), SCHEMA), "4 hours"), "live_candles", "update", str(tmp_path / "c2"))
    first = bars.orderBy("candle_at").first()
    assert (first.open, first.close, first.high) == (2.0, 3.0, 3.0)
    clock = W.run_to_memory(W.live_clock(W.landed(spark, str(tmp_path / "in"), SCHEMA)), "live_clock", "complete", str(tmp_path / "c3"))
    assert clock.first().data_as_of == datetime(2024, 1, 3)


def test_ingest_sets_bad_rows_aside_and_is_idempotent(spark, tmp_path):
    for _ in range(2):
        stream = landed(spark, tmp_path) if not (tmp_path / "in").exists() else W.landed(spark, str(tmp_path / "in"), SCHEMA)
        W.ingest(stream, *(str(tmp_path / n) for n in ("facts", "rejected", "coverage", "check"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 3
    assert spark.read.parquet(str(tmp_path / "rejected")).first().reason == "missing_id"
    assert spark.read.parquet(str(tmp_path / "coverage")).first().trades == 4


def test_pages_that_do_not_parse_are_kept(spark):
    good = json.dumps({"result": {"data": {"items": [{"_id": "1", "money": "1e1", "quantity": 2, "itemCode": "x", "createdAt": "2024-01-01T00:00:00"}]}}})
    pages = spark.createDataFrame([(1, good), (2, "{broken"), (3, "{}"), (4, None), (5, json.dumps({"result": {"data": {"items": []}}}))], "page int, raw string")
    assert {(r.page, r.reason) for r in D.malformed_pages(pages).collect()} == {(2, "not_json"), (3, "no_items"), (4, "not_json")}
    rows = D.trade_facts(pages).collect()
    assert [(r.page, r.id, float(r.money), r.money_precision, r.quantity_precision) for r in rows] == [(1, "1", 10.0, "decoded_float", "decimal")]


def test_times_without_an_offset_are_utc(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        texts = spark.createDataFrame([("2024-01-01T00:00:00",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00Z",), ("x",)], "t string")
        assert [r[0] for r in texts.select(F.unix_micros(D.iso_time(F.col("t")))).collect()] == [1704067200000000] * 3 + [None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("levels", [1, 3, 8])
def test_leaves_by_rounds(spark, levels):
    rows = [(1, '{"a/b": {"c~d": [1, [2, []], {}], "__v": 3}, "e": null, "f": ""}'), (2, "7"), (3, "[]"), (4, '{"x": {"y": {"z": {"w": [{"v": false}]}}}}'), (5, "{")]
    got = {(r.id, r.path, r.type, r.text) for r in D.json_leaves(spark.createDataFrame(rows, "id int, raw string"), levels=levels).collect()}
    assert got == {(1, "/a~1b/c~0d/0", "number", "1"), (1, "/a~1b/c~0d/1/0", "number", "2"), (1, "/e", "null", None), (1, "/f", "string", ""), (2, "", "number", "7"), (4, "/x/y/z/w/0/v", "boolean", "false")}


def test_one_deep_text_beside_many_flat_ones(spark):
    flat = spark.range(50_000).selectExpr("cast(id as int) as id", "concat('{\"a\": ', id, ', \"b\": {\"c\": true}}') as raw")
    depth = 60
    deep = spark.createDataFrame([(-1, '{"d": [' * depth + "5" + "]}" * depth)], "id int, raw string")
    got = D.json_leaves(flat.unionByName(deep))
    assert got.count() == 100_001
    assert got.where("id = -1").first().path == "/d/0" * depth


def test_leaves_of_any_depth(spark):
    deep = {"x": 1.5}
    for k in range(30):
        deep = {f"k{k}": [deep, None]} if k % 2 else {"q": deep}
    raw = spark.createDataFrame([(1, json.dumps({"deep": deep, "s": "a{[b", "t": True})), (2, "no json"), (3, None)], "id int, raw string")
    got = {(r.id, r.path.count("/"), r.type, r.text) for r in D.json_leaves(raw).where("type <> 'null'").collect()}
    assert got == {(1, 47, "number", "1.5"), (1, 1, "string", "a{[b"), (1, 1, "boolean", "true")}
    assert D.json_leaves(raw).where("type = 'null'").count() == 15


def test_first_alias_counts(spark):
    df = D.with_aliases(spark.createDataFrame([("n", "i", 1.0, 2.0, 3.0)], "name string, item string, highest_bid double, bid_price double, price double"))
    assert (df.first().item_name, df.first().bid) == ("i", 2.0) and "last_trade_price" not in df.columns


def test_ids_count_once_across_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    for rows in ([("1", t), ("2", t)], [("2", t), ("3", datetime(2024, 1, 2))], [("1", t)]):
        spark.createDataFrame([(i, "x", "trading", at, 2.0, 1.0, 2.0) for i, at in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        W.ingest(W.landed(spark, str(tmp_path / "in"), SCHEMA), *(str(tmp_path / n) for n in ("facts", "rejected", "coverage", "check"))).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "facts")).collect()) == ["1", "2", "3"]
    assert W.recomputed_clock(spark, str(tmp_path / "facts")).first()[0] == datetime(2024, 1, 2)


def test_strict_ingest_fails_and_loses_nothing(spark, tmp_path):
    import pytest
    from pyspark.errors import StreamingQueryException

    stream = landed(spark, tmp_path)
    places = [str(tmp_path / n) for n in ("facts", "rejected", "coverage", "check")]
    with pytest.raises(StreamingQueryException):
        W.ingest(stream, *places, strict=True).awaitTermination()
    assert not (tmp_path / "facts").exists() and spark.read.parquet(places[1]).first().reason == "missing_id"
    # The batch was not committed, so its good trades come again.
    W.ingest(W.landed(spark, str(tmp_path / "in"), SCHEMA), *places).awaitTermination()
    assert spark.read.parquet(places[0]).count() == 3


def test_fields_that_are_not_text(spark):
    page = lambda *items: '{"result": {"data": {"items": [' + ", ".join(items) + "]}}}"
    pages = [(1, page('{"_id": "a", "itemCode": 5, "buyerId": {"x": 1}}', '{"_id": null, "money": 3, "quantity": "4"}')), (2, page('{"createdAt": [1], "other": 9}')), (3, page()), (4, "no json"), (5, None), (6, '{"result": {"data": {"items": 3}}}')]
    got = D.mistyped_trades(spark.createDataFrame(pages, "page int, raw string")).collect()
    found = sorted((r.page, r.field, r.found.split("<")[0]) for r in got)
    assert found == [(1, "buyerId", "OBJECT"), (1, "itemCode", "BIGINT"), (2, "createdAt", "ARRAY")]
    assert D.mistyped_trades(spark.createDataFrame([], "page int, raw string")).count() == 0
