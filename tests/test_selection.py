"""Matches, annotations, nesting, names, stream coverage and stale quotes."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import books as B
from tidemark.operators import candles as K
from tidemark.operators import indexes as I
from tidemark.operators import ledger as L
from tidemark.operators import selection as N
from tidemark.streaming import live as W


def test_first_asked_case_wins(spark):
    rows = spark.createDataFrame([("Iron", 1), ("wood", 2)], "item_code string, x int")
    wanted = spark.createDataFrame([("IRON", 0), ("iron", 1)], "code string, position int")
    assert [(r.item_code, r.asked_as) for r in N.match_items(rows, wanted).collect()] == [("Iron", "IRON")]


def test_annotations(spark):
    t = datetime(2024, 1, 2)
    rows = [("live", "production", "s", t, ["a"]), ("live", "production", "s", t, []), ("draft", "production", "s", t, []), ("live", "test", "s", t, []), ("live", "production", None, t, []), ("live", "production", "s", datetime(2025, 1, 1), [])]
    notes = spark.createDataFrame(rows, "status string, environment string, source string, effective_at timestamp, index_keys array<string>")
    at = lambda d: F.lit(d).cast("timestamp")
    assert N.live_annotations(notes, at("2024-01-01"), at("2024-02-01")).count() == 2
    assert N.live_annotations(notes, at("2024-01-01"), at("2024-02-01"), "b").count() == 1


def test_nested_trades(spark):
    trades = spark.createDataFrame([(1,), (2,)], "id int")
    parties = spark.createDataFrame([(1, "buy", "u", None, None, None), (1, "sell", "v", "m", None, None)], "id int, side string, user_id string, mu_id string, country_id string, party_id string")
    equipment = spark.createDataFrame([(1, "sword")], "id int, code string")
    stats = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0)], "id int, skill string, value double")
    got = {r.id: r for r in N.nest_trades(trades, parties, equipment, stats).collect()}
    assert got[1].parties["sell"].mu_id == "m" and got[1].equipment.stats == {"a": 1.0, "b": 2.0} and got[2].equipment is None


def test_names(spark):
    entities = spark.createDataFrame([("user", "x", "Ann", "c"), ("user", "y", "ann", None), ("mu", "ann", "Z", None), ("country", "c", "Land", None)], "kind string, id string, name string, citizenship_id string")
    asked = spark.createDataFrame([("ann",), ("ANN",), ("z",), ("none",)], "text string")
    got = {r.text: (r.candidates, r.entity and r.entity.id) for r in N.resolve_names(asked, entities).collect()}
    assert got == {"ann": (1, "ann"), "ANN": (2, None), "z": (1, "ann"), "none": (0, None)}
    ledger = spark.createDataFrame([("user", "x"), ("user", "q")], "kind string, account string")
    assert {(r.account, r.name, r.country_name) for r in N.with_names(ledger, entities).collect()} == {("x", "Ann", "Land"), ("q", None, None)}


def test_streams_are_covered_only_together(spark):
    reached = spark.createDataFrame([("a", 10), ("b", 4)], "stream string, reached int")
    progress = spark.createDataFrame([("a", "complete", 0, None), ("b", "complete", 0, None)], "stream string, status string, rejected int, error string")
    got = {r.stream: (r.covered, r.all_covered) for r in N.stream_coverage(reached, progress, F.lit(5)).collect()}
    assert got == {"a": (True, False), "b": (False, False)}
    trades = spark.createDataFrame([("a", 1.0), ("a", None)], "transaction_type string, unit_price double")
    assert {(r.stream, r.retained, r.normalized) for r in N.sync_status(progress, trades).collect()} == {("a", 2, 1), ("b", 0, 0)}


def test_basis(spark):
    some = spark.createDataFrame([(1.0, 1.0), (1.0, None)], "gross_buy double, gross_sell double")
    assert L.money_basis(some).first().basis == "source" and L.money_basis(some.na.drop()).first().basis == "gross" and L.money_basis(some.limit(0)).first().basis == "source"


def test_external_candles(spark):
    bars = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5), (None, 2.0, 0.5, 1.5)], "Open double, HIGH double, low double, Close double")
    assert [tuple(r) for r in K.normalized_ohlc(bars).collect()] == [(1.0, 2.0, 0.5, 1.5, 0.0)]


def test_stale_quotes(spark, tmp_path):
    kind, t = "item_code string, observed_at timestamp, current_price double", datetime(2024, 1, 1)
    for n, rows in enumerate([[("x", t, 1.0), ("y", t, 1.0)], [("y", t + timedelta(hours=2), 1.0)], [("y", t + timedelta(hours=3), 1.0)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = W.stale_quotes(W.landed(spark, str(tmp_path / "in"), kind)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.item_code, r.stale) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("x", True) in got and ("y", False) in got


def test_snapshots_without_levels_stay(spark):
    t = datetime(2024, 1, 2)
    snapshots = spark.createDataFrame([("a", t, 5.0), ("b", t, 6.0), ("c", t, None)], "item_code string, observed_at timestamp, best_bid double")
    levels = [("a", t, "bid", 2, 1.0, 1.0), ("a", t, "bid", 1, 2.0, 1.0), ("a", t, "ask", 1, 3.0, 0.0), ("c", t, "ask", 1, None, 2.0)]
    got = B.with_levels(snapshots, spark.createDataFrame(levels, "item_code string, observed_at timestamp, side string, position int, price double, quantity double"))
    assert {r.item_code: ([x.price for x in r.bids], len(r.asks), r.levels_available) for r in got.collect()} == {"a": ([2.0, 1.0], 0, True), "b": ([], 0, False), "c": ([], 0, False)}


def test_members_missing_at_either_end(spark):
    weights = spark.createDataFrame([("i", "a", 0.75), ("i", "b", 0.25), ("j", "b", 1.0)], "index_key string, item_code string, weight double")
    base = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "item_code string, base_price double")
    day = lambda n: date(2024, 1, n)
    prices = spark.createDataFrame([("a", day(1), 2.0), ("a", day(2), 3.0), ("b", day(2), 1.0), ("a", day(3), 3.0), ("b", day(3), 1.0)], "item_code string, as_of date, price double")
    got = {(r.index_key, r.as_of.day): (r.matched_pct, r.matched, r.missing) for r in I.matched_members(weights, base, prices, 1).collect()}
    assert got == {("i", 2): (75.0, ["a"], ["b"]), ("i", 3): (100.0, ["a", "b"], []), ("j", 2): (0.0, [], ["b"]), ("j", 3): (100.0, ["b"], [])}
    assert I.matched_members(weights, base, prices, 9).count() == 0 and I.matched_members(weights, base, prices.where("false"), 1).count() == 0
