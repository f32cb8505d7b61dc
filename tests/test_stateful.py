"""Stateful streams against plain loops, with rows dealt to files in different ways."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ledger as L
from tidemark.operators import resolve as R
from tidemark.streaming import stateful as S

ARRIVALS = "id string, arrival long, item_code string, revised_at long, fields map<string,string>"


def plain_merge(arrivals: list[tuple]) -> tuple[list[tuple], dict]:
    """Outcomes and the fields' (value, revision), one arrival after the other."""
    items, state, out = {}, {}, []
    for ident, arrival, item, revision, fields in sorted(arrivals, key=lambda a: a[1]):
        new = ident not in items
        kind = (fields or {}).get("transaction_type")
        known = state.get((ident, "transaction_type"), (None, None))[0]
        if not new and (items[ident] != item or kind is not None and known is not None and kind != known):
            out.append((ident, arrival, "rejected"))
            continue
        items.setdefault(ident, item)
        changed = False
        for field, value in (fields or {}).items():
            if (ident, field) not in state:
                state[ident, field], changed = (value, revision), True
                continue
            old, prior = state[ident, field]
            newer = revision is not None and (prior is None or revision > prior)
            if newer or (old is None and prior is None and value is not None):
                state[ident, field], changed = (value, revision), True
        out.append((ident, arrival, "inserted" if new else "enriched" if changed else "unchanged"))
    return out, state


def random_arrivals(seed: int, ids: int, rows: int) -> list[tuple]:
    rng = random.Random(seed)
    found = []
    for arrival in range(rows):
        fields = {f: rng.choice([None, "a", "b"]) for f in ("money", "note") if rng.random() < 0.7}
        if rng.random() < 0.5:
            fields["transaction_type"] = rng.choice([None, "trading", "trading", "trading", "itemMarket"])
        found.append((f"t{rng.randrange(ids)}", arrival, rng.choice(["x"] * 9 + ["y"]), rng.choice([None, 1, 2, 3, 4]), rng.choice([fields, fields, fields, {}, None])))
    return found


def streamed(spark, rows: list[tuple], schema: str, cuts: list[int], folder, make) -> list:
    """Rows of a stream that reads the given runs of rows from one file each."""
    for number, (low, high) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.parquet(str(folder / "in" / f"f={number}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
    query = make(stream).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(folder / "out")).collect()


def test_a_newer_null_blanks_a_value_and_guards_it(spark, tmp_path):
    rows = [("a", 0, "x", 1, {"money": "5"}), ("a", 1, "x", 2, {"money": None}), ("a", 2, "x", 1, {"money": "7"}), ("a", 3, "x", None, {"money": "8"}), ("a", 4, "x", 3, {}), ("a", 5, "x", 3, {"money": "9"})]
    got = {r.arrival: (r.outcome, {k: (v.value, v.revised_at) for k, v in r.changes.items()}) for r in streamed(spark, rows, ARRIVALS, [2, 3], tmp_path, S.resolved_records)}
    assert got == {0: ("inserted", {"money": ("5", 1)}), 1: ("enriched", {"money": (None, 2)}), 2: ("unchanged", {}), 3: ("unchanged", {}), 4: ("unchanged", {}), 5: ("enriched", {"money": ("9", 3)})}
    log = R.field_log(spark.createDataFrame(rows[:5], ARRIVALS))
    assert [(r.value, r.is_null, r.revised_at) for r in R.latest_fields(log).collect()] == [(None, True, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_live_resolution_equals_a_loop(spark, tmp_path, seed):
    rows = random_arrivals(seed, 12, 160)
    want, state = plain_merge(rows)
    got = streamed(spark, rows, ARRIVALS, [40, 41, 100], tmp_path, S.resolved_records)
    assert sorted((r.id, r.arrival, r.outcome) for r in got) == sorted(want)
    last = {}
    for r in sorted(got, key=lambda r: r.arrival):
        last |= {(r.id, f): (c.value, c.revised_at) for f, c in r.changes.items()}
    assert last == state


@pytest.mark.parametrize("seed", [3, 4])
def test_batch_resolution_equals_a_loop(spark, seed):
    rows = [(i, a, "x", r, f and {k: v for k, v in f.items() if k != "transaction_type"}) for i, a, _, r, f in random_arrivals(seed, 12, 160)]
    want, state = plain_merge(rows)
    log = R.field_log(spark.createDataFrame(rows, ARRIVALS).repartition(3))
    assert sorted(map(tuple, R.outcomes(log).collect())) == sorted(want)
    assert {(r.id, r.field): (r.value, r.revised_at) for r in R.latest_fields(log).collect()} == state


def test_optional_identity(spark):
    rows = [("a", 0, "x", None), ("a", 1, "x", "trading"), ("a", 2, "y", "trading"), ("a", 3, "x", "itemMarket"), ("a", 4, "x", None), ("b", 0, "y", "itemMarket")]
    records = spark.createDataFrame(rows, "id string, arrival long, item_code string, kind string")
    good, bad = R.by_identity(records, ["item_code"], ["kind"])
    assert sorted((r.id, r.arrival) for r in bad.collect()) == [("a", 2), ("a", 3)]
    assert good.count() == 4


PAGES = "stream string, page long, position long, id long, created_at timestamp"


def test_pages_guarded_across_batches(spark, tmp_path):
    at = lambda minutes: F.lit("2024-01-01 12:00:00").cast("timestamp") + F.make_interval(mins=F.lit(minutes))
    plan = [  # file by file: (stream, page, position, minutes)
        [("s", 0, 0, 60), ("s", 0, 1, 50), ("t", 0, 0, 10)],
        [("s", 1, 1, 55), ("s", 1, 0, 50), ("s", 2, 0, 49)],
        [("s", 5, 0, 40), ("s", 5, 1, 40)],
        [("s", 3, 0, 45), ("s", 6, 0, 41), ("s", 6, 1, 30), ("t", 1, 0, 5)],
    ]
    ident = 0
    for number, rows in enumerate(plan):
        frame = spark.createDataFrame([(*r, ident + n) for n, r in enumerate(rows)], "stream string, page long, position long, minutes int, id long")
        ident += len(rows)
        frame.select("stream", "page", "position", "id", at(F.col("minutes")).alias("created_at") if False else (F.lit("2024-01-01 12:00:00").cast("timestamp") + F.make_interval(mins="minutes")).alias("created_at")).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={number}"))
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    S.guard_to_tables(stream, str(tmp_path / "taken"), str(tmp_path / "aside"), str(tmp_path / "gaps"), str(tmp_path / "state"), "45 minutes").awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    assert {(r.stream, r.page, r.position, r.reason) for r in read("aside").collect()} == {("s", 1, 1, "not_descending"), ("s", 3, 0, "late_page"), ("s", 6, 0, "not_descending"), }
    assert {(r.stream, r.page, r.position) for r in read("taken").collect()} == {("s", 0, 0), ("s", 0, 1), ("t", 0, 0), ("s", 1, 0), ("s", 2, 0), ("s", 5, 0), ("s", 5, 1), ("s", 6, 1), ("t", 1, 0)}
    assert [(r.stream, r.page, r.missing_pages) for r in read("gaps").collect()] == [("s", 5, 2)]


def test_late_rows_go_aside(spark, tmp_path):
    rows = [("s", 0, 0, 1, 100), ("s", 1, 0, 2, 95), ("s", 2, 0, 3, 20)]
    frame = spark.createDataFrame(rows, "stream string, page long, position long, id long, minutes int").select("stream", "page", "position", "id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins="minutes")).alias("created_at"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in" / "f=0"))
    stream = spark.readStream.schema(PAGES).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = S.guarded_pages(stream, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.page, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(0, None), (1, None), (2, "late")}


PARTS = "transaction_type string, kind string, account string, item_code string, created_at timestamp, id long, side string, quantity double, money double, gross double, net double, fee_known boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_live_inventory_equals_fifo(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = []
    for n in range(300):
        amount = lambda: rng.choice([None, float(rng.randrange(1, 64))])  # noqa: B023, E731
        rows.append(("trading", "user", rng.choice("ab"), rng.choice("xy"), rng.randrange(0, 4_000), n, rng.choice(["buy", "buy", "sell"]), rng.choice([None, 0.0] + [1.0, 2.0, 4.0] * 20), amount(), amount(), amount(), rng.random() < 0.5))
    seconds = PARTS.replace("created_at timestamp", "at long")
    order = sorted(rows, key=lambda r: r[4] + rng.randrange(-900, 900)) + [("trading", "user", "end", "end", 9_000_000, 1_000, "buy", 1.0, None, None, None, True)]
    stamped = lambda df: df.withColumn("created_at", F.timestamp_seconds("at")).drop("at").select(*[c.split()[0] for c in PARTS.split(", ")])
    for number, low in enumerate(range(0, len(order), 70)):
        stamped(spark.createDataFrame(order[low : low + 70], seconds)).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={number}"))
    stream = spark.readStream.schema(PARTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    query = S.live_matches(stream, "2 hours").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = L.fifo(stamped(spark.createDataFrame(rows, seconds)))
    shape = lambda df: sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("kind", "account", "item_code", "sale_id", "sold_at", "lot_id", "matched", "profit", "gross_profit", "net_profit", "sale_quantity", "lot_equal_time").collect())
    assert shape(got) == shape(want)
    assert got.count() > 30
