"""The store of facts: counts, repeats, moves between days and merges that broke off."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import DataFrameWriter

from tests.test_stateful import ARRIVALS, plain_merge, random_arrivals
from tidemark.operators import resolve as R
from tidemark.sources import facts as S

DAY = "2024-01-0"


def arrivals(seed: int) -> list[tuple]:
    """Random arrivals with a time each now and then, and types that are never blanked."""
    found = []
    for ident, arrival, item, revision, fields in random_arrivals(seed, 10, 120):
        fields = {k: v for k, v in (fields or {}).items() if k != "transaction_type" or v is not None}
        if arrival % 3 == 0:
            fields["created_at"] = f"{DAY}{1 + arrival * 7 % 4} 12:00:00"
        found.append((ident, arrival, item, revision, fields))
    return found


def content(spark, folder: str) -> dict:
    rows = S.facts(spark, folder, id_type="string").collect()
    assert len({r.id for r in rows}) == len(rows)
    for r in rows:
        stamp = r.fields.get("created_at")
        assert r.day == (dt.date.fromisoformat(stamp.value[:10]) if stamp and stamp.value else None)
    return {(r.id, f): (v.value, v.revised_at) for r in rows for f, v in r.fields.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_merges_equal_a_loop(spark, tmp_path, seed):
    rows, folder = arrivals(seed), str(tmp_path / "store")
    outcomes, state = plain_merge(rows)
    for batch, low in enumerate(range(0, 120, 40)):
        want = {o: sum(1 for _, a, x in outcomes if x == o and low <= a < low + 40) for o in S.OUTCOMES}
        frame = spark.createDataFrame(rows[low : low + 40], ARRIVALS)
        assert S.merge(folder, batch, frame) == want
        assert S.merge(folder, batch, frame) == want
    assert content(spark, folder) == state
    before = content(spark, folder)
    assert S.vacuum(spark, folder) >= 1
    assert content(spark, folder) == before


@pytest.mark.parametrize("broken", ["rejected", "staged", "data", "manifest"])
def test_a_merge_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch, broken):
    rows, folder = arrivals(3), str(tmp_path / "store")
    S.merge(folder, 0, spark.createDataFrame(rows[:60], ARRIVALS))
    before = content(spark, folder)
    write = DataFrameWriter.parquet

    def failing(self, path, *args, **kwargs):
        if f"/{broken}/" in path:
            raise RuntimeError("lost")
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    with pytest.raises(RuntimeError, match="lost"):
        S.merge(folder, 1, spark.createDataFrame(rows[60:], ARRIVALS))
    monkeypatch.undo()
    assert content(spark, folder) == before
    counts = S.merge(folder, 1, spark.createDataFrame(rows[60:], ARRIVALS))
    outcomes, state = plain_merge(rows)
    assert counts == {o: sum(1 for _, a, x in outcomes if x == o and a >= 60) for o in S.OUTCOMES}
    assert content(spark, folder) == state


def test_only_touched_days_are_written(spark, tmp_path):
    folder = str(tmp_path / "store")
    stamp = lambda d: {"created_at": f"{DAY}{d} 10:00:00", "money": "1"}
    S.merge(folder, 0, spark.createDataFrame([(f"t{d}", d, "x", 1, stamp(d)) for d in (1, 2, 3)], ARRIVALS))
    first = S.manifest(spark, folder)[2]
    S.merge(folder, 1, spark.createDataFrame([("t2", 9, "x", 2, {"money": None}), ("t3", 9, "x", 2, stamp(4))], ARRIVALS))
    second = S.manifest(spark, folder)[2]
    day = lambda d: dt.date(2024, 1, d)
    assert first[day(1)] == second[day(1)]
    assert first[day(2)] != second[day(2)]
    assert set(second) == {day(1), day(2), day(4)}
    assert [r.id for r in S.facts(spark, folder, day(2), day(4), "string").collect()] == ["t2"]
    plan = S.facts(spark, folder, day(1), day(2), "string")._jdf.queryExecution().toString()
    assert "day=2024-01-04" not in plan
    assert R.latest_fields(S._as_arrivals(S.facts(spark, folder, id_type="string"))).count() == 6
