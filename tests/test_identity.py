"""Accepted records and those set aside come from one pass of marking."""

from tidemark.operators import resolve as R


def test_accepted_records_are_not_joined_with_those_set_aside(spark):
    rows = [("a", 0, "x", None, "k"), ("a", 1, "y", "t", "k"), ("a", 2, "x", "t", None), ("a", 3, "x", "m", "k"), ("a", 4, "x", "t", "l"), (None, 0, "z", None, None)]
    records = spark.createDataFrame(rows, "id string, arrival long, item_code string, kind string, note string")
    good, bad = R.by_identity(records, ["item_code"], ["kind", "note"])
    assert sorted((r.id or "", r.arrival) for r in good.collect()) == [("", 0), ("a", 0), ("a", 2)]
    assert sorted((r.id, r.arrival) for r in bad.collect()) == [("a", 1), ("a", 3), ("a", 4)]
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and plan.count("Join ") == 3
