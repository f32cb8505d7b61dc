"""What all parts of a report read is made once."""

from tidemark.plans import guidance


def test_events_are_parsed_once(spark, sf_dir):
    plan = guidance.fair_value_guidance(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in plan and "itemMarket" not in plan
