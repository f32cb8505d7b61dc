"""The SQL of coverage gives one result, however many scans are alike."""

import duckdb
import pytest

from tidemark.plans import registry


@pytest.fixture(scope="module")
def busy():
    """Forty thousand events of one item, dozens in each hour."""
    c = duckdb.connect()
    c.sql("create view events as select r as event_id, timestamp '2024-01-01' + to_seconds(r * 7919 % 2592000) as ts, 'click' as event_type from range(40000) t(r)")
    return c


def test_islands_of_repeated_scans_do_not_overlap(busy):
    found = busy.sql(f"select start, \"end\" from ({registry.oracle_sql()['coverage_merged']}) order by start").fetchall()
    assert len(found) == 31
    assert all(end < following for (_, end), (following, _) in zip(found, found[1:], strict=False))
