"""A week whose lowest price is zero: zero is no measure, in the rules and in their SQL."""

import duckdb
import pytest

from tests.test_oracles import rows, same
from tidemark.plans import registry


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Eight days of two items with books to the end; one item trades at nothing once."""
    folder, c = tmp_path_factory.mktemp("zeros"), duckdb.connect()
    c.sql(f"""copy (select r as event_id, timestamp '2024-01-01' + to_seconds(r * 350) as ts, r % 150 as user_id, case when r // 2 % 2 = 0 then 'click' else 'view' end as event_type,
      case when r = 1500 then 0 else 5 + r * 37 % 900 / 10 end as value, '{{"k": ' || (1 + r % 50) || '}}' as props from range(2000) t(r)) to '{folder}/events.parquet'""")
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["market_metrics", "market_scores"])
def test_zero_is_no_measure(spark, zeros, name):
    folder, duck = zeros
    got, want = registry.queries()[name](spark, folder).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    a, b = rows(got), rows(want)
    assert len(a) == len(b) == 2
    assert all(same(x, y) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)), (a, b)
    scored = got.set_index("item_code")["attractiveness"]
    assert scored.isna()["click"] and scored["view"] > 0
