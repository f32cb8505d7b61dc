"""Every registered library query against its SQL on DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return str(v)


def rows(df):
    out = [tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).values.tolist()]
    return sorted(out, key=lambda r: [str(x) if not isinstance(x, float) else "" for x in r] + [round(x, 3) for x in r if isinstance(x, float)])


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if not all(map(same, x, y))]
    assert not wrong, wrong[:2]
