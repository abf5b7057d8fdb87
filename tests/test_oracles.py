"""Every query with a SQL counterpart gives the same rows in DuckDB, on the smallest tables."""

import duckdb
import pytest

from pharmalith.plans.adapters import TABLES
from pharmalith.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    text = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    assert sorted(tuple(text(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(text(r[k]) for k in place) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() == 150
