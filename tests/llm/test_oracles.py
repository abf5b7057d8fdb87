"""Queries that SQL can express give the same rows in DuckDB."""

import duckdb
import pytest

from pharmalith.llm.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[k] for k in place)) for r in want.fetchall())


def test_every_operator_is_registered_once():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))
