"""Every registered query with a SQL twin gives the twin's rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, close, rows_of

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db(root):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, root, db, name):
    df = entry.queries()[name](spark, root)
    result = db.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(result.columns, result.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert close(a, b), (a, b)
