"""Queries that SQL can express, against it."""

import duckdb
import pytest

from quillspark.llm import queries


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_same_as_sql(spark, tiny, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    got = queries.queries()[name](spark, tiny)
    want = con.execute(queries.oracle_sql()[name])
    assert got.columns == [c[0] for c in want.description]
    rows = want.fetchall()
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    assert any(r[2] for r in rows)
