"""Every core query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans import catalog


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(tiny):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tiny}/{f}'")
    return con


def plain(frame: pd.DataFrame) -> list[tuple]:
    rows = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    cell = lambda x: round(x, 6) if isinstance(x, float) else str(x)
    return sorted(tuple("" if x is None else str(cell(x)).removesuffix(".0").removesuffix(" 00:00:00") for x in r) for r in rows.itertuples(index=False))


@pytest.mark.parametrize("name", [*catalog.oracle_sql()])
def test_same_as_sql(spark, duck, tiny, name):
    got = catalog.queries()[name](spark, tiny).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) > 0 or name in ("adjacent_duplicate_segments", "alignment_omission", "orphan_targets")


def test_issue_hotspots_reads_few_columns(spark, tiny):
    plan = catalog.queries()["issue_hotspots"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]
