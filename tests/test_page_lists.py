"""Which pages hold a kind of block: told by their list, not by a sum that other lists share."""

import hashlib

import duckdb

from quillspark.operators import bundles


def test_lists(spark, tmp_path):
    # equal sums: 1 + 4 = 2 + 3; order as text: 10 before 2
    pages = [(1, "<h1>a</h1>"), (4, "<h1>a</h1><h1>b</h1>"), (2, "<p>a</p>"), (3, f"<p>{'long ' * 10}</p>"), (None, "<p>no number</p><blockquote>x</blockquote>"), (9, None), (9, "")]
    pages += [(i, "<li>x</li><li>y</li>") for i in (*range(5, 600, 3), 5, 10, -2)]
    spark.createDataFrame(pages, "page_id long, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = bundles.block_summary(spark, str(tmp_path))
        got = {r.tag: r.asDict() for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = con.execute(bundles.SQL["block_summary"])
    names = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(names)
    assert got == {r["tag"]: r for row in want.fetchall() for r in [dict(zip(names, row, strict=True))]}
    listed = lambda *ids: hashlib.md5(",".join(sorted(map(str, ids))).encode()).hexdigest()
    assert (got["h1"]["pages"], got["p"]["pages"]) == (listed(1, 4), listed(2, 3))
    assert got["li"]["pages"] == listed(*{*range(5, 600, 3), 10, -2})


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert bundles.block_summary(spark, str(tmp_path)).collect() == []
