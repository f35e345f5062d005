"""JSON encoded twice, shared columns, and rows by key."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sinks import migrate


def test_json_is_decoded_once(spark):
    held = {"a": 'x "y" \\ \n é', "b": [1, None]}
    texts = [json.dumps(json.dumps(held)), json.dumps(held), json.dumps("a plain text"), "no json", '"[1]"', '" {} "', None, "", '"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r.t for r in migrate.migrated(rows, ["t", "id"], ("t",)).orderBy("id").collect()]
    assert json.loads(got[0]) == held and got[1:] == [*texts[1:4], "[1]", " {} ", None, "", '"']
    assert migrate.migrated(rows.withColumn("more", F.lit(1)), ["gone", "id"]).columns == ["id"]


def test_row_of_a_key(spark, tiny):
    orders = spark.read.parquet(f"{tiny}/orders.parquet")
    found = migrate.row_of(orders, "o_orderkey", 7)
    assert found.first().o_orderkey == 7 and "EqualTo(o_orderkey,7)" in found._jdf.queryExecution().executedPlan().toString()
    for key, value in (("o_orderkey", -1), ("o_orderstatus", "F")):
        with pytest.raises(ValueError, match=key):
            migrate.row_of(orders, key, value)
