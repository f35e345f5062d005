"""Bundles in one shuffle, with keys that some parts lack."""

import json

from quillspark.operators import wholes


def test_bundles(spark):
    frame = spark.createDataFrame
    parts = {
        "head": frame([(1, "a"), (2, "b"), (None, "x")], "id long, name string"),
        "items": frame([(1, 2, None), (1, 1, "z"), (1, 1, "y"), (3, 1, "q")], "id long, n int, t string"),
        "state": frame([(1, 5, "old"), (1, 7, "new"), (1, None, "none"), (3, 1, "only")], "id long, version int, status string"),
    }
    got = {r.id: r for r in wholes.bundled("id", parts, {"state": ["version"]}, "head").collect()}
    assert {k: ([x.name for x in r.head], [(x.n, x.t) for x in r["items"]], r.state and r.state.status) for k, r in got.items()} == {1: (["a"], [(1, "y"), (1, "z"), (2, None)], "new"), 2: (["b"], [], None)}
    whole = {r.id for r in wholes.bundled("id", parts).collect()}
    assert whole == {1, 2, 3}
    dump = {r.id: json.loads(r.bundle) for r in wholes.as_json(wholes.bundled("id", parts, {"state": ["version"]}, "head"), "id").collect()}
    assert dump[2] == {"id": 2, "head": [{"name": "b"}], "items": []} and dump[1]["state"] == {"version": 7, "status": "new"}


def test_one_exchange(spark, tiny):
    for name in ("chapter_wholes", "packet_wholes"):
        plan = wholes.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
