"""Sketches against exact answers, within their bounds."""

from bisect import bisect_left, bisect_right

from quillspark.operators import sketches


def within(got, users, values):
    assert abs(got.distinct_count - len(users)) <= max(1, 0.05 * len(users))
    for q, x in ((0.5, got.p50), (0.95, got.p95)):
        low, high = bisect_left(values, x) / len(values), bisect_right(values, x) / len(values)
        assert low - 2 * sketches.RANK <= q <= high + 2 * sketches.RANK


def test_estimates(spark, tiny):
    path = tiny.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{path}/events.parquet").collect()
    got = {r.event_type: r for r in sketches.sketched_activity(spark, path).collect()}
    assert {*got} == {r.event_type for r in rows}
    for kind, r in got.items():
        mine = [x for x in rows if x.event_type == kind]
        assert r.row_count == len(mine)
        within(r, {x.user_id for x in mine} - {None}, sorted(x.value for x in mine if x.value is not None))


def test_batches_add_up_and_nulls_are_left_out(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, d int, u long, v double")
    first = [("a", i % 7, i, float(i)) for i in range(20_000)] + [("n", 1, None, None)]
    second = [("a", i % 3, i, float(i)) for i in range(15_000, 30_000)] + [("b", 1, 5, 1.0)] * 40
    parts = [sketches.sketched(frame(rows).repartition(4), ["k", "d"], "u", "v") for rows in (first, second)]
    got = {r.k: r for r in sketches.told(sketches.merged(parts, ["k"]), ["k"]).collect()}
    within(got["a"], range(30_000), sorted(x[3] for x in first[:-1] + second if x[0] == "a"))
    assert (got["b"].row_count, got["b"].distinct_count, got["b"].p50) == (40, 1, 1.0)
    assert (got["n"].row_count, got["n"].distinct_count, got["n"].p50) == (1, 0, None)
