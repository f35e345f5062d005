"""Leases that end, on tables and on streams, over a restart from the checkpoint."""

import datetime as dt

import pytest

from quillspark.streaming import activity, leases

pytest.importorskip("google.protobuf")
SCHEMA = "lease_id string, item long, worker long, action string, ts timestamp, ttl double"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


ROWS = [
    ("lapsed", 1, 1, "claim", at(0), 600.0),
    ("kept", 2, 1, "claim", at(1), 600.0), ("kept", 2, 1, "heartbeat", at(9), 600.0), ("kept", 2, 1, "heartbeat", at(10), 60.0), ("kept", 2, 1, "heartbeat", at(18), 600.0),
    ("done", 3, 2, "claim", at(2), 600.0), ("done", 3, 2, "release", at(5), None), ("done", 3, 2, "heartbeat", at(6), 600.0),
    ("late beat", 4, 2, "claim", at(2), 60.0), ("late beat", 4, 2, "heartbeat", at(4), 600.0), ("late beat", 4, 2, "release", at(5), None),
    ("never claimed", 5, 2, "heartbeat", at(3), 600.0), ("twice", 6, 3, "claim", at(3), 120.0), ("twice", 6, 4, "claim", at(4), 6000.0),
    ("edge", 7, 3, "claim", at(3), 60.0), ("edge", 7, 3, "release", at(4), None), ("open", 8, 3, "claim", at(29), 99999.0), (None, 9, 9, "claim", at(1), 1.0), ("no time", 9, 9, "claim", None, 1.0),
]
WANT = {
    ("lapsed", 1, 1, "expired", at(0), at(10), 0), ("kept", 2, 1, "expired", at(1), at(28), 3), ("done", 3, 2, "released", at(2), at(5), 0),
    ("late beat", 4, 2, "expired", at(2), at(3), 0), ("twice", 6, 3, "expired", at(3), at(5), 0), ("edge", 7, 3, "released", at(3), at(4), 0),
}


@pytest.fixture
def rocks(spark):
    for k, v in leases.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in leases.STATE_STORE:
        spark.conf.unset(k)


def test_table(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {tuple(r) for r in leases.ended_leases(rows, str(at(30))).collect()}
    assert got == WANT | {("open", 8, 3, "active", at(29), at(29) + dt.timedelta(seconds=99999), 0)}


def drained(spark, stream, folder, out):
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder).outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def test_stream_over_a_restart(rocks, tmp_path):
    """Three runs from one checkpoint; a worker that is gone has its lease expire in a later run, by the clock of others."""
    spark = rocks
    known = [r for r in ROWS if r[0] is not None and r[4] is not None]
    cuts = [at(8), at(18) + dt.timedelta(seconds=1), at(99)]
    counts = []
    for k, end in enumerate(cuts):
        begin = cuts[k - 1] if k else at(-1)
        rows = [r for r in known if begin <= r[4] < end] + [(f"tick{k}", 0, 0, "heartbeat", end - dt.timedelta(seconds=1), 0.0)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = leases.watched_leases(activity.follow(spark, f"{tmp_path}/in/*", SCHEMA, 1, "0 seconds"))
        got = drained(spark, stream, f"{tmp_path}/state", f"{tmp_path}/out")
        counts.append(len(got))
        assert len(got) == len(set(got))
    assert set(got) == WANT
    assert counts[0] >= 3 and counts[0] < counts[2]


def test_seeds_come_once(rocks, tmp_path):
    spark = rocks
    schema = "seed string, ts timestamp, payload string"
    runs = [[("a", at(0), "2"), ("a", at(0), "1"), ("b", at(1), None), (None, at(1), "x")], [("a", at(2), "3"), ("c", at(3), "4")], []]
    for k, rows in enumerate(runs):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        got = drained(spark, leases.new_seeds(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")), f"{tmp_path}/state", f"{tmp_path}/out")
    assert sorted(got) == [("a", at(0), "1"), ("b", at(1), None), ("c", at(3), "4")]
