"""Leases of work that run out, on tables by windows and on streams by state with timers; and seeds that come once.

Events of leases are rows (lease_id, item, worker, action, ts, ttl): `claim` begins a lease for ttl seconds, a `heartbeat`
makes it last ttl seconds from then on (never shorter), `release` ends it. What comes after the end counts no more, nor what
comes before the claim, nor a second claim. Null lease ids and times are left out.

A stream needs RocksDB as its state store (STATE_STORE). State is one small row for each open lease, and timers fire as the
watermark passes, so a lease whose worker is gone comes out once, and not again after a restart from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.review import load
from quillspark.streaming.processors import ACTIONS, FirstSight, LeaseKeeper

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ENDED = "lease_id string, item long, worker long, status string, acquired_at long, ended_at long, beats long"


def ended_leases(events: DataFrame, now: str) -> DataFrame:
    """lease_id, item, worker, status, acquired_at, ended_at and beats of all leases: `released` at its release, `expired`
    when it ran out before now, or `active` with the moment when it would run out."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    order = Window.partitionBy("lease_id").orderBy("ts", rank)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where("lease_id is not null and ts is not null").withColumn("begun", F.count_if(F.col("action") == "claim").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # from the first claim on, without further claims
    rows = rows.where((F.col("begun") > 0) & ((F.col("action") != "claim") | (F.col("begun") == 1)))
    until = F.when(F.col("action") != "release", F.expr("ts + make_dt_interval(0, 0, 0, ttl)"))
    rows = rows.withColumn("until", until).withColumn("lasts", F.max("until").over(past))
    over = F.coalesce((F.col("ts") > F.col("lasts")) | (F.lag("action").over(order) == "release"), F.lit(False))
    rows = rows.withColumn("over", F.max(over).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("not over")
    found = rows.groupBy("lease_id").agg(F.min_by(F.struct("item", "worker", "ts"), F.struct("ts", rank)).alias("first"), F.max("until").alias("until"), F.max(F.when(F.col("action") == "release", F.col("ts"))).alias("released"), F.count_if(F.col("action") == "heartbeat").alias("beats"))
    status = F.when(F.col("released").isNotNull(), "released").when(F.col("until") < F.lit(now).cast("timestamp"), "expired").otherwise("active")
    return found.select("lease_id", "first.item", "first.worker", status.alias("status"), F.col("first.ts").alias("acquired_at"), F.coalesce("released", "until").alias("ended_at"), "beats")


def watched_leases(events: DataFrame) -> DataFrame:
    """The leases of a stream (with a watermark on ts) that end, each once: as of ended_leases, without active ones."""
    known = events.where("lease_id is not null and ts is not null").withColumn("at", F.unix_micros("ts"))
    found = known.groupBy("lease_id").transformWithState(statefulProcessor=LeaseKeeper(), outputStructType=StructType.fromDDL(ENDED), outputMode="Append", timeMode="EventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("acquired_at", "ended_at")})


def new_seeds(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Seeds (seed, ts, payload) of a stream that no earlier batch has asked for: the first of each batch's equals by ts and
    payload. Keys are kept for ttl_ms (in processing time), or for ever. Null seeds are left out."""
    schema = StructType.fromDDL("seed string, ts timestamp, payload string")
    known = requests.where("seed is not null")
    return known.groupBy("seed").transformWithState(statefulProcessor=FirstSight(ttl_ms), outputStructType=schema, outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def lease_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of leases: a user's events of three days belong to one lease, the first view or signup claims it, an
    error releases it, others are heartbeats; it lasts 6 hours and up to 29 more by the event's value."""
    rows = load(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    action = F.when(F.col("event_type").isin("view", "signup"), "claim").when(F.col("event_type") == "error", "release").otherwise("heartbeat")
    part = F.floor(F.dayofyear("ts") / 3)
    return rows.select(F.concat_ws("-", "user_id", part).alias("lease_id"), (F.col("user_id") % 40).alias("item"), (F.col("user_id") % 7).alias("worker"), action.alias("action"), "ts", (21600 + F.floor(F.coalesce("value", F.lit(0.0))) % 30 * 3600).cast("double").alias("ttl"))


def lease_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ended_leases(lease_events(spark, sf_dir), "2024-01-20 00:00:00")


QUERIES = {f.__name__: f for f in (lease_endings,)}
SQL = {
    "lease_endings": """WITH e AS (SELECT user_id::VARCHAR || '-' || (dayofyear(ts) // 3)::VARCHAR AS lease_id, user_id % 40 AS item, user_id % 7 AS worker, CASE WHEN event_type IN ('view', 'signup') THEN 1 WHEN event_type = 'error' THEN 3 ELSE 2 END AS action, ts, (21600 + floor(coalesce(value, 0))::BIGINT % 30 * 3600) AS ttl FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, count(*) FILTER (action = 1) OVER (PARTITION BY lease_id ORDER BY ts, action ROWS UNBOUNDED PRECEDING) AS begun FROM e),
u AS (SELECT *, CASE WHEN action != 3 THEN ts + ttl * INTERVAL 1 SECOND END AS until FROM b WHERE begun > 0 AND (action != 1 OR begun = 1)),
l AS (SELECT *, coalesce(ts > max(until) OVER (PARTITION BY lease_id ORDER BY ts, action ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR lag(action) OVER (PARTITION BY lease_id ORDER BY ts, action) = 3, false) AS ends FROM u),
o AS (SELECT *, bool_or(ends) OVER (PARTITION BY lease_id ORDER BY ts, action ROWS UNBOUNDED PRECEDING) AS over FROM l),
g AS (SELECT lease_id, arg_min(item, (ts, action)) AS item, arg_min(worker, (ts, action)) AS worker, min(ts) AS acquired_at, max(until) AS until, max(CASE WHEN action = 3 THEN ts END) AS released, count(*) FILTER (action = 2) AS beats FROM o WHERE NOT over GROUP BY lease_id)
SELECT lease_id, item, worker, CASE WHEN released IS NOT NULL THEN 'released' WHEN until < TIMESTAMP '2024-01-20 00:00:00' THEN 'expired' ELSE 'active' END AS status, acquired_at, coalesce(released, until) AS ended_at, beats FROM g""",
}
