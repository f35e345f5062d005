"""Event-time operators that work alike on tables and on streams. A stream gets its
watermark once, in follow: late is how long state waits for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.review import load


def hourly(events: DataFrame) -> DataFrame:
    """Counts and sums by hour and type."""
    found = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    return found.select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events that less than a gap parts."""
    found = events.where("user_id is not null").groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return found.select("user_id", "n", "first_at", "last_at")


def once(events: DataFrame) -> DataFrame:
    """Each event_id once: on a stream, within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def follow(spark: SparkSession, folder: str, schema: str, files: int = 16, late: str = "2 hours") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withWatermark("ts", late)


def hourly_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(load(spark, sf_dir, "events"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(load(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (hourly_activity, user_sessions)}
SQL = {
    "hourly_activity": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "user_sessions": "WITH n AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY user_id, session",
}
