"""Rows from one store to another: shared columns alone, JSON that was encoded twice as it was meant, writes in batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.review import load


def row_of(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The one row with a key, by a filter that reaches the scan; ValueError if there is none, or more than one."""
    found = rows.where(F.col(key) == value)
    n = len(found.select(F.lit(1)).limit(2).collect())
    if n != 1:
        raise ValueError(f"{key} {value!r}: {'no row' if n == 0 else 'several rows'}")
    return found


def decoded_once(text: Column) -> Column:
    """JSON in a text: what a JSON string holds if that is JSON of an object or array, else the text as it is."""
    inner = F.get_json_object(F.concat(F.lit("["), text, F.lit("]")), "$[0]")
    return F.when(F.btrim(text).rlike(r'(?s)^".*"$') & F.btrim(inner).rlike(r"(?s)^(?:\{.*\}|\[.*\])$"), inner).otherwise(text)


def migrated(source: DataFrame, columns: list[str], json_columns: tuple[str, ...] = ()) -> DataFrame:
    """source with those of the target's columns that it has, in the target's order, and its JSON columns decoded once."""
    return source.select(*[decoded_once(F.col(c)).alias(c) if c in json_columns else F.col(c) for c in columns if c in source.columns])


def write_jdbc(rows: DataFrame, url: str, table: str, batch: int = 500, parts: int = 8) -> None:
    """Appends rows to a table by JDBC, batch rows to a statement, over at most parts connections."""
    rows.coalesce(parts).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).mode("append").save()


def migrated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties were encoded twice in every other row, to a table without users and with a column more."""
    rows = load(spark, sf_dir, "events")
    twice = F.to_json(F.array("props"))
    rows = rows.withColumn("props", F.when(F.col("event_id") % 2 == 0, F.substring(twice, F.lit(2), F.length(twice) - 2)).otherwise(F.col("props")))
    return migrated(rows, ["event_id", "event_type", "ts", "props", "migrated_at"], ("props",))


QUERIES = {f.__name__: f for f in (migrated_events,)}
SQL = {"migrated_events": "SELECT event_id, event_type, ts, props FROM events"}
