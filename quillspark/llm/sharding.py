"""Contiguous shards of near equal bytes, by global prefix sums.

Rows go in the order of doc_id (nulls first; of equal ids, by the rest of the row). A null text has no
bytes, and each row counts one byte more than its text. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import buckets, written


def with_prefix(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Adds, for each {new: column} of sums, the sum of column over all rows before, in the given order.

    Rows are range-partitioned; each part's total is summed over the parts (as many rows as parts), and
    added to the running sum inside the part.
    """
    n = buckets(df.sparkSession)
    parts = written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("part").agg(*[F.sum(c).alias(f"{k}_part") for k, c in sums.items()])
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", *[F.coalesce(F.sum(f"{k}_part").over(ahead), F.lit(0)).alias(f"{k}_base") for k in sums])
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(k) for k, c in sums.items()])
    return rows.join(before, "part").select(*df.columns, *[(F.col(k) + F.col(f"{k}_base")).alias(k) for k in sums])


def byte_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. A row goes to the shard in whose share of all bytes it starts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(1).cast("long").alias("one"))
    ranked = written(with_prefix(rows, ["doc_id", "size", "text_crc32"], {"bytes_before": "size", "rows_before": "one"}), "prefix")
    total = ranked.agg(F.max(F.col("bytes_before") + F.col("size")).alias("total"))
    cut = ranked.crossJoin(F.broadcast(total)).withColumn("shard", F.expr(f"least({shards - 1}, cast(bytes_before * {shards} div total as int))"))
    firsts = cut.groupBy("shard").agg(F.min("rows_before").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") - F.col("first")).alias("slot"))
