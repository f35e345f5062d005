"""Distinct counts and quantiles by sketches that are made once, kept, and merged for any coarser grouping.

A sketch of a group has a bounded size (some 3 KB for counts, some 2 KB for quantiles), so rows are read once and summed up
before the shuffle; what is asked later reads sketches alone. Sketches of new rows are merged with those that are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.review import load

#: Distinct counts are within 3 standard errors of 1.04 / sqrt(2^LOG) for nearly all groups; ranks of quantiles within RANK.
LOG, K, RANK = 12, 400, 0.01


def sketched(rows: DataFrame, by: list[str], who: str, value: str) -> DataFrame:
    """by, row_count, who_sketch and value_sketch of each group; nulls are in no sketch."""
    return rows.groupBy(*by).agg(F.count("*").alias("row_count"), F.hll_sketch_agg(F.col(who).cast("long"), LOG).alias("who_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), K).alias("value_sketch"))


def merged(tables: list[DataFrame], by: list[str]) -> DataFrame:
    """Tables of sketched, with the same or finer groups, as one by coarser groups."""
    every = reduce(lambda a, b: a.unionByName(b), [t.select(*by, "row_count", "who_sketch", "value_sketch") for t in tables])
    return every.groupBy(*by).agg(F.sum("row_count").alias("row_count"), F.hll_union_agg("who_sketch").alias("who_sketch"), F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def told(table: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """by, row_count, distinct_count and a column for each quantile (p50, p95, ..); null quantiles for groups without values."""
    some = F.kll_sketch_get_n_double("value_sketch") > 0
    return table.select(*by, "row_count", F.hll_sketch_estimate("who_sketch").alias("distinct_count"), *[F.when(some, F.kll_sketch_get_quantile_double("value_sketch", F.lit(q))).alias(f"p{round(100 * q)}") for q in quantiles])


def sketched_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By type of event: users and quantiles of values, from sketches by type and day."""
    rows = load(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return told(merged([sketched(rows, ["event_type", "day"], "user_id", "value")], ["event_type"]), ["event_type"])


QUERIES = {f.__name__: f for f in (sketched_activity,)}
#: Estimates depend on the order of merging; the tests hold them to their bounds.
SQL: dict[str, str] = {}
