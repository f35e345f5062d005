"""Where work stands: rows after a checkpoint, lookahead, trailing runs, lane frontiers, preferred terms, counts by status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .documents import SQL as DOCUMENTS
from .documents import target_islands
from .review import load

#: The turn that a resumed conversation was last saved at.
CHECKPOINT = 2


def after_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns after the saved one; all turns of conversations that lack it."""
    saved = F.max(F.when(F.col("turn") == CHECKPOINT, F.col("turn"))).over(Window.partitionBy("conv_id"))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", saved.alias("saved"))
    return rows.where(F.col("saved").isNull() | (F.col("turn") > F.col("saved"))).select("conv_id", "turn")


def later_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any later turn of the conversation asks a question; false after the last."""
    ahead = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    asks = F.coalesce(F.contains("text", F.lit("?")), F.lit(False))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.bool_or(asks).over(ahead), F.lit(False)).alias("asked_later"))


def trailing_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length of each conversation's last run of answers; turns after it don't count."""
    return target_islands(spark, sf_dir).where("role = 'assistant'").groupBy("conv_id").agg(F.max_by("turn_count", "first_turn").alias("run_length"))


def lane_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's first open order, where none of theirs is in progress: at most one item a lane."""
    status = F.col("o_orderstatus")
    rows = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.when(status == "O", F.col("o_orderkey"))).alias("next_orderkey"), F.count_if(status == "P").alias("active"))
    return rows.where("active = 0 and next_orderkey is not null").select("o_custkey", "next_orderkey")


def preferred_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One part for each brand, whatever its case: narrower scope, then locked, then the newest version."""
    scope, locked = F.col("p_type").startswith("PROMO").cast("int"), (F.col("p_size") > 25).cast("int")
    rows = load(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("term"))
    return rows.agg(F.max_by("p_partkey", F.struct(scope.alias("scope"), locked.alias("locked"), "p_partkey")).alias("p_partkey"))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_orderkey"))


QUERIES = {f.__name__: f for f in (after_checkpoint, later_question, trailing_answers, lane_frontier, preferred_terms, status_counts)}
SQL = {
    "after_checkpoint": f"WITH s AS (SELECT conv_id, turn, max(CASE WHEN turn = {CHECKPOINT} THEN turn END) OVER (PARTITION BY conv_id) AS saved FROM conversations) SELECT conv_id, turn FROM s WHERE saved IS NULL OR turn > saved",
    "later_question": "SELECT conv_id, turn, EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn > a.turn AND contains(b.text, '?')) AS asked_later FROM conversations a",
    "trailing_answers": f"SELECT conv_id, arg_max(turn_count, first_turn) AS run_length FROM ({DOCUMENTS['target_islands']}) WHERE role = 'assistant' GROUP BY conv_id",
    "lane_frontier": "SELECT o_custkey, min(o_orderkey) AS next_orderkey FROM orders a WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus = 'P') GROUP BY o_custkey",
    "preferred_terms": "SELECT lower(p_brand) AS term, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_brand) ORDER BY starts_with(p_type, 'PROMO') DESC, p_size > 25 DESC, p_partkey DESC) = 1",
    "status_counts": "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first_orderkey FROM orders GROUP BY o_orderstatus",
}
