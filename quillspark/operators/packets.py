"""Packets of blocks with their context, the roles of sentences in them, and chapter briefs and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .documents import SENTENCES, sentences
from .review import load


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English blocks as packets, with the places of the two blocks before and after."""
    size = sentences(spark, sf_dir).groupBy("doc_id", "ordinal").agg(F.count("*").alias("sentence_count"))
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    near = lambda a, b: F.collect_list("ordinal").over(order.rowsBetween(a, b))
    return size.select("doc_id", "ordinal", F.row_number().over(order).alias("packet"), "sentence_count", near(-2, -1).alias("before"), near(1, 2).alias("after"))


def context_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return packets(spark, sf_dir).select("doc_id", "packet", "ordinal", "sentence_count", places("before").alias("before"), places("after").alias("after"))


def packet_sentence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sentences a packet holds, and in which role; each packet reads at most five blocks."""
    role = lambda c, r: F.transform(c, lambda x: F.struct(x.alias("at"), F.lit(r).alias("role")))
    parts = packets(spark, sf_dir).select("doc_id", "packet", F.explode(F.concat(role("before", "before"), role(F.array("ordinal"), "current"), role("after", "after"))).alias("p"))
    return parts.select("doc_id", "packet", F.col("p.at").alias("ordinal"), "p.role").join(sentences(spark, sf_dir).select("doc_id", "ordinal", "n"), ["doc_id", "ordinal"])


def chapter_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each English document its first sentence, its longest in the second half, and its sizes."""
    rows = sentences(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "n"))).withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    late = F.when(F.col("place") * 2 > F.col("total"), F.struct(F.length("sentence").alias("size"), (-F.col("place")).alias("back")))
    return rows.groupBy("doc_id").agg(F.md5(F.min_by("sentence", "place")).alias("first_digest"), F.md5(F.max_by("sentence", late)).alias("late_digest"), F.count("*").alias("sentence_count"), F.count_distinct("ordinal").alias("block_count"))


def memories(rows: DataFrame) -> DataFrame:
    """Each turn's memory: its version, the ids of the last four turns, characters so far. A window does the fold."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return rows.select("conv_id", "turn", F.row_number().over(order).alias("version"), F.array_join(F.collect_list(F.col("turn").cast("string")).over(order.rowsBetween(-3, 0)), ",").alias("tail"), F.sum(F.coalesce(F.length("text"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("chars_so_far"))


def memory_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memories(load(spark, sf_dir, "conversations"))


def latest_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = memories(load(spark, sf_dir, "conversations")).groupBy("conv_id").agg(F.max_by(F.struct("version", "tail", "chars_so_far"), "version").alias("m"))
    return last.select("conv_id", "m.*")


def trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram Jaccard similarity of a turn and the one before: 1 if equal, the shares of lengths if one holds the other."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.lower("text").alias("a"), F.lag(F.lower("text")).over(order).alias("b")).where("a != '' and b != ''")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    rows = rows.withColumn("x", grams(F.col("a"))).withColumn("y", grams(F.col("b")))
    both = F.size(F.array_intersect("x", "y"))
    held = F.contains("a", F.col("b")) | F.contains("b", F.col("a"))
    score = F.when(held, F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"))).otherwise(both / (F.size("x") + F.size("y") - both))
    return rows.select("conv_id", "turn", F.round(score.cast("double"), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (context_packets, packet_sentence_map, chapter_briefs, memory_versions, latest_memory, trigram_similarity)}
_PACKETS = SENTENCES + ", sized AS (SELECT doc_id, ordinal, count(*) AS sentence_count FROM sentences GROUP BY ALL), packets AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal)::INT AS packet FROM sized)"
_NEAR = "SELECT p.doc_id, p.packet, q.ordinal, CASE WHEN q.packet < p.packet THEN 'before' WHEN q.packet = p.packet THEN 'current' ELSE 'after' END AS role FROM packets p JOIN packets q ON p.doc_id = q.doc_id AND q.packet BETWEEN p.packet - 2 AND p.packet + 2"
_MEMORY = "memory AS (SELECT conv_id, turn, row_number() OVER w::INT AS version, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS tail, (sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS chars_so_far FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_GRAMS = "list_distinct(list_transform(range(1, greatest(length({0}) - 2, 1) + 1), lambda i: substr({0}, i, 3)))"
SQL = {
    "context_packets": f"WITH {_PACKETS}, near AS ({_NEAR}) SELECT p.doc_id, p.packet, p.ordinal, sentence_count, coalesce(string_agg(n.ordinal, ',' ORDER BY n.ordinal) FILTER (role = 'before'), '') AS before, coalesce(string_agg(n.ordinal, ',' ORDER BY n.ordinal) FILTER (role = 'after'), '') AS after FROM packets p JOIN near n ON p.doc_id = n.doc_id AND p.packet = n.packet GROUP BY ALL",
    "packet_sentence_map": f"WITH {_PACKETS}, near AS ({_NEAR}) SELECT doc_id, packet, ordinal, role, n FROM near JOIN sentences USING (doc_id, ordinal)",
    "chapter_briefs": f"WITH {SENTENCES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, n) AS place, count(*) OVER (PARTITION BY doc_id) AS total FROM sentences) SELECT doc_id, md5(arg_min(sentence, place)) AS first_digest, md5(arg_max(sentence, row(length(sentence), -place)) FILTER (place * 2 > total)) AS late_digest, count(*) AS sentence_count, count(DISTINCT ordinal) AS block_count FROM r GROUP BY doc_id",
    "memory_versions": f"WITH {_MEMORY} SELECT * FROM memory",
    "latest_memory": f"WITH {_MEMORY} SELECT conv_id, version, tail, chars_so_far FROM memory QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY version DESC) = 1",
    "trigram_similarity": f"WITH t AS (SELECT conv_id, turn, lower(text) AS a, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations), g AS (SELECT *, {_GRAMS.format('a')} AS x, {_GRAMS.format('b')} AS y FROM t WHERE a != '' AND b != '') SELECT conv_id, turn, round(CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b)) / greatest(length(a), length(b)) ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END, 6) AS similarity FROM g",
}
