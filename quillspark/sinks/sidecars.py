"""Sidecars of parsed documents: their nodes and relations as JSON lines, and a checksum that tells whether a parse changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.documents import BLOCKS, blocks


def node_id(*parts: Column) -> Column:
    """A name for a node that depends on its place and content alone."""
    return F.sha2(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def nodes(rows: DataFrame) -> DataFrame:
    """Documents, pages and blocks of rows (doc_id, page, idx, text) as nodes: doc_id, node, parent (null for documents), kind,
    place, which is 0 for documents. Null texts are empty; rows equal in doc_id, page and idx are one block, that of the least
    text."""
    document = node_id(F.lit("document"), F.col("doc_id"))
    page = node_id(F.lit("page"), F.col("doc_id"), F.col("page"))
    one = rows.groupBy("doc_id", "page", "idx").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    block = node_id(F.lit("block"), F.col("doc_id"), F.col("page"), F.col("idx"), F.col("text"))
    as_node = lambda node, parent, kind, place: F.struct(node.alias("node"), parent.alias("parent"), F.lit(kind).alias("kind"), place.cast("long").alias("place"))
    # a page's first block brings the page's node with it, and the document's first that of the document: no distinct
    first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("page", "idx")) == 1
    found = one.withColumn("opens_page", first(["doc_id", "page"])).withColumn("opens", first(["doc_id"]))
    every = F.array_compact(F.array(
        as_node(block, page, "block", F.col("idx")),
        F.when(F.col("opens_page"), as_node(page, document, "page", F.col("page"))),
        F.when(F.col("opens"), as_node(document, F.lit(None).cast("string"), "document", F.lit(0))),
    ))
    return found.select("doc_id", F.explode(every).alias("n")).select("doc_id", "n.*")


def relations(found: DataFrame) -> DataFrame:
    """How nodes hang together: each with its parent (`holds`), and with the next one of its parent (`precedes`)."""
    holds = found.where("parent is not null").select("doc_id", F.lit("holds").alias("relation"), F.col("parent").alias("source"), F.col("node").alias("target"))
    following = F.lead("node").over(Window.partitionBy("doc_id", "parent").orderBy("place"))
    precedes = found.where("parent is not null").select("doc_id", F.lit("precedes").alias("relation"), F.col("node").alias("source"), following.alias("target"))
    return holds.unionByName(precedes.where("target is not null"))


def checksums(found: DataFrame, parts: int = 64) -> DataFrame:
    """A checksum of each document's nodes, whatever their order: they are hashed in `parts` parts first, so that the nodes of
    no document gather in one task."""
    part = F.pmod(F.conv(F.substring("node", 1, 8), 16, 10).cast("long"), F.lit(parts))
    inner = found.groupBy("doc_id", part.alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), ","), 256).alias("digest"), F.count("*").alias("n"))
    outer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), ",")
    return inner.groupBy("doc_id").agg(F.sum("n").alias("node_count"), F.sha2(outer, 256).alias("checksum"))


def write_sidecar(rows: DataFrame, path: str) -> None:
    """nodes, relations and checksums of rows as JSON lines in three folders below path."""
    found = nodes(rows)
    for name, frame in (("nodes", found), ("relations", relations(found)), ("checksums", checksums(found))):
        frame.write.mode("overwrite").json(f"{path}/{name}")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("doc_id", F.floor(F.col("ordinal") / 10).alias("page"), F.col("ordinal").alias("idx"), F.col("block_text").alias("text"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(_paged(spark, sf_dir))


def node_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(nodes(_paged(spark, sf_dir)))


def parse_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checksums(nodes(_paged(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (document_nodes, node_relations, parse_checksums)}
_NODES = f"""{BLOCKS}, b AS (SELECT doc_id, (ordinal // 10)::BIGINT AS page, ordinal AS idx, sha256(concat_ws('::', 'block', doc_id, ordinal // 10, ordinal, block_text)) AS block, sha256(concat_ws('::', 'page', doc_id, ordinal // 10)) AS p, sha256(concat_ws('::', 'document', doc_id)) AS d FROM blocks),
nodes AS (SELECT doc_id, block AS node, p AS parent, 'block' AS kind, idx::BIGINT AS place FROM b UNION ALL (SELECT DISTINCT doc_id, p, d, 'page', page FROM b) UNION ALL (SELECT DISTINCT doc_id, d, NULL, 'document', 0 FROM b))"""
SQL = {
    "document_nodes": f"WITH {_NODES} SELECT * FROM nodes",
    "node_relations": f"WITH {_NODES}, r AS (SELECT doc_id, 'holds' AS relation, parent AS source, node AS target FROM nodes UNION ALL SELECT doc_id, 'precedes', node, lead(node) OVER (PARTITION BY doc_id, parent ORDER BY place) FROM nodes) SELECT * FROM r WHERE source IS NOT NULL AND target IS NOT NULL",
    "parse_checksums": f"WITH {_NODES}, i AS (SELECT doc_id, ('0x' || node[1:8])::BIGINT % 64 AS part, sha256(string_agg(node, ',' ORDER BY node)) AS digest, count(*) AS n FROM nodes GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS node_count, sha256(string_agg(digest, ',' ORDER BY part)) AS checksum FROM i GROUP BY doc_id",
}
