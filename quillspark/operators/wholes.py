"""All that belongs to a chapter, a document or a packet as one nested row."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.documents import BLOCKS, blocks
from quillspark.operators.review import load


def bundled(key: str, parts: Mapping[str, DataFrame], newest: Mapping[str, list[str]] | None = None, owner: str | None = None) -> DataFrame:
    """A row for each key with an array for each part: the part's rows as structs, ordered by their columns from the left on.
    Of parts in newest only the row with the greatest of the given columns is taken, as a struct (or null).

    The parts (each with the key as a column) lie in one union, tagged by the column that they fill, so one shuffle brings
    together what one join for each part would shuffle again and again. Keys that owner alone has have empty arrays; with
    owner, keys that it hasn't are left out, as an inner lookup does. Null keys are left out.
    """
    newest = newest or {}
    shape = {name: F.struct(*[F.col(c) for c in df.columns if c != key]) for name, df in parts.items()}
    kinds = {name: df.select(shape[name].alias("x")).schema["x"].dataType for name, df in parts.items()}
    place = lambda name: lambda n: shape[name].alias(n) if n == name else F.lit(None).cast(kinds[n]).alias(n)
    tagged = [df.where(F.col(key).isNotNull()).select(key, *map(place(name), parts)) for name, df in parts.items()]
    every = reduce(DataFrame.union, tagged)

    def gathered(name: str) -> Column:
        if name in newest:
            return F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{c}") for c in newest[name]])))
        return F.array_sort(F.collect_list(name))

    found = every.groupBy(key).agg(*[gathered(name).alias(name) for name in parts])
    if owner is None:
        return found
    return found.where(F.col(owner).isNotNull() if owner in newest else F.size(owner) > 0)


def as_json(bundles: DataFrame, key: str) -> DataFrame:
    """The key and the whole row as a JSON text (a dump for people; null fields are left out)."""
    return bundles.select(key, F.to_json(F.struct(*bundles.columns)).alias("bundle"))


def listed(items: str, *fields: str) -> Column:
    """Items as text, for comparison: fields by blanks, items by commas."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(" ", *[x[f].cast("string") for f in fields])), ",")


def chapter_wholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters, with their blocks, the turns of the conversation and the page of the same number, labels, and
    the events of the user of the same number: all of them as an audit, the newest as the state."""
    events = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), "event_id", "ts", "event_type")
    found = bundled(
        "doc_id",
        {
            "chapter": load(spark, sf_dir, "documents").select("doc_id", "source", "lang"),
            "blocks": blocks(spark, sf_dir).select("doc_id", "ordinal", F.md5("block_text").alias("digest")),
            "targets": load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", F.length("text").alias("n_chars")),
            "pages": load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url"),
            "labels": load(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"),
            "audit": events.select("doc_id", "event_id", "event_type"),
            "state": events,
        },
        {"chapter": ["source"], "state": ["ts", "event_id"]},
        "chapter",
    )
    return found.select("doc_id", "chapter.source", "chapter.lang", listed("blocks", "ordinal", "digest").alias("blocks"), listed("targets", "turn", "role", "n_chars").alias("targets"), listed("pages", "url").alias("pages"), listed("labels", "quality", "toxic").alias("labels"), F.size("audit").alias("audit_count"), F.md5(listed("audit", "event_id", "event_type")).alias("audit_md5"), F.col("state.event_type").alias("state"))


def packet_wholes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packets, with their lines as the map of sentences, in order."""
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("packet_id"), "o_orderstatus", "o_custkey")
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("packet_id"), "l_linenumber", "l_partkey", "l_linestatus")
    found = bundled("packet_id", {"packet": orders, "sentences": lines}, {"packet": ["o_custkey"]}, "packet")
    return found.select("packet_id", "packet.o_orderstatus", F.size("sentences").alias("sentence_count"), listed("sentences", "l_linenumber", "l_partkey", "l_linestatus").alias("sentences"))


QUERIES = {f.__name__: f for f in (chapter_wholes, packet_wholes)}
SQL = {
    "chapter_wholes": f"""WITH {BLOCKS}, b AS (SELECT doc_id, string_agg(ordinal || ' ' || md5(block_text), ',' ORDER BY ordinal) AS blocks FROM blocks GROUP BY doc_id),
t AS (SELECT conv_id, string_agg(concat_ws(' ', turn, role, length(text)), ',' ORDER BY turn, role NULLS LAST, length(text)) AS targets FROM conversations GROUP BY conv_id), p AS (SELECT page_id, string_agg(url, ',' ORDER BY url) AS pages FROM pages GROUP BY page_id), l AS (SELECT doc_id, string_agg(concat_ws(' ', quality, toxic), ',' ORDER BY quality, toxic) AS labels FROM labels GROUP BY doc_id),
a AS (SELECT user_id, count(*) AS n, string_agg(event_id || ' ' || event_type, ',' ORDER BY event_id, event_type) AS audit, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY user_id)
SELECT d.doc_id, source, lang, coalesce(blocks, '') AS blocks, coalesce(targets, '') AS targets, coalesce(pages, '') AS pages, coalesce(labels, '') AS labels, coalesce(n, 0) AS audit_count, md5(coalesce(audit, '')) AS audit_md5, state
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN t ON t.conv_id = d.doc_id LEFT JOIN p ON p.page_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN a ON a.user_id = d.doc_id""",
    "packet_wholes": "SELECT o_orderkey AS packet_id, o_orderstatus, count(l_orderkey) AS sentence_count, coalesce(string_agg(l_linenumber || ' ' || l_partkey || ' ' || l_linestatus, ',' ORDER BY l_linenumber, l_partkey, l_linestatus) FILTER (l_orderkey IS NOT NULL), '') AS sentences FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
}
