"""Exports as DataFrames of rendered rows, and writers for them. Rendering stays in Spark; each task writes its own files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.documents import turns
from quillspark.operators.review import load
from quillspark.sources.web import SQL as WEB
from quillspark.sources.web import page_blocks


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def merged_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as one Markdown text, blocks in order."""
    mark = F.when(F.col("tag").rlike("^h[1-6]$"), F.concat(F.expr("repeat('#', cast(substring(tag, 2, 1) as int))"), F.lit(" "))).when(F.col("tag") == "li", "- ").when(F.col("tag") == "blockquote", "> ").otherwise("")
    rows = page_blocks(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", F.concat(mark, "text").alias("line")))).alias("b"))
    return rows.select("page_id", F.array_join(F.col("b.line"), "\n\n").alias("markdown"))


def bilingual_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a table with a row for each user turn and its answer."""
    source, target = turns(spark, sf_dir)
    both = source.join(target, (F.col("conv_id") == F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left")
    row = F.concat(F.lit("<tr><td>"), escape(F.coalesce("text", F.lit(""))), F.lit("</td><td>"), escape(F.coalesce("target", F.lit(""))), F.lit("</td></tr>"))
    rows = both.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", row.alias("row")))).alias("r"))
    return rows.select("conv_id", F.concat(F.lit("<table>"), F.array_join(F.col("r.row"), ""), F.lit("</table>")).alias("html"))


def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: documents, characters, and the newest version of an export by (n_chars, doc_id)."""
    rows = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("document_count"), F.sum("n_chars").alias("n_chars"), F.max_by("doc_id", F.struct("n_chars", "doc_id")).alias("largest_doc_id"))
    return rows.select("source", F.to_json(F.struct("document_count", "n_chars", "largest_doc_id")).alias("manifest"))


def merge_last(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows over old's of the same key: an upsert."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def last_by_id(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of rows with the same key the last by order; of those that tie, the one whose other columns are greatest."""
    others = [c for c in rows.columns if c not in (key, *order)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in (*order, *others)]))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def write_texts(rows: DataFrame, key: str, text: str, path: str) -> None:
    """One folder of text files for each key: for chapters of a book, say, not for millions of keys."""
    rows.select(F.col(key), F.col(text).alias("value")).write.partitionBy(key).text(path)


QUERIES = {f.__name__: f for f in (merged_markdown, bilingual_html, export_manifest)}
_ESCAPED = "replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL = {
    "merged_markdown": f"SELECT page_id, string_agg(CASE WHEN regexp_matches(tag, '^h[1-6]$') THEN repeat('#', tag[2:2]::INT) || ' ' WHEN tag = 'li' THEN '- ' WHEN tag = 'blockquote' THEN '> ' ELSE '' END || text, chr(10) || chr(10) ORDER BY ordinal) AS markdown FROM ({WEB['page_blocks']}) GROUP BY page_id",
    "bilingual_html": f"SELECT s.conv_id, '<table>' || string_agg('<tr><td>' || {_ESCAPED.format('s.text')} || '</td><td>' || {_ESCAPED.format('t.text')} || '</td></tr>', '' ORDER BY s.turn) || '</table>' AS html FROM conversations s LEFT JOIN conversations t ON t.role = 'assistant' AND t.conv_id = s.conv_id AND t.turn = s.turn + 1 WHERE s.role = 'user' GROUP BY s.conv_id",
    "export_manifest": "SELECT source, '{\"document_count\":' || count(*) || ',\"n_chars\":' || sum(n_chars)::BIGINT || ',\"largest_doc_id\":' || arg_max(doc_id, row(n_chars, doc_id)) || '}' AS manifest FROM documents GROUP BY source",
}
