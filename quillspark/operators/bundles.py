"""Joins that bring together what belongs to a chapter, a document or a suggestion, and picks among them.

Each operator takes DataFrames and parameters; the queries below feed them from the given tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.documents import BLOCKS, RUNS, blocks, runs
from quillspark.operators.review import ISSUES, issues, load
from quillspark.operators.layout import ordered_texts
from quillspark.sources.web import _BLOCKS as PAGE_BLOCKS
from quillspark.sources.web import html_blocks


def run_chain(runs: DataFrame, packets: DataFrame, chapters: DataFrame) -> DataFrame:
    """Runs (run_id, packet_id, ..) with their packets' (packet_id, chapter_id) chapters (chapter_id, ..)."""
    return runs.join(packets, "packet_id").join(chapters, "chapter_id")


def aligned(sentences: DataFrame, edges: DataFrame, segments: DataFrame, work: DataFrame) -> DataFrame:
    """sentences (sentence_id) over edges (sentence_id, segment_id) to segments (segment_id, run_id) and their runs (run_id):
    each pair once."""
    return sentences.join(edges.dropDuplicates(["sentence_id", "segment_id"]), "sentence_id").join(segments, "segment_id").join(work, "run_id")


def with_counts(rows: DataFrame, key: str, tables: dict[str, DataFrame]) -> DataFrame:
    """rows with, for each {name: table}, how many rows of the table have the same key, 0 where there are none. Each table is
    counted before it is joined."""
    for name, table in tables.items():
        rows = rows.join(table.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    return rows.fillna(0, [*tables])


def edges_of(suggestions: DataFrame) -> DataFrame:
    """Each source of a suggestion (suggestion_id, sources, targets) with each of its targets."""
    return suggestions.select("suggestion_id", "targets", F.explode("sources").alias("source_id")).select("suggestion_id", "source_id", F.explode("targets").alias("target_id"))


def first_edges(edges: DataFrame, order: str) -> DataFrame:
    """Of edges (source_id, target_id, ..) with the same ends the first in the given order."""
    return edges.withColumn("place", F.row_number().over(Window.partitionBy("source_id", "target_id").orderBy(order))).where("place = 1").drop("place")


def remapped(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """rows with the ids that names (anchor, new_id) has for the anchors in column; anchors without one are kept as null."""
    return rows.join(names.select(F.col("anchor").alias(column), F.col("new_id").alias(f"{column}_id")), column, "left")


def page_of(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows with total, how many rows there are, and has_more, whether some follow it: a paged report."""
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def review_packages(sentences: DataFrame, found: DataFrame) -> DataFrame:
    """For each chapter the JSON of its sentences (chapter_id, n, source, target), in order, and of its issues
    (chapter_id, issue_id, issue_type)."""
    said = sentences.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("n", "source", "target"))).alias("sentences"))
    held = found.groupBy("chapter_id").agg(F.array_sort(F.collect_list(F.struct("issue_id", "issue_type"))).alias("issues"))
    rows = said.join(held, "chapter_id", "left")
    return rows.select("chapter_id", F.to_json(F.struct("chapter_id", "sentences", F.coalesce("issues", F.array().cast("array<struct<issue_id:bigint,issue_type:string>>")).alias("issues"))).alias("package"))


def with_lists(rows: DataFrame) -> DataFrame:
    """For each tag the sums of its rows (tag, member, n, long_count; each member once), how many members it has, and the
    md5 of their list in order, with commas between; null where there are none. Null members are in the sums alone.

    Ranges of members are sorted and joined side by side. The md5 of a list needs it in order, so what they give is
    hashed as a stream: a task holds a batch, not a list.
    """
    columns = ["tag", "first", "part", "n", "page_count", "long_count"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = groupby(zip(*(batch[c].to_pylist() for c in ("tag", "member", "n", "long_count")), strict=True), itemgetter(0))
            out = []
            for tag, own in groups:
                _, members, n, long = zip(*own, strict=True)
                held = [m for m in members if m is not None]
                out.append((tag, held[0] if held else None, ",".join(held) if held else None, sum(n), len(held), sum(long)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, [pa.string()] * 3 + [pa.int64()] * 3, strict=True)], columns)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in columns), strict=True))
        for tag, own in groupby(each, itemgetter(0)):
            digest, sums = hashlib.md5(usedforsecurity=False), [0, 0, 0]
            for _, _, part, *more in own:
                if part is not None:
                    digest.update((("," if sums[1] else "") + part).encode())
                sums = [a + b for a, b in zip(sums, more, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (tag, *sums)] + [pa.array([digest.hexdigest() if sums[1] else None], pa.string())], ["tag", "n", "page_count", "long_count", "pages"])

    joined = rows.repartitionByRange("tag", "member").sortWithinPartitions("tag", "member").mapInArrow(parts, "tag string, first string, part string, n long, page_count long, long_count long")
    return joined.repartition("tag").sortWithinPartitions("tag", "first").mapInArrow(hashed, "tag string, n long, page_count long, long_count long, pages string")


def merged_html(rows: DataFrame) -> DataFrame:
    """For each document one page of HTML with a table of contents, from rows (doc_id, n, title, body) of its chapters."""
    safe = lambda x: F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = rows.select("doc_id", "n", F.concat(F.lit('<li><a href="#c'), F.col("n"), F.lit('">'), safe(F.col("title")), F.lit("</a></li>")).alias("entry"), F.concat(F.lit('<section id="c'), F.col("n"), F.lit('"><h2>'), safe(F.col("title")), F.lit("</h2><p>"), safe(F.col("body")), F.lit("</p></section>")).alias("section"))
    return parts.groupBy("doc_id").agg(F.concat(F.lit("<nav><ol>"), ordered_texts("n", "entry", ""), F.lit("</ol></nav>"), ordered_texts("n", "section", "")).alias("html"))


def open_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and whether they have an open blocking issue: what stands in an IN list is a semi join."""
    rows = issues(spark, sf_dir)
    held = rows.where("status = 'open' and blocking").select("chapter_id").distinct().withColumn("open", F.lit(True))
    return rows.select("chapter_id").distinct().join(held, "chapter_id", "left").select("chapter_id", F.coalesce("open", F.lit(False)).alias("has_open_blocking"))


def scoped_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers that had an error."""
    ids = load(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("o_custkey"))
    return load(spark, sf_dir, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


def runs_by_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a market: lines are runs, orders packets, customers chapters."""
    rows = run_chain(runs(spark, sf_dir).select(F.col("l_orderkey").alias("packet_id"), "cost"), load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("packet_id"), F.col("o_custkey").alias("chapter_id")), load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chapter_id"), "c_mktsegment"))
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("run_count"), F.sum("cost").cast("double").alias("cost"))


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the answers behind them and the events that stand for their runs."""
    rows = load(spark, sf_dir, "conversations")
    key = lambda shift: (F.col("conv_id") * 1000 + F.col("turn") + shift)
    ask, answer = rows.where("role = 'user'"), rows.where("role = 'assistant'")
    edges = answer.select(key(-1).alias("sentence_id"), key(0).alias("segment_id"))
    work = load(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), "event_type")
    found = aligned(ask.select(key(0).alias("sentence_id"), F.length("text").alias("source_size")), edges.union(edges), answer.select(key(0).alias("segment_id"), F.col("conv_id").alias("run_id"), F.length("text").alias("target_size")), work)
    return found.select("sentence_id", "segment_id", "run_id", "event_type", "source_size", "target_size")


def document_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with how many orders, errors and purchases they have."""
    event = lambda kind: load(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("c_custkey"))
    return with_counts(load(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", {"orders": load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "errors": event("error"), "purchases": event("purchase")})


def suggestion_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the questions and the answers of each group of four turns; repeated ones go."""
    part = F.floor(F.col("turn") / 4)
    rows = load(spark, sf_dir, "conversations").groupBy((F.col("conv_id") * 100 + part).cast("long").alias("suggestion_id"))
    ids = lambda role: F.array_compact(F.collect_list(F.when(F.col("role") == role, F.col("conv_id") * 1000 + F.col("turn"))))
    found = edges_of(rows.agg(ids("user").alias("sources"), ids("assistant").alias("targets")))
    return first_edges(found.union(found), "suggestion_id")


def remapped_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short blocks as captions that name the block before them by its anchor, with that block's id if it is a long one."""
    rows = blocks(spark, sf_dir)
    anchor = lambda n: F.concat_ws("#", F.col("doc_id"), n)
    names = rows.where("length(block_text) > 60").select(anchor(F.col("ordinal")).alias("anchor"), (F.col("doc_id") * 100000 + F.col("ordinal")).alias("new_id"))
    captions = rows.where("length(block_text) <= 60").select("doc_id", "ordinal", anchor(F.col("ordinal") - 1).alias("target"))
    return remapped(captions, names, "target").select("doc_id", "ordinal", "target_id")


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages by the source of the document with the page's number; pages without one are unassigned."""
    links = F.size(F.regexp_extract_all("html", F.lit("(<a )"), F.lit(1)))
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), links.alias("links"))
    named = load(spark, sf_dir, "documents").select("doc_id", "source")
    rows = rows.join(named, "doc_id", "left").groupBy(F.coalesce("source", F.lit("unassigned")).alias("chapter"))
    return rows.agg(F.count("*").alias("page_count"), F.sum("links").alias("links"))


def block_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each kind of block on pages: how many, on how many pages and which (as the hash of their list), and how many are
    long."""
    rows = html_blocks(load(spark, sf_dir, "pages")).groupBy("tag", F.col("page_id").cast("string").alias("member"))
    return with_lists(rows.agg(F.count("*").alias("n"), F.count_if(F.length("text") > 40).alias("long_count"))).select("tag", "n", "page_count", "pages", "long_count")


def usage_by_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type and by the remainder of the number in their properties, which stands for the worker."""
    worker = F.get_json_object("props", "$.k").try_cast("int") % 3
    rows = load(spark, sf_dir, "events").groupBy("event_type", worker.alias("worker"))
    return rows.agg(F.count("*").alias("run_count"), F.round(F.sum(F.col("value").cast("decimal(18,4)")).cast("double"), 4).alias("cost")).orderBy(F.desc("cost"), F.desc("run_count"), "event_type", "worker")


def approximate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type of event, whether sketches of its users and of its values' median come near the exact ones."""
    rows = load(spark, sf_dir, "events").groupBy("event_type")
    found = rows.agg(F.count_distinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("sketched"), F.percentile("value", 0.5).alias("middle"), F.approx_percentile("value", 0.5, 10000).alias("near"))
    return found.select("event_type", "users", (F.abs(F.col("sketched") - F.col("users")) <= F.col("users") * 0.1 + 1).alias("count_is_near"), (F.abs(F.col("near") - F.col("middle")) <= F.abs("middle") * 0.1 + 1).alias("median_is_near"))


def event_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "ts")
    return page_of(rows, [F.desc("ts"), F.desc("event_id")], 40, 20).select("event_id", "total", "has_more")


def chapter_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapters with most open, most blocking and most resolved issues; none where there is no such issue."""
    rows = issues(spark, sf_dir).groupBy("chapter_id").agg(F.count_if(F.col("status") == "open").alias("open"), F.count_if("blocking").alias("blocking"), F.count_if(F.col("status") == "resolved").alias("resolved"))
    top = lambda c: F.max_by(F.when(F.col(c) > 0, F.col("chapter_id")), F.struct(F.col(c), -F.col("chapter_id"))).alias(f"top_{c}")
    return rows.agg(top("open"), top("blocking"), top("resolved"))


def selected_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each owner the chapter with the least penalty, among those with an open issue: its parts decide in turn."""
    rows = issues(spark, sf_dir).groupBy("owner_id", "chapter_id").agg(F.count_if(F.col("status") == "open").alias("open"), F.count_if("blocking").alias("blocking"), F.count("*").alias("n"))
    penalty = F.struct(F.when(F.col("blocking") > 0, 1).otherwise(0).alias("a"), F.abs(F.col("n") - 30).alias("b"), (-F.col("open")).alias("c"), "chapter_id")
    return rows.where("open > 0").groupBy("owner_id").agg(F.min_by("chapter_id", penalty).alias("chapter_id"))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates, from 0 to 100: many blocks and long ones help, headings without text between them don't."""
    rows = blocks(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.length("block_text") <= 60).alias("short"), F.max(F.length("block_text")).alias("longest"))
    score = 40 + F.least(F.lit(30), F.col("n")) + F.when(F.col("longest") > 400, 30).otherwise(0) - 10 * F.col("short")
    return rows.select("doc_id", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long").alias("score"))


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of a user's events in the order in which they came first."""
    rows = load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return rows.groupBy("user_id").agg(ordered_texts("first", "event_type", ",").alias("kinds"))


def chapter_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of chapters: headings of pages first, then titles, each page and text once, and none on special pages."""
    rows = load(spark, sf_dir, "pages")
    get = lambda p, n: rows.select("page_id", F.lower(F.regexp_extract("html", p, 1)).alias("title"), F.lit(n).alias("rank"))
    both = get("<h1>([^<]*)</h1>", 1).union(get("<title>([^<]*)</title>", 2)).where("title != ''")
    kept = both.groupBy("page_id", "title").agg(F.min("rank").alias("rank"))
    special = rows.where("url like '%page=%'").select("page_id")
    return kept.join(special, "page_id", "left_anti").select("page_id", F.md5("title").alias("title"), "rank")


def open_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose last turn asks, or that hold a turn with a question mark that no answer follows; those of one turn
    are exempt."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w))
    asks = (F.col("role") == "user") & ~F.coalesce(F.col("next_role") == "assistant", F.lit(False))
    found = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(asks).alias("open_count"))
    return found.where("turns > 1").select("conv_id", "open_count", F.when(F.col("open_count") > 0, "CONTEXT_FAILURE").alias("issue"))


def concept_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a conversation's turns, of eight letters at least, said in two turns or more: a concept without a lock if no
    title of a page has it; a brief is stale if its first turn lacks it though three turns or more went by."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{8,})"), F.lit(1)))).alias("term")
    rows = load(spark, sf_dir, "conversations").where("text is not null")
    turns = rows.groupBy("conv_id").agg(F.count("*").alias("turns"))
    said = rows.select("conv_id", "turn", word).groupBy("conv_id", "term").agg(F.count("*").alias("seen"), F.min("turn").alias("first")).where("seen >= 2")
    locked = load(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all(F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("([a-z]{8,})"), F.lit(1))).alias("term")).distinct().withColumn("locked", F.lit(True))
    found = said.join(locked, "term", "left").join(turns, "conv_id")
    return found.select("conv_id", "term", "seen", F.col("locked").isNull().alias("unlocked"), ((F.col("first") > 0) & (F.col("turns") >= 3)).alias("stale_brief"))


def chapter_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of conversations: questions with their answers, and the issues of the chapter with the same number."""
    rows = load(spark, sf_dir, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    said = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source")).join(answers, ["conv_id", "turn"])
    found = issues(spark, sf_dir).select("chapter_id", "issue_id", "issue_type")
    made = review_packages(said.select(F.col("conv_id").alias("chapter_id"), F.col("turn").alias("n"), "source", "target"), found)
    read = F.from_json("package", "sentences array<struct<n: bigint, source: string, target: string>>, issues array<struct<issue_id: bigint, issue_type: string>>").alias("p")
    size = lambda c: F.size(f"p.{c}").cast("long")
    return made.select("chapter_id", read).select("chapter_id", size("sentences").alias("sentence_count"), size("issues").alias("issue_count"), F.md5(F.array_join(F.transform("p.sentences", lambda s: F.concat_ws("|", s["n"], s["source"], s["target"])), "/")).alias("sentences"), F.array_join(F.transform("p.issues", lambda i: i["issue_id"].cast("string")), ",").alias("issues"))


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one page of HTML: blocks of up to 60 characters are titles, with the length of the block behind them."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    rows = blocks(spark, sf_dir).withColumn("body", F.lead("block_text").over(w)).where("length(block_text) <= 60")
    return merged_html(rows.select("doc_id", F.col("ordinal").alias("n"), F.col("block_text").alias("title"), "body")).select("doc_id", F.length("html").cast("long").alias("size"), F.md5("html").alias("html"))


QUERIES = {f.__name__: f for f in (open_blocking, scoped_orders, runs_by_chapter, aligned_rows, document_history, suggestion_edges, remapped_captions, chapter_pages, block_summary, usage_by_worker, approximate_counts, event_page, chapter_highlights, selected_chapters, scored_documents, ordered_distinct, chapter_starts, open_questions, concept_issues, chapter_packages, merged_pages)}

_safe = lambda x: f"replace(replace(replace(coalesce({x}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL = {
    "open_blocking": f"WITH {ISSUES} SELECT chapter_id, bool_or(status = 'open' AND blocking) AS has_open_blocking FROM issues GROUP BY chapter_id",
    "scoped_orders": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'error')",
    "runs_by_chapter": f"WITH {RUNS} SELECT c_mktsegment, count(*) AS run_count, sum(cost)::DOUBLE AS cost FROM runs JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "aligned_rows": "SELECT s.conv_id * 1000 + s.turn AS sentence_id, t.conv_id * 1000 + t.turn AS segment_id, event_id AS run_id, event_type, length(s.text) AS source_size, length(t.text) AS target_size FROM conversations s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn = s.turn + 1 AND t.role = 'assistant' JOIN events ON event_id = s.conv_id WHERE s.role = 'user'",
    "document_history": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'error') AS errors, (SELECT count(*) FROM events WHERE user_id = c_custkey AND event_type = 'purchase') AS purchases FROM customer",
    "suggestion_edges": "SELECT s.conv_id * 100 + s.turn // 4 AS suggestion_id, s.conv_id * 1000 + s.turn AS source_id, t.conv_id * 1000 + t.turn AS target_id FROM conversations s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn // 4 = s.turn // 4 AND t.role = 'assistant' WHERE s.role = 'user'",
    "remapped_captions": f"WITH {BLOCKS} SELECT c.doc_id, c.ordinal, CASE WHEN b.doc_id IS NOT NULL THEN b.doc_id * 100000 + b.ordinal END AS target_id FROM blocks c LEFT JOIN blocks b ON b.doc_id = c.doc_id AND b.ordinal = c.ordinal - 1 AND length(b.block_text) > 60 WHERE length(c.block_text) <= 60",
    "chapter_pages": "SELECT coalesce(source, 'unassigned') AS chapter, count(*) AS page_count, sum(len(regexp_extract_all(html, '<a ')))::BIGINT AS links FROM pages LEFT JOIN documents ON page_id = doc_id GROUP BY 1",
    "block_summary": f"WITH {PAGE_BLOCKS} SELECT tag, count(*) AS n, count(DISTINCT page_id) AS page_count, md5(string_agg(DISTINCT page_id::VARCHAR, ',' ORDER BY page_id::VARCHAR)) AS pages, count(*) FILTER (length(text) > 40) AS long_count FROM blocks GROUP BY tag",
    "usage_by_worker": "SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) % 3 AS worker, count(*) AS run_count, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS cost FROM events GROUP BY ALL",
    "approximate_counts": "SELECT event_type, count(DISTINCT user_id) AS users, true AS count_is_near, true AS median_is_near FROM events GROUP BY 1",
    "event_page": "SELECT event_id, count(*) OVER () AS total, 60 < count(*) OVER () AS has_more FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40",
    "chapter_highlights": f"WITH {ISSUES}, c AS (SELECT chapter_id, count(*) FILTER (status = 'open') AS o, count(*) FILTER (blocking) AS b, count(*) FILTER (status = 'resolved') AS r FROM issues GROUP BY 1) SELECT (SELECT chapter_id FROM c WHERE o > 0 ORDER BY o DESC, chapter_id LIMIT 1) AS top_open, (SELECT chapter_id FROM c WHERE b > 0 ORDER BY b DESC, chapter_id LIMIT 1) AS top_blocking, (SELECT chapter_id FROM c WHERE r > 0 ORDER BY r DESC, chapter_id LIMIT 1) AS top_resolved",
    "selected_chapters": f"WITH {ISSUES}, c AS (SELECT owner_id, chapter_id, count(*) FILTER (status = 'open') AS o, count(*) FILTER (blocking) AS b, count(*) AS n FROM issues GROUP BY ALL) SELECT owner_id, chapter_id FROM c WHERE o > 0 QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY b > 0, abs(n - 30), -o, chapter_id) = 1",
    "scored_documents": f"WITH {BLOCKS} SELECT doc_id, greatest(0, least(100, 40 + least(30, count(*)) + CASE WHEN max(length(block_text)) > 400 THEN 30 ELSE 0 END - 10 * count(*) FILTER (length(block_text) <= 60))) AS score FROM blocks GROUP BY doc_id",
    "ordered_distinct": "WITH f AS (SELECT user_id, event_type, min(row(ts, event_id)) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM f GROUP BY 1",
    "chapter_starts": "WITH c AS (SELECT page_id, url, lower(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS title, 1 AS rank FROM pages UNION ALL SELECT page_id, url, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), 2 FROM pages) SELECT page_id, md5(title) AS title, min(rank) AS rank FROM c WHERE title != '' AND url NOT LIKE '%page=%' GROUP BY page_id, title",
    "open_questions": "WITH n AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) SELECT conv_id, count(*) FILTER (role = 'user' AND after IS DISTINCT FROM 'assistant') AS open_count, CASE WHEN open_count > 0 THEN 'CONTEXT_FAILURE' END AS issue FROM n GROUP BY conv_id HAVING count(*) > 1",
    "concept_issues": """WITH w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}'))) AS term FROM conversations), s AS (SELECT conv_id, term, count(*) AS seen, min(turn) AS first FROM w GROUP BY ALL HAVING count(*) >= 2), l AS (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z]{8,}')) AS term FROM pages), t AS (SELECT conv_id, count(*) AS turns FROM conversations WHERE text IS NOT NULL GROUP BY 1)
SELECT conv_id, term, seen, term NOT IN (SELECT term FROM l) AS unlocked, first > 0 AND turns >= 3 AS stale_brief FROM s JOIN t USING (conv_id)""",
    "chapter_packages": f"""WITH {ISSUES}, p AS (SELECT s.conv_id, s.turn, concat_ws('|', s.turn, s.text, t.text) AS x FROM conversations s JOIN conversations t ON t.conv_id = s.conv_id AND t.turn = s.turn + 1 AND t.role = 'assistant' WHERE s.role = 'user'), g AS (SELECT conv_id AS chapter_id, count(*) AS sentence_count, md5(string_agg(x, '/' ORDER BY turn)) AS sentences FROM p GROUP BY 1), i AS (SELECT chapter_id, count(*) AS n, string_agg(issue_id::VARCHAR, ',' ORDER BY issue_id) AS ids FROM issues GROUP BY 1)
SELECT chapter_id, sentence_count, coalesce(n, 0) AS issue_count, sentences, coalesce(ids, '') AS issues FROM g LEFT JOIN i USING (chapter_id)""",
    "merged_pages": f"""WITH {BLOCKS}, n AS (SELECT doc_id, ordinal, block_text AS title, lead(block_text) OVER (PARTITION BY doc_id ORDER BY ordinal) AS body FROM blocks), h AS (SELECT doc_id, '<nav><ol>' || string_agg('<li><a href="#c' || ordinal || '">' || {_safe('title')} || '</a></li>', '' ORDER BY ordinal) || '</ol></nav>' || string_agg('<section id="c' || ordinal || '"><h2>' || {_safe('title')} || '</h2><p>' || {_safe('body')} || '</p></section>', '' ORDER BY ordinal) AS html FROM n WHERE length(title) <= 60 GROUP BY doc_id)
SELECT doc_id, length(html) AS size, md5(html) AS html FROM h""",
}
