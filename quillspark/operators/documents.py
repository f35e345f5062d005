"""Document, sentence and alignment operators, and usage rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .review import load


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work runs: a line of an order is a run, its part's residue the model, its price the cost."""
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5).alias("model"), F.col("l_quantity").cast("decimal(18,2)").alias("tokens"), F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"), (F.col("l_linestatus") == "F").alias("succeeded"), F.to_date("l_shipdate").alias("day"), "o_custkey", "o_orderdate")


RUNS = "runs AS (SELECT l_orderkey, l_linenumber, l_partkey % 5 AS model, l_quantity::DECIMAL(18,2) AS tokens, l_extendedprice::DECIMAL(18,2) AS cost, l_linestatus = 'F' AS succeeded, l_shipdate::DATE AS day, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
USAGE = "count(*) AS run_count, count(*) FILTER (succeeded) AS succeeded_count, sum(tokens)::DOUBLE AS tokens, sum(cost)::DOUBLE AS cost"


def usage() -> list:
    return [F.count("*").alias("run_count"), F.count_if("succeeded").alias("succeeded_count"), F.sum("tokens").cast("double").alias("tokens"), F.sum("cost").cast("double").alias("cost")]


def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).agg(*usage()).where("run_count > 0")


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("model").agg(*usage()).orderBy(F.desc("cost"), F.desc("run_count"), "model")


def usage_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupBy("day").agg(*usage()).orderBy(F.desc("day"))


def usage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).groupingSets([[], [F.col("model")], [F.col("succeeded")]], "model", "succeeded").agg(*usage()).select("model", F.col("succeeded"), "run_count", "succeeded_count", "tokens", "cost")


def usage_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = runs(spark, sf_dir).groupBy("model").agg(*usage())
    return by.agg(F.max_by("model", F.struct("cost", "model")).alias("top_cost_model"), F.max_by("model", F.struct("tokens", "model")).alias("top_token_model"), F.max_by("model", F.struct("run_count", "model")).alias("top_volume_model"))


def latest_run_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.o_orderkey", "r.o_orderstatus")


def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 20 customers whose segment holds 'build', newest order first: a paged report."""
    last = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("order_count"), F.max("o_orderdate").alias("latest_at"))
    found = load(spark, sf_dir, "customer").where(F.col("c_mktsegment").ilike("%build%")).join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    found = found.select("c_custkey", "c_name", F.coalesce("order_count", F.lit(0)).alias("order_count"), "latest_at")
    return found.orderBy(F.desc_nulls_last("latest_at"), "c_custkey").offset(20).limit(20)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty lines of documents as blocks, numbered from 0 among all lines."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("ordinal", "block_text"))
    return rows.where("block_text != ''")


BLOCKS = "blocks AS (SELECT doc_id, lang, ordinal::INT AS ordinal, block_text FROM (SELECT doc_id, lang, unnest(range(len(a))) AS ordinal, unnest(a) AS block_text FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)) WHERE block_text != '')"


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.length("block_text") <= 60, "heading").when(F.col("block_text").rlike("^[-*] "), "list_item").otherwise("paragraph")
    return blocks(spark, sf_dir).select("doc_id", "ordinal", kind.alias("block_type"), F.length("block_text").cast("long").alias("n_chars"), F.md5("block_text").alias("digest"))


#: After an end of a sentence, maybe quoted, and a blank, before a capital or an opening mark; Chinese ends need no blank.
SPLIT = r"""([.!?]["'”’)]*)\s+([\p{Lu}¿¡"“«(])"""
CJK = r"([。！？])([^。！？”’])"


def sentences_of(rows: DataFrame, text: str) -> DataFrame:
    """rows with n and sentence for each sentence of a text in any language."""
    marked = F.regexp_replace(F.regexp_replace(text, SPLIT, "$1\u0001$2"), CJK, "$1\u0001$2")
    return rows.select("*", F.posexplode(F.split(marked, "\u0001")).alias("n", "sentence")).where("sentence != ''")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all blocks, in any language."""
    return sentences_of(blocks(spark, sf_dir), "block_text").select("doc_id", "ordinal", "n", "sentence")


_MARKED = f"regexp_replace(regexp_replace(block_text, '{SPLIT.replace(chr(39), chr(39) * 2)}', '\\1' || chr(1) || '\\2', 'g'), '{CJK}', '\\1' || chr(1) || '\\2', 'g')"
SENTENCES = BLOCKS + f", sentences AS (SELECT doc_id, ordinal, n::INT AS n, sentence FROM (SELECT doc_id, ordinal, unnest(range(len(a))) AS n, unnest(a) AS sentence FROM (SELECT doc_id, ordinal, string_split({_MARKED}, chr(1)) AS a FROM blocks)) WHERE sentence != '')"


def segment_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(spark, sf_dir).groupBy("doc_id", "ordinal").agg(F.count("*").alias("sentence_count"), F.max(F.length("sentence")).cast("long").alias("longest"))


def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 32 sentences of a document, in order."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "n")) - 1
    rows = sentences(spark, sf_dir).withColumn("chunk", F.floor(place / 32).cast("long"))
    return rows.groupBy("doc_id", "chunk").agg(F.count("*").alias("sentence_count"), F.sum(F.length("sentence")).alias("n_chars"))


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block with the lengths of the two before and after it."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    size = F.length("block_text").cast("long")
    return blocks(spark, sf_dir).select("doc_id", "ordinal", *[(F.lag(size, k).over(order) if k > 0 else F.lead(size, -k).over(order)).alias(n) for n, k in (("before_2", 2), ("before_1", 1), ("after_1", -1), ("after_2", -2))])


def repeated_edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last blocks whose digit-masked text stands at the same edge of two documents or more."""
    edge = blocks(spark, sf_dir).groupBy("doc_id").agg(F.min_by("block_text", "ordinal").alias("header"), F.max_by("block_text", "ordinal").alias("footer"))
    rows = edge.select("doc_id", F.expr("stack(2, 'header', header, 'footer', footer) as (zone, line)"))
    return rows.groupBy("zone", F.md5(F.regexp_replace("line", "[0-9]+", "#")).alias("signature")).agg(F.count("*").alias("document_count")).where("document_count >= 2")


def exact_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later documents whose text, in lower case with single blanks, equals an earlier one's."""
    # blanks are rarely doubled, so few texts need the pattern
    flat = F.replace(F.replace(F.lower("text"), F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    sign = F.md5(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " {2,}", " ")).otherwise(flat))
    rows = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", sign.alias("signature"))
    first = rows.groupBy("signature").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "signature").where("doc_id != first_doc_id").select("doc_id", "first_doc_id")


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids (version 5, URL namespace) of documents' key parts."""
    name = F.concat_ws("::", F.lit("document"), F.col("doc_id").cast("string"), "source")
    raw = F.substring(F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), name.cast("binary"))), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(raw, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))).cast("long")))
    part = lambda a, n: F.substring(raw, a, n)
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)).alias("stable_id"))


TERMS = (("and", "und"), ("the", "die"), ("is", "est"), ("for", "pour"))
RULES = (("repeated_mark", r"[!?.]{2,}"), ("digits", r"[0-9]+"), ("symbol_word", r"[a-z][#*$%&]+"), ("email", r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+"))


def term_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked terms in blocks, whatever the case, and how often the expected target is there as well."""
    terms = spark.createDataFrame([*TERMS], "term string, target string")
    low = F.lower("block_text")
    rows = blocks(spark, sf_dir).join(F.broadcast(terms), F.contains(low, F.col("term")))
    return rows.groupBy("term", "target").agg(F.count("*").alias("block_count"), F.count_if(F.contains(low, F.col("target"))).alias("with_target"))


def regex_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.array(*[F.when(F.col("block_text").rlike(p), F.lit(n)) for n, p in RULES])
    rows = blocks(spark, sf_dir).select("doc_id", F.explode(F.array_compact(hits)).alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("block_count"), F.count_distinct("doc_id").alias("document_count"))


def turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "conversations")
    return rows.where("role = 'user'"), rows.where("role = 'assistant'").select(F.col("conv_id").alias("t_conv"), (F.col("turn") - 1).alias("t_turn"), F.col("text").alias("target"))


def alignment_omission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns that no answer follows."""
    source, target = turns(spark, sf_dir)
    return source.join(target, (F.col("conv_id") == F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left_anti").select("conv_id", "turn")


def orphan_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that follow no user turn."""
    source, target = turns(spark, sf_dir)
    return target.join(source, (F.col("conv_id") == F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left_anti").select(F.col("t_conv").alias("conv_id"), (F.col("t_turn") + 1).alias("turn"))


def orphaned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose question is gone: every third question is taken away first."""
    source, target = turns(spark, sf_dir)
    left = source.where("(conv_id + turn) % 3 > 0")
    return target.join(left, (F.col("conv_id") == F.col("t_conv")) & (F.col("turn") == F.col("t_turn")), "left_anti").select(F.col("t_conv").alias("conv_id"), (F.col("t_turn") + 1).alias("turn"))


def echoed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that repeat the one before, whatever the case: every third turn is replaced so first."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations")
    rows = rows.withColumn("text", F.when(F.col("turn") % 3 == 2, F.lower(F.lag("text").over(order))).otherwise(F.col("text")))
    return rows.withColumn("before", F.lag(F.lower("text")).over(order)).where((F.length("text") >= 6) & (F.lower("text") == F.col("before"))).select("conv_id", "turn")


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all languages: how many, and their characters."""
    return sentences_of(blocks(spark, sf_dir), "block_text").groupBy("lang").agg(F.count("*").alias("sentence_count"), F.sum(F.length("sentence")).alias("n_chars"), F.max(F.length("sentence")).cast("long").alias("longest"))


def adjacent_duplicate_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose text, of six characters at least, equals the one before in lower case."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    low = F.lower("text")
    rows = load(spark, sf_dir, "conversations").withColumn("before", F.lag(low).over(order))
    return rows.where((F.length("text") >= 6) & (low == F.col("before"))).select("conv_id", "turn")


def target_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns with the same role: where each starts and how long it is."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").withColumn("new", F.when(F.lag("role").over(order).eqNullSafe(F.col("role")), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.count("*").alias("turn_count"), F.min("role").alias("role"))


def unified_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 of events and orders together: a top-k report."""
    events = load(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("happened_at"))
    orders = load(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("happened_at"))
    return events.union(orders).orderBy(F.desc_nulls_last("happened_at"), "kind", "id").limit(20)


def reconcile_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against labels as an older and a newer table: added, gone and kept keys by source."""
    old, new = load(spark, sf_dir, "documents").select("doc_id", "source"), load(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = old.join(new, "doc_id", "full")
    state = F.when(F.col("source").isNull(), "added").when(F.col("quality").isNull(), "gone").otherwise("kept")
    return rows.groupBy("source", state.alias("state")).agg(F.count("*").alias("n"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda p: F.regexp_extract("html", p, 1)
    return load(spark, sf_dir, "pages").select("page_id", get(r"<title>([^<]*)</title>").alias("title"), get(r"<h1>([^<]*)</h1>").alias("heading"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("paragraphs"))


QUERIES = {f.__name__: f for f in (usage_summary, usage_by_model, usage_per_day, usage_grouping_sets, usage_highlights, latest_run_per_document, history_page, paragraph_blocks, segment_sentences, sentence_chunks, neighbour_context, repeated_edge_text, exact_duplicate_documents, stable_ids, term_containment, regex_rules, alignment_omission, orphan_targets, adjacent_duplicate_segments, orphaned_answers, echoed_segments, sentence_counts, target_islands, unified_timeline, reconcile_refresh, page_titles)}

_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(concat_ws('::', 'document', doc_id::VARCHAR, source)))"
SQL = {
    "usage_summary": f"WITH {RUNS} SELECT {USAGE} FROM runs HAVING count(*) > 0",
    "usage_by_model": f"WITH {RUNS} SELECT model, {USAGE} FROM runs GROUP BY model",
    "usage_per_day": f"WITH {RUNS} SELECT day, {USAGE} FROM runs GROUP BY day",
    "usage_grouping_sets": f"WITH {RUNS} SELECT model, succeeded, {USAGE} FROM runs GROUP BY GROUPING SETS ((), (model), (succeeded))",
    "usage_highlights": f"WITH {RUNS}, m AS (SELECT model, {USAGE} FROM runs GROUP BY model) SELECT arg_max(model, row(cost, model)) AS top_cost_model, arg_max(model, row(tokens, model)) AS top_token_model, arg_max(model, row(run_count, model)) AS top_volume_model FROM m",
    "latest_run_per_document": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "history_page": "SELECT c_custkey, c_name, coalesce(order_count, 0) AS order_count, latest_at FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS order_count, max(o_orderdate) AS latest_at FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey WHERE c_mktsegment ILIKE '%build%' ORDER BY latest_at DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 20",
    "paragraph_blocks": f"WITH {BLOCKS} SELECT doc_id, ordinal, CASE WHEN length(block_text) <= 60 THEN 'heading' WHEN regexp_matches(block_text, '^[-*] ') THEN 'list_item' ELSE 'paragraph' END AS block_type, length(block_text)::BIGINT AS n_chars, md5(block_text) AS digest FROM blocks",
    "segment_sentences": f"WITH {SENTENCES} SELECT doc_id, ordinal, count(*) AS sentence_count, max(length(sentence))::BIGINT AS longest FROM sentences GROUP BY ALL",
    "sentence_chunks": f"WITH {SENTENCES}, p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, n) - 1) // 32 AS chunk FROM sentences) SELECT doc_id, chunk, count(*) AS sentence_count, sum(length(sentence))::BIGINT AS n_chars FROM p GROUP BY ALL",
    "neighbour_context": f"WITH {BLOCKS} SELECT doc_id, ordinal, lag(length(block_text), 2) OVER w AS before_2, lag(length(block_text)) OVER w AS before_1, lead(length(block_text)) OVER w AS after_1, lead(length(block_text), 2) OVER w AS after_2 FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal)",
    "repeated_edge_text": f"WITH {BLOCKS}, e AS (SELECT doc_id, arg_min(block_text, ordinal) AS header, arg_max(block_text, ordinal) AS footer FROM blocks GROUP BY doc_id), s AS (SELECT 'header' AS zone, header AS line FROM e UNION ALL SELECT 'footer', footer FROM e) SELECT zone, md5(regexp_replace(line, '[0-9]+', '#', 'g')) AS signature, count(*) AS document_count FROM s GROUP BY ALL HAVING count(*) >= 2",
    "exact_duplicate_documents": "WITH s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(lower(regexp_replace(text, '[ \t\n]+', ' ', 'g')))) AS first_doc_id FROM documents WHERE text IS NOT NULL) SELECT * FROM s WHERE doc_id != first_doc_id",
    "stable_ids": f"WITH r AS (SELECT doc_id, {_SHA} AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab89ab89ab89ab', ('0x' || h[17:17])::INT + 1, 1) || h[18:20] || '-' || h[21:32] AS stable_id FROM r",
    "term_containment": f"WITH {BLOCKS} SELECT term, target, count(*) AS block_count, count(*) FILTER (contains(lower(block_text), target)) AS with_target FROM blocks JOIN (VALUES {', '.join(map(str, TERMS))}) t(term, target) ON contains(lower(block_text), term) GROUP BY ALL",
    "regex_rules": f"WITH {BLOCKS} SELECT rule, count(*) AS block_count, count(DISTINCT doc_id) AS document_count FROM blocks JOIN (VALUES " + ", ".join(f"('{n}', '{p}')" for n, p in RULES) + ") r(rule, pattern) ON regexp_matches(block_text, pattern) GROUP BY rule",
    "alignment_omission": "SELECT conv_id, turn FROM conversations s WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations t WHERE t.role = 'assistant' AND t.conv_id = s.conv_id AND t.turn = s.turn + 1)",
    "orphan_targets": "SELECT conv_id, turn FROM conversations t WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations s WHERE s.role = 'user' AND t.conv_id = s.conv_id AND t.turn = s.turn + 1)",
    "adjacent_duplicate_segments": "SELECT conv_id, turn FROM (SELECT *, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE length(text) >= 6 AND lower(text) = before",
    "orphaned_answers": "SELECT conv_id, turn FROM conversations t WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM conversations s WHERE s.role = 'user' AND t.conv_id = s.conv_id AND t.turn = s.turn + 1 AND (s.conv_id + s.turn) % 3 > 0)",
    "echoed_segments": "WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN lower(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)) ELSE text END AS text FROM conversations) SELECT conv_id, turn FROM (SELECT *, lag(lower(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM e) WHERE length(text) >= 6 AND lower(text) = before",
    "sentence_counts": f"WITH {BLOCKS}, s AS (SELECT lang, unnest(string_split(regexp_replace(regexp_replace(block_text, '{SPLIT.replace(chr(39), chr(39) * 2)}', '\\1' || chr(1) || '\\2', 'g'), '{CJK}', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentence FROM blocks) SELECT lang, count(*) AS sentence_count, sum(length(sentence))::BIGINT AS n_chars, max(length(sentence)) AS longest FROM s WHERE sentence != '' GROUP BY lang",
    "target_islands": "WITH n AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, (sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS island FROM n) SELECT conv_id, island, min(turn) AS first_turn, count(*) AS turn_count, min(role) AS role FROM i GROUP BY conv_id, island",
    "unified_timeline": "SELECT 'event' AS kind, event_id AS id, ts AS happened_at FROM events UNION ALL SELECT 'order', o_orderkey, o_orderdate FROM orders ORDER BY happened_at DESC NULLS LAST, kind, id LIMIT 20",
    "reconcile_refresh": "SELECT source, CASE WHEN d.doc_id IS NULL THEN 'added' WHEN quality IS NULL THEN 'gone' ELSE 'kept' END AS state, count(*) AS n FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
    "page_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading, len(regexp_extract_all(html, '<p[ >]'))::BIGINT AS paragraphs FROM pages",
}
