"""Operators over work that goes on: edges built again, actions to follow up, owners, states of exports, reports of patches,
titles in the target language, visible chapters, advisory layout risks and rebuilt packets.

Each operator takes DataFrames and parameters; the queries below make such tables of the given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.decisions import ROUTES, route_name
from quillspark.operators.documents import BLOCKS, blocks
from quillspark.operators.review import ACTIVE, ISSUES, issues, load

# They decide results.
FOLLOWED = ("TERM_CONFLICT", "UNLOCKED_KEY_CONCEPT", "STYLE_DRIFT")
SURE, LEAST_PAGES, LEAST_ANCHORED = 0.82, 4, 3
EDGES = "array<struct<sentence_id: bigint, segment_id: bigint>>"


def realigned(edges: DataFrame, runs: DataFrame) -> DataFrame:
    """edges (packet_id, sentence_id, segment_id) with those of each packet in place that its latest run of runs (packet_id,
    run_id, output) gives as a JSON array of edges. A run whose output gives no whole edge changes nothing; an edge that it
    gives twice stands once."""
    last = runs.groupBy("packet_id").agg(F.max_by("output", "run_id").alias("output"))
    new = last.select("packet_id", F.explode(F.from_json("output", EDGES)).alias("e")).select("packet_id", "e.sentence_id", "e.segment_id")
    new = new.where("sentence_id is not null and segment_id is not null").distinct()
    return edges.join(new.select("packet_id").distinct(), "packet_id", "left_anti").select("packet_id", "sentence_id", "segment_id").unionByName(new)


def followups(found: DataFrame, attempted: DataFrame) -> DataFrame:
    """Of each packet in found (action_id, packet_id, issue_type, blocking) the action to take next: blocking ones first, then
    by type, then by id; only types that are followed, none that attempted (action_id) holds. With it how many issues the
    packet has, and how many of them are no style drift."""
    counts = found.groupBy("packet_id").agg(F.count("*").alias("issue_count"), F.count_if(F.col("issue_type") != FOLLOWED[-1]).alias("other_count"))
    kind = F.array_position(F.array(*[F.lit(x) for x in FOLLOWED]), F.col("issue_type"))
    open_ = found.where(F.col("issue_type").isin(*FOLLOWED)).join(attempted.select("action_id"), "action_id", "left_anti")
    first = open_.groupBy("packet_id").agg(F.min_by("action_id", F.struct(~F.col("blocking"), kind, "action_id")).alias("action_id"))
    return first.join(counts, "packet_id").select("packet_id", "action_id", "issue_count", "other_count")


def assigned(changes: DataFrame) -> DataFrame:
    """Who owns each chapter after changes (chapter_id, owner, at, change_id), of which one without an owner clears it: the
    owner, since when (the first change of the last run of that owner), and how many changes there were."""
    w = Window.partitionBy("chapter_id").orderBy("at", "change_id")
    begins = F.when(F.lag("owner").over(w).eqNullSafe(F.col("owner")) & (F.row_number().over(w) > 1), None).otherwise(F.col("at"))
    found = changes.withColumn("begins", begins).groupBy("chapter_id").agg(F.max_by("owner", F.struct("at", "change_id")).alias("owner"), F.max("begins").alias("since"), F.count("*").alias("changes"))
    return found.where("owner is not null")


def export_states(chapters: DataFrame, exports: DataFrame) -> DataFrame:
    """State of each document in chapters (doc_id, chapter_id) after exports (chapter_id; repeated rows count once): exported,
    partially_exported or active, with its counts."""
    done = exports.select("chapter_id").distinct().withColumn("done", F.lit(True))
    rows = chapters.join(done, "chapter_id", "left").groupBy("doc_id").agg(F.count("*").alias("chapter_count"), F.count("done").alias("exported_count"))
    state = F.when(F.col("exported_count") == F.col("chapter_count"), "exported").when(F.col("exported_count") > 0, "partially_exported").otherwise("active")
    return rows.withColumn("state", state)


def validated(proposals: DataFrame) -> DataFrame:
    """proposals (proposal_id, passed, report: map) with their state, and the report with `passed` and `canary_verdict`, if it
    doesn't tell them itself. A null report is empty, and a proposal that isn't known to have passed is rejected."""
    passed = F.coalesce(F.col("passed"), F.lit(False))
    told = F.create_map(F.lit("passed"), passed.cast("string"), F.lit("canary_verdict"), F.when(passed, "passed").otherwise("failed"))
    report = F.coalesce(F.col("report"), F.create_map().cast("map<string,string>"))
    return proposals.select("proposal_id", F.when(passed, "validated").otherwise("rejected").alias("state"), T.merged_map(told, report).alias("report"))


def target_titles(titles: DataFrame, headings: DataFrame, chapters: int = 2, longest: int = 60) -> DataFrame:
    """Titles in the target language: of titles (doc_id, title, subtitle) the first heading of headings (doc_id, chapter, idx,
    source, target) in the first chapters whose source is the title whatever the case, and likewise the subtitle, in one. A
    target that reads like prose, over `longest` characters or with the end of a sentence, is passed over."""
    clean = lambda c: T.single_spaced(F.col(c))
    target = clean("target")
    good = headings.where(F.col("chapter") < chapters).where((target != "") & (F.length(target) <= longest) & ~target.rlike("[.!?。！？]$"))
    found = titles.select("doc_id", F.lower(clean("title")).alias("title"), F.lower(clean("subtitle")).alias("subtitle")).where("title != ''")
    rows = found.join(good.select("doc_id", "chapter", "idx", F.lower(clean("source")).alias("source"), target.alias("target")).where("source != ''"), "doc_id")
    is_title = F.col("source") == F.col("title")
    first = lambda hit: F.min_by(F.when(hit, F.col("target")), F.when(hit, F.struct("chapter", "idx")))
    both = rows.groupBy("doc_id").agg(first(is_title).alias("title"), first(~is_title & (F.col("source") == F.col("subtitle"))).alias("subtitle"))
    return both.where("title is not null").select("doc_id", T.composed_title(F.col("title"), F.col("subtitle"), "：").alias("title"))


def visible_chapters(rows: DataFrame) -> DataFrame:
    """Chapters of rows (doc_id, idx, signature, number, is_appendix, is_front) as readers see them. A chapter whose signature
    came before goes; null signatures are all kept. The others form groups: one begins with the first chapter, with an
    appendix, with front matter before chapter 1, and with a number above all those since the sequence began; the sequence
    begins with number 1, or with the first chapter if that has a number. Returns doc_id, first_idx, last_idx, parts."""
    seen = Window.partitionBy("doc_id", "signature").orderBy("idx")
    kept = rows.withColumn("copy", F.row_number().over(seen)).where("copy = 1 or signature is null")
    w = Window.partitionBy("doc_id").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("is_first", F.row_number().over(w) == 1)
    opens = (F.col("number") == 1) | (F.col("is_first") & F.col("number").isNotNull())
    kept = kept.withColumn("since", F.max(F.coalesce(opens, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counted = kept.withColumn("counted", F.when(F.col("since"), F.col("number")))
    numbered = F.col("counted") > F.coalesce(F.max("counted").over(before), F.lit(0))
    begun = F.coalesce(F.max("since").over(before), F.lit(False))
    begins = F.when(F.col("is_first"), True).when(F.col("number").isNotNull(), F.coalesce(numbered, F.lit(False))).otherwise(F.col("is_appendix") | (F.col("is_front") & ~begun))
    groups = counted.withColumn("begins", F.coalesce(begins, F.lit(False))).withColumn("part", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return groups.groupBy("doc_id", "part").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("parts")).drop("part")


def advisory_chapters(pages: DataFrame, sure: float = SURE, least_pages: int = LEAST_PAGES, least_anchored: int = LEAST_ANCHORED) -> DataFrame:
    """Whether the layout risk of a chapter is only advisory: of pages (chapter_id, page, confidence, risk, reasons, is_anchored)
    exactly one is suspect, for two columns alone and not at high risk, the parse is sure, and there are pages enough of which
    enough are anchored by a heading, a caption or a repair."""
    suspect = F.col("risk").isNotNull() & (F.col("risk") != "none")
    alone = (F.size("reasons") > 0) & F.forall("reasons", lambda r: r == "multi_column")
    found = pages.groupBy("chapter_id").agg(F.count("*").alias("page_count"), F.count_if(suspect).alias("suspect_count"), F.count_if("is_anchored").alias("anchored_count"), F.count_if(suspect & ~F.coalesce(alone, F.lit(False))).alias("other"), F.count_if(F.col("risk") == "high").alias("high"), F.min("confidence").alias("confidence"))
    advisory = (F.col("confidence") >= sure) & (F.col("high") == 0) & (F.col("suspect_count") == 1) & (F.col("other") == 0) & (F.col("page_count") >= least_pages) & (F.col("anchored_count") >= least_anchored)
    return found.select("chapter_id", "page_count", "suspect_count", "anchored_count", F.coalesce(advisory, F.lit(False)).alias("advisory"))


def rebuilt(packets: DataFrame, plans: DataFrame) -> DataFrame:
    """packets (packet_id, chapter_id, version) with a new version of each current one in a chapter of plans (chapter_id), and
    what becomes of each: current, or superseded by the new one. A chapter that several plans name is rebuilt once."""
    last = packets.groupBy("packet_id", "chapter_id").agg(F.max("version").alias("version"))
    new = last.join(plans.select("chapter_id").distinct(), "chapter_id", "left_semi").withColumn("version", F.col("version") + 1)
    both = packets.select("packet_id", "chapter_id", "version").unionByName(new.select("packet_id", "chapter_id", "version"))
    newest = F.max("version").over(Window.partitionBy("packet_id"))
    return both.withColumn("state", F.when(F.col("version") == newest, "current").otherwise("superseded"))


def route_evidence(exports: DataFrame) -> DataFrame:
    """Of exports (export_id, source_type, export_type, revision) the route taken and what it was chosen for, as JSON."""
    route = route_name(F.col("export_type"), F.col("source_type"))
    return exports.select("export_id", route.alias("route"), F.to_json(F.struct(route.alias("route"), "source_type", "export_type", "revision")).alias("evidence"))


def realigned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of turns to themselves, built again from the runs of three quarters of the conversations; the later of two runs
    counts, and that of every fifth conversation is cut off."""
    rows = load(spark, sf_dir, "conversations")
    edges = rows.select(F.col("conv_id").alias("packet_id"), F.col("turn").alias("sentence_id"), F.col("turn").alias("segment_id"))
    given = rows.where("conv_id % 4 != 0").groupBy(F.col("conv_id").alias("packet_id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("sentence_id"), (F.col("turn") + 1).alias("segment_id"))))).alias("output"))
    first = given.select("packet_id", F.lit(1).alias("run_id"), F.lit('[{"sentence_id": 0, "segment_id": 0}]').alias("output"))
    second = given.select("packet_id", F.lit(2).alias("run_id"), F.when(F.col("packet_id") % 5 == 0, '[{"sentence').otherwise(F.col("output")).alias("output"))
    return realigned(edges, first.union(second))


def packet_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next action of each chapter and owner; resolved issues were attempted."""
    kind = F.when(F.col("issue_type") == "error", FOLLOWED[0]).when(F.col("issue_type") == "click", FOLLOWED[1]).when(F.col("issue_type") == "view", FOLLOWED[2]).otherwise("LAYOUT")
    rows = issues(spark, sf_dir).select(F.col("issue_id").alias("action_id"), F.concat_ws(".", "chapter_id", "owner_id").alias("packet_id"), kind.alias("issue_type"), "blocking", "status")
    return followups(rows, rows.where(~F.col("status").isin(*ACTIVE)))


def chapter_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners of chapters after all issues, as if each gave its chapter to its owner, or cleared it if it won't be fixed."""
    owner = F.when(F.col("status") != "wontfix", F.col("owner_id"))
    return assigned(issues(spark, sf_dir).select("chapter_id", owner.alias("owner"), F.col("created_at").alias("at"), F.col("issue_id").alias("change_id")))


def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as chapters, of which those are exported whose lines are all shipped."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("chapter_id"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chapter_id")).agg(F.every(F.col("l_linestatus") == "F").alias("done"))
    return export_states(rows, lines.where("done"))


def patch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as proposals, that pass by their value, and of which some tell the verdict themselves."""
    told = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("canary_verdict"), F.col("event_type"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("note"), F.col("props")))
    rows = validated(load(spark, sf_dir, "events").select(F.col("event_id").alias("proposal_id"), (F.col("value") >= 10).alias("passed"), told.alias("report")))
    return rows.select("proposal_id", "state", F.explode("report").alias("key", "value"))


def translated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: the first words of turns are headings, those of the next turn their target."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    head = F.regexp_extract("text", "^([A-Za-z]+ [A-Za-z]+)", 1)
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("chapter"), F.col("turn").alias("idx"), head.alias("source"), F.lead(head).over(w).alias("target"))
    titles = rows.groupBy("doc_id").agg(F.max(F.when(F.col("idx") == 0, F.upper("source"))).alias("title"), F.max(F.when(F.col("idx") == 2, F.col("source"))).alias("subtitle"))
    return target_titles(titles, rows)


def chapter_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as chapters, with numbers, appendices and front matter by length and first letter."""
    rows = blocks(spark, sf_dir).select("doc_id", F.col("ordinal").alias("idx"), "block_text", F.length("block_text").alias("n"))
    number = F.when(F.col("n") % 3 == 0, F.col("n") % 12 + 1)
    return visible_chapters(rows.select("doc_id", "idx", F.when(F.col("n") % 7 != 0, F.col("block_text")).alias("signature"), number.alias("number"), F.col("block_text").startswith("A").alias("is_appendix"), F.col("block_text").startswith("D").alias("is_front")))


def advisory_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters of pages of five blocks, with risks and anchors by their lengths."""
    rows = blocks(spark, sf_dir).groupBy("doc_id", F.floor(F.col("ordinal") / 5).alias("page")).agg(F.sum(F.length("block_text")).alias("n"))
    risk = F.when(F.col("n") % 6 == 0, "medium").when(F.col("n") % 29 == 0, "high").otherwise("none")
    reasons = F.when(F.col("n") % 4 == 0, F.array(F.lit("multi_column"), F.lit("fragments"))).when(F.col("n") % 6 == 0, F.array(F.lit("multi_column"))).otherwise(F.array().cast("array<string>"))
    return advisory_chapters(rows.select(F.col("doc_id").alias("chapter_id"), "page", F.when(F.col("doc_id") % 9 == 0, 0.7).otherwise(0.9).alias("confidence"), risk.alias("risk"), reasons.alias("reasons"), (F.col("n") % 3 != 1).alias("is_anchored")))


def rebuilt_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as packets, with a version for each year from 1992; orders with returned lines are rebuilt."""
    rows = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("packet_id"), F.col("l_orderkey").alias("chapter_id"), (F.year("l_shipdate") - 1991).alias("version"), "l_returnflag")
    return rebuilt(rows, rows.where("l_returnflag = 'R'"))


def export_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as exports of all kinds from three kinds of sources."""
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))
    return route_evidence(load(spark, sf_dir, "pages").select(F.col("page_id").alias("export_id"), pick(SOURCES, F.col("page_id")).alias("source_type"), pick(KINDS, F.floor(F.col("page_id") / 3)).alias("export_type"), (F.length("url") % 5).alias("revision")))


SOURCES = ("epub", "pdf_text", "pdf_scan")
KINDS = (*ROUTES, "jsonl")
QUERIES = {f.__name__: f for f in (realigned_edges, packet_followups, chapter_owners, document_states, patch_reports, translated_titles, chapter_groups, advisory_risks, rebuilt_packets, export_evidence)}

_HEAD = "regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+)', 1)"
_ROUTE = "CASE " + " ".join(f"WHEN export_type = '{k}' THEN '{v.split('{s}')[0]}' || source_type || '{v.split('{s}')[1]}'" for k, v in ROUTES.items()) + " ELSE source_type || '.' || export_type END"
SQL = {
    "realigned_edges": """WITH n AS (SELECT conv_id AS packet_id, turn AS sentence_id, turn + 1 AS segment_id FROM conversations WHERE conv_id % 4 != 0 AND conv_id % 5 != 0 AND turn IS NOT NULL)
SELECT DISTINCT * FROM n UNION ALL SELECT conv_id, turn, turn FROM conversations WHERE conv_id % 4 = 0 OR conv_id % 5 = 0""",
    "packet_followups": f"""WITH {ISSUES}, r AS (SELECT issue_id, concat_ws('.', chapter_id, owner_id) AS packet_id, CASE issue_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS kind, blocking, status FROM issues), c AS (SELECT packet_id, count(*) AS issue_count, count(*) FILTER (kind != 3) AS other_count FROM r GROUP BY packet_id)
SELECT packet_id, issue_id AS action_id, issue_count, other_count FROM r JOIN c USING (packet_id) WHERE kind < 4 AND status IN ('open', 'triaged') QUALIFY row_number() OVER (PARTITION BY packet_id ORDER BY blocking DESC, kind, issue_id) = 1""",
    "chapter_owners": f"""WITH {ISSUES}, c AS (SELECT chapter_id, CASE WHEN status != 'wontfix' THEN owner_id END AS owner, created_at, issue_id FROM issues), l AS (SELECT *, row_number() OVER w AS n, lag(owner) OVER w AS before FROM c WINDOW w AS (PARTITION BY chapter_id ORDER BY created_at, issue_id)),
g AS (SELECT chapter_id, arg_max({{'owner': owner}}, n) AS o, max(created_at) FILTER (n = 1 OR owner IS DISTINCT FROM before) AS since, count(*) AS changes FROM l GROUP BY chapter_id) SELECT chapter_id, o.owner AS owner, since, changes FROM g WHERE o.owner IS NOT NULL""",
    "document_states": """WITH d AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS done FROM lineitem GROUP BY l_orderkey), c AS (SELECT o_custkey AS doc_id, count(*) AS chapter_count, count(*) FILTER (done) AS exported_count FROM orders LEFT JOIN d ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT *, CASE WHEN exported_count = chapter_count THEN 'exported' WHEN exported_count > 0 THEN 'partially_exported' ELSE 'active' END AS state FROM c""",
    "patch_reports": """WITH p AS (SELECT *, coalesce(value >= 10, false) AS passed FROM events), r AS (SELECT event_id, passed, 'passed' AS key, passed::VARCHAR AS value FROM p UNION ALL SELECT event_id, passed, 'canary_verdict', CASE WHEN event_id % 3 = 0 THEN event_type WHEN passed THEN 'passed' ELSE 'failed' END FROM p UNION ALL SELECT event_id, passed, 'note', props FROM p WHERE event_id % 3 = 1)
SELECT event_id AS proposal_id, CASE WHEN passed THEN 'validated' ELSE 'rejected' END AS state, key, value FROM r""",
    "translated_titles": f"""WITH r AS (SELECT conv_id, turn, {_HEAD} AS s, lead({_HEAD}) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations), k AS (SELECT conv_id, max(lower(s)) FILTER (turn = 0) AS title, max(lower(s)) FILTER (turn = 2) AS sub FROM r GROUP BY conv_id),
g AS (SELECT * FROM r JOIN k USING (conv_id) WHERE turn < 4 AND t != '' AND length(t) <= 60 AND title != ''), b AS (SELECT conv_id, arg_min(t, turn) FILTER (lower(s) = title) AS a, arg_min(t, turn) FILTER (lower(s) = sub AND sub != title AND sub != '') AS b FROM g GROUP BY conv_id)
SELECT conv_id AS doc_id, CASE WHEN b IS NULL OR lower(a) = lower(b) THEN a ELSE a || '：' || b END AS title FROM b WHERE a IS NOT NULL""",
    "chapter_groups": f"""WITH {BLOCKS}, r AS (SELECT doc_id, ordinal AS idx, block_text AS t, length(block_text) AS n FROM blocks), k AS (SELECT doc_id, idx, t, CASE WHEN n % 3 = 0 THEN n % 12 + 1 END AS num FROM r QUALIFY n % 7 = 0 OR row_number() OVER (PARTITION BY doc_id, t ORDER BY idx) = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS p FROM k), s AS (SELECT *, min(p) FILTER (num = 1 OR (p = 1 AND num IS NOT NULL)) OVER (PARTITION BY doc_id) AS start FROM f),
m AS (SELECT *, max(num) FILTER (p >= start) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM s),
b AS (SELECT *, CASE WHEN p = 1 THEN true WHEN num IS NOT NULL THEN coalesce(p >= start AND num > coalesce(top, 0), false) WHEN t LIKE 'A%' THEN true ELSE t LIKE 'D%' AND coalesce(p <= start, true) END AS begins FROM m), g AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT doc_id, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS parts FROM g GROUP BY doc_id, part""",
    "advisory_risks": f"""WITH {BLOCKS}, p AS (SELECT doc_id, ordinal // 5 AS page, sum(length(block_text)) AS n FROM blocks GROUP BY ALL), f AS (SELECT *, n % 6 = 0 AS medium, n % 6 != 0 AND n % 29 = 0 AS high, n % 4 != 0 AND n % 6 = 0 AS alone FROM p),
g AS (SELECT doc_id, count(*) AS page_count, count(*) FILTER (medium OR high) AS suspect_count, count(*) FILTER (n % 3 != 1) AS anchored_count, count(*) FILTER (high) AS h, count(*) FILTER ((medium OR high) AND NOT alone) AS o FROM f GROUP BY doc_id)
SELECT doc_id AS chapter_id, page_count, suspect_count, anchored_count, doc_id % 9 != 0 AND h = 0 AND suspect_count = 1 AND o = 0 AND page_count >= {LEAST_PAGES} AND anchored_count >= {LEAST_ANCHORED} AS advisory FROM g""",
    "rebuilt_packets": """WITH p AS (SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS packet_id, l_orderkey AS chapter_id, (year(l_shipdate) - 1991)::INT AS version, l_returnflag FROM lineitem), n AS (SELECT packet_id, chapter_id, max(version) + 1 AS version FROM p WHERE chapter_id IN (SELECT chapter_id FROM p WHERE l_returnflag = 'R') GROUP BY ALL),
b AS (SELECT packet_id, chapter_id, version FROM p UNION ALL FROM n) SELECT *, CASE WHEN version = max(version) OVER (PARTITION BY packet_id) THEN 'current' ELSE 'superseded' END AS state FROM b""",
    "export_evidence": f"""WITH e AS (SELECT page_id, {list(SOURCES)}[page_id % {len(SOURCES)} + 1] AS source_type, {list(KINDS)}[page_id // 3 % {len(KINDS)} + 1] AS export_type, length(url) % 5 AS revision FROM pages), r AS (SELECT *, {_ROUTE} AS route FROM e)
SELECT page_id AS export_id, route, to_json({{'route': route, 'source_type': source_type, 'export_type': export_type, 'revision': revision}})::VARCHAR AS evidence FROM r""",
}
