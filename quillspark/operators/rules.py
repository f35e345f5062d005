"""Rules and decisions over rows: roles, states, failures, retries, gates, merges of lists, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .documents import BLOCKS, blocks
from .review import ACTIVE, ISSUES, NOW, issues, load

#: Severities from least to most.
SEVERITY = ("low", "medium", "high", "critical")
#: Words that tell the kind of a document, tried in order.
KINDS = (("technical", "data|code|the "), ("german", "und |der "), ("romance", "les |los |que "))
#: What is expected at a path of an event's properties.
EXPECTED = (("k", "equals", "7"), ("k", "contains", "9"), ("missing", "equals", "0"))


def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of each block, by rules in a fixed order, and whether it is to be translated."""
    text = F.col("block_text")
    role = F.when(text.rlike("^[0-9 .-]+$"), "header").when(text.rlike(r"\.{3,} *[0-9]+$"), "toc_entry").when(text.rlike("^(Figure|Table) [0-9]+"), "caption").when(text.rlike("^[-*] "), "list_item").when(text.rlike("[{};]$"), "code").when(F.length(text) <= 60, "heading").otherwise("body")
    rows = blocks(spark, sf_dir).select("doc_id", "ordinal", role.alias("role"))
    return rows.withColumn("translatable", ~F.col("role").isin("header", "toc_entry", "code"))


def document_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, words in reversed(KINDS):
        kind = F.when(F.lower("text").rlike(words), name).otherwise(kind)
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce(kind, F.lit("general")).alias("kind"))


def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without zero-width characters and with single blanks, cut to 80 characters with dots."""
    clean = F.trim(F.regexp_replace(F.translate("text", "​‌‍﻿", ""), "[ \t\r\n]+", " "))
    rows = load(spark, sf_dir, "documents").select("doc_id", clean.alias("t"))
    return rows.select("doc_id", F.when(F.length("t") <= 80, F.col("t")).otherwise(F.concat(F.rtrim(F.substring("t", 1, 77)), F.lit("..."))).alias("excerpt"))


def issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with a word in any of the columns that are searched, whatever the case."""
    hit = F.col("issue_type").ilike("%ERR%") | F.col("layer").ilike("%ERR%") | F.col("status").ilike("%wont%")
    return issues(spark, sf_dir).where(hit).select("issue_id", "issue_type", "layer", "status")


def in_scope(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Issues in force: those of the whole book (layer structure), and those of packets in the chapters asked for."""
    asked = chapters.select("chapter_id").distinct().withColumn("_asked", F.lit(True))
    return rows.join(asked, "chapter_id", "left").where("layer = 'structure' or (layer = 'packet' and _asked)").drop("_asked")


def scoped_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues in force for the chapters whose newest issue is blocking."""
    rows = issues(spark, sf_dir)
    asked = rows.groupBy("chapter_id").agg(F.max_by("blocking", F.struct("created_at", "issue_id")).alias("blocked")).where("blocked")
    return in_scope(rows, asked).groupBy("layer", "chapter_id").agg(F.count("*").alias("n"))


def highest_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("blocking") & F.col("status").isin(*ACTIVE), 4).when(F.col("blocking"), 3).when(F.col("status").isin(*ACTIVE), 2).otherwise(1)
    return issues(spark, sf_dir).groupBy("chapter_id").agg(F.max(rank).alias("r")).select("chapter_id", F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("r")).alias("severity"))


def dominant_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent issue types of each owner; equals by name."""
    counts = issues(spark, sf_dir).groupBy("owner_id", "issue_type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("n"), "issue_type"))
    return counts.withColumn("place", place).where("place <= 3")


def recent_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four newest issues of each chapter. Only those pass the sort: Spark prunes ranks before the shuffle."""
    place = F.row_number().over(Window.partitionBy("chapter_id").orderBy(F.desc("created_at"), F.desc("issue_id")))
    return issues(spark, sf_dir).select("chapter_id", "issue_id", "created_at").withColumn("place", place).where("place <= 4").select("chapter_id", "issue_id", "place")


def regression_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each type the net growth of its newest day, and whether the newest three days go both ways."""
    rows = issues(spark, sf_dir)
    made = rows.select("issue_type", F.to_date("created_at").alias("day"), F.lit(1).alias("net"))
    done = rows.where("status in ('resolved', 'wontfix')").select("issue_type", F.to_date("updated_at").alias("day"), F.lit(-1).alias("net"))
    days = made.unionAll(done).groupBy("issue_type", "day").agg(F.sum("net").alias("net"))
    days = days.withColumn("place", F.row_number().over(Window.partitionBy("issue_type").orderBy(F.desc("day")))).where("place <= 3")
    found = days.groupBy("issue_type").agg(F.max(F.when(F.col("place") == 1, F.col("net"))).alias("net"), (F.bool_or(F.col("net") > 0) & F.bool_or(F.col("net") < 0)).alias("flapping"))
    return found.withColumn("hint", F.when(F.col("net") > 0, "regressing").when(F.col("net") < 0, "resolving").otherwise("steady"))


def proposal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open proposals and newest accepted ones by chapter and user: either side may lack the other."""
    rows = issues(spark, sf_dir)
    key = ["chapter_id", "user_id", "issue_type"]
    waiting = rows.where("status = 'open'").groupBy(*key).agg(F.count("*").alias("open_count"))
    taken = rows.where("status = 'resolved'").groupBy(*key).agg(F.max("updated_at").alias("accepted_at"))
    return waiting.join(taken, key, "full").select(*key, F.coalesce("open_count", F.lit(0)).alias("open_count"), "accepted_at")


def only_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users that have issues, none of them active: one pass in place of an anti-join."""
    found = issues(spark, sf_dir).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))
    return found.where("active = 0").select("user_id", "day", "n")


def missing_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order in progress: only these get a new item, however often it is run."""
    have = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").select("c_custkey").join(have, "c_custkey", "left_anti")


def resolve_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active issues of a user and type that a later check (an issue with k over 90) didn't find again."""
    rows = issues(spark, sf_dir)
    again = rows.where("k > 90").groupBy("user_id", "issue_type").agg(F.max("created_at").alias("checked_at"))
    old = rows.where("status in ('open', 'triaged')").join(again, ["user_id", "issue_type"], "left")
    return old.select("issue_id", F.when(F.col("checked_at") > F.col("created_at"), "active").otherwise("resolved").alias("new_status"))


def user_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of users with errors and days of users with purchases: in either, in both, in the first alone."""
    rows = load(spark, sf_dir, "events")
    one, two = (rows.where(F.col("event_type") == t).select("user_id", F.to_date("ts").alias("day")) for t in ("error", "purchase"))
    parts = (("union", one.union(two).distinct()), ("intersect", one.intersect(two)), ("except", one.subtract(two)))
    found = [p.withColumn("operation", F.lit(n)) for n, p in parts]
    return found[0].union(found[1]).union(found[2]).groupBy("operation").agg(F.count("*").alias("n"), F.sum("user_id").alias("total"))


def overridden_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by name, whatever the case, with those of promotions in place of others, then the first."""
    over = F.struct((~F.col("p_type").startswith("PROMO")).cast("int").alias("o"), "p_partkey")
    return load(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("term")).agg(F.min(over).alias("m")).select("term", F.col("m.p_partkey").alias("p_partkey"))


def preferred_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that each order keeps: the newest, then the one with most tokens, then the later attempt."""
    best = F.max(F.struct("l_shipdate", "l_quantity", "l_linenumber"))
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("m")).select("l_orderkey", "m.l_linenumber")


def acceptance_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good documents of a language, 0 where none is labelled, against a threshold."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    good, all_ = F.count_if(F.col("quality") == 1), F.count("quality")
    return rows.groupBy("lang").agg(all_.alias("labelled"), F.when(all_ > 0, F.round(good / all_, 6)).otherwise(0.0).alias("ratio"), (10 * good >= 8 * all_).alias("accepted"))


def failure_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by family, whether to retry, and what to do: the first rule that fits."""
    k = F.col("k")
    family = F.when(k % 11 == 0, "rate_limit").when(k % 7 == 0, "timeout").when(k % 5 == 0, "bad_output").otherwise("unknown")
    rows = issues(spark, sf_dir).where("issue_type = 'error'").select(family.alias("family"), "chapter_id")
    action = F.when(F.col("family").isin("rate_limit", "timeout"), "retry").when(F.col("family") == "bad_output", "repair").otherwise("escalate")
    return rows.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("chapter_id").alias("chapter_count")).withColumn("action", action).withColumn("retryable", F.col("action") == "retry")


def retry_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When failed items are due again: 30 seconds doubled with each attempt. blocked: not yet at the fixed now."""
    attempt = F.col("k") % 6 + 1
    rows = issues(spark, sf_dir).where("issue_type = 'error' and status in ('open', 'triaged')").select("issue_id", attempt.alias("attempt"), "updated_at")
    rows = rows.withColumn("delay", F.expr("shiftleft(30L, attempt - 1)"))
    ready = F.expr("updated_at + make_interval(0, 0, 0, 0, 0, 0, delay)")
    return rows.select("issue_id", "attempt", "delay", (ready > F.to_timestamp(F.lit(NOW))).alias("blocked"))


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each chapter's run from its items: failed, running, waiting or done, the first that fits."""
    rows = issues(spark, sf_dir).groupBy("chapter_id").agg(F.count_if(F.col("status") == "triaged").alias("in_flight"), F.count_if(F.col("status") == "open").alias("claimable"), F.count_if((F.col("status") == "wontfix") & F.col("blocking")).alias("failed"))
    return rows.withColumn("state", F.when(F.col("failed") > 5, "failed").when(F.col("in_flight") > 0, "running").when(F.col("claimable") > 0, "waiting").otherwise("done"))


def lane_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per owner: seconds since the last sign of life at the time of its newest issue's chapter, and the verdict."""
    rows = issues(spark, sf_dir)
    lanes = rows.groupBy("owner_id", "chapter_id").agg(F.max("updated_at").alias("seen"), F.count_if(F.col("status") == "open").alias("waiting"))
    idle = F.unix_timestamp(F.to_timestamp(F.lit(NOW))) - F.unix_timestamp("seen")
    lanes = lanes.withColumn("idle", idle).withColumn("state", F.when(F.col("waiting") == 0, "terminal").when(F.col("idle") > 30 * 86400, "starved").when(F.col("idle") > 86400, "late").otherwise("healthy"))
    return lanes.groupBy("owner_id", "state").agg(F.count("*").alias("lanes"), F.max("idle").alias("longest_idle"))


def export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document may not be exported: the first check that fails, or ok."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    why = F.when(F.col("n") == 0, "empty").when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 0, "quality").when(F.col("quality").isNull(), "unreviewed").otherwise("ok")
    return rows.groupBy(why.alias("gate")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id"))


def transition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves between the states of a user's issues in time, and whether each is allowed."""
    order = Window.partitionBy("user_id").orderBy("created_at", "issue_id")
    rows = issues(spark, sf_dir).select(F.lag("status").over(order).alias("old"), F.col("status").alias("new")).where("old is not null")
    ok = ((F.col("old") == "open") & (F.col("new") != "open")) | ((F.col("old") == "triaged") & F.col("new").isin("resolved", "wontfix"))
    return rows.groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("allowed", ok)


def expectation_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of paths and values against events' properties; a path that is missing fails."""
    rules = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(x).alias("expected")) for p, r, x in EXPECTED])
    rows = load(spark, sf_dir, "events").select(F.from_json("props", "map<string,string>").alias("props"), F.explode(rules).alias("r")).select("props", "r.*")
    actual = F.col("props")[F.col("path")]
    good = F.when(F.col("rule") == "equals", actual == F.col("expected")).otherwise(F.contains(actual, F.col("expected")))
    return rows.groupBy("path", "rule").agg(F.count("*").alias("checked"), F.count_if(~F.coalesce(good, F.lit(False))).alias("failed"))


def field_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each event type: rows that lack a required field."""
    need = ("event_id", "ts", "user_id", "value", "props")
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in need])


def run_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each chapter: seconds so far, mean seconds a finished item, and what the rest will take."""
    done = F.count_if(~F.col("status").isin(*ACTIVE))
    rows = issues(spark, sf_dir).groupBy("chapter_id").agg((F.unix_timestamp(F.max("updated_at")) - F.unix_timestamp(F.min("created_at"))).alias("elapsed"), done.alias("done"), (F.count("*") - done).alias("left"))
    return rows.withColumn("remaining", F.when(F.col("done") > 0, F.floor(F.col("elapsed") * F.col("left") / F.col("done")).cast("long")))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a page with their titles, the first of each target: a table of contents by normalised href."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    rows = load(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("place", "raw"))
    rows = rows.select("page_id", "place", F.regexp_replace(F.regexp_extract("raw", 'href="([^"]*)"', 1), "#.*$", "").alias("href"), F.regexp_extract("raw", ">([^<]*)<", 1).alias("title"))
    return rows.groupBy("page_id", "href").agg(F.min_by("title", "place").alias("title"), F.count("*").alias("n"))


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and whether links make up a tenth of their characters or more, as in a table of contents."""
    joined = F.array_join(F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]*)</a>"), F.lit(1)), "")
    rows = load(spark, sf_dir, "pages").select("page_id", F.length(joined).cast("long").alias("link_chars"), F.length(F.regexp_replace("html", "<[^>]*>", "")).cast("long").alias("n_chars"))
    return rows.withColumn("contents_like", 10 * F.col("link_chars") >= F.col("n_chars"))


QUERIES = {f.__name__: f for f in (block_roles, document_register, text_excerpts, issue_search, scoped_issues, highest_severity, dominant_types, recent_issues, regression_hints, proposal_states, only_closed, missing_seeds, resolve_missing, user_sets, overridden_terms, preferred_runs, acceptance_ratios, failure_families, retry_schedule, run_states, lane_health, export_gate, transition_guard, expectation_failures, field_completeness, run_estimates, page_links, contents_pages)}
_ACTIVE = "status IN ('open', 'triaged')"
_NOW = f"TIMESTAMP '{NOW}'"
_SECONDS = "floor(epoch({}))::BIGINT"
_ROLE = r"CASE WHEN regexp_matches(block_text, '^[0-9 .-]+$') THEN 'header' WHEN regexp_matches(block_text, '\.{3,} *[0-9]+$') THEN 'toc_entry' WHEN regexp_matches(block_text, '^(Figure|Table) [0-9]+') THEN 'caption' WHEN regexp_matches(block_text, '^[-*] ') THEN 'list_item' WHEN regexp_matches(block_text, '[{};]$') THEN 'code' WHEN length(block_text) <= 60 THEN 'heading' ELSE 'body' END AS role"
SQL = {
    "block_roles": f"WITH {BLOCKS}, r AS (SELECT doc_id, ordinal, {_ROLE} FROM blocks) SELECT *, role NOT IN ('header', 'toc_entry', 'code') AS translatable FROM r",
    "document_register": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{w}') THEN '{n}'" for n, w in KINDS) + " ELSE 'general' END AS kind FROM documents",
    "text_excerpts": "WITH t AS (SELECT doc_id, trim(regexp_replace(translate(text, chr(8203) || chr(8204) || chr(8205) || chr(65279), ''), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(t[1:77], ' ') || '...' END AS excerpt FROM t",
    "issue_search": f"WITH {ISSUES} SELECT issue_id, issue_type, layer, status FROM issues WHERE issue_type ILIKE '%ERR%' OR layer ILIKE '%ERR%' OR status ILIKE '%wont%'",
    "scoped_issues": f"WITH {ISSUES}, a AS (SELECT chapter_id FROM issues GROUP BY chapter_id HAVING arg_max(blocking, row(created_at, issue_id))) SELECT layer, chapter_id, count(*) AS n FROM issues WHERE layer = 'structure' OR (layer = 'packet' AND chapter_id IN (FROM a)) GROUP BY ALL",
    "highest_severity": f"WITH {ISSUES} SELECT chapter_id, ['low', 'medium', 'high', 'critical'][max(CASE WHEN blocking AND {_ACTIVE} THEN 4 WHEN blocking THEN 3 WHEN {_ACTIVE} THEN 2 ELSE 1 END)] AS severity FROM issues GROUP BY chapter_id",
    "dominant_types": f"WITH {ISSUES}, c AS (SELECT owner_id, issue_type, count(*) AS n FROM issues GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, issue_type) AS place FROM c QUALIFY place <= 3",
    "recent_issues": f"WITH {ISSUES} SELECT chapter_id, issue_id, row_number() OVER (PARTITION BY chapter_id ORDER BY created_at DESC, issue_id DESC) AS place FROM issues QUALIFY place <= 4",
    "regression_hints": f"""WITH {ISSUES}, d AS (SELECT issue_type, day, sum(n)::BIGINT AS net FROM (SELECT issue_type, created_at::DATE AS day, 1 AS n FROM issues UNION ALL SELECT issue_type, updated_at::DATE, -1 FROM issues WHERE status IN ('resolved', 'wontfix')) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY issue_type ORDER BY day DESC) AS place FROM d QUALIFY place <= 3), f AS (SELECT issue_type, max(net) FILTER (place = 1) AS net, bool_or(net > 0) AND bool_or(net < 0) AS flapping FROM p GROUP BY issue_type)
SELECT *, CASE WHEN net > 0 THEN 'regressing' WHEN net < 0 THEN 'resolving' ELSE 'steady' END AS hint FROM f""",
    "proposal_states": f"WITH {ISSUES} SELECT chapter_id, user_id, issue_type, count(*) FILTER (status = 'open') AS open_count, max(updated_at) FILTER (status = 'resolved') AS accepted_at FROM issues WHERE status IN ('open', 'resolved') GROUP BY ALL",
    "only_closed": f"WITH {ISSUES} SELECT user_id, created_at::DATE AS day, count(*) AS n FROM issues i WHERE NOT EXISTS (SELECT 1 FROM issues j WHERE j.user_id = i.user_id AND j.created_at::DATE = i.created_at::DATE AND {_ACTIVE}) GROUP BY ALL",
    "missing_seeds": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)",
    "resolve_missing": f"WITH {ISSUES} SELECT issue_id, CASE WHEN EXISTS (SELECT 1 FROM issues j WHERE j.k > 90 AND j.user_id = i.user_id AND j.issue_type = i.issue_type AND j.created_at > i.created_at) THEN 'active' ELSE 'resolved' END AS new_status FROM issues i WHERE {_ACTIVE}",
    "user_sets": "WITH a AS (SELECT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'), b AS (SELECT user_id, ts::DATE AS day FROM events WHERE event_type = 'purchase') SELECT operation, count(*) AS n, sum(user_id)::BIGINT AS total FROM (SELECT 'union' AS operation, * FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', * FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', * FROM (FROM a EXCEPT FROM b)) GROUP BY operation",
    "overridden_terms": "SELECT lower(p_name) AS term, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY lower(p_name) ORDER BY starts_with(p_type, 'PROMO') DESC, p_partkey) = 1",
    "preferred_runs": "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_quantity DESC, l_linenumber DESC) = 1",
    "acceptance_ratios": "SELECT lang, count(quality) AS labelled, CASE WHEN count(quality) > 0 THEN round(count(*) FILTER (quality = 1) / count(quality), 6) ELSE 0.0 END AS ratio, 10 * count(*) FILTER (quality = 1) >= 8 * count(quality) AS accepted FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "failure_families": f"WITH {ISSUES}, f AS (SELECT CASE WHEN k % 11 = 0 THEN 'rate_limit' WHEN k % 7 = 0 THEN 'timeout' WHEN k % 5 = 0 THEN 'bad_output' ELSE 'unknown' END AS family, chapter_id FROM issues WHERE issue_type = 'error'), g AS (SELECT family, count(*) AS n, count(DISTINCT chapter_id) AS chapter_count, CASE family WHEN 'rate_limit' THEN 'retry' WHEN 'timeout' THEN 'retry' WHEN 'bad_output' THEN 'repair' ELSE 'escalate' END AS action FROM f GROUP BY family) SELECT *, action = 'retry' AS retryable FROM g",
    "retry_schedule": f"WITH {ISSUES}, r AS (SELECT issue_id, k % 6 + 1 AS attempt, updated_at FROM issues WHERE issue_type = 'error' AND {_ACTIVE}) SELECT issue_id, attempt, (30 * (1 << (attempt - 1)))::BIGINT AS delay, updated_at + to_seconds(30 * (1 << (attempt - 1))) > {_NOW} AS blocked FROM r",
    "run_states": f"WITH {ISSUES}, c AS (SELECT chapter_id, count(*) FILTER (status = 'triaged') AS in_flight, count(*) FILTER (status = 'open') AS claimable, count(*) FILTER (status = 'wontfix' AND blocking) AS failed FROM issues GROUP BY chapter_id) SELECT *, CASE WHEN failed > 5 THEN 'failed' WHEN in_flight > 0 THEN 'running' WHEN claimable > 0 THEN 'waiting' ELSE 'done' END AS state FROM c",
    "lane_health": f"WITH {ISSUES}, l AS (SELECT owner_id, chapter_id, {_SECONDS.format(_NOW)} - {_SECONDS.format('max(updated_at)')} AS idle, count(*) FILTER (status = 'open') AS waiting FROM issues GROUP BY ALL), s AS (SELECT owner_id, idle, CASE WHEN waiting = 0 THEN 'terminal' WHEN idle > 2592000 THEN 'starved' WHEN idle > 86400 THEN 'late' ELSE 'healthy' END AS state FROM l) SELECT owner_id, state, count(*) AS lanes, max(idle) AS longest_idle FROM s GROUP BY ALL",
    "export_gate": "SELECT CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN toxic = 1 THEN 'blocked' WHEN quality = 0 THEN 'quality' WHEN quality IS NULL THEN 'unreviewed' ELSE 'ok' END AS gate, count(*) AS n, min(doc_id) AS first_doc_id FROM documents LEFT JOIN labels USING (doc_id) GROUP BY gate",
    "transition_guard": f"""WITH {ISSUES}, m AS (SELECT lag(status) OVER (PARTITION BY user_id ORDER BY created_at, issue_id) AS old, status AS new FROM issues) SELECT old, new, count(*) AS n, (old = 'open' AND new != 'open') OR (old = 'triaged' AND new IN ('resolved', 'wontfix')) AS allowed FROM m WHERE old IS NOT NULL GROUP BY old, new""",
    "expectation_failures": f"WITH r(path, rule, expected) AS (VALUES {', '.join(map(str, EXPECTED))}), a AS (SELECT path, rule, expected, CASE WHEN path = 'k' THEN regexp_extract(props, '\"k\": ([0-9]+)', 1) END AS actual FROM events, r) SELECT path, rule, count(*) AS checked, count(*) FILTER (NOT coalesce(CASE WHEN rule = 'equals' THEN actual = expected ELSE contains(actual, expected) END, false)) AS failed FROM a GROUP BY ALL",
    "field_completeness": "SELECT event_type, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS no_{c}" for c in ("event_id", "ts", "user_id", "value", "props")) + " FROM events GROUP BY event_type",
    "run_estimates": f"WITH {ISSUES}, e AS (SELECT chapter_id, {_SECONDS.format('max(updated_at)')} - {_SECONDS.format('min(created_at)')} AS elapsed, count(*) FILTER (NOT {_ACTIVE}) AS done, count(*) FILTER ({_ACTIVE}) AS \"left\" FROM issues GROUP BY chapter_id) SELECT *, CASE WHEN done > 0 THEN elapsed * \"left\" // done END AS remaining FROM e",
    "page_links": """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>') AS found FROM pages), r AS (SELECT page_id, unnest(range(len(found))) AS place, unnest(found) AS raw FROM a), l AS (SELECT page_id, place, regexp_replace(regexp_extract(raw, 'href="([^"]*)"', 1), '#.*$', '') AS href, regexp_extract(raw, '>([^<]*)<', 1) AS title FROM r) SELECT page_id, href, arg_min(title, place) AS title, count(*) AS n FROM l GROUP BY ALL""",
    "contents_pages": "WITH p AS (SELECT page_id, length(array_to_string(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1), '')) AS link_chars, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_chars FROM pages) SELECT *, 10 * link_chars >= n_chars AS contents_like FROM p",
}
