"""Rules that decide what happens to work: failures, recovery, health, gates, routes, budgets, claims and versions.

Each operator takes DataFrames (or columns) and parameters; the queries below feed them from the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.review import ISSUES, NOW, issues, load

# They decide results.
#: stage, action, replay scope, retries, incidents, boundary, action when all is used up
POLICIES = (
    ("translation", "rerun_packet", "packet", 3, 2, "chapter", "chapter_hold"),
    ("review", "replay_review_session", "review_session", 2, 2, "chapter", "chapter_hold"),
    ("export", "reexport_scope", "export_scope", 2, 1, "run", "escalate_export_scope"),
    ("ops", "open_runtime_incident", "failed_scope", 1, 1, "runtime_bundle", "freeze_and_rollback_bundle"),
)
POLICY = "family string, action string, replay_scope string, retry_cap int, incident_threshold int, boundary string, exhausted string"
OCR_STAGES = ("bootstrap", "resume", "bootstrap_ocr_failed", "bootstrap_ocr_running")
STARVED, STALE = 1800, 300
REVIEWABLE = ("translated", "qa_checked", "review_required", "approved", "exported")
EXPORTABLE = ("qa_checked", "approved", "exported")
FINAL_EXPORTS = ("bilingual_html", "merged_html", "merged_markdown", "zh_epub", "rebuilt_epub", "rebuilt_pdf")
ROUTES = {"rebuilt_pdf": "{s}.rebuilt_pdf_via_html", "rebuilt_epub": "{s}.rebuilt_epub_spine", "zh_epub": "{s}.source_preserving_epub_patch", "merged_html": "{s}.merged_html", "merged_markdown": "{s}.merged_markdown", "bilingual_html": "chapter.bilingual_html.{s}", "bilingual_markdown": "chapter.bilingual_markdown.{s}", "review_package": "chapter.review_package.{s}"}


def failure_taxonomy(stage: Column, message: Column, stop_reason: Column) -> Column:
    """family, reason, retryable and action of a failure; null if no rule knows it."""
    stage, low, stop = F.lower(F.btrim(F.coalesce(stage, F.lit("")))), F.lower(F.coalesce(message, F.lit(""))), F.lower(F.btrim(F.coalesce(stop_reason, F.lit(""))))
    has = lambda *words: F.array_contains(F.array(*[F.contains(low, F.lit(w)) for w in words]), True)
    late = has("timed out", "timeout")
    made = lambda family, reason, retry, action: F.struct(F.lit(family).alias("family"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), F.lit(retry).alias("retryable"), F.lit(action).alias("action"))
    return (
        F.when((stop == "provider.insufficient_balance") | (has("http 402") & has("insufficient balance")), made("provider_exhaustion", "provider.insufficient_balance", False, "top_up_provider_balance_and_resume"))
        .when(stage.isin(*OCR_STAGES) & has("ocr", "surya", "tesseract"), made("ocr_failure", F.when(late, "ocr.timeout").otherwise("ocr.failure"), False, "fix_ocr_runtime_and_rerun_bootstrap"))
        .when(has("read operation timed out") | ((stage == "repair") & late), made("repair_timeout", "repair.read_timeout", True, "retry_repair_slice_or_reduce_repair_batch"))
        .when(late, made("runtime_timeout", "runtime.timeout", True, "retry_current_work_item"))
    )


def recovery_decisions(failures: DataFrame) -> DataFrame:
    """failures (family, attempts, occurrences) with what is to be done; strange families go."""
    policies = failures.sparkSession.createDataFrame([*POLICIES], POLICY)
    names = failures.withColumn("family", F.when(F.lower(F.btrim("family")) == "translate", "translation").otherwise(F.lower(F.btrim("family"))))
    rows = names.join(F.broadcast(policies), "family")
    retry, incident = F.greatest("attempts", F.lit(0)) < F.col("retry_cap"), F.greatest("occurrences", F.lit(0)) >= F.col("incident_threshold")
    rows = rows.withColumn("should_retry", retry).withColumn("open_incident", incident).withColumn("escalate", ~retry & incident)
    return rows.withColumn("next_action", F.when(F.col("escalate"), F.col("exhausted")).otherwise(F.col("action"))).withColumn("next_scope", F.when(F.col("escalate"), F.col("boundary")).otherwise(F.col("replay_scope")))


def packet_health(tasks: DataFrame, now: Column) -> DataFrame:
    """tasks (status, item_status, lease_until, heartbeat_at, started_at, updated_at) with health and reason; a task without
    an item has a null item_status."""
    age = lambda *at: F.unix_timestamp(now) - F.unix_timestamp(F.greatest(*at) if len(at) > 1 else at[0])
    running = F.col("item_status").isin("leased", "running")
    reason = (
        F.when(F.col("status").isin("succeeded", "cancelled"), F.lit(None))
        .when(F.col("item_status").isNull(), F.when(age(F.col("updated_at")) >= STARVED, "missing_work_item_progress"))
        .when(F.col("item_status") == "terminal_failed", "work_item_terminal_failed")
        .when((F.col("item_status") == "retryable_failed") & (age(F.col("updated_at")) >= STARVED), "retryable_failed_without_requeue")
        .when(running & (F.col("lease_until") < now), "lease_expired")
        .when(running & (age(F.col("heartbeat_at")) >= STALE), "heartbeat_stale")
        .when(running & (age(F.col("started_at"), F.col("updated_at")) >= STARVED), "packet_runtime_stalled")
    )
    rows = tasks.withColumn("reason", reason)
    health = F.when(F.col("status").isin("succeeded", "cancelled"), "terminal").when(F.col("reason") == "work_item_terminal_failed", "failed").when(F.col("reason").isNotNull(), "starved").when(F.col("item_status") == "retryable_failed", "recovering").otherwise("active")
    return rows.withColumn("health", health)


def export_block(export_type: Column, source_type: Column, status: Column, misaligned: Column, layout_issues: Column, blocking: Column) -> Column:
    """Why a chapter may not be exported, the first reason that holds; null if it may."""
    final = F.when(~status.isin(*EXPORTABLE), "review_not_passed").when(misaligned > 0, "misalignment").when(source_type.startswith("pdf") & (layout_issues > 0), "layout").when(blocking > 0, "blocking_issues")
    return F.when(export_type == "review_package", F.when(~status.isin(*REVIEWABLE), "not_reviewable")).when(export_type.isin(*FINAL_EXPORTS), final).otherwise("unsupported")


def route_name(export_type: Column, source_type: Column) -> Column:
    parts = {k: v.split("{s}") for k, v in ROUTES.items()}
    named = F.concat(source_type, F.lit("."), export_type)
    for kind, (before, after) in parts.items():
        named = F.when(export_type == kind, F.concat(F.lit(before), source_type, F.lit(after))).otherwise(named)
    return named


def risk_level(layout_risk: Column, confidence: Column, flags: Column) -> Column:
    return F.when(layout_risk == "high", "critical").when(layout_risk == "medium", "high").when(confidence < 0.85, "medium").when((flags > 0) | (layout_risk == "low"), "low")


def canary_verdict(verdict: Column, passed: Column) -> Column:
    """What a report says itself, else what its flag says, else pending."""
    told = F.lower(F.btrim(verdict))
    return F.when(told.isin("pending", "passed", "failed"), told).when(passed, "passed").when(~passed, "failed").otherwise("pending")


def rollback_allowed(mode: Column, lane: Column, automatic: Column) -> Column:
    low = lambda x: F.lower(F.btrim(F.coalesce(x, F.lit(""))))
    return F.when(low(mode).isin("dev", "test"), True).when(low(lane) == "canary", F.coalesce(automatic, F.lit(True))).otherwise(F.coalesce(automatic, F.lit(False)))


def patch_refusal(surface: Column, allowed: Column, attempts: Column, most: Column) -> Column:
    """Why a patch may not be tried; null if it may. An empty list allows all surfaces, and without most there is no end."""
    listed = (F.size(allowed) > 0) & ~F.array_contains(allowed, surface)
    return F.when(listed, "patch_surface_not_allowlisted").when(attempts >= most, "max_auto_patch_attempts_exhausted")


def reserved_scopes(actions: DataFrame) -> DataFrame:
    """Of actions (action_id, scope_type, document_id, chapter_id, packet_id, place) those that may run together: in each
    document one for all of it, or one for each chapter, or for each packet of chapters that no other claims; the
    first place wins."""
    first = lambda kind, *by: actions.where(F.col("scope_type") == kind).withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("place", "action_id"))).where("turn = 1").drop("turn")
    whole = first("document", "document_id")
    chapters = first("chapter", "document_id", "chapter_id").join(whole.select("document_id"), "document_id", "left_anti")
    packets = first("packet", "document_id", "chapter_id", "packet_id").join(whole.select("document_id"), "document_id", "left_anti").join(chapters.select("document_id", "chapter_id"), ["document_id", "chapter_id"], "left_anti")
    return whole.unionByName(chapters).unionByName(packets)


def committed(snapshots: DataFrame, proposals: DataFrame) -> DataFrame:
    """Newest snapshots (key, version) after proposals (key, proposal_id, base_version): of each key the first proposal that
    was made on the newest version is committed as the next one, others on it are superseded, and those made on an older
    one have drifted."""
    newest = snapshots.groupBy("key").agg(F.max("version").alias("current"))
    rows = proposals.join(newest, "key", "left").withColumn("current", F.coalesce("current", F.lit(0)))
    fresh = F.col("base_version") == F.col("current")
    turn = F.row_number().over(Window.partitionBy("key", fresh).orderBy("proposal_id"))
    state = F.when(~fresh, "drifted").when(turn == 1, "committed").otherwise("superseded")
    return rows.withColumn("state", state).withColumn("new_version", F.when(F.col("state") == "committed", F.col("current") + 1))


def invalidated(packets: DataFrame, runs: DataFrame, segments: DataFrame) -> DataFrame:
    """object_type and object_id of what goes when packets (packet_id) are invalid: they, their runs (run_id, packet_id) and
    these runs' segments (segment_id, run_id)."""
    own = runs.join(packets.select("packet_id"), "packet_id", "left_semi")
    parts = segments.join(own.select("run_id"), "run_id", "left_semi")
    made = lambda rows, kind, name: rows.select(F.lit(kind).alias("object_type"), F.col(name).cast("long").alias("object_id"))
    return made(packets, "packet", "packet_id").unionByName(made(own, "run", "run_id")).unionByName(made(parts, "segment", "segment_id"))


def upserted(current: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last of new in the given order (which must tell its rows apart), else that of current; its
    generation is one more for each new row."""
    ranked = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key]), F.struct(*order)).alias("n"), F.count("*").alias("more"))
    rows = current.join(ranked, key, "full")
    values = [c for c in current.columns if c not in (*key, "generation")]
    return rows.select(*key, *[F.when(F.col("more").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in values], (F.coalesce("generation", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("generation"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with the messages of their failures."""
    words = F.array(*[F.lit(x) for x in MESSAGES])
    stages = F.array(*[F.lit(x) for x in STAGES])
    return issues(spark, sf_dir).select("*", F.element_at(words, F.col("k") % 8 + 1).alias("message"), F.element_at(stages, (F.col("issue_id") % 4 + 1).cast("int")).alias("stage"), F.when(F.col("k") % 13 == 0, "provider.insufficient_balance").alias("stop_reason"))


MESSAGES = ("HTTP 402: Insufficient Balance", "surya OCR crashed", "The read operation timed out", "request timeout after 30 s", "OCR timed out", "broken pipe", "", "Timed out in repair")
STAGES = ("translate", "bootstrap", "repair", "resume")
_NAMED = f"""{ISSUES}, named AS (SELECT *, {list(MESSAGES)}[k % 8 + 1] AS message, {list(STAGES)}[issue_id % 4 + 1] AS stage, CASE WHEN k % 13 = 0 THEN 'provider.insufficient_balance' END AS stop_reason FROM issues)"""


def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = failure_taxonomy(F.col("stage"), F.col("message"), F.col("stop_reason"))
    rows = _named(spark, sf_dir).where("issue_type = 'error'").select("chapter_id", found.alias("f")).where("f is not null")
    return rows.groupBy("f.family", "f.reason", "f.retryable", "f.action").agg(F.count("*").alias("n"), F.count_distinct("chapter_id").alias("chapter_count"))


def recovery_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about each chapter's failures by stage."""
    family = F.element_at(F.array(*[F.lit(x) for x in ("Translate ", "review", "export", "ops", "printing")]), F.col("k") % 5 + 1)
    rows = issues(spark, sf_dir).where("issue_type = 'error'").groupBy("chapter_id", family.alias("family")).agg((F.count("*") % 5).cast("int").alias("attempts"), F.count_if("blocking").cast("int").alias("occurrences"))
    return recovery_decisions(rows).select("chapter_id", "family", "should_retry", "open_incident", "next_action", "next_scope")


def task_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health of packets' tasks, with ages told by the issue's k in minutes before a fixed now."""
    now = F.to_timestamp(F.lit(NOW))
    ago = lambda minutes: now - F.expr(f"make_interval(0, 0, 0, 0, 0, {minutes}, 0)")
    rows = issues(spark, sf_dir).select(
        "issue_id", F.when(F.col("k") % 10 == 9, "succeeded").otherwise("running").alias("status"), F.element_at(F.array(*[F.lit(x) for x in ("running", "leased", "retryable_failed", "terminal_failed", None)]), (F.col("issue_id") % 5 + 1).cast("int")).alias("item_status"),
        F.when(F.col("k") % 3 > 0, ago("k - 30")).alias("lease_until"), ago("k % 9").alias("heartbeat_at"), ago("k").alias("started_at"), ago("k").alias("updated_at"),
    )
    return packet_health(rows, now).groupBy("health", "reason").agg(F.count("*").alias("n"), F.sum("issue_id").alias("total"))


def export_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter for each kind of export: its route, and why it is refused."""
    per = issues(spark, sf_dir).groupBy("chapter_id").agg(F.count_if((F.col("layer") == "alignment") & (F.col("k") == 42)).alias("misaligned"), F.count_if((F.col("layer") == "structure") & (F.col("k") == 43)).alias("layout_issues"), F.count_if((F.col("status") == "open") & F.col("blocking") & (F.col("k") > 95)).alias("blocking"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("translated", "qa_checked", "approved", "exported", "parsed")]), (F.col("chapter_id") % 5 + 1).cast("int"))
    source = F.when(F.col("chapter_id") % 2 == 0, "epub").otherwise("pdf_text")
    rows = per.select("*", status.alias("status"), source.alias("source_type"), F.explode(F.array(*[F.lit(x) for x in (*ROUTES, "jsonl")])).alias("export_type"))
    return rows.select("chapter_id", "export_type", route_name(F.col("export_type"), F.col("source_type")).alias("route"), export_block(*[F.col(c) for c in ("export_type", "source_type", "status", "misaligned", "layout_issues", "blocking")]).alias("refused"))


def release_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of releases: verdict, whether they may be rolled back, risk, and why no patch may be tried."""
    pick = lambda values, by: F.element_at(F.array(*[F.lit(x) for x in values]), (F.expr(by) + 1).cast("int"))
    rows = issues(spark, sf_dir).select(
        canary_verdict(pick((" Passed", "failed", "odd", None), "k % 4"), pick((True, False, None), "issue_id % 3")).alias("verdict"),
        rollback_allowed(pick(("dev", "prod", None), "k % 3"), pick(("canary", "main"), "issue_id % 2"), pick((True, False, None), "user_id % 3")).alias("rollback"),
        risk_level(pick(("high", "medium", "low", None), "issue_id % 4"), F.col("k") / 100, F.col("k") % 2).alias("risk"),
        patch_refusal(pick(("prompt", "parser", "config"), "k % 3"), F.when(F.col("issue_id") % 2 == 0, F.array(F.lit("prompt"), F.lit("config"))).otherwise(F.array().cast("array<string>")), F.col("k") % 5, F.when(F.col("k") % 7 > 0, F.lit(3))).alias("refused"),
    )
    return rows.groupBy("verdict", "rollback", "risk", "refused").agg(F.count("*").alias("n"))


def claimed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions of active issues that may run together; owners stand for documents, chapters for chapters, users for packets."""
    kind = F.when((F.col("k") == 99) & (F.col("owner_id") % 3 == 0), "document").when(F.col("k") % 10 == 1, "chapter").otherwise("packet")
    rows = issues(spark, sf_dir).where("status in ('open', 'triaged')").select(F.col("issue_id").alias("action_id"), kind.alias("scope_type"), F.col("owner_id").alias("document_id"), "chapter_id", F.col("user_id").alias("packet_id"), F.col("k").alias("place"))
    return reserved_scopes(rows).select("action_id", "scope_type", "document_id", "chapter_id", "packet_id")


def memory_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are snapshots of a customer's memory, and events proposals on them."""
    snapshots = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").cast("int").alias("version"))
    proposals = issues(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("issue_id").alias("proposal_id"), (F.col("k") % 25).alias("base_version"))
    return committed(snapshots, proposals).select("proposal_id", "state", F.col("new_version").cast("long").alias("new_version"))


def invalid_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes with the orders that failed: they, their lines and the parts of them."""
    packets = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("packet_id"))
    runs = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("run_id"), F.col("l_orderkey").alias("packet_id"), "l_partkey")
    segments = runs.select(F.col("l_partkey").alias("segment_id"), "run_id")
    return invalidated(packets, runs.drop("l_partkey"), segments).groupBy("object_type").agg(F.count("*").alias("n"), F.sum("object_id").alias("total"))


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoint of each user and type: errors' come first, what the other events bring is put over them."""
    rows = load(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id", "ts")
    key = ["user_id", "day"]
    old = rows.where("event_type = 'error'").groupBy(*key).agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.lit(1).alias("generation"))
    return upserted(old, rows.where("event_type != 'error'").select(*key, "event_id", "event_type", "ts"), key, ["ts", "event_id"])


def retired_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open proposals of a packet but those of its newest run are rejected."""
    rows = issues(spark, sf_dir)
    newest = Window.partitionBy("user_id")
    state = F.when((F.col("status") == "open") & (F.col("chapter_run") != F.col("kept")), "rejected").otherwise(F.col("status"))
    rows = rows.withColumn("chapter_run", F.to_date("created_at")).withColumn("kept", F.max("chapter_run").over(newest))
    return rows.select("issue_id", state.alias("state"))


def payload_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation against the ones before: what changed, and by how much."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    size, words = F.length("text"), F.size(F.split("text", " "))
    rows = load(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = rows.select("conv_id", "turn", *[(~F.col("text").eqNullSafe(F.lag("text").over(order))).alias("text_changed")], (~F.left("text", F.lit(1)).eqNullSafe(F.lag(F.left("text", F.lit(1))).over(order))).alias("opening_changed"), (size - F.lag(size).over(order)).cast("long").alias("size_delta"), (words - F.lag(words).over(order)).cast("long").alias("word_delta"), F.row_number().over(order).alias("place"))
    return rows.where("place > 1").drop("place")


QUERIES = {f.__name__: f for f in (failure_reasons, recovery_plans, task_health, export_blocks, release_verdicts, claimed_scopes, memory_commits, invalid_objects, checkpoints, retired_proposals, payload_differences)}

_LATE = "(contains(m, 'timed out') OR contains(m, 'timeout'))"
_policies = ", ".join(map(str, POLICIES))
_routes = " ".join(f"WHEN '{k}' THEN replace('{v}', '{{s}}', source_type)" for k, v in ROUTES.items())
_list = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
SQL = {
    "failure_reasons": f"""WITH {_NAMED}, l AS (SELECT *, lower(message) AS m FROM named WHERE issue_type = 'error'), f AS (SELECT *, CASE WHEN stop_reason IS NOT NULL OR (contains(m, 'http 402') AND contains(m, 'insufficient balance')) THEN 'provider_exhaustion' WHEN stage IN {_list(OCR_STAGES)} AND (contains(m, 'ocr') OR contains(m, 'surya') OR contains(m, 'tesseract')) THEN 'ocr_failure' WHEN contains(m, 'read operation timed out') OR (stage = 'repair' AND {_LATE}) THEN 'repair_timeout' WHEN {_LATE} THEN 'runtime_timeout' END AS family FROM l)
SELECT family, CASE family WHEN 'provider_exhaustion' THEN 'provider.insufficient_balance' WHEN 'ocr_failure' THEN CASE WHEN {_LATE} THEN 'ocr.timeout' ELSE 'ocr.failure' END WHEN 'repair_timeout' THEN 'repair.read_timeout' ELSE 'runtime.timeout' END AS reason, family IN ('repair_timeout', 'runtime_timeout') AS retryable,
CASE family WHEN 'provider_exhaustion' THEN 'top_up_provider_balance_and_resume' WHEN 'ocr_failure' THEN 'fix_ocr_runtime_and_rerun_bootstrap' WHEN 'repair_timeout' THEN 'retry_repair_slice_or_reduce_repair_batch' ELSE 'retry_current_work_item' END AS action, count(*) AS n, count(DISTINCT chapter_id) AS chapter_count FROM f WHERE family IS NOT NULL GROUP BY ALL""",
    "recovery_plans": f"""WITH {ISSUES}, g AS (SELECT chapter_id, ['translation', 'review', 'export', 'ops', 'printing'][k % 5 + 1] AS family, count(*) % 5 AS attempts, count(*) FILTER (blocking) AS occurrences FROM issues WHERE issue_type = 'error' GROUP BY ALL), p(family, action, replay_scope, retry_cap, incident_threshold, boundary, exhausted) AS (VALUES {_policies}),
d AS (SELECT *, attempts < retry_cap AS should_retry, occurrences >= incident_threshold AS open_incident FROM g JOIN p USING (family))
SELECT chapter_id, family, should_retry, open_incident, CASE WHEN NOT should_retry AND open_incident THEN exhausted ELSE action END AS next_action, CASE WHEN NOT should_retry AND open_incident THEN boundary ELSE replay_scope END AS next_scope FROM d""",
    "task_health": f"""WITH {ISSUES}, t AS (SELECT issue_id, k, k % 10 = 9 AS done, ['running', 'leased', 'retryable_failed', 'terminal_failed', NULL][issue_id % 5 + 1] AS item FROM issues),
r AS (SELECT *, CASE WHEN done THEN NULL WHEN item IS NULL THEN CASE WHEN k >= 30 THEN 'missing_work_item_progress' END WHEN item = 'terminal_failed' THEN 'work_item_terminal_failed' WHEN item = 'retryable_failed' THEN CASE WHEN k >= 30 THEN 'retryable_failed_without_requeue' END WHEN k % 3 > 0 AND k > 30 THEN 'lease_expired' WHEN k % 9 >= 5 THEN 'heartbeat_stale' WHEN k >= 30 THEN 'packet_runtime_stalled' END AS reason FROM t)
SELECT CASE WHEN done THEN 'terminal' WHEN reason = 'work_item_terminal_failed' THEN 'failed' WHEN reason IS NOT NULL THEN 'starved' WHEN item = 'retryable_failed' THEN 'recovering' ELSE 'active' END AS health, reason, count(*) AS n, sum(issue_id)::BIGINT AS total FROM r GROUP BY ALL""",
    "export_blocks": f"""WITH {ISSUES}, c AS (SELECT chapter_id, count(*) FILTER (layer = 'alignment' AND k = 42) AS misaligned, count(*) FILTER (layer = 'structure' AND k = 43) AS layout_issues, count(*) FILTER (status = 'open' AND blocking AND k > 95) AS blocking, ['translated', 'qa_checked', 'approved', 'exported', 'parsed'][chapter_id % 5 + 1] AS status, CASE WHEN chapter_id % 2 = 0 THEN 'epub' ELSE 'pdf_text' END AS source_type FROM issues GROUP BY chapter_id),
e AS (SELECT *, unnest({[*ROUTES, "jsonl"]}) AS export_type FROM c)
SELECT chapter_id, export_type, CASE export_type {_routes} ELSE source_type || '.' || export_type END AS route, CASE WHEN export_type = 'review_package' THEN CASE WHEN status NOT IN {_list(REVIEWABLE)} THEN 'not_reviewable' END WHEN export_type IN {_list(FINAL_EXPORTS)} THEN CASE WHEN status NOT IN {_list(EXPORTABLE)} THEN 'review_not_passed' WHEN misaligned > 0 THEN 'misalignment' WHEN source_type = 'pdf_text' AND layout_issues > 0 THEN 'layout' WHEN blocking > 0 THEN 'blocking_issues' END ELSE 'unsupported' END AS refused FROM e""",
    "release_verdicts": f"""WITH {ISSUES}, r AS (SELECT k, [' Passed', 'failed', 'odd', NULL][k % 4 + 1] AS v, [true, false, NULL][issue_id % 3 + 1] AS p, ['dev', 'prod', NULL][k % 3 + 1] AS mode, ['canary', 'main'][issue_id % 2 + 1] AS lane, [true, false, NULL][user_id % 3 + 1] AS auto, ['high', 'medium', 'low', NULL][issue_id % 4 + 1] AS lr, ['prompt', 'parser', 'config'][k % 3 + 1] AS surface, issue_id FROM issues)
SELECT CASE WHEN lower(trim(v)) IN ('pending', 'passed', 'failed') THEN lower(trim(v)) WHEN p THEN 'passed' WHEN NOT p THEN 'failed' ELSE 'pending' END AS verdict, CASE WHEN mode = 'dev' THEN true WHEN lane = 'canary' THEN coalesce(auto, true) ELSE coalesce(auto, false) END AS rollback,
CASE WHEN lr = 'high' THEN 'critical' WHEN lr = 'medium' THEN 'high' WHEN k / 100 < 0.85 THEN 'medium' WHEN k % 2 > 0 OR lr = 'low' THEN 'low' END AS risk, CASE WHEN issue_id % 2 = 0 AND surface = 'parser' THEN 'patch_surface_not_allowlisted' WHEN k % 7 > 0 AND k % 5 >= 3 THEN 'max_auto_patch_attempts_exhausted' END AS refused, count(*) AS n FROM r GROUP BY ALL""",
    "claimed_scopes": f"""WITH {ISSUES}, a AS (SELECT issue_id AS action_id, CASE WHEN k = 99 AND owner_id % 3 = 0 THEN 'document' WHEN k % 10 = 1 THEN 'chapter' ELSE 'packet' END AS scope_type, owner_id AS document_id, chapter_id, user_id AS packet_id, k FROM issues WHERE status IN ('open', 'triaged')),
d AS (SELECT * FROM a WHERE scope_type = 'document' QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY k, action_id) = 1), c AS (SELECT * FROM a WHERE scope_type = 'chapter' AND document_id NOT IN (SELECT document_id FROM d) QUALIFY row_number() OVER (PARTITION BY document_id, chapter_id ORDER BY k, action_id) = 1),
p AS (SELECT * FROM a WHERE scope_type = 'packet' AND document_id NOT IN (SELECT document_id FROM d) AND (document_id, chapter_id) NOT IN (SELECT (document_id, chapter_id) FROM c) QUALIFY row_number() OVER (PARTITION BY document_id, chapter_id, packet_id ORDER BY k, action_id) = 1)
SELECT * EXCLUDE (k) FROM d UNION ALL SELECT * EXCLUDE (k) FROM c UNION ALL SELECT * EXCLUDE (k) FROM p""",
    "memory_commits": f"""WITH {ISSUES}, s AS (SELECT o_custkey AS key, count(*) AS version FROM orders GROUP BY 1), r AS (SELECT issue_id, user_id AS key, k % 25 AS base, coalesce(version, 0) AS current FROM issues LEFT JOIN s ON user_id = key), t AS (SELECT *, row_number() OVER (PARTITION BY key, base = current ORDER BY issue_id) AS turn FROM r)
SELECT issue_id AS proposal_id, CASE WHEN base != current THEN 'drifted' WHEN turn = 1 THEN 'committed' ELSE 'superseded' END AS state, CASE WHEN base = current AND turn = 1 THEN current + 1 END AS new_version FROM t""",
    "invalid_objects": """WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT l_orderkey * 10 + l_linenumber AS run_id, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM p))
SELECT 'packet' AS object_type, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM p UNION ALL SELECT 'run', count(*), sum(run_id)::BIGINT FROM r UNION ALL SELECT 'segment', count(*), sum(l_partkey)::BIGINT FROM r""",
    "checkpoints": """WITH e AS (SELECT *, ts::DATE AS day FROM events), o AS (SELECT user_id, day, max(event_id) AS event_id FROM e WHERE event_type = 'error' GROUP BY ALL), n AS (SELECT user_id, day, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type, count(*) AS more FROM e WHERE event_type != 'error' GROUP BY ALL)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.day, n.day) AS day, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.event_type, 'error') AS event_type, CASE WHEN o.user_id IS NULL THEN 0 ELSE 1 END + coalesce(more, 0) AS generation FROM o FULL JOIN n ON o.user_id = n.user_id AND o.day = n.day""",
    "retired_proposals": f"WITH {ISSUES} SELECT issue_id, CASE WHEN status = 'open' AND created_at::DATE != max(created_at::DATE) OVER (PARTITION BY user_id) THEN 'rejected' ELSE status END AS state FROM issues",
    "payload_differences": """WITH a AS (SELECT *, lag(text) OVER w AS before, row_number() OVER w AS place FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text IS DISTINCT FROM before AS text_changed, text[1] IS DISTINCT FROM before[1] AS opening_changed, length(text) - length(before) AS size_delta, len(string_split(text, ' ')) - len(string_split(before, ' ')) AS word_delta FROM a WHERE place > 1""",
}
