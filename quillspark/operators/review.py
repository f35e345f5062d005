"""Issue analytics: hotspots, pressure, heat, queues, timelines, routing. Issues come from the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The moment that ages are counted to.
NOW = "2024-12-31 00:00:00"
ACTIVE = ("open", "triaged")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    rows = load(spark, sf_dir, "events").withColumn("k", F.coalesce(k, F.lit(0)))
    return rows.select(
        F.col("event_id").alias("issue_id"), F.col("event_type").alias("issue_type"), (F.col("user_id") % 40).alias("chapter_id"), (F.col("user_id") % 7).alias("owner_id"),
        F.when(F.col("k") % 4 == 0, "packet").when(F.col("k") % 4 == 1, "segment").when(F.col("k") % 4 == 2, "alignment").otherwise("structure").alias("layer"),
        F.when(F.col("k") % 5 == 1, "triaged").when(F.col("k") % 5 == 2, "resolved").when(F.col("k") % 5 == 3, "wontfix").otherwise("open").alias("status"),
        (F.col("k") % 3 == 0).alias("blocking"), F.col("ts").alias("created_at"), F.expr("ts + make_interval(0, 0, 0, 0, k, 0, 0)").alias("updated_at"), "user_id", "k",
    )


ISSUES = """issues AS (SELECT event_id AS issue_id, event_type AS issue_type, user_id % 40 AS chapter_id, user_id % 7 AS owner_id,
 CASE k % 4 WHEN 0 THEN 'packet' WHEN 1 THEN 'segment' WHEN 2 THEN 'alignment' ELSE 'structure' END AS layer,
 CASE k % 5 WHEN 1 THEN 'triaged' WHEN 2 THEN 'resolved' WHEN 3 THEN 'wontfix' ELSE 'open' END AS status,
 k % 3 = 0 AS blocking, ts AS created_at, ts + k * INTERVAL 1 HOUR AS updated_at, user_id, k
 FROM (SELECT *, coalesce(try_cast(regexp_extract(props, '[0-9]+') AS INT), 0) AS k FROM events))"""


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def status_counts() -> list[Column]:
    return [*[count_if(F.col("status") == s).alias(f"{s}_count") for s in ("open", "triaged", "resolved", "wontfix")], count_if(F.col("blocking")).alias("blocking_count")]


STATUS_SQL = ", ".join([*[f"count(*) FILTER (status = '{s}') AS {s}_count" for s in ("open", "triaged", "resolved", "wontfix")], "count(*) FILTER (blocking) AS blocking_count"])


def issue_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues(spark, sf_dir).groupBy("issue_type", "layer").agg(F.count("*").alias("issue_count"), *status_counts(), F.count_distinct("chapter_id").alias("chapter_count"), F.max("created_at").alias("latest_at"))
    return found.orderBy(F.desc("open_count"), F.desc("blocking_count"), F.desc("issue_count"), "issue_type", "layer")


def chapter_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(spark, sf_dir).groupBy("chapter_id").agg(F.count("*").alias("issue_count"), *status_counts(), F.max("created_at").alias("latest_at"))


def breakdown(found: DataFrame) -> DataFrame:
    active = F.col("blocking") & F.col("status").isin(*ACTIVE)
    return found.groupBy("chapter_id", "issue_type", "layer").agg(F.count("*").alias("issue_count"), *status_counts(), count_if(active).alias("active_blocking_count"))


def chapter_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breakdown(issues(spark, sf_dir))


BREAKDOWN = f"""breakdown AS (SELECT chapter_id, issue_type, layer, count(*) AS issue_count, {STATUS_SQL},
 count(*) FILTER (blocking AND status IN ('open', 'triaged')) AS active_blocking_count FROM issues GROUP BY ALL)"""


def heat(found: DataFrame) -> DataFrame:
    sums = ("issue_count", "open_count", "triaged_count", "active_blocking_count")
    weight = F.struct(F.col("open_count") + F.col("triaged_count"), "active_blocking_count", "issue_count", "issue_type")
    heads = breakdown(found).groupBy("chapter_id").agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("family_count"), F.max_by("issue_type", weight).alias("dominant_type"))
    score = 3 * F.col("open_count") + 2 * F.col("triaged_count") + 4 * F.col("active_blocking_count")
    level = F.when(score <= 0, "none").when(score <= 3, "low").when(score <= 6, "medium").when(score <= 11, "high").otherwise("critical")
    return heads.select("*", score.alias("heat_score"), level.alias("heat_level"))


def chapter_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat(issues(spark, sf_dir))


HEAT = """heat AS (SELECT *, CASE WHEN heat_score <= 0 THEN 'none' WHEN heat_score <= 3 THEN 'low' WHEN heat_score <= 6 THEN 'medium' WHEN heat_score <= 11 THEN 'high' ELSE 'critical' END AS heat_level FROM (
 SELECT chapter_id, sum(issue_count)::BIGINT AS issue_count, sum(open_count)::BIGINT AS open_count, sum(triaged_count)::BIGINT AS triaged_count, sum(active_blocking_count)::BIGINT AS active_blocking_count, count(*) AS family_count,
 arg_max(issue_type, row(open_count + triaged_count, active_blocking_count, issue_count, issue_type)) AS dominant_type,
 (3 * sum(open_count) + 2 * sum(triaged_count) + 4 * sum(active_blocking_count))::BIGINT AS heat_score FROM breakdown GROUP BY chapter_id))"""


def queued(found: DataFrame) -> DataFrame:
    """Chapters with active issues: priority, what drives it, age and SLA state, and what they are ranked by."""
    oldest = found.where(F.col("status").isin(*ACTIVE)).groupBy("chapter_id").agg(F.min("created_at").alias("oldest_active_at"), F.min("owner_id").alias("owner_id"))
    rows = heat(found).join(oldest, "chapter_id")
    priority = F.when(F.col("active_blocking_count") > 0, "immediate").when(F.col("heat_level").isin("high", "critical"), "high").otherwise("medium")
    rows = rows.withColumn("priority", priority).withColumn("sla_hours", F.when(priority == "immediate", 4).when(priority == "high", 24).otherwise(72))
    rows = rows.withColumn("age_hours", F.greatest(F.lit(0), F.floor((F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp("oldest_active_at")) / 3600)).cast("long"))
    sla = F.when(F.col("age_hours") * 2 < F.col("sla_hours"), "fresh").when(F.col("age_hours") < F.col("sla_hours"), "aging").otherwise("overdue")
    return rows.withColumn("sla_state", sla)


def ranked(rows: DataFrame, lead: list[str], fine: list[str], rest: list[Column], name: str) -> DataFrame:
    """rows with their rank in the order of the columns lead, fine and rest, all ascending, without all rows in one task: rows
    of equal lead and fine are numbered by themselves, behind the counts of those before. Only the counts of the values of
    lead, which must be few, are summed up in one task. No column of lead and fine may be null."""
    counts = rows.groupBy(*lead, *fine).agg(F.count("*").alias("_n"))
    up_to = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.withColumn("_inside", up_to(Window.partitionBy(*lead).orderBy(*fine))).drop("_n")
    ahead = counts.groupBy(*lead).agg(F.sum("_n").alias("_n")).withColumn("_ahead", up_to(Window.orderBy(*lead))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*lead, *fine).orderBy(*rest))
    placed = rows.withColumn("_own", own).join(inside, [*lead, *fine]).join(ahead, lead)
    return placed.withColumn(name, F.col("_ahead") + F.col("_inside") + F.col("_own")).drop("_ahead", "_inside", "_own")


def queue(found: DataFrame) -> DataFrame:
    """Chapters with active issues: priority, what drives it, age, SLA state and rank."""
    urgency = F.when(F.col("priority") == "immediate", 0).when(F.col("priority") == "high", 1).otherwise(2)
    rows = queued(found).withColumns({"_urgency": urgency, "_cool": -F.col("heat_score"), "_calm": -F.col("active_blocking_count"), "_idle": -F.col("open_count"), "_hour": F.date_trunc("hour", "oldest_active_at")})
    rows = ranked(rows, ["_urgency", "_cool"], ["_calm", "_idle", "_hour"], [F.col("oldest_active_at"), F.col("chapter_id")], "queue_rank")
    return rows.select("chapter_id", "owner_id", "priority", "sla_hours", "age_hours", "sla_state", "heat_score", "dominant_type", F.col("queue_rank").cast("int").alias("queue_rank"))


def chapter_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue(issues(spark, sf_dir))


QUEUE = f"""queue AS (SELECT chapter_id, owner_id, priority, sla_hours, age_hours, CASE WHEN age_hours * 2 < sla_hours THEN 'fresh' WHEN age_hours < sla_hours THEN 'aging' ELSE 'overdue' END AS sla_state, heat_score, dominant_type,
 (row_number() OVER (ORDER BY CASE priority WHEN 'immediate' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, heat_score DESC, active_blocking_count DESC, open_count DESC, oldest_active_at, chapter_id))::INT AS queue_rank
 FROM (SELECT *, CASE priority WHEN 'immediate' THEN 4 WHEN 'high' THEN 24 ELSE 72 END AS sla_hours, greatest(0, floor((epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(oldest_active_at))::BIGINT) / 3600))::BIGINT AS age_hours
 FROM (SELECT heat.*, o.oldest_active_at, o.owner_id, CASE WHEN active_blocking_count > 0 THEN 'immediate' WHEN heat_level IN ('high', 'critical') THEN 'high' ELSE 'medium' END AS priority
 FROM heat JOIN (SELECT chapter_id, min(created_at) AS oldest_active_at, min(owner_id) AS owner_id FROM issues WHERE status IN ('open', 'triaged') GROUP BY chapter_id) o USING (chapter_id))))"""


def owner_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = [count_if(F.col("priority") == p).alias(f"{p}_count") for p in ("immediate", "high", "medium")] + [count_if(F.col("sla_state") == s).alias(f"{s}_count") for s in ("fresh", "aging", "overdue")]
    return queued(issues(spark, sf_dir)).groupBy("owner_id").agg(F.count("*").alias("chapter_count"), *flags, F.sum("heat_score").alias("heat_score"), F.max("age_hours").alias("oldest_hours"))


def worklist_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = queued(issues(spark, sf_dir)).select(F.explode(F.array(F.struct(F.lit("priority").alias("kind"), F.col("priority").alias("value")), F.struct(F.lit("sla").alias("kind"), F.col("sla_state").alias("value")))).alias("c"))
    return rows.groupBy("c.kind", "c.value").agg(F.count("*").alias("chapter_count"))


def activity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: created, resolved, wontfix, net, and the running open count, shown as 0 at least."""
    found = issues(spark, sf_dir)
    made = found.select(F.to_date("created_at").alias("day"), F.lit("created").alias("what"))
    done = found.where(F.col("status").isin("resolved", "wontfix")).select(F.to_date("updated_at").alias("day"), F.col("status").alias("what"))
    days = made.union(done).groupBy("day").agg(*[count_if(F.col("what") == w).alias(f"{w}_count") for w in ("created", "resolved", "wontfix")])
    days = days.withColumn("net_delta", F.col("created_count") - F.col("resolved_count") - F.col("wontfix_count"))
    running = F.sum("net_delta").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("open_running", F.greatest(running, F.lit(0)))


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest and last run of issues without a resolution, per user (islands between resolutions)."""
    order = Window.partitionBy("user_id").orderBy("created_at", "issue_id")
    rows = issues(spark, sf_dir).withColumn("good", (F.col("status") == "resolved").cast("int")).withColumn("island", F.sum("good").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy("user_id", "island").agg(F.sum(1 - F.col("good")).alias("n"))
    return islands.groupBy("user_id").agg(F.max("n").alias("longest_streak"), F.max_by("n", "island").alias("last_streak"))


def budget_guardrails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event at which a user's running total passes a limit; the first limit that holds names the reason."""
    order = Window.partitionBy("user_id").orderBy("created_at", "issue_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = issues(spark, sf_dir).withColumn("spent", F.sum("k").over(order)).withColumn("calls", F.count("*").over(order))
    reason = F.when(F.col("spent") > 400, "cost").when(F.col("calls") > 8, "calls")
    stopped = rows.withColumn("reason", reason).where("reason is not null")
    return stopped.groupBy("user_id").agg(F.min_by(F.struct("issue_id", "reason", "spent", "calls"), F.struct("created_at", "issue_id")).alias("s")).select("user_id", "s.*")


def claimable_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 open items by priority, age and id; a top-k report of the queue."""
    return issues(spark, sf_dir).where("status = 'open'").select("issue_id", (F.col("k") % 10).alias("priority"), "created_at").orderBy("priority", "created_at", "issue_id").limit(50)


def expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("updated_at") < F.lit("2024-06-30 00:00:00").cast("timestamp")
    return issues(spark, sf_dir).where("status = 'triaged'").where(late).select("issue_id", F.lit("expired").alias("lease_status"), F.lit("retryable_failed").alias("item_status"))


def work_item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by layer and status; pairs that don't occur are 0."""
    found = issues(spark, sf_dir)
    layers = spark.createDataFrame([(x,) for x in ("alignment", "packet", "segment", "structure")], "layer string")
    states = spark.createDataFrame([(x,) for x in ("open", "triaged", "resolved", "wontfix", "blocked")], "status string")
    counts = found.groupBy("layer", "status").agg(F.count("*").alias("n"))
    return F.broadcast(layers).crossJoin(F.broadcast(states)).join(counts, ["layer", "status"], "left").select("layer", "status", F.coalesce("n", F.lit(0)).alias("item_count"))


def issue_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when((F.col("layer") == "packet") & F.col("blocking"), "rebuild_packet").when(F.col("layer") == "packet", "rerun_packet").when(F.col("layer") == "segment", "resegment").when(F.col("layer") == "alignment", "realign").when(F.col("blocking"), "reparse_document").otherwise("reparse_chapter")
    return issues(spark, sf_dir).withColumn("action", action).groupBy("issue_type", "layer", "blocking", "action").agg(F.count("*").alias("issue_count"))


def merge_duplicate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (chapter, type, layer): highest severity, any blocking, the statuses, the first id."""
    rank = F.when(F.col("blocking") & F.col("status").isin(*ACTIVE), 3).when(F.col("blocking"), 2).when(F.col("status").isin(*ACTIVE), 1).otherwise(0)
    return issues(spark, sf_dir).withColumn("rank", rank).groupBy("chapter_id", "issue_type", "layer").agg(F.max("rank").alias("severity_rank"), F.bool_or("blocking").alias("blocking"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("statuses"), F.min("issue_id").alias("first_issue_id"))


def incident_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    print_ = F.sha2(F.concat_ws("::", "issue_type", "layer", F.col("chapter_id").cast("string")), 256)
    return issues(spark, sf_dir).where("status != 'resolved'").groupBy(print_.alias("fingerprint")).agg(F.count("*").alias("failure_count"), F.max("issue_id").alias("latest_item_id"))


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = lambda layer: ~F.bool_or((F.col("layer") == layer) & F.col("status").isin(*ACTIVE))
    return issues(spark, sf_dir).groupBy("chapter_id").agg(F.count("*").alias("issue_count"), count_if(F.col("status") == "resolved").alias("resolved_count"), none("packet").alias("coverage_ok"), none("alignment").alias("alignment_ok"), none("segment").alias("term_ok"), none("structure").alias("format_ok"))


def activity_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per issue type the days with their counts, oldest first, as text; and the newest day's change."""
    days = issues(spark, sf_dir).groupBy("issue_type", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    return days.groupBy("issue_type").agg(F.count("*").alias("day_count"), F.sum("n").alias("issue_count"), F.max_by("n", "day").alias("newest_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "n"))), lambda x: F.concat_ws(":", x["day"].cast("string"), x["n"].cast("string"))), ",").alias("timeline"))


QUERIES = {f.__name__: f for f in (issue_hotspots, chapter_pressure, chapter_breakdown, chapter_heatmap, chapter_queue, owner_workload, worklist_counters, activity_timeline, failure_streaks, budget_guardrails, claimable_queue, expired_leases, work_item_counts, issue_actions, merge_duplicate_issues, incident_fingerprints, quality_summary, activity_by_family)}

_ACTIVE = "status IN ('open', 'triaged')"
SQL = {
    "issue_hotspots": f"WITH {ISSUES} SELECT issue_type, layer, count(*) AS issue_count, {STATUS_SQL}, count(DISTINCT chapter_id) AS chapter_count, max(created_at) AS latest_at FROM issues GROUP BY ALL",
    "chapter_pressure": f"WITH {ISSUES} SELECT chapter_id, count(*) AS issue_count, {STATUS_SQL}, max(created_at) AS latest_at FROM issues GROUP BY ALL",
    "chapter_breakdown": f"WITH {ISSUES}, {BREAKDOWN} SELECT * FROM breakdown",
    "chapter_heatmap": f"WITH {ISSUES}, {BREAKDOWN}, {HEAT} SELECT * FROM heat",
    "chapter_queue": f"WITH {ISSUES}, {BREAKDOWN}, {HEAT}, {QUEUE} SELECT * FROM queue",
    "owner_workload": f"WITH {ISSUES}, {BREAKDOWN}, {HEAT}, {QUEUE} SELECT owner_id, count(*) AS chapter_count, " + ", ".join([f"count(*) FILTER (priority = '{p}') AS {p}_count" for p in ("immediate", "high", "medium")] + [f"count(*) FILTER (sla_state = '{s}') AS {s}_count" for s in ("fresh", "aging", "overdue")]) + ", sum(heat_score)::BIGINT AS heat_score, max(age_hours) AS oldest_hours FROM queue GROUP BY owner_id",
    "worklist_counters": f"WITH {ISSUES}, {BREAKDOWN}, {HEAT}, {QUEUE} SELECT 'priority' AS kind, priority AS value, count(*) AS chapter_count FROM queue GROUP BY ALL UNION ALL SELECT 'sla', sla_state, count(*) FROM queue GROUP BY ALL",
    "activity_timeline": f"""WITH {ISSUES}, days AS (SELECT day, count(*) FILTER (what = 'created') AS created_count, count(*) FILTER (what = 'resolved') AS resolved_count, count(*) FILTER (what = 'wontfix') AS wontfix_count FROM (SELECT created_at::DATE AS day, 'created' AS what FROM issues UNION ALL SELECT updated_at::DATE, status FROM issues WHERE status IN ('resolved', 'wontfix')) GROUP BY day)
 SELECT *, created_count - resolved_count - wontfix_count AS net_delta, greatest(sum(created_count - resolved_count - wontfix_count) OVER (ORDER BY day), 0)::BIGINT AS open_running FROM days""",
    "failure_streaks": f"""WITH {ISSUES}, r AS (SELECT *, (status = 'resolved')::INT AS good, sum((status = 'resolved')::INT) OVER (PARTITION BY user_id ORDER BY created_at, issue_id ROWS UNBOUNDED PRECEDING) AS island FROM issues), i AS (SELECT user_id, island, sum(1 - good)::BIGINT AS n FROM r GROUP BY ALL)
 SELECT user_id, max(n) AS longest_streak, arg_max(n, island) AS last_streak FROM i GROUP BY user_id""",
    "budget_guardrails": f"""WITH {ISSUES}, r AS (SELECT *, sum(k) OVER w AS spent, count(*) OVER w AS calls FROM issues WINDOW w AS (PARTITION BY user_id ORDER BY created_at, issue_id ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, CASE WHEN spent > 400 THEN 'cost' WHEN calls > 8 THEN 'calls' END AS reason FROM r)
 SELECT user_id, issue_id, reason, spent::BIGINT AS spent, calls FROM s WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, issue_id) = 1""",
    "claimable_queue": f"WITH {ISSUES} SELECT issue_id, k % 10 AS priority, created_at FROM issues WHERE status = 'open' ORDER BY priority, created_at, issue_id LIMIT 50",
    "expired_leases": f"WITH {ISSUES} SELECT issue_id, 'expired' AS lease_status, 'retryable_failed' AS item_status FROM issues WHERE status = 'triaged' AND updated_at < TIMESTAMP '2024-06-30 00:00:00'",
    "work_item_counts": f"WITH {ISSUES} SELECT l.layer, s.status, count(issue_id) AS item_count FROM (VALUES ('alignment'), ('packet'), ('segment'), ('structure')) l(layer) CROSS JOIN (VALUES ('open'), ('triaged'), ('resolved'), ('wontfix'), ('blocked')) s(status) LEFT JOIN issues i ON i.layer = l.layer AND i.status = s.status GROUP BY ALL",
    "issue_actions": f"WITH {ISSUES} SELECT issue_type, layer, blocking, CASE WHEN layer = 'packet' AND blocking THEN 'rebuild_packet' WHEN layer = 'packet' THEN 'rerun_packet' WHEN layer = 'segment' THEN 'resegment' WHEN layer = 'alignment' THEN 'realign' WHEN blocking THEN 'reparse_document' ELSE 'reparse_chapter' END AS action, count(*) AS issue_count FROM issues GROUP BY ALL",
    "merge_duplicate_issues": f"WITH {ISSUES} SELECT chapter_id, issue_type, layer, max(CASE WHEN blocking AND {_ACTIVE} THEN 3 WHEN blocking THEN 2 WHEN {_ACTIVE} THEN 1 ELSE 0 END) AS severity_rank, bool_or(blocking) AS blocking, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, min(issue_id) AS first_issue_id FROM issues GROUP BY ALL",
    "incident_fingerprints": f"WITH {ISSUES} SELECT sha256(concat_ws('::', issue_type, layer, chapter_id)) AS fingerprint, count(*) AS failure_count, max(issue_id) AS latest_item_id FROM issues WHERE status != 'resolved' GROUP BY ALL",
    "quality_summary": f"WITH {ISSUES} SELECT chapter_id, count(*) AS issue_count, count(*) FILTER (status = 'resolved') AS resolved_count, " + ", ".join(f"NOT bool_or(layer = '{x}' AND {_ACTIVE}) AS {n}_ok" for x, n in (("packet", "coverage"), ("alignment", "alignment"), ("segment", "term"), ("structure", "format"))) + " FROM issues GROUP BY chapter_id",
    "activity_by_family": f"WITH {ISSUES}, d AS (SELECT issue_type, created_at::DATE AS day, count(*) AS n FROM issues GROUP BY ALL) SELECT issue_type, count(*) AS day_count, sum(n)::BIGINT AS issue_count, arg_max(n, day) AS newest_count, string_agg(day::VARCHAR || ':' || n::VARCHAR, ',' ORDER BY day) AS timeline FROM d GROUP BY issue_type",
}
