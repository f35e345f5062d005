"""What of a chapter's blocks is shown, how, and what stands inside another: captions and explanations go with their artifact.

Blocks are rows (doc_id, page, idx, block_type, role, policy, text, target, hidden, image, caption_idx, caption_of, protected,
top, bottom): caption_idx is the caption that an artifact names, caption_of the artifact that a caption names, protected
whether any of a block's sentences is. Null counts as false, and a null text or target as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.documents import BLOCKS, blocks
from quillspark.operators.layout import artifact_context

# Names of modes and kinds, and patterns that decide them.
TRANSLATED = "zh_primary_with_optional_source"
INLINE = "zh_primary_with_inline_protected_spans"
PRESERVED = "source_artifact_full_width"
WRAPPED = "translated_wrapper_with_preserved_artifact"
ANCHORED = "image_anchor_with_translated_caption"
REFERENCE = "reference_preserve_with_translated_label"
SOURCE_ONLY = (PRESERVED, WRAPPED, ANCHORED, REFERENCE)
FURNITURE = ("header", "footer", "toc_entry")
PICTURES, WRAPS = ("image", "figure"), ("table", "equation")
FIGURE_CAPTION = r"(?i)^(?:figure|fig\.?|image|diagram|chart)\s*[0-9A-Z]"
LITERAL = r"^\s*(?:https?://\S+|doi:\S+|[\w.+-]+@[\w-]+\.[\w.]+)\s*$"
CODE_START = r"^\s*(?:def |class |import |from \w+ import |#include|public |SELECT )"


def mode_and_kind() -> tuple[Column, Column]:
    """render_mode and artifact_kind of a block by itself; the first rule that holds."""
    kind, text, policy = F.col("block_type"), F.coalesce("text", F.lit("")), F.col("policy")
    code = (kind == "code") | (~kind.isin(*PICTURES, *WRAPS, "heading", "caption") & text.rlike(CODE_START))
    literal = text.rlike(LITERAL)
    mode = (
        F.when(F.coalesce("image", F.lit(False)) | ((kind == "caption") & text.rlike(FIGURE_CAPTION)), ANCHORED)
        .when(literal, REFERENCE).when(code, PRESERVED).when(kind == "table", WRAPPED).when(policy == "protect", PRESERVED)
        .when((policy == "mixed") | F.coalesce("protected", F.lit(False)), INLINE).otherwise(TRANSLATED)
    )
    artifact = (
        F.when(mode == ANCHORED, "image").when(mode == REFERENCE, "reference").when(kind.isin(*PICTURES, "equation"), kind)
        .when(code, "code").when(kind == "table", "table").when(mode == PRESERVED, "protected_artifact")
    )
    return mode, artifact


def claims(rows: DataFrame, reach: float, positions: int) -> DataFrame:
    """doc_id, idx and owner: the blocks that artifacts with a caption of their own take in, each by the first that asks."""
    role = F.when(F.col("block_type").isin(*PICTURES, *WRAPS), "artifact").when((F.col("block_type") == "paragraph") & F.coalesce(F.col("role") == "body", F.lit(True)), "body").otherwise("other")
    context = artifact_context(rows.select("doc_id", "page", "idx", role.alias("role"), "top", "bottom"), reach, positions)
    captions = rows.where("block_type = 'caption'").select("doc_id", F.col("idx").alias("caption_idx"))
    owners = rows.where(F.col("block_type").isin(*PICTURES, *WRAPS) & ~F.coalesce("hidden", F.lit(False)) & ~F.coalesce(F.col("role").isin(*FURNITURE), F.lit(False)))
    owners = owners.select("doc_id", "page", F.col("idx").alias("owner"), "caption_idx").join(captions, ["doc_id", "caption_idx"])
    owners = owners.join(context.select("doc_id", "page", F.col("idx").alias("owner"), "context"), ["doc_id", "page", "owner"])
    each = owners.select("doc_id", "owner", F.explode(F.array_append("context", F.col("caption_idx").cast("long"))).alias("idx"))
    return each.groupBy("doc_id", "idx").agg(F.min("owner").alias("owner"))


def assembled(rows: DataFrame, reach: float = 96.0, positions: int = 4) -> DataFrame:
    """A row for each block: doc_id, idx, state (`shown`, `absorbed`, `hidden` or `furniture`), owner (of an absorbed block),
    render_mode, artifact_kind, source_text, target_text, absorbed (the blocks inside, in order) and source_only.

    Pictures, tables and equations that name a caption take it in, with the body blocks below that explain them (see
    artifact_context). A block that several ask for goes to the first of them. A caption that names an artifact is absorbed
    by it even if no artifact names the caption. Pictures have their caption's text in place of their own; the targets of
    what is absorbed, caption first, are theirs.
    """
    taken = claims(rows, reach, positions)
    mode, artifact = mode_and_kind()
    own = F.when(F.coalesce("hidden", F.lit(False)), "hidden").when(F.col("role").isin(*FURNITURE), "furniture")
    all_rows = rows.join(taken, ["doc_id", "idx"], "left").withColumn("owner", F.coalesce("owner", F.when(F.col("block_type") == "caption", F.col("caption_of"))))
    all_rows = all_rows.withColumns({"own_mode": mode, "own_kind": artifact, "state": F.coalesce(own, F.when(F.col("owner").isNotNull(), "absorbed"), F.lit("shown"))})
    all_rows = all_rows.withColumn("owner", F.when(F.col("state") == "absorbed", F.col("owner")))
    # owners and what they take in lie together: no join back
    group = F.when(F.col("state") == "absorbed", F.col("owner")).otherwise(F.col("idx"))
    w = Window.partitionBy("doc_id", "group").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.collect_list(F.when(F.col("state") == "absorbed", F.struct((F.col("block_type") != "caption").alias("later"), "idx", "text", "target"))).over(w)
    found = all_rows.withColumn("group", group).withColumn("inside", F.array_sort(inside))
    kind = F.col("block_type")
    holds = (F.col("state") == "shown") & F.col("caption_idx").isNotNull() & (F.size("inside") > 0) & kind.isin(*PICTURES, *WRAPS)
    found = found.withColumn("holds", holds)
    caption = F.get(F.transform(F.filter("inside", lambda x: ~x["later"]), lambda x: x["text"]), F.lit(0))
    target = F.when(F.col("holds"), T.inline_joined(F.filter(F.transform("inside", lambda x: F.coalesce(x["target"], F.lit(""))), lambda x: x != ""))).otherwise(F.coalesce("target", F.lit("")))
    mode = F.when(F.col("holds") & kind.isin(*PICTURES), ANCHORED).when(F.col("holds"), WRAPPED).otherwise(F.col("own_mode"))
    shown = F.col("state") == "shown"
    artifact = F.when(F.col("holds") & kind.isin(*PICTURES), "image").otherwise(F.col("own_kind"))
    source = F.when(F.col("holds") & kind.isin(*PICTURES), F.coalesce(caption, F.lit(""))).otherwise(F.coalesce("text", F.lit("")))
    return found.select(
        "doc_id", "idx", "state", "owner", F.when(shown, mode).alias("render_mode"), F.when(shown, artifact).alias("artifact_kind"), F.when(shown, source).alias("source_text"), F.when(shown, F.nullif(target, F.lit(""))).alias("target_text"),
        F.when(F.col("holds"), F.array_sort(F.transform("inside", lambda x: x["idx"].cast("long")))).otherwise(F.array().cast("array<long>")).alias("absorbed"), F.when(shown, mode.isin(*SOURCE_ONLY)).alias("source_only"),
    )


def chapter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents, ten to a page: of each page the third is a figure or table that names the block behind it as its
    caption, the seventh an equation that in half of the pages names the same, and others are furniture, code or hidden."""
    n, size = F.col("ordinal"), F.length("block_text")
    k = n % 10
    w = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    rows = blocks(spark, sf_dir).withColumn("page", F.floor(n / 10).cast("long"))
    bottom = F.sum((12 + size % 120).cast("double")).over(w)
    kind = F.when(k == 2, F.element_at(F.array(*map(F.lit, ("figure", "image", "table"))), (size % 3 + 1).cast("int"))).when(k == 3, "caption").when(k == 6, "equation").when(size <= 40, "heading").when(size % 13 == 0, "code").otherwise("paragraph")
    caption = F.when(k == 2, n + 1).when((k == 6) & (size % 2 == 0), n - 3)
    return rows.select(
        "doc_id", "page", F.col("ordinal").cast("long").alias("idx"), kind.alias("block_type"), F.when(k == 9, "footer").otherwise("body").alias("role"), F.when(size % 11 == 0, "protect").when(size % 11 == 1, "mixed").otherwise("translate").alias("policy"),
        F.col("block_text").alias("text"), F.when(size % 7 > 0, F.concat(F.lit("T"), F.left("block_text", F.lit(5)))).alias("target"), (size % 17 == 0).alias("hidden"), ((k == 2) & (size % 5 == 0)).alias("image"), caption.cast("long").alias("caption_idx"), F.when((k == 3) & (size % 4 == 0), n - 1).cast("long").alias("caption_of"), (size % 3 == 0).alias("protected"), (bottom - 12).alias("top"), bottom.alias("bottom"),
    )


def assembled_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assembled(chapter_blocks(spark, sf_dir))
    return found.select("doc_id", "idx", "state", "owner", "render_mode", "artifact_kind", F.md5("source_text").alias("source_md5"), "target_text", F.array_join(F.col("absorbed").cast("array<string>"), ",").alias("absorbed"), "source_only")


QUERIES = {f.__name__: f for f in (assembled_chapters,)}
_LISTED = lambda names: "('" + "', '".join(names) + "')"
_GAP = "regexp_matches({a}, '[A-Za-z0-9]\\s*$') AND regexp_matches({b}, '^\\s*[A-Za-z0-9]')"
SQL = {
    "assembled_chapters": rf"""WITH {BLOCKS}, o AS (SELECT doc_id, ordinal // 10 AS page, ordinal AS n, ordinal % 10 AS k, length(block_text) AS size, block_text AS text FROM blocks),
r AS (SELECT doc_id, page, n::BIGINT AS idx, CASE WHEN k = 2 THEN ['figure', 'image', 'table'][size % 3 + 1] WHEN k = 3 THEN 'caption' WHEN k = 6 THEN 'equation' WHEN size <= 40 THEN 'heading' WHEN size % 13 = 0 THEN 'code' ELSE 'paragraph' END AS kind, CASE WHEN k = 9 THEN 'footer' ELSE 'body' END AS role,
CASE size % 11 WHEN 0 THEN 'protect' WHEN 1 THEN 'mixed' ELSE 'translate' END AS policy, text, CASE WHEN size % 7 > 0 THEN 'T' || left(text, 5) END AS target, size % 17 = 0 AS hidden, k = 2 AND size % 5 = 0 AS image, CASE WHEN k = 2 THEN n + 1 WHEN k = 6 AND size % 2 = 0 THEN n - 3 END AS caption_idx, CASE WHEN k = 3 AND size % 4 = 0 THEN n - 1 END AS caption_of, size % 3 = 0 AS protected, size % 120 AS gap FROM o),
a AS (SELECT *, kind IN ('figure', 'image', 'table', 'equation') AS artifact, kind != 'paragraph' OR role != 'body' OR gap > 96 AS stops, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS place FROM r),
x AS (SELECT p.doc_id, p.idx AS owner, q.idx, bool_or(q.stops) OVER (PARTITION BY p.doc_id, p.page, p.idx ORDER BY q.place ROWS UNBOUNDED PRECEDING) AS over FROM a p JOIN a q ON q.doc_id = p.doc_id AND q.page = p.page AND q.place BETWEEN p.place + 1 AND p.place + 4 WHERE p.artifact),
w AS (SELECT p.doc_id, p.idx AS owner, c.idx AS caption FROM a p JOIN a c ON c.doc_id = p.doc_id AND c.idx = p.caption_idx AND c.kind = 'caption' WHERE p.artifact AND NOT p.hidden AND p.role = 'body'),
t AS (SELECT doc_id, idx, min(owner) AS owner FROM (SELECT doc_id, owner, caption AS idx FROM w UNION ALL SELECT x.doc_id, x.owner, x.idx FROM x JOIN w ON w.doc_id = x.doc_id AND w.owner = x.owner WHERE NOT over) GROUP BY ALL),
s AS (SELECT a.*, coalesce(t.owner, CASE WHEN kind = 'caption' THEN caption_of END) AS asked, kind = 'code' OR (kind = 'paragraph' AND regexp_matches(text, '{CODE_START}')) AS code FROM a LEFT JOIN t ON t.doc_id = a.doc_id AND t.idx = a.idx),
m AS (SELECT *, CASE WHEN hidden THEN 'hidden' WHEN role = 'footer' THEN 'furniture' WHEN asked IS NOT NULL THEN 'absorbed' ELSE 'shown' END AS state, CASE WHEN image OR (kind = 'caption' AND regexp_matches(text, '{FIGURE_CAPTION}')) THEN '{ANCHORED}' WHEN regexp_matches(text, '{LITERAL}') THEN '{REFERENCE}' WHEN code THEN '{PRESERVED}' WHEN kind = 'table' THEN '{WRAPPED}' WHEN policy = 'protect' THEN '{PRESERVED}' WHEN policy = 'mixed' OR protected THEN '{INLINE}' ELSE '{TRANSLATED}' END AS mode FROM s),
i AS (SELECT doc_id, asked AS idx, count(*) AS held, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS absorbed, list(coalesce(target, '') ORDER BY kind != 'caption', idx) AS targets, arg_min(text, idx) FILTER (kind = 'caption') AS caption FROM m WHERE state = 'absorbed' GROUP BY ALL),
h AS (SELECT m.*, coalesce(state = 'shown' AND caption_idx IS NOT NULL AND held > 0 AND artifact, false) AS holds, absorbed, list_filter(targets, lambda z: z != '') AS targets, caption, kind IN ('figure', 'image') AS picture FROM m LEFT JOIN i ON i.doc_id = m.doc_id AND i.idx = m.idx),
z AS (SELECT *, CASE WHEN holds AND picture THEN '{ANCHORED}' WHEN holds THEN '{WRAPPED}' ELSE mode END AS render_mode FROM h)
SELECT doc_id, idx, state, CASE WHEN state = 'absorbed' THEN asked END AS owner, CASE WHEN state = 'shown' THEN render_mode END AS render_mode,
CASE WHEN state = 'shown' THEN CASE WHEN holds AND picture THEN 'image' WHEN mode = '{ANCHORED}' THEN 'image' WHEN mode = '{REFERENCE}' THEN 'reference' WHEN kind IN ('image', 'figure', 'equation') THEN kind WHEN code THEN 'code' WHEN kind = 'table' THEN 'table' WHEN mode = '{PRESERVED}' THEN 'protected_artifact' END END AS artifact_kind,
CASE WHEN state = 'shown' THEN md5(CASE WHEN holds AND picture THEN coalesce(caption, '') ELSE text END) END AS source_md5,
CASE WHEN state = 'shown' THEN nullif(CASE WHEN NOT holds THEN coalesce(target, '') WHEN len(targets) = 0 THEN '' ELSE list_reduce(targets, lambda p, q: p || CASE WHEN ({_GAP.format(a="p", b="q")}) OR (regexp_matches(p, '{T.AFTER_GAP.replace("'", "''")}') AND regexp_matches(q, '{T.BEFORE_GAP.replace("'", "''")}')) THEN ' ' ELSE '' END || q) END, '') END AS target_text,
CASE WHEN holds THEN absorbed ELSE '' END AS absorbed, CASE WHEN state = 'shown' THEN render_mode IN {_LISTED(SOURCE_ONLY)} END AS source_only FROM z""",
}
