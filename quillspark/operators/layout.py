"""Operators over blocks on pages: footnotes and anchors, layout checks, lines to blocks, headings and tables that go on,
artifacts and what belongs to them.

Each operator takes a DataFrame of blocks in reading order (doc_id, idx, ..) and parameters; the queries below make such
tables of the given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.documents import BLOCKS, blocks
from quillspark.operators.review import load

# They decide results.
ANCHORING = ("body", "heading", "caption")
CLOSING = r"""["'\])”’.,;:!?]"""
TAIL = 160
TERMINAL = r"[.!?:;]\s*$"


def anchor_pattern(marker: Column) -> Column:
    """What tells that a text ends with a marker, or that a new sentence follows it: the marker in brackets, alone, or, if
    it is a number, right behind a word."""
    safe = F.regexp_replace(marker, r"([^0-9A-Za-z])", r"\\$1")
    whole = F.concat(F.lit(r"(?:\[\s*"), safe, F.lit(r"\s*\]|\(\s*"), safe, F.lit(r"\s*\)|(?:^|\W)"), safe, F.lit(r")(?:" + CLOSING + r"*\s*$|\s+[A-Z])"))
    return F.when(marker.rlike("^[0-9]+$"), F.concat(whole, F.lit("|[A-Za-z]"), safe, F.lit(r"(?:" + CLOSING + r"|\s+[A-Z]|\s*$)"))).otherwise(whole)


def footnote_anchors(rows: DataFrame, pages_back: int = 1) -> DataFrame:
    """Of each footnote in rows (doc_id, idx, page, role, marker, text) the nearest block before it, at most pages_back
    pages back, whose end holds its marker: anchor_idx, null for an orphan. A null marker has no anchor."""
    notes = rows.where("role = 'footnote'").select("doc_id", "idx", "page", "marker")
    body = rows.where(F.col("role").isin(*ANCHORING)).select("doc_id", F.col("idx").alias("anchor_idx"), F.right(T.single_spaced(F.col("text")), F.lit(TAIL)).alias("tail"), F.explode(F.sequence(F.col("page"), F.col("page") + pages_back)).alias("page"))
    pairs = notes.where("marker is not null").withColumn("pattern", anchor_pattern(F.col("marker"))).join(body, ["doc_id", "page"]).where("anchor_idx < idx and tail rlike pattern")
    return notes.join(pairs.groupBy("doc_id", "idx").agg(F.max("anchor_idx").alias("anchor_idx")), ["doc_id", "idx"], "left").select("doc_id", "idx", "marker", "anchor_idx")


def islands(rows: DataFrame, by: list[str], order: str, begins: Column, name: str = "island") -> DataFrame:
    """rows with the number of the run that each belongs to; a run begins where begins holds."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn(name, F.sum(F.when(F.coalesce(begins, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def ordered_texts(order: str, text: str, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), glue)


def continued_footnotes(rows: DataFrame) -> DataFrame:
    """Footnotes of rows (doc_id, idx, page, role, marker, text) with the footnotes right behind them that have no marker,
    on the same page or the next: first_idx, parts and text."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    goes_on = (F.lag("role").over(w) == "footnote") & (F.col("role") == "footnote") & F.col("marker").isNull() & (F.col("page") - F.lag("page").over(w) <= 1)
    found = rows.withColumn("begins", ~F.coalesce(goes_on, F.lit(False)))
    found = islands(found, ["doc_id"], "idx", F.col("begins")).where("role = 'footnote'")
    return found.groupBy("doc_id", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("parts"), ordered_texts("idx", "text", " ").alias("text")).drop("island")


def continued_headings(rows: DataFrame, most: int = 60) -> DataFrame:
    """Headings of rows (doc_id, idx, page, text, is_heading) that follow one another without an end between, in one:
    first_idx, parts and text of at most `most` characters each."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    own = F.col("is_heading") & (F.length("text") <= most)
    found = rows.withColumn("own", own)
    goes_on = F.lag("own").over(w) & F.col("own") & (F.col("page") - F.lag("page").over(w) <= 1) & ~F.lag("text").over(w).rlike(TERMINAL)
    found = islands(found.withColumn("begins", ~F.coalesce(goes_on, F.lit(False))), ["doc_id"], "idx", F.col("begins")).where("own")
    return found.groupBy("doc_id", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("parts"), ordered_texts("idx", "text", " ").alias("text")).drop("island")


def table_fragments(rows: DataFrame) -> DataFrame:
    """Parts of tables in rows (doc_id, idx, page, n_columns; null for what is no table) that go on with as many columns on
    the same page or the next, in one: first_idx, parts, last_page."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    goes_on = (F.lag("n_columns").over(w) == F.col("n_columns")) & (F.col("page") - F.lag("page").over(w) <= 1)
    found = islands(rows.withColumn("begins", ~F.coalesce(goes_on, F.lit(False))), ["doc_id"], "idx", F.col("begins")).where("n_columns is not null")
    return found.groupBy("doc_id", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("parts"), F.max("page").alias("last_page")).drop("island")


def lines_to_blocks(rows: DataFrame) -> DataFrame:
    """Lines (doc_id, page, idx, x, y, height, text, is_heading, page_width) to blocks of a page: headings stand alone; a
    block ends at a gap over 1.15 median heights (14 at least), and where lines are shifted by over 8 % of the page's width
    (1.6 median heights at least) behind the end of a sentence."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    found = rows.withColumn("middle", F.median("height").over(Window.partitionBy("doc_id", "page")))
    gap = F.col("y") - F.lag(F.col("y") + F.col("height")).over(w)
    shift = F.abs(F.col("x") - F.lag("x").over(w))
    split = (gap > F.greatest(1.15 * F.col("middle"), F.lit(14.0))) | ((shift > F.greatest(0.08 * F.col("page_width"), 1.6 * F.col("middle"))) & F.lag("text").over(w).rlike(TERMINAL))
    found = found.withColumn("begins", split | F.col("is_heading") | F.lag("is_heading").over(w))
    found = islands(found, ["doc_id", "page"], "idx", F.col("begins"), "block")
    return found.groupBy("doc_id", "page", "block").agg(F.count("*").alias("line_count"), F.min("y").alias("top"), F.max(F.col("y") + F.col("height")).alias("bottom"), ordered_texts("idx", "text", " ").alias("text"))


def layout_issues(rows: DataFrame) -> DataFrame:
    """What is wrong with blocks (doc_id, idx, block_type, level, text, has_asset, anchor_matched): a row for each issue."""
    text = T.single_spaced(F.col("text"))
    order = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("block_type") == "heading", F.col("level")), ignorenulls=True).over(order)
    kind = lambda *k: F.col("block_type").isin(*k)
    rules = (
        ("HEADING_EMPTY", "high", kind("heading") & (text == "")),
        ("HEADING_LEVEL_SKIP", "high", kind("heading") & (F.col("level") > F.col("before") + 1)),
        ("FIGURE_ASSET_MISSING", "high", kind("image", "figure") & ~F.coalesce(F.col("has_asset"), F.lit(False))),
        ("FOOTNOTE_EMPTY", "high", kind("footnote") & (text == "")),
        ("FOOTNOTE_ANCHOR_ORPHANED", "medium", kind("footnote") & (F.col("anchor_matched") == F.lit(False))),
        ("TABLE_EMPTY", "high", kind("table") & (text == "")),
        ("TABLE_STRUCTURE_UNRENDERABLE", "high", kind("table") & (text != "") & ~T.is_plain_table(F.col("text"))),
    )
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("issue_code"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    return rows.withColumn("before", before).select("doc_id", "idx", F.explode(found).alias("i")).select("doc_id", "idx", "i.issue_code", "i.severity")


def artifact_context(rows: DataFrame, reach: float = 96.0, positions: int = 4) -> DataFrame:
    """Of each artifact in rows (doc_id, page, idx, role, top, bottom) the body blocks below it on its page that explain it:
    at most `positions` places ahead, none over `reach` below what it follows; the first block that isn't body ends them."""
    w = Window.partitionBy("doc_id", "page").orderBy("idx")
    found = rows.withColumn("gap", F.col("top") - F.lag("bottom").over(w)).withColumn("stops", (F.col("role") != "body") | (F.col("gap") > reach))
    ahead = w.rowsBetween(1, positions)
    near = F.collect_list(F.struct("idx", "stops")).over(ahead)
    context = F.aggregate(near, F.struct(F.array().cast("array<long>").alias("ids"), F.lit(False).alias("over")), lambda a, x: F.struct(F.when(a["over"] | x["stops"], a["ids"]).otherwise(F.array_append(a["ids"], x["idx"].cast("long"))).alias("ids"), (a["over"] | x["stops"]).alias("over")), lambda a: a["ids"])
    return found.withColumn("context", context).where("role = 'artifact'").select("doc_id", "page", "idx", "context")


def column_pages(rows: DataFrame, width: float) -> DataFrame:
    """Pages of rows (doc_id, page, x0, x1, top, bottom) with two columns: two narrow blocks at least on either side, which
    stand beside one another."""
    narrow = F.col("x1") - F.col("x0") < 0.55 * width
    left, right = narrow & (F.col("x1") <= 0.55 * width), narrow & (F.col("x0") >= 0.45 * width)
    edge = lambda f, c, side: f(F.when(side, F.col(c)))
    found = rows.groupBy("doc_id", "page").agg(F.count_if(left).alias("left_count"), F.count_if(right).alias("right_count"), *[edge(f, c, s).alias(f"{n}_{c}") for n, s in (("l", left), ("r", right)) for f, c in ((F.min, "top"), (F.max, "bottom"))])
    beside = F.coalesce((F.col("l_top") < F.col("r_bottom")) & (F.col("r_top") < F.col("l_bottom")), F.lit(False))
    return found.select("doc_id", "page", "left_count", "right_count", ((F.col("left_count") >= 2) & (F.col("right_count") >= 2) & beside).alias("two_columns"))


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents, ten to a page; each fourth is a footnote, and others end with the marker of one that may follow."""
    n = F.col("ordinal")
    marker = F.when(n % 8 == 3, ((n / 4).cast("int") % 5).cast("string")).when((n % 8 == 7) & (n % 3 > 0), "*")
    text = F.when(n % 4 == 3, F.col("block_text")).when(n % 4 == 1, F.concat("block_text", F.lit("["), ((n / 4).cast("int") % 4).cast("string"), F.lit("]."))).when(n % 8 == 6, F.concat("block_text", F.lit(" *"))).otherwise(F.col("block_text"))
    return blocks(spark, sf_dir).select("doc_id", n.alias("idx"), (n / 10).cast("int").alias("page"), F.when(n % 4 == 3, "footnote").otherwise("body").alias("role"), F.when(n % 4 == 3, marker).alias("marker"), text.alias("text"))


_NOTED = BLOCKS + """, noted AS (SELECT doc_id, ordinal AS idx, ordinal // 10 AS page, CASE WHEN ordinal % 4 = 3 THEN 'footnote' ELSE 'body' END AS role, CASE WHEN ordinal % 8 = 3 THEN (ordinal // 4 % 5)::VARCHAR WHEN ordinal % 8 = 7 AND ordinal % 3 > 0 THEN '*' END AS marker,
CASE WHEN ordinal % 4 = 3 THEN block_text WHEN ordinal % 4 = 1 THEN block_text || '[' || ordinal // 4 % 4 || '].' WHEN ordinal % 8 = 6 THEN block_text || ' *' ELSE block_text END AS text FROM blocks)"""


def linked_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return footnote_anchors(noted(spark, sf_dir))


def merged_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footnotes and what goes on with them, of blocks of which every other two are footnotes."""
    rows = noted(spark, sf_dir).withColumn("role", F.when(F.col("idx") % 4 >= 2, "footnote").otherwise("body"))
    return continued_footnotes(rows).withColumn("text", F.md5("text"))


def merged_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continued_headings(noted(spark, sf_dir).select("doc_id", "idx", "page", "text", (F.length("text") <= 60).alias("is_heading"))).withColumn("text", F.md5("text"))


def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks as parts of tables with as many columns as they have sentences, if these are two to four."""
    columns = F.size(F.split("text", r"\. "))
    return table_fragments(noted(spark, sf_dir).select("doc_id", "idx", "page", F.when(columns.between(2, 4), columns).alias("n_columns")))


def scanned_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents as lines of a scan, whose heights and gaps come from their lengths."""
    n = F.length("block_text")
    height, w = (10 + n % 5).cast("double"), Window.partitionBy("doc_id", "page").orderBy("ordinal")
    rows = blocks(spark, sf_dir).withColumn("page", (F.col("ordinal") / 10).cast("int")).withColumn("height", height)
    y = F.sum(F.col("height") + F.length("block_text") % 17).over(w) - F.col("height")
    rows = rows.select("doc_id", "page", F.col("ordinal").alias("idx"), ((n % 7) * 20).cast("double").alias("x"), y.alias("y"), "height", F.col("block_text").alias("text"), (n <= 20).alias("is_heading"), F.lit(600.0).alias("page_width"))
    return lines_to_blocks(rows).withColumn("text", F.md5("text"))


def checked_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of blocks whose kinds, levels, assets and anchors come from their places."""
    n = F.col("ordinal")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("heading", "figure", "footnote", "table", "paragraph")]), n % 5 + 1)
    text = F.when(n % 15 == 0, F.lit("  ")).when(n % 10 == 2, F.lit("")).when((n % 10 == 3) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("a | b\n--|--\n"), F.left("block_text", F.lit(5)), F.lit(" | d"))).when(n % 20 == 8, F.lit("")).otherwise(F.col("block_text"))
    rows = blocks(spark, sf_dir).select("doc_id", n.alias("idx"), kind.alias("block_type"), (F.length("block_text") % 4 + 1).alias("level"), text.alias("text"), F.when(n % 4 > 0, n % 2 == 0).alias("has_asset"), F.when(n % 3 > 0, n % 3 == 1).alias("anchor_matched"))
    return layout_issues(rows)


def explained_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sixth block is an artifact, every seventh a heading; heights and gaps come from lengths."""
    w = Window.partitionBy("doc_id", "page").orderBy("ordinal")
    n, size = F.col("ordinal"), F.length("block_text")
    rows = blocks(spark, sf_dir).withColumn("page", (n / 10).cast("int"))
    bottom = F.sum((12 + size % 120).cast("double")).over(w)
    role = F.when(n % 6 == 2, "artifact").when(n % 7 == 0, "heading").otherwise("body")
    found = artifact_context(rows.select("doc_id", "page", n.alias("idx"), role.alias("role"), (bottom - 12).alias("top"), bottom.alias("bottom")))
    return found.select("doc_id", "page", "idx", F.array_join(F.col("context").cast("array<string>"), ",").alias("context"))


def two_column_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks on the left, on the right or over the whole width, by their lengths."""
    n, size = F.col("ordinal"), F.length("block_text")
    x0 = F.when(size % 5 < 2, 40.0).when(size % 5 < 4, 320.0).otherwise(40.0)
    x1 = F.when(size % 5 < 2, 290.0).otherwise(560.0)
    return column_pages(blocks(spark, sf_dir).select("doc_id", (n / 10).cast("int").alias("page"), x0.alias("x0"), x1.alias("x1"), (n % 10 * 50).cast("double").alias("top"), (n % 10 * 50 + 45).cast("double").alias("bottom")), 600.0)


QUERIES = {f.__name__: f for f in (linked_footnotes, merged_footnotes, merged_headings, merged_tables, scanned_blocks, checked_layout, explained_artifacts, two_column_pages)}

_sql = lambda x: x.replace("'", "''")
_ISLAND = "sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island"
_CELLS = "list_filter(list_transform(string_split(x, '|'), lambda c: trim(c)), lambda c: c != '')"
_WIDE = "list_filter(list_transform(string_split_regex(x, '\\t+|\\s{2,}'), lambda c: trim(c)), lambda c: c != '')"
SQL = {
    "linked_footnotes": f"""WITH {_NOTED}, f AS (SELECT doc_id, idx, page, marker, CASE WHEN marker = '*' THEN '\\*' ELSE marker END AS m FROM noted WHERE role = 'footnote'), b AS (SELECT doc_id, idx, page, right(trim(regexp_replace(text, '\\s+', ' ', 'g')), {TAIL}) AS tail FROM noted WHERE role = 'body'),
p AS (SELECT f.doc_id, f.idx, max(b.idx) AS anchor_idx FROM f JOIN b ON b.doc_id = f.doc_id AND b.idx < f.idx AND b.page >= f.page - 1 AND regexp_matches(tail, '(?:\\[\\s*' || m || '\\s*\\]|\\(\\s*' || m || '\\s*\\)|(?:^|\\W)' || m || ')(?:{_sql(CLOSING)}*\\s*$|\\s+[A-Z])' || CASE WHEN marker = '*' THEN '' ELSE '|[A-Za-z]' || m || '(?:{_sql(CLOSING)}|\\s+[A-Z]|\\s*$)' END) GROUP BY ALL)
SELECT f.doc_id, f.idx, marker, anchor_idx FROM f LEFT JOIN p ON p.doc_id = f.doc_id AND p.idx = f.idx""",
    "merged_footnotes": f"""WITH {_NOTED}, r AS (SELECT doc_id, idx, page, marker, text, idx % 4 >= 2 AS note FROM noted), g AS (SELECT *, note AND marker IS NULL AND coalesce(lag(note) OVER w AND page - lag(page) OVER w <= 1, false) AS goes_on FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), i AS (SELECT *, {_ISLAND} FROM g)
SELECT doc_id, min(idx) AS first_idx, count(*) AS parts, md5(string_agg(text, ' ' ORDER BY idx)) AS text FROM i WHERE note GROUP BY doc_id, island""",
    "merged_headings": f"""WITH {_NOTED}, r AS (SELECT doc_id, idx, page, text, length(text) <= 60 AS own FROM noted), g AS (SELECT *, own AND coalesce(lag(own) OVER w AND page - lag(page) OVER w <= 1 AND NOT regexp_matches(lag(text) OVER w, '{TERMINAL}'), false) AS goes_on FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), i AS (SELECT *, {_ISLAND} FROM g)
SELECT doc_id, min(idx) AS first_idx, count(*) AS parts, md5(string_agg(text, ' ' ORDER BY idx)) AS text FROM i WHERE own GROUP BY doc_id, island""",
    "merged_tables": f"""WITH {_NOTED}, r AS (SELECT doc_id, idx, page, CASE WHEN len(string_split(text, '. ')) BETWEEN 2 AND 4 THEN len(string_split(text, '. ')) END AS n FROM noted), g AS (SELECT *, coalesce(n = lag(n) OVER w AND page - lag(page) OVER w <= 1, false) AS goes_on FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), i AS (SELECT *, {_ISLAND} FROM g)
SELECT doc_id, min(idx) AS first_idx, count(*) AS parts, max(page) AS last_page FROM i WHERE n IS NOT NULL GROUP BY doc_id, island""",
    "scanned_blocks": f"""WITH {BLOCKS}, l AS (SELECT doc_id, ordinal AS idx, ordinal // 10 AS page, block_text AS text, length(block_text) AS n, (10 + length(block_text) % 5)::DOUBLE AS height FROM blocks), y AS (SELECT *, sum(height + n % 17) OVER (PARTITION BY doc_id, page ORDER BY idx ROWS UNBOUNDED PRECEDING) - height AS y, (n % 7 * 20)::DOUBLE AS x, n <= 20 AS head, median(height) OVER (PARTITION BY doc_id, page) AS middle FROM l),
g AS (SELECT *, NOT coalesce(y - lag(y + height) OVER w > greatest(1.15 * middle, 14) OR (abs(x - lag(x) OVER w) > greatest(48, 1.6 * middle) AND regexp_matches(lag(text) OVER w, '{TERMINAL}')) OR head OR lag(head) OVER w, true) AS goes_on FROM y WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx)), i AS (SELECT *, (sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY idx ROWS UNBOUNDED PRECEDING))::BIGINT AS block FROM g)
SELECT doc_id, page, block, count(*) AS line_count, min(y) AS top, max(y + height) AS bottom, md5(string_agg(text, ' ' ORDER BY idx)) AS text FROM i GROUP BY ALL""",
    "checked_layout": f"""WITH {BLOCKS}, r AS (SELECT doc_id, ordinal AS n, ['heading', 'figure', 'footnote', 'table', 'paragraph'][ordinal % 5 + 1] AS kind, length(block_text) % 4 + 1 AS level, CASE WHEN ordinal % 15 = 0 THEN '  ' WHEN ordinal % 10 = 2 THEN '' WHEN ordinal % 10 = 3 AND doc_id % 2 = 0 THEN 'a | b' || chr(10) || '--|--' || chr(10) || left(block_text, 5) || ' | d' WHEN ordinal % 20 = 8 THEN '' ELSE block_text END AS text FROM blocks),
h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN level END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, trim(text) = '' AS empty, list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x != ''), lambda x: CASE WHEN contains(x, '|') AND len({_CELLS}) >= 2 THEN {_CELLS} WHEN len({_WIDE}) >= 2 THEN {_WIDE} END) AS cells FROM r),
t AS (SELECT *, list_filter(cells, lambda c: c IS NULL OR len(list_filter(c, lambda q: NOT regexp_full_match(q, ':?-{{2,}}:?|={{2,}}'))) > 0) AS rows FROM h),
i AS (SELECT doc_id, n, unnest(list_filter([CASE WHEN kind = 'heading' AND empty THEN 'HEADING_EMPTY' END, CASE WHEN kind = 'heading' AND level > before + 1 THEN 'HEADING_LEVEL_SKIP' END, CASE WHEN kind = 'figure' AND NOT (n % 4 > 0 AND n % 2 = 0) THEN 'FIGURE_ASSET_MISSING' END, CASE WHEN kind = 'footnote' AND empty THEN 'FOOTNOTE_EMPTY' END, CASE WHEN kind = 'footnote' AND n % 3 = 2 THEN 'FOOTNOTE_ANCHOR_ORPHANED' END, CASE WHEN kind = 'table' AND empty THEN 'TABLE_EMPTY' END,
CASE WHEN kind = 'table' AND NOT empty AND NOT coalesce(len(rows) >= 2 AND len(rows[1]) BETWEEN 2 AND 8 AND len(list_filter(rows, lambda c: c IS NULL OR len(c) != len(rows[1]))) = 0, false) THEN 'TABLE_STRUCTURE_UNRENDERABLE' END], lambda x: x IS NOT NULL)) AS issue_code FROM t)
SELECT doc_id, n AS idx, issue_code, CASE WHEN issue_code = 'FOOTNOTE_ANCHOR_ORPHANED' THEN 'medium' ELSE 'high' END AS severity FROM i""",
    "explained_artifacts": f"""WITH {BLOCKS}, b AS (SELECT doc_id, ordinal // 10 AS page, ordinal AS idx, CASE WHEN ordinal % 6 = 2 THEN 'artifact' WHEN ordinal % 7 = 0 THEN 'heading' ELSE 'body' END AS role, length(block_text) % 120 AS gap FROM blocks), s AS (SELECT *, role != 'body' OR gap > 96 AS stops, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS place FROM b),
c AS (SELECT a.doc_id, a.page, a.idx, x.idx AS other, bool_or(x.stops) OVER (PARTITION BY a.doc_id, a.page, a.idx ORDER BY x.place ROWS UNBOUNDED PRECEDING) AS over FROM s a JOIN s x ON x.doc_id = a.doc_id AND x.page = a.page AND x.place BETWEEN a.place + 1 AND a.place + 4 WHERE a.role = 'artifact')
SELECT s.doc_id, s.page, s.idx, coalesce(string_agg(other::VARCHAR, ',' ORDER BY other) FILTER (NOT over), '') AS context FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.page = s.page AND c.idx = s.idx WHERE s.role = 'artifact' GROUP BY ALL""",
    "two_column_pages": f"""WITH {BLOCKS}, b AS (SELECT doc_id, ordinal // 10 AS page, length(block_text) % 5 < 2 AS l, length(block_text) % 5 IN (2, 3) AS r, ordinal % 10 * 50 AS top, ordinal % 10 * 50 + 45 AS bottom FROM blocks)
SELECT doc_id, page, count(*) FILTER (l) AS left_count, count(*) FILTER (r) AS right_count, count(*) FILTER (l) >= 2 AND count(*) FILTER (r) >= 2 AND coalesce(min(top) FILTER (l) < max(bottom) FILTER (r) AND min(top) FILTER (r) < max(bottom) FILTER (l), false) AS two_columns FROM b GROUP BY ALL""",
}
