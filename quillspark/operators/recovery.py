"""Raw blocks to the blocks of a document, by a chain of passes that know where each line came from.

A block is a row (doc_id, at, page, last_page, role, level, lines, flags): lines are structs (idx, line, text) of the raw
blocks' lines, and at is the first one's (idx, line), by which blocks are ordered. A pass joins blocks, cuts them or gives
them another role, never touches a line, and adds its flag to what it changed; so the lines of all blocks are those of the
raw blocks, each once. Passes take and give the same columns and are put together freely. All work inside a document, so
the whole chain needs the one shuffle that brings its blocks together.

Raw blocks (doc_id, idx, page, role, level, text): idx is unique in a document. A null text is one empty line, a null role
`body`, a null page 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from quillspark.operators.documents import blocks
from quillspark.operators.layout import TERMINAL
from quillspark.operators.repairs import CODE_LINE, SENTENCE

Pass = Callable[[DataFrame], DataFrame]
KEPT = ("doc_id", "at", "page", "last_page", "role", "level", "lines", "flags")
CAPTION = r"(?i)^\s*(?:figure|fig\.|table|listing)\s*[0-9]"


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("at")


def raw_blocks(rows: DataFrame) -> DataFrame:
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(F.col("idx").cast("long").alias("idx"), i.cast("int").alias("line"), x.alias("text")))
    page = F.coalesce(F.col("page").cast("long"), F.lit(0))
    return rows.select("doc_id", F.struct(F.col("idx").cast("long").alias("idx"), F.lit(0).alias("line")).alias("at"), page.alias("page"), page.alias("last_page"), F.coalesce("role", F.lit("body")).alias("role"), F.col("level").cast("int").alias("level"), lines.alias("lines"), F.array().cast("array<string>").alias("flags"))


def text_of(lines: str | Column = "lines") -> Column:
    return F.array_join(F.transform(lines, lambda x: x["text"]), "\n")


def told(rows: DataFrame, when: Column, role: Column, flag: str) -> DataFrame:
    """rows with another role and the flag where the condition holds."""
    rows = rows.withColumn("changes", F.coalesce(when, F.lit(False)))
    return rows.withColumns({"role": F.when(F.col("changes"), role).otherwise(F.col("role")), "flags": F.when(F.col("changes"), F.array_append("flags", F.lit(flag))).otherwise(F.col("flags"))}).select(*KEPT)


def joined_runs(rows: DataFrame, goes_on: Column, flag: str) -> DataFrame:
    """rows with each block for which goes_on holds joined to the one before it."""
    rows = rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))).withColumn("run", F.count_if(~F.col("goes_on")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, "at").alias(c)
    parts = F.array_sort(F.collect_list(F.struct("at", "lines", "flags")))
    found = rows.groupBy("doc_id", "run").agg(F.min("at").alias("at"), first("page"), F.max("last_page").alias("last_page"), first("role"), first("level"), parts.alias("parts"))
    flags = F.flatten(F.transform("parts", lambda p: p["flags"]))
    flags = F.array_distinct(F.when(F.size("parts") > 1, F.array_append(flags, F.lit(flag))).otherwise(flags))
    return found.select("doc_id", "at", "page", "last_page", "role", "level", F.flatten(F.transform("parts", lambda p: p["lines"])).alias("lines"), flags.alias("flags"))


def near_before() -> Column:
    """Whether a block begins on the page where the one before ends, or on the next."""
    return F.col("page") - F.lag("last_page").over(in_order()) <= 1


def edge_texts(least: int = 3) -> Pass:
    """The first and last block of a page become `header` and `footer` where their text, digits aside, stands at that edge of
    `least` pages; a page's only block is neither."""

    def run(rows: DataFrame) -> DataFrame:
        page = Window.partitionBy("doc_id", "page")
        down = page.orderBy("at")
        rows = rows.withColumns({"from_top": F.row_number().over(down), "size": F.count("*").over(page), "mask": F.regexp_replace(text_of(), "[0-9]+", "#")})
        edge = F.when(F.col("size") == 1, "").when(F.col("from_top") == 1, "header").when(F.col("from_top") == F.col("size"), "footer").otherwise("")
        rows = rows.withColumn("edge", edge).withColumn("same", F.count("*").over(Window.partitionBy("doc_id", "edge", "mask")))
        return told(rows, (F.col("edge") != "") & (F.trim("mask") != "") & (F.col("same") >= least), F.col("edge"), "edge_text")

    return run


def heading_levels(rows: DataFrame) -> DataFrame:
    """Headings without a level have that of the heading before, or 1."""
    known = F.last(F.when(F.col("role") == "heading", F.col("level")), ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("level", F.when(F.col("role") == "heading", F.coalesce("level", known, F.lit(1))).otherwise(F.col("level"))).select(*KEPT)


def joined_headings(rows: DataFrame) -> DataFrame:
    """A heading goes on with the next of its level, unless it ends like a sentence."""
    text = text_of()
    goes_on = (F.col("role") == "heading") & (F.lag("role").over(in_order()) == "heading") & (F.lag("level").over(in_order()) == F.col("level")) & near_before() & ~F.lag(text.rlike(TERMINAL)).over(in_order())
    return joined_runs(rows, goes_on, "heading_joined")


def prose_again(least_words: int = 8) -> Pass:
    """Code of least_words words or more in which no line looks like code is body."""

    def run(rows: DataFrame) -> DataFrame:
        words = F.size(F.regexp_extract_all(text_of(), F.lit(r"([^\s]+)"), F.lit(1)))
        return told(rows, (F.col("role") == "code") & (words >= least_words) & ~F.exists("lines", lambda x: x["text"].rlike(CODE_LINE)), F.lit("body"), "prose")

    return run


def joined_code(rows: DataFrame) -> DataFrame:
    return joined_runs(rows, (F.col("role") == "code") & (F.lag("role").over(in_order()) == "code") & near_before(), "code_joined")


def cut_kinds(rows: DataFrame) -> DataFrame:
    """Code and body blocks are cut where lines that look like code meet others; blank lines go with what is before them."""
    each = rows.select(*[c for c in KEPT if c != "lines"], F.posexplode("lines").alias("n", "held"))
    inside = Window.partitionBy("doc_id", "at").orderBy("n")
    own = F.when(F.trim("held.text") != "", F.when(F.col("held.text").rlike(CODE_LINE), "code").otherwise("body"))
    each = each.withColumn("own", F.when(F.col("role").isin("code", "body"), own))
    # blank lines before all others belong to the first
    so_far = F.last("own", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("own", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    each = each.withColumn("kind", F.coalesce(so_far, ahead, F.col("role")))
    each = each.withColumn("piece", F.count_if(F.coalesce(F.lag("kind").over(inside) != F.col("kind"), F.lit(False))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    each = each.withColumn("pieces", F.max("piece").over(Window.partitionBy("doc_id", "at")))
    found = each.groupBy("doc_id", "at", "piece", "kind", "pieces").agg(*[F.first(c).alias(c) for c in ("page", "last_page", "level", "flags")], F.array_sort(F.collect_list("held")).alias("lines"))
    cut = F.col("pieces") > 0
    at = F.when(F.col("piece") == 0, F.col("at")).otherwise(F.struct(F.get("lines", F.lit(0))["idx"].alias("idx"), F.get("lines", F.lit(0))["line"].alias("line")))
    return found.select("doc_id", at.alias("at"), "page", "last_page", F.col("kind").alias("role"), "level", "lines", F.when(cut, F.array_distinct(F.array_append("flags", F.lit("cut")))).otherwise(F.col("flags")).alias("flags"))


def late_code(rows: DataFrame) -> DataFrame:
    """A body between two blocks of code is code, unless it is a sentence."""
    return told(rows, (F.col("role") == "body") & (F.lag("role").over(in_order()) == "code") & (F.lead("role").over(in_order()) == "code") & ~text_of().rlike(SENTENCE), F.lit("code"), "promoted")


def cells(line: Column) -> Column:
    return F.size(F.split(line["text"], r"\|"))


def late_tables(rows: DataFrame) -> DataFrame:
    """A body of two lines or more with as many cells in each is a table."""
    first = cells(F.get("lines", F.lit(0)))
    return told(rows, (F.col("role") == "body") & (F.size("lines") > 1) & (first > 1) & F.forall("lines", lambda x: cells(x) == first), F.lit("table"), "table")


def joined_tables(rows: DataFrame) -> DataFrame:
    width = cells(F.get("lines", F.lit(0)))
    return joined_runs(rows, (F.col("role") == "table") & (F.lag("role").over(in_order()) == "table") & near_before() & (F.lag(width).over(in_order()) == width), "table_joined")


def captions(rows: DataFrame) -> DataFrame:
    """A body that begins like a caption beside a table, figure or code is one."""
    beside = F.lag("role").over(in_order()).isin("table", "figure", "code") | F.coalesce(F.lead("role").over(in_order()).isin("table", "figure", "code"), F.lit(False))
    return told(rows, (F.col("role") == "body") & text_of().rlike(CAPTION) & F.coalesce(beside, F.lead("role").over(in_order()).isin("table", "figure", "code")), F.lit("caption"), "caption")


PASSES: tuple[Pass, ...] = (edge_texts(), heading_levels, joined_headings, prose_again(), joined_code, cut_kinds, late_code, joined_code, late_tables, joined_tables, captions)


def recovered(rows: DataFrame, passes: Iterable[Pass] = PASSES) -> DataFrame:
    """The blocks that the passes make of raw blocks, one pass upon the other."""
    found = raw_blocks(rows).repartition("doc_id")
    for step in passes:
        found = step(found)
    return found


def scanned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines of a document to a raw block and eight blocks to a page; roles come from places and lengths, some
    bodies are tables by their lines, and a fifth of the documents have a running head on every page."""
    rows = blocks(spark, sf_dir).withColumn("idx", F.floor(F.col("ordinal") / 2).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "block_text"))), lambda x: x["block_text"]), "\n")
    rows = rows.groupBy("doc_id", "idx").agg(text.alias("text")).withColumn("page", F.floor(F.col("idx") / 8).cast("long"))
    n = F.length("text")
    k = F.col("idx") % 10
    kind = F.when((n <= 90) | k.isin(1, 2), "heading").when((n % 4 == 0) | k.isin(4, 5), "code").when(n % 29 == 1, "figure").otherwise("body")
    table = F.concat(F.lit("k | "), F.left("text", F.lit(6)), F.lit("\nv | "), F.right("text", F.lit(6)))
    planted = F.when((F.col("doc_id") % 5 == 0) & (F.col("idx") % 8 == 0), F.concat(F.lit("Head "), "page")).when(k > 7, table).when(k == 7, F.concat(F.lit("Table 1. "), "text")).when(k.isin(1, 2), F.left("text", F.lit(30))).when((n % 7 == 0) | k.isin(4, 5), F.concat("text", F.lit("\n\nx = f(1);"))).otherwise(F.col("text"))
    return rows.select("doc_id", "idx", "page", F.when(k > 6, "body").otherwise(kind).alias("role"), F.when(n % 3 == 0, n % 3 + 1).cast("int").alias("level"), planted.alias("text"))


def recovered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recovered(scanned_documents(spark, sf_dir))
    sources = F.array_distinct(F.transform("lines", lambda x: x["idx"]))
    return found.select("doc_id", F.col("at.idx").alias("idx"), F.col("at.line").alias("line"), "page", "last_page", "role", "level", F.size("lines").alias("line_count"), F.array_join(sources.cast("array<string>"), ",").alias("sources"), F.array_join("flags", ",").alias("flags"), F.md5(text_of()).alias("text_md5"))


QUERIES = {f.__name__: f for f in (recovered_documents,)}
#: A chain of eleven passes; the tests hold it against a plain version.
SQL: dict[str, str] = {}
