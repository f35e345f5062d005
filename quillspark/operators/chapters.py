"""Where chapters begin, from an outline, a table of contents or headings, and the pages that each chapter has.

An entry of a table of contents finds its page by the first way that gives one: the next heading behind the table with an
overlapping title; the offset between printed and real pages that most matches have, or else most footers; the printed page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.documents import BLOCKS, blocks

#: Ways to an entry's page, and sources of a document's chapters, the best first.
WAYS = ("title_match", "title_match_offset", "footer_offset", "printed", "unresolved")
SOURCES = ("outline", "toc", "heading")


def next_with_title(entries: DataFrame, headings: DataFrame) -> DataFrame:
    """doc_id, entry and match_page: the first page behind an entry's own with a heading that shares a variant of its title.

    An as-of join in one shuffle: entries and headings lie together by variant, the last heading seen from the end of the
    document backwards is the next one; no pairs are formed. Entries without a match are left out.
    """
    each = lambda rows, entry: rows.select("doc_id", "page", entry.alias("entry"), F.explode(T.title_variants(F.col("title"))).alias("variant"))
    both = each(entries, F.col("entry")).union(each(headings, F.lit(None).cast("long")))
    heading = F.when(F.col("entry").isNull(), F.col("page"))
    back = Window.partitionBy("doc_id", "variant").orderBy(F.desc("page"), F.desc_nulls_last("entry")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("match_page", F.last(heading, ignorenulls=True).over(back)).where("entry is not null and match_page is not null")
    return found.groupBy("doc_id", "entry").agg(F.min("match_page").alias("match_page"))


def dominant(rows: DataFrame, difference: Column, name: str) -> DataFrame:
    """doc_id and the most frequent difference of 0 or more, the least among equals."""
    counts = rows.select("doc_id", difference.alias(name)).where(F.col(name) >= 0).groupBy("doc_id", name).count()
    return counts.groupBy("doc_id").agg(F.min_by(name, F.struct(-F.col("count"), name)).alias(name))


def resolved_contents(entries: DataFrame, headings: DataFrame, footers: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, entry, title, printed_page, start_page, way and page_offset of each entry of a table of contents.

    entries: doc_id, entry (a number), page (of the table), title, printed_page. headings: doc_id, page, title. footers:
    doc_id, page, label (digits or Roman). sizes: doc_id, last_page. Pages must lie behind the table and within the document.
    An entry without a title or printed page, or of a document without sizes, is unresolved.
    """
    usable = entries.where("trim(title) != '' and printed_page is not null")
    matches = next_with_title(usable, headings)
    ends = entries.groupBy("doc_id").agg(F.max("page").alias("contents_end"))
    numbered = footers.join(ends, "doc_id").where("page > contents_end").withColumn("number", T.page_number(F.col("label")))
    by_title = dominant(usable.join(matches, ["doc_id", "entry"]), F.col("match_page") - F.col("printed_page"), "title_offset")
    by_footer = dominant(numbered, F.col("page") - F.col("number"), "footer_offset")
    rows = entries.join(matches, ["doc_id", "entry"], "left").join(by_title, "doc_id", "left").join(by_footer, "doc_id", "left").join(sizes, "doc_id", "left")
    known = (F.trim("title") != "") & F.col("printed_page").isNotNull() & F.col("last_page").isNotNull()
    inside = lambda page: known & (page > F.col("page")) & (page <= F.col("last_page"))
    printed = F.col("printed_page")
    ways = list(zip(WAYS, (F.col("match_page"), printed + F.col("title_offset"), printed + F.col("footer_offset"), printed), strict=False))
    found = F.coalesce(*[F.when(inside(page), F.struct(F.lit(way).alias("way"), page.cast("long").alias("start_page"))) for way, page in ways])
    rows = rows.withColumn("found", found).withColumns({"way": F.coalesce("found.way", F.lit(WAYS[-1])), "start_page": F.col("found.start_page")})
    return rows.select("doc_id", "entry", "title", "printed_page", "start_page", "way", (F.col("start_page") - printed).alias("page_offset"))


def chapter_starts(outline: DataFrame, contents: DataFrame, headings: DataFrame, pattern: str) -> DataFrame:
    """doc_id, start_page, title and source: of each document from the first of SOURCES that has any, a start for each page.

    outline: doc_id, level, page, title; its top level counts. contents: as of resolved_contents. headings: those whose title
    matches pattern. Of several on a page the one with the least title holds.
    """
    top = outline.withColumn("top", F.min("level").over(Window.partitionBy("doc_id"))).where("level = top")
    tagged = lambda rows, page, source: rows.select("doc_id", F.col(page).cast("long").alias("start_page"), "title", F.lit(SOURCES.index(source)).alias("rank"))
    every = tagged(top, "page", "outline").union(tagged(contents.where("start_page is not null"), "start_page", "toc")).union(tagged(headings.where(F.col("title").rlike(pattern)), "page", "heading"))
    best = every.withColumn("best", F.min("rank").over(Window.partitionBy("doc_id"))).where("rank = best")
    return best.groupBy("doc_id", "start_page").agg(F.min("title").alias("title"), F.element_at(F.array(*map(F.lit, SOURCES)), F.min("rank") + 1).alias("source"))


def chapter_ranges(starts: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, start_page, end_page, title, source: each page of sizes (doc_id, last_page) once. Pages before the first start
    are `front`, a document without starts is `whole`. Starts outside of the document are left out."""
    inside = starts.join(sizes, "doc_id").where("start_page between 1 and last_page")
    first = sizes.select("doc_id", F.lit(1).cast("long").alias("start_page"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source"), "last_page")
    w = Window.partitionBy("doc_id").orderBy("start_page", F.col("source").isNull())
    rows = inside.select(*first.columns).union(first).withColumn("again", F.lag("start_page").over(w) == F.col("start_page"))
    rows = rows.where("again is null or not again").withColumn("next", F.lead("start_page").over(Window.partitionBy("doc_id").orderBy("start_page")))
    source = F.coalesce("source", F.when(F.col("next").isNull(), "whole").otherwise("front"))
    return rows.select("doc_id", "start_page", F.coalesce(F.col("next") - 1, F.col("last_page")).cast("long").alias("end_page"), "title", source.alias("source"))


def printed_books(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents as books: three blocks to a page behind two pages of contents; each ninth block opens with a heading.

    Printed numbers leave out the first two pages. Titles in the contents have a name or number before them, or are others
    (in a fifth of the books all are); a tenth has no footers, a ninth an outline, and a seventh no contents.
    """
    rows = blocks(spark, sf_dir).withColumn("page", F.floor(F.col("ordinal") / 3).cast("long") + 3)
    title = F.array_join(F.slice(F.split("block_text", " "), 1, 6), " ")
    heads = rows.where("ordinal % 9 = 0").select("doc_id", "page", title.alias("title"), F.floor(F.col("ordinal") / 9).cast("long").alias("entry"))
    d, n = F.col("doc_id"), F.col("entry")
    kind = F.when(d % 5 == 4, 3).otherwise((d + n) % 4)
    named = F.when(kind == 0, F.concat(F.lit("Chapter "), n + 1, F.lit(": "), "title")).when(kind == 1, F.concat(n + 1, F.lit(".2 "), "title")).when(kind == 2, F.col("title")).otherwise(F.concat(F.lit("Lost "), "title"))
    return {
        "headings": heads.select("doc_id", "page", "title"),
        "entries": heads.where("doc_id % 7 != 5").select("doc_id", "entry", F.lit(2).cast("long").alias("page"), named.alias("title"), (F.col("page") - 2).alias("printed_page")),
        "footers": rows.where("doc_id % 10 != 4").select("doc_id", "page", (F.col("page") - 2).cast("string").alias("label")).distinct(),
        "outline": heads.where("doc_id % 9 = 1").select("doc_id", (n % 2 + 1).alias("level"), "page", "title"),
        "sizes": rows.groupBy("doc_id").agg(F.max("page").alias("last_page")),
    }


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = printed_books(spark, sf_dir)
    return resolved_contents(t["entries"], t["headings"], t["footers"], t["sizes"])


def chapter_pages_of_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = printed_books(spark, sf_dir)
    contents = resolved_contents(t["entries"], t["headings"], t["footers"], t["sizes"])
    return chapter_ranges(chapter_starts(t["outline"], contents, t["headings"], "^[A-Z]"), t["sizes"])


QUERIES = {"contents_pages": contents_pages, "chapter_ranges": chapter_pages_of_books}
_STEP = "list_distinct(v || list_transform(v, lambda x: trim(regexp_replace(x, '{p}', ''))) || list_transform(v, lambda x: trim(regexp_replace(x, '{n}', ''))))".format(p=T.CHAPTER_PREFIX, n=T.SECTION_NUMBER)
_SPACED = "lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"
_VARIANTS = lambda name, columns, table: f"{name} AS (SELECT {columns}, unnest(list_filter(v, lambda x: x != '')) AS variant FROM (SELECT {columns}, {_STEP} AS v FROM (SELECT {columns}, {_STEP} AS v FROM (SELECT {columns}, {_STEP} AS v FROM (SELECT {columns}, [{_SPACED}] AS v FROM {table})))))"
_BOOKS = f"""{BLOCKS}, rows AS (SELECT *, ordinal // 3 + 3 AS page FROM blocks),
heads AS (SELECT doc_id, page, array_to_string(string_split(block_text, ' ')[1:6], ' ') AS title, ordinal // 9 AS entry FROM rows WHERE ordinal % 9 = 0),
kinds AS (SELECT *, CASE WHEN doc_id % 5 = 4 THEN 3 ELSE (doc_id + entry) % 4 END AS kind FROM heads),
entries AS (SELECT doc_id, entry, 2 AS page, CASE kind WHEN 0 THEN 'Chapter ' || (entry + 1) || ': ' || title WHEN 1 THEN (entry + 1) || '.2 ' || title WHEN 2 THEN title ELSE 'Lost ' || title END AS title, page - 2 AS printed_page FROM kinds WHERE doc_id % 7 != 5),
footers AS (SELECT DISTINCT doc_id, page, page - 2 AS number FROM rows WHERE doc_id % 10 != 4),
sizes AS (SELECT doc_id, max(page)::BIGINT AS last_page FROM rows GROUP BY doc_id),
{_VARIANTS("ev", "doc_id, entry, page", "entries")}, {_VARIANTS("hv", "doc_id, page", "heads")},
m AS (SELECT e.doc_id, e.entry, min(h.page) AS match_page FROM ev e JOIN hv h ON h.doc_id = e.doc_id AND h.variant = e.variant AND h.page > e.page GROUP BY ALL),
tofs AS (SELECT doc_id, o AS title_offset FROM (SELECT e.doc_id, match_page - printed_page AS o, count(*) AS n FROM entries e JOIN m ON m.doc_id = e.doc_id AND m.entry = e.entry WHERE match_page >= printed_page GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) = 1),
fofs AS (SELECT doc_id, o AS footer_offset FROM (SELECT doc_id, page - number AS o, count(*) AS n FROM footers WHERE page > 2 AND page >= number AND doc_id IN (SELECT doc_id FROM entries) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) = 1),
c AS (SELECT e.*, match_page, printed_page + title_offset AS a, printed_page + footer_offset AS b, last_page FROM entries e JOIN sizes USING (doc_id) LEFT JOIN m ON m.doc_id = e.doc_id AND m.entry = e.entry LEFT JOIN tofs ON tofs.doc_id = e.doc_id LEFT JOIN fofs ON fofs.doc_id = e.doc_id),
w AS (SELECT *, CASE WHEN trim(title) = '' THEN 'unresolved' WHEN match_page > page AND match_page <= last_page THEN 'title_match' WHEN a > page AND a <= last_page THEN 'title_match_offset' WHEN b > page AND b <= last_page THEN 'footer_offset' WHEN printed_page > page AND printed_page <= last_page THEN 'printed' ELSE 'unresolved' END AS way FROM c),
contents AS (SELECT doc_id, entry::BIGINT AS entry, title, printed_page::BIGINT AS printed_page, (CASE way WHEN 'title_match' THEN match_page WHEN 'title_match_offset' THEN a WHEN 'footer_offset' THEN b WHEN 'printed' THEN printed_page END)::BIGINT AS start_page, way FROM w)"""
SQL = {
    "contents_pages": f"WITH {_BOOKS} SELECT *, start_page - printed_page AS page_offset FROM contents",
    "chapter_ranges": f"""WITH {_BOOKS}, s AS (SELECT doc_id, page::BIGINT AS start_page, title, 0 AS rank FROM (SELECT *, entry % 2 AS level FROM heads WHERE doc_id % 9 = 1) QUALIFY level = min(level) OVER (PARTITION BY doc_id)
UNION ALL SELECT doc_id, start_page, title, 1 FROM contents WHERE start_page IS NOT NULL UNION ALL SELECT doc_id, page, title, 2 FROM heads WHERE regexp_matches(title, '^[A-Z]')),
b AS (SELECT doc_id, start_page, min(title) AS title, any_value(rank) AS rank FROM (SELECT * FROM s QUALIFY rank = min(rank) OVER (PARTITION BY doc_id)) GROUP BY ALL),
f AS (SELECT doc_id, start_page, title, ['outline', 'toc', 'heading'][rank + 1] AS source FROM b UNION ALL SELECT doc_id, 1, NULL, NULL FROM sizes z WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = z.doc_id AND start_page = 1)),
n AS (SELECT f.*, lead(start_page) OVER (PARTITION BY f.doc_id ORDER BY start_page) AS next, last_page FROM f JOIN sizes USING (doc_id))
SELECT doc_id, start_page, coalesce(next - 1, last_page)::BIGINT AS end_page, title, coalesce(source, CASE WHEN next IS NULL THEN 'whole' ELSE 'front' END) AS source FROM n""",
}
