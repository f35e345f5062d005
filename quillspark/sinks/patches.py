"""Translations put into the pages that they were made from, all else left as it is.

A page is cut into parts (tags, texts, comments with scripts) with the place where each begins. How deep a part stands tells
which end tag belongs to which start tag, so an element is a stretch of parts. Replacements are joined by page, the parts
that an element replaces fall away, and the rest is put together again by place: every other character stays. Replacements
and pages are shuffled by page once; all windows work inside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.review import load

# Fixed values of HTML: elements without an end tag, and what is read as a whole.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
WHOLE = r"<!--.*?-->|<script[\s>].*?</script\s*>|<style[\s>].*?</style\s*>"
TAG = r"""<[a-zA-Z/!?](?:[^>"']|"[^"]*"|'[^']*')*>"""
PARTS = rf"(?is){WHOLE}|{TAG}|[^<]+|<"
NAME = r"^<([a-zA-Z][^\s/>]*)"
ID = r"""\sid\s*=\s*["']([^"']*)["']"""
POINTER = r"(?i)\s(?:id|href)\s*="


def attribute(tag: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(tag, f"(?i){pattern}", 1), F.lit(""))


def page_parts(pages: DataFrame) -> DataFrame:
    """Parts of pages (page_id, html and further columns): place (from 0), start (in characters), part, kind (open, close,
    text, other), tag in lower case, and level: how many elements an open or close tag or a text stands in, its own counted.
    anchor is an element's id, or its tag and number on the page (`p:3`, from 1). Null pages have none."""
    w = Window.partitionBy("page_id").orderBy("place")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    part, tag, kind = F.col("part"), F.col("tag"), F.col("kind")
    rows = pages.where("html is not null").select(*[c for c in pages.columns if c != "html"], F.posexplode(F.regexp_extract_all("html", F.lit(PARTS), F.lit(0))).alias("place", "part"))
    rows = rows.withColumn("start", F.sum(F.length(part)).over(upto) - F.length(part))
    rows = rows.withColumn("tag", F.lower(F.regexp_extract(F.replace(part, F.lit("</"), F.lit("<")), NAME, 1)))
    single = tag.isin(*VOID) | part.rlike(r"/\s*>$") | part.rlike(rf"(?is)^(?:{WHOLE})$")
    rows = rows.withColumn("kind", F.when(~part.startswith("<") | (part == "<"), "text").when((tag == "") | single, "other").when(part.startswith("</"), "close").otherwise("open"))
    step = F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
    rows = rows.withColumn("level", F.sum(step).over(upto) + F.when(kind == "close", 1).otherwise(0))
    number = F.sum(F.when(kind == "open", 1).otherwise(0)).over(Window.partitionBy("page_id", "tag").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("anchor", F.when(kind == "open", F.coalesce(attribute(part, ID), F.concat_ws(":", "tag", number))))


def elements(parts: DataFrame) -> DataFrame:
    """parts with stop, the place of an open tag's end tag, if all tags between are closed in order; has_text, whether such
    an element holds more than white space; and is_first, whether no element before it has its anchor."""
    peers = Window.partitionBy("page_id", "level", F.col("kind").isin("open", "close")).orderBy("place")
    upto = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("kind") == "open", F.col("kind") == "close"
    follows = opens & F.coalesce((F.lead("kind").over(peers) == "close") & (F.lead("tag").over(peers) == F.col("tag")), F.lit(False))
    ended = closes & F.coalesce((F.lag("kind").over(peers) == "open") & (F.lag("tag").over(peers) == F.col("tag")), F.lit(False))
    rows = parts.withColumns({"own_stop": F.when(follows, F.lead("place").over(peers)), "bad": (opens & ~follows) | (closes & ~ended)})
    full = (F.col("kind") == "text") & F.col("part").rlike(r"[^\s]")
    rows = rows.withColumns({"bad_upto": F.count_if("bad").over(upto), "text_upto": F.count_if(full).over(upto)})
    rows = rows.withColumns({"bad_stop": F.lead("bad_upto").over(peers), "text_stop": F.lead("text_upto").over(peers)})
    first = F.row_number().over(Window.partitionBy("page_id", "anchor").orderBy("place")) == 1
    whole = F.col("own_stop").isNotNull() & (F.col("bad_stop") == F.col("bad_upto"))
    return rows.select(*parts.columns, F.when(whole, F.col("own_stop")).alias("stop"), (F.col("text_stop") > F.col("text_upto")).alias("has_text"), (opens & first).alias("is_first"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def patched_parts(pages: DataFrame, replacements: DataFrame, whole_pages: bool = False) -> DataFrame:
    """Parts of pages with out: the part as it is, or what takes its place (see patched_pages)."""
    given = replacements.where("target is not null").groupBy("page_id", "anchor").agg(F.max("target").alias("target"))
    given = given.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("anchor", "target"))).alias("targets"))
    w = Window.partitionBy("page_id").orderBy("place")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = elements(page_parts(pages.select("page_id", "html").join(given, "page_id", "left")))
    target = F.when(F.col("is_first") & F.col("stop").isNotNull() & F.col("has_text"), F.get(F.map_values(F.map_filter("targets", lambda k, _: k == F.col("anchor"))), F.lit(0)))
    if whole_pages:
        broken = (F.col("kind") == "open") & F.col("stop").isNull()
        sound = (F.count_if(broken).over(Window.partitionBy("page_id")) == 0) & (F.sum(F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)).over(Window.partitionBy("page_id")) == 0)
        rows = rows.withColumn("sound", sound)
        target = F.when(F.col("sound"), target)
    rows = rows.withColumn("target", target).drop("targets")
    # the end tag of a replaced element is the next tag as deep as its start tag
    peers = Window.partitionBy("page_id", "level", F.col("kind").isin("open", "close")).orderBy("place")
    rows = rows.withColumn("ends", F.coalesce((F.col("kind") == "close") & F.lag("target").over(peers).isNotNull() & (F.lag("stop").over(peers) == F.col("place")), F.lit(False)))
    opened = F.count_if(F.col("target").isNotNull()).over(upto)
    ended = F.count_if("ends").over(upto)
    rows = rows.withColumn("depth", opened - ended)
    # among parts as deep as a replaced element, the last of those elements before a part is the one that it stands in
    owner = F.last(F.when(F.col("target").isNotNull(), F.col("level")), ignorenulls=True).over(Window.partitionBy("page_id", "depth").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    led = (F.lag("kind").over(w) == "open") & F.lag("part").over(w).rlike(POINTER) & F.lag("target").over(w).isNull()
    rows = rows.withColumns({"owner": F.when(F.col("depth") > 0, owner), "led": F.coalesce(led, F.lit(False))})
    stays = F.col("led") & (F.col("level") == F.col("owner") + 1)
    gone = (F.col("kind") == "text") & F.col("owner").isNotNull() & ~stays
    return rows.withColumn("out", F.when(F.col("target").isNotNull(), F.concat("part", escaped(F.col("target")))).when(gone, "").otherwise(F.col("part")))


def patched_pages(pages: DataFrame, replacements: DataFrame, whole_pages: bool = False) -> DataFrame:
    """page_id, html, n_patched, n_parts, and kept_chars (how many characters of the page are still there).

    replacements: page_id, anchor, target. The first element with the anchor, if it holds text and is closed, begins with
    the target; all texts inside it go, but for what a child with an id or href begins with, and for elements inside that
    are replaced themselves. Tags, comments and all outside of it stay. whole_pages leaves pages alone in which any tag
    isn't closed in order. Of several targets for an anchor the greatest holds; a null target and an anchor that no element
    has replace nothing. Null pages stay null. page_id is a key.
    """
    rows = patched_parts(pages, replacements, whole_pages)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "out"))), lambda x: x["out"]), "")
    kept = F.sum(F.when(F.col("out") == "", 0).otherwise(F.length("part"))).alias("kept_chars")
    found = rows.groupBy("page_id").agg(joined.alias("html"), F.count("target").alias("n_patched"), F.count("*").alias("n_parts"), kept)
    empty = pages.where("html is null or html = ''").select("page_id", "html", *[F.lit(0).cast("long").alias(c) for c in ("n_patched", "n_parts", "kept_chars")])
    return found.union(empty)


def own_texts(pages: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """page_id, anchor and target for a trial: what follows the start tag of each element with one of the tags, with an arrow before it."""
    rows = page_parts(pages.select("page_id", "html"))
    following = F.lead("part").over(Window.partitionBy("page_id").orderBy("place"))
    return rows.withColumn("target", F.concat(F.lit("→ "), following)).where(F.col("kind").isin("open") & F.col("tag").isin(*tags)).select("page_id", "anchor", "target")


TRIED = ("p", "li", "h1", "footer")


def patched_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with headings, paragraphs, points and footers replaced."""
    pages = load(spark, sf_dir, "pages")
    found = patched_pages(pages, own_texts(pages, TRIED))
    return found.select("page_id", "n_patched", "n_parts", "kept_chars", F.md5("html").alias("html_md5"))


QUERIES = {f.__name__: f for f in (patched_sources,)}
_PARTS = PARTS.replace("'", "''")
_WHOLE = WHOLE.replace("'", "''")
SQL = {
    "patched_sources": rf"""WITH r AS (SELECT page_id, unnest(range(len(a))) AS place, unnest(a) AS part FROM (SELECT page_id, regexp_extract_all(html, '{_PARTS}') AS a FROM pages)),
t AS (SELECT *, lower(regexp_extract(replace(part, '</', '<'), '^<([a-zA-Z][^\s/>]*)', 1)) AS tag FROM r),
k AS (SELECT *, CASE WHEN part[1] != '<' OR part = '<' THEN 'text' WHEN tag = '' OR tag IN {VOID} OR regexp_matches(part, '/\s*>$') OR regexp_matches(part, '(?is)^(?:{_WHOLE})$') THEN 'other' WHEN part[1:2] = '</' THEN 'close' ELSE 'open' END AS kind FROM t),
l AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY place) + (kind = 'close')::INT AS level, tag || ':' || count(*) FILTER (kind = 'open') OVER (PARTITION BY page_id, tag ORDER BY place) AS anchor, lead(part) OVER (PARTITION BY page_id ORDER BY place) AS next FROM k),
m AS (SELECT *, CASE WHEN kind = 'open' AND lead(kind) OVER p = 'close' AND lead(tag) OVER p = tag THEN lead(place) OVER p END AS stop, kind = 'close' AND coalesce(lag(kind) OVER p = 'open' AND lag(tag) OVER p = tag, false) AS ended FROM l WINDOW p AS (PARTITION BY page_id, level, kind IN ('open', 'close') ORDER BY place)),
c AS (SELECT *, count(*) FILTER ((kind = 'open' AND stop IS NULL) OR (kind = 'close' AND NOT ended)) OVER w AS bad, count(*) FILTER (kind = 'text' AND regexp_matches(part, '[^\s]')) OVER w AS texts FROM m WINDOW w AS (PARTITION BY page_id ORDER BY place)),
x AS (SELECT c.*, CASE WHEN c.tag IN {TRIED} AND e.bad = c.bad AND e.texts > c.texts THEN '→ ' || c.next END AS target FROM c LEFT JOIN c e ON e.page_id = c.page_id AND e.place = c.stop),
o AS (SELECT x.page_id, x.place, any_value(x.part) AS part, any_value(x.kind) AS kind, any_value(x.level) AS level, any_value(x.target) AS target, arg_max(y.level, y.place) AS owner FROM x LEFT JOIN x y ON y.page_id = x.page_id AND y.target IS NOT NULL AND x.place > y.place AND x.place < y.stop GROUP BY ALL),
f AS (SELECT *, coalesce(lag(kind) OVER w = 'open' AND regexp_matches(lag(part) OVER w, '(?i)\s(?:id|href)\s*=') AND lag(target) OVER w IS NULL, false) AND level = owner + 1 AS stays FROM o WINDOW w AS (PARTITION BY page_id ORDER BY place)),
z AS (SELECT *, CASE WHEN target IS NOT NULL THEN part || replace(replace(replace(target, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') WHEN kind = 'text' AND owner IS NOT NULL AND NOT stays THEN '' ELSE part END AS result FROM f)
SELECT page_id, count(target) AS n_patched, count(*) AS n_parts, sum(CASE WHEN result = '' THEN 0 ELSE length(part) END)::BIGINT AS kept_chars, md5(string_agg(result, '' ORDER BY place)) AS html_md5 FROM z GROUP BY page_id""",
}
