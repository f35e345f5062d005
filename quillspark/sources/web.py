"""Blocks of web pages, by Spark functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.review import load

# Fixed values of HTML: what isn't shown, blocks with a text of their own, what else ends a block, and entities.
HIDDEN = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
OWN = r"h[1-6]|p|li|blockquote|pre|td|th|figcaption"
ENDS = r"(?i)(</?(?:h[1-6]|p|li|blockquote|pre|td|th|figcaption|html|head|title|body|div|section|article|aside|main|header|footer|nav|ul|ol|dl|dt|dd|table|thead|tbody|tfoot|tr|caption|figure|form|hr)(?:\s[^>]*)?/?>)"
BREAK = r"(?i)<br\s*/?>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ordinal, tag (in lower case) and text of each block with a text of its own: up to where the next block
    begins or one ends, tags inside it left out and entities decoded. Null pages have none."""
    bare = F.regexp_replace(F.regexp_replace("html", HIDDEN, ""), BREAK, " ")
    parts = F.split(F.regexp_replace(bare, ENDS, "\u0001$1"), "\u0001")
    def read(part: Column) -> Column:
        text = F.regexp_replace(part, "<[^>]*>", "")
        for name, sign in ENTITIES:
            text = F.replace(text, F.lit(name), F.lit(sign))
        return F.struct(F.lower(F.regexp_extract(part, rf"^(?i)<({OWN})(?:\s[^>]*)?>", 1)).alias("tag"), F.btrim(text).alias("text"))

    found = F.filter(F.transform(parts, read), lambda b: (b["tag"] != "") & (b["text"] != ""))
    return pages.select("page_id", F.posexplode(found).alias("ordinal", "b")).select("page_id", "ordinal", "b.tag", "b.text")


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(load(spark, sf_dir, "pages"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a page with levels made regular: the first is 1, its peers 2, others follow their raw level."""
    order = Window.partitionBy("page_id").orderBy("ordinal")
    rows = page_blocks(spark, sf_dir).where(F.col("tag").rlike("^h[1-6]$")).withColumn("raw", F.substring("tag", 2, 1).cast("int"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("top", F.first("raw").over(order)).withColumn("least", F.min("raw").over(whole)).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("peers", F.bool_or((F.col("place") > 1) & (F.col("raw") == F.col("top"))).over(whole))
    level = F.when(F.col("place") == 1, 1).when(F.col("raw") == F.col("top"), 2).otherwise(F.greatest(F.lit(2), F.col("raw") - F.col("least") + F.when(F.col("peers"), 2).otherwise(1)))
    return rows.select("page_id", "ordinal", "raw", level.alias("level"))


QUERIES = {f.__name__: f for f in (page_blocks, heading_levels)}
_DECODED = "regexp_replace(part, '<[^>]*>', '', 'g')"
for _name, _sign in ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_name}', '{_sign.replace(chr(39), chr(39) * 2)}')"
_BLOCKS = f"""blocks AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INT AS ordinal, tag, text FROM (SELECT page_id, place, lower(regexp_extract(part, '^(?i)<({OWN})(?:\\s[^>]*)?>', 1)) AS tag, trim({_DECODED}) AS text FROM (SELECT page_id, unnest(range(len(a))) AS place, unnest(a) AS part FROM (
SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BREAK}', ' ', 'g'), '{ENDS}', chr(1) || '\\1', 'g'), chr(1)) AS a FROM pages))) WHERE tag != '' AND text != '')"""
SQL = {
    "page_blocks": f"WITH {_BLOCKS} SELECT page_id, ordinal, tag, text FROM blocks",
    "heading_levels": f"""WITH {_BLOCKS}, h AS (SELECT page_id, ordinal, tag[2:2]::INT AS raw FROM blocks WHERE regexp_matches(tag, '^h[1-6]$')),
t AS (SELECT *, first(raw) OVER w AS top, min(raw) OVER (PARTITION BY page_id) AS least, row_number() OVER w AS place FROM h WINDOW w AS (PARTITION BY page_id ORDER BY ordinal)),
p AS (SELECT *, bool_or(place > 1 AND raw = top) OVER (PARTITION BY page_id) AS peers FROM t)
SELECT page_id, ordinal, raw, CASE WHEN place = 1 THEN 1 WHEN raw = top THEN 2 ELSE greatest(2, raw - least + CASE WHEN peers THEN 2 ELSE 1 END) END AS level FROM p""",
}
