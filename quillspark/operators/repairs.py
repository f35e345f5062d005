"""Operators that repair blocks: code that wrapped or goes on, blocks of code and prose, lists in one line, prose that was
taken for code, and bodies between code.

Each operator takes a DataFrame of lines or blocks in reading order (doc_id, idx, ..) and parameters; the queries below make
such tables of the given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators.documents import BLOCKS, blocks
from quillspark.operators.layout import islands, ordered_texts
from quillspark.operators.review import load

OPENING, CLOSING = r"[(\[{]", r"[)\]}]"
HANGING = r"[,\\(\[{+*/=-]\s*$"
CODE_LINE = r"[{};]\s*$|^\s*(?:def|class|import|from|return|for|if|while)\b|[=()\[\]]{2}|\w\(.*\)"
SENTENCE = r"^[A-Z][^{}\[\];=]*[.!?]\s*$"
ITEM = r"\s*[•▪‣]\s+|\s+\d+[.)]\s+(?=[A-Z])"


def depth_of(text: Column) -> Column:
    """Brackets that a text opens less those that it closes."""
    return F.regexp_count(text, F.lit(OPENING)) - F.regexp_count(text, F.lit(CLOSING))


def reflowed(rows: DataFrame) -> DataFrame:
    """Lines of code (doc_id, idx, text) with those in one that were wrapped: a line goes on while brackets are open, or if it
    ends in a sign that asks for more. A bracket that closes nothing counts for nothing; a blank line ends what goes before
    it. Null texts are empty lines. Returns doc_id, first_idx, parts, text; a joined line loses its own indent."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("doc_id", "idx", F.coalesce("text", F.lit("")).alias("text")).withColumn("blank", F.trim("text") == "")
    # brackets are counted anew behind each blank line
    found = found.withColumn("stretch", F.sum(F.col("blank").cast("int")).over(so_far))
    inside = Window.partitionBy("doc_id", "stretch").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("total", F.sum(depth_of(F.col("text"))).over(inside))
    found = found.withColumn("open", F.col("total") - F.least(F.lit(0), F.min("total").over(inside)))
    goes_on = ~F.col("blank") & ~F.lag("blank").over(w) & ((F.lag("open").over(w) > 0) | F.lag("text").over(w).rlike(HANGING))
    found = islands(found.withColumn("begins", ~F.coalesce(goes_on, F.lit(False))), ["doc_id"], "idx", F.col("begins"))
    piece = found.withColumn("text", F.when(F.col("begins"), F.col("text")).otherwise(F.trim("text")))
    return piece.groupBy("doc_id", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("parts"), ordered_texts("idx", "text", " ").alias("text")).drop("island")


def continued_code(rows: DataFrame, most_between: int = 1) -> DataFrame:
    """Blocks of code in rows (doc_id, idx, page, role, text) that go on on the same page or the next, with at most
    most_between artifacts and nothing else between: first_idx, parts, last_page, text."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    # the artifacts right before each block; other blocks break the chain
    kept = rows.withColumn("chain", F.sum(F.when(F.col("role").isin("code", "artifact"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.withColumn("artifacts", F.sum(F.when(F.col("role") == "artifact", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("role = 'code'")
    goes_on = (F.lag("chain").over(w) == F.col("chain")) & (F.col("artifacts") - F.lag("artifacts").over(w) <= most_between) & (F.col("page") - F.lag("page").over(w) <= 1)
    found = islands(kept.withColumn("begins", ~F.coalesce(goes_on, F.lit(False))), ["doc_id"], "idx", F.col("begins"))
    return found.groupBy("doc_id", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("parts"), F.max("page").alias("last_page"), ordered_texts("idx", "text", "\n").alias("text")).drop("island")


def split_blocks(rows: DataFrame) -> DataFrame:
    """Blocks (doc_id, idx, text) cut where their lines change between code and prose: doc_id, idx, part from 0, kind, lines.
    Blank lines belong to what goes before them, and are prose at a block's begin."""
    lines = rows.select("doc_id", "idx", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    w = Window.partitionBy("doc_id", "idx").orderBy("line")
    own = F.when(F.trim("text") != "", F.when(F.col("text").rlike(CODE_LINE), "code").otherwise("prose"))
    lines = lines.withColumn("own", own).withColumn("kind", F.coalesce(F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("prose")))
    found = islands(lines.withColumn("begins", F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind"))), ["doc_id", "idx"], "line", F.col("begins"), "part")
    return found.groupBy("doc_id", "idx", (F.col("part") - 1).alias("part"), "kind").agg(F.count("*").alias("lines"))


def list_items(rows: DataFrame, indent: int = 2) -> DataFrame:
    """Items of lists (doc_id, idx, text) of which several may stand in one line, with the depth that the blanks before a line
    tell, `indent` for each level: doc_id, idx, item from 0, level, text. Empty items go."""
    level = F.floor(F.length(F.regexp_extract("text", r"^( *)", 1)) / indent)
    parts = F.filter(F.transform(F.split("text", ITEM), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("doc_id", "idx", level.alias("level"), F.posexplode(parts).alias("item", "text"))


def late_promoted(rows: DataFrame) -> DataFrame:
    """rows (doc_id, idx, role, text) with the new role of each block: a body between two blocks of code, or beside one if it
    looks like code, becomes code unless it is a sentence."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    before, behind = (F.coalesce(f("role").over(w) == "code", F.lit(False)) for f in (F.lag, F.lead))
    looks = F.coalesce(F.col("text").rlike(CODE_LINE), F.lit(False))
    becomes = (F.col("role") == "body") & ((before & behind) | ((before | behind) & looks)) & ~F.coalesce(F.col("text").rlike(SENTENCE), F.lit(False))
    return rows.select("doc_id", "idx", "role", F.when(becomes, "code").otherwise(F.col("role")).alias("new_role"))


def prose_chains(rows: DataFrame, least_words: int = 8) -> DataFrame:
    """Artifacts in rows (doc_id, idx, role, text) that are prose taken for code: code of at least least_words words without
    signs of code. Those in a row form a chain while sentences go on: doc_id, first_idx, parts, text."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\s]+)"), F.lit(1)))
    is_prose = (F.col("role") == "code") & (words >= least_words) & ~F.col("text").rlike(CODE_LINE)
    found = rows.withColumn("is_prose", F.coalesce(is_prose, F.lit(False)))
    goes_on = F.lag("is_prose").over(w) & F.col("is_prose") & ~F.lag("text").over(w).rlike(r"[.!?]\s*$")
    found = islands(found.withColumn("begins", ~F.coalesce(goes_on, F.lit(False))), ["doc_id"], "idx", F.col("begins")).where("is_prose")
    return found.groupBy("doc_id", "island").agg(F.min("idx").alias("first_idx"), F.count("*").alias("parts"), ordered_texts("idx", "text", " ").alias("text")).drop("island")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents on pages of ten, with roles by their lengths."""
    n = F.length("block_text")
    role = F.when(n % 5 < 2, "code").when(n % 5 == 2, "artifact").otherwise("body")
    return blocks(spark, sf_dir).select("doc_id", F.col("ordinal").alias("idx"), F.floor(F.col("ordinal") / 10).alias("page"), role.alias("role"), F.col("block_text").alias("text"))


def digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.md5("text"))


def reflowed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as code, with a bracket opened and closed by their numbers."""
    line = F.concat("block_text", F.when(F.col("ordinal") % 6 == 1, F.lit(" (")).when(F.col("ordinal") % 6 == 3, F.lit(" )")).when(F.col("ordinal") % 6 == 4, F.lit(",")).otherwise(F.lit("")))
    return digested(reflowed(blocks(spark, sf_dir).select("doc_id", F.col("ordinal").alias("idx"), line.alias("text"))))


def merged_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(continued_code(coded(spark, sf_dir)))


def split_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose sentences are lines, of which every other ends as code does."""
    text = F.regexp_replace("text", r"([a-z])\. *", "$1;\n\n")
    return split_blocks(load(spark, sf_dir, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), text.alias("text")))


def split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose sentences are items in one line, behind some blanks."""
    line = F.concat(F.repeat(F.lit(" "), (F.col("ordinal") % 5).cast("int")), F.lit("• "), F.regexp_replace("block_text", r"\. ", " • "))
    return digested(list_items(blocks(spark, sf_dir).select("doc_id", F.col("ordinal").alias("idx"), line.alias("text"))))


def promoted_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark, sf_dir)
    return late_promoted(rows.withColumn("text", F.when(F.col("idx") % 3 == 0, F.concat("text", F.lit(";"))).otherwise(F.col("text"))))


def prose_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coded(spark, sf_dir)
    return digested(prose_chains(rows.withColumn("text", F.when(F.col("idx") % 2 == 0, F.regexp_replace("text", r"\.$", "")).otherwise(F.col("text")))))


QUERIES = {f.__name__: f for f in (reflowed_code, merged_code, split_code, split_lists, promoted_code, prose_artifacts)}

_sql = lambda x: x.replace("'", "''")
_CODED = f"{BLOCKS}, c AS (SELECT doc_id, ordinal AS idx, (ordinal // 10)::BIGINT AS page, CASE WHEN length(block_text) % 5 < 2 THEN 'code' WHEN length(block_text) % 5 = 2 THEN 'artifact' ELSE 'body' END AS role, block_text AS text FROM blocks)"
_ISLAND = "sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island"
SQL = {
    "reflowed_code": f"""WITH {BLOCKS}, t AS (SELECT doc_id, ordinal AS idx, block_text || CASE ordinal % 6 WHEN 1 THEN ' (' WHEN 3 THEN ' )' WHEN 4 THEN ',' ELSE '' END AS text FROM blocks), s AS (SELECT *, trim(text) = '' AS blank, sum((trim(text) = '')::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS stretch FROM t),
n AS (SELECT *, sum(len(regexp_extract_all(text, '{OPENING}')) - len(regexp_extract_all(text, '{CLOSING}'))) OVER (PARTITION BY doc_id, stretch ORDER BY idx ROWS UNBOUNDED PRECEDING) AS total FROM s), o AS (SELECT *, total - least(0, min(total) OVER (PARTITION BY doc_id, stretch ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS depth FROM n),
g AS (SELECT *, coalesce(NOT blank AND NOT lag(blank) OVER w AND (lag(depth) OVER w > 0 OR regexp_matches(lag(text) OVER w, '{HANGING}')), false) AS goes_on FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), i AS (SELECT *, {_ISLAND} FROM g)
SELECT doc_id, min(idx) AS first_idx, count(*) AS parts, md5(string_agg(CASE WHEN goes_on THEN trim(text, ' ') ELSE text END, ' ' ORDER BY idx)) AS text FROM i GROUP BY doc_id, island""",
    "merged_code": f"""WITH {_CODED}, r AS (SELECT *, sum((role = 'body')::INT) OVER w AS chain, sum((role = 'artifact')::INT) OVER w AS artifacts FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)), k AS (FROM r WHERE role = 'code'),
g AS (SELECT *, coalesce(lag(chain) OVER w = chain AND artifacts - lag(artifacts) OVER w <= 1 AND page - lag(page) OVER w <= 1, false) AS goes_on FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), i AS (SELECT *, {_ISLAND} FROM g)
SELECT doc_id, min(idx) AS first_idx, count(*) AS parts, max(page) AS last_page, md5(string_agg(text, chr(10) ORDER BY idx)) AS text FROM i GROUP BY doc_id, island""",
    "split_code": f"""WITH l AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([a-z])\\. *', '\\1;' || chr(10) || chr(10), 'g'), chr(10)) AS a FROM conversations WHERE text IS NOT NULL), e AS (SELECT conv_id, turn, unnest(range(len(a))) AS line, unnest(a) AS text FROM l),
k AS (SELECT *, coalesce(last_value(CASE WHEN trim(text) != '' THEN CASE WHEN regexp_matches(text, '{_sql(CODE_LINE)}') THEN 'code' ELSE 'prose' END END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY line ROWS UNBOUNDED PRECEDING), 'prose') AS kind FROM e),
g AS (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY line))::INT AS b FROM k), p AS (SELECT *, (sum(b) OVER (PARTITION BY conv_id, turn ORDER BY line ROWS UNBOUNDED PRECEDING) - 1)::BIGINT AS part FROM g)
SELECT conv_id AS doc_id, turn AS idx, part, kind, count(*) AS lines FROM p GROUP BY ALL""",
    "split_lists": f"""WITH {BLOCKS}, t AS (SELECT doc_id, ordinal AS idx, (ordinal % 5 // 2)::BIGINT AS level, list_filter(list_transform(string_split_regex(replace(block_text, '. ', ' • '), '\\s*[•▪‣]\\s+|\\s+\\d+[.)]\\s+([A-Z])'), lambda x: trim(x)), lambda x: x != '') AS a FROM blocks)
SELECT doc_id, idx, level, (unnest(range(len(a))))::INT AS item, md5(unnest(a)) AS text FROM t""",
    "promoted_code": f"""WITH {_CODED}, t AS (SELECT doc_id, idx, role, CASE WHEN idx % 3 = 0 THEN text || ';' ELSE text END AS text, coalesce(lag(role) OVER w = 'code', false) AS before, coalesce(lead(role) OVER w = 'code', false) AS behind FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT doc_id, idx, role, CASE WHEN role = 'body' AND ((before AND behind) OR ((before OR behind) AND regexp_matches(text, '{_sql(CODE_LINE)}'))) AND NOT regexp_matches(text, '{_sql(SENTENCE)}') THEN 'code' ELSE role END AS new_role FROM t""",
    "prose_artifacts": f"""WITH {_CODED}, t AS (SELECT doc_id, idx, role, CASE WHEN idx % 2 = 0 THEN regexp_replace(text, '\\.$', '') ELSE text END AS text FROM c), p AS (SELECT *, role = 'code' AND len(regexp_extract_all(text, '[^\\s]+')) >= 8 AND NOT regexp_matches(text, '{_sql(CODE_LINE)}') AS prose FROM t),
g AS (SELECT *, coalesce(prose AND lag(prose) OVER w AND NOT regexp_matches(lag(text) OVER w, '[.!?]\\s*$'), false) AS goes_on FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), i AS (SELECT *, {_ISLAND} FROM g)
SELECT doc_id, min(idx) AS first_idx, count(*) AS parts, md5(string_agg(text, ' ' ORDER BY idx)) AS text FROM i WHERE prose GROUP BY doc_id, island""",
}
