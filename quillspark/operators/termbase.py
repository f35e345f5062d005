"""The terms that hold for a document, as numbered versions that change only when a term does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.review import load

#: From the weakest to the strongest.
LOCKS = ("suggested", "preferred", "locked")
TERMS = "array<struct<term:string,target:string,lock_level:string>>"


def holding_terms(entries: DataFrame) -> DataFrame:
    """doc_id and terms (term in lower case, target, lock_level; by term) of entries (doc_id, chapter_id, source, target,
    lock_level, version): of equal terms, whatever their case and blanks, the one of a chapter goes before the document's,
    then the stronger lock, then the newer version, then the greater target. Entries without a term or target are left out."""
    term = F.lower(F.btrim(F.regexp_replace("source", r"\s+", " ")))
    rank = F.struct(F.col("chapter_id").isNotNull().alias("narrow"), F.array_position(F.array(*map(F.lit, LOCKS)), F.col("lock_level")).alias("lock"), "version", "target")
    rows = entries.where("trim(source) != '' and trim(target) != ''").groupBy("doc_id", term.alias("term")).agg(F.max_by(F.struct("target", "lock_level"), rank).alias("best"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term", "best.target", "best.lock_level"))).cast(TERMS).alias("terms"))


def refreshed(entries: DataFrame, current: DataFrame) -> DataFrame:
    """doc_id, version, terms, and how many were added, removed and changed against current (doc_id, version, terms).

    The version goes up by one where anything differs, and stays where nothing does. A document without current terms begins
    with version 1; one whose entries are gone has no terms left.
    """
    rows = current.select("doc_id", F.col("version").alias("old_version"), F.col("terms").cast(TERMS).alias("old")).join(holding_terms(entries), "doc_id", "full")
    none = F.array().cast(TERMS)
    rows = rows.withColumns({"old": F.coalesce("old", none), "terms": F.coalesce("terms", none)})
    names = lambda c: F.transform(c, lambda x: x["term"])
    rows = rows.withColumns({"added": F.size(F.array_except(names("terms"), names("old"))), "removed": F.size(F.array_except(names("old"), names("terms")))})
    changed = F.size(F.array_except("terms", "old")) - F.col("added")
    rows = rows.withColumn("changed", changed)
    version = F.coalesce("old_version", F.lit(0)) + F.when(F.col("added") + F.col("removed") + F.col("changed") > 0, 1).otherwise(0)
    return rows.select("doc_id", version.cast("long").alias("version"), "terms", *[F.col(c).cast("long").alias(c) for c in ("added", "removed", "changed")])


def refreshed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entries of 60 documents: names are terms and types their renderings, promoted ones are of a chapter. What held
    is what the parts but for each ninth gave, in documents 0 to 49; documents 40 to 44 have no parts now."""
    words = F.split("p_name", " ")
    rows = load(spark, sf_dir, "part").select((F.col("p_partkey") % 60).alias("doc_id"), F.when(F.col("p_type").startswith("PROMO"), 1).alias("chapter_id"), F.element_at(words, 1).alias("source"), F.col("p_type").alias("target"), F.when(F.col("p_size") > 35, "locked").when(F.col("p_size") > 20, "preferred").otherwise("suggested").alias("lock_level"), F.col("p_size").alias("version"), "p_partkey")
    before = holding_terms(rows.where("p_partkey % 9 > 0 and doc_id < 50")).withColumn("version", F.lit(3))
    found = refreshed(rows.where("doc_id not between 40 and 44"), before)
    return found.select("doc_id", "version", F.array_join(F.transform("terms", lambda x: F.concat_ws(" ", x["term"], x["target"], x["lock_level"])), ",").alias("terms"), "added", "removed", "changed")


QUERIES = {f.__name__: f for f in (refreshed_terms,)}
_HOLDING = "SELECT doc_id, term, arg_max(target || ' ' || lock_level, (narrow, lock, version, target)) AS best FROM rows WHERE {where} GROUP BY ALL"
SQL = {
    "refreshed_terms": f"""WITH rows AS (SELECT p_partkey % 60 AS doc_id, starts_with(p_type, 'PROMO') AS narrow, lower(string_split(p_name, ' ')[1]) AS term, p_type AS target, CASE WHEN p_size > 35 THEN 'locked' WHEN p_size > 20 THEN 'preferred' ELSE 'suggested' END AS lock_level, CASE WHEN p_size > 35 THEN 3 WHEN p_size > 20 THEN 2 ELSE 1 END AS lock, p_size AS version, p_partkey FROM part WHERE trim(string_split(p_name, ' ')[1]) != ''),
a AS ({_HOLDING.format(where="p_partkey % 9 > 0 AND doc_id < 50")}), b AS ({_HOLDING.format(where="doc_id NOT BETWEEN 40 AND 44")}),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.term, b.term) AS term, a.best AS old, b.best AS new FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.term = b.term),
g AS (SELECT doc_id, coalesce(string_agg(term || ' ' || new, ',' ORDER BY term) FILTER (new IS NOT NULL), '') AS terms, count(*) FILTER (old IS NULL) AS added, count(*) FILTER (new IS NULL) AS removed, count(*) FILTER (old != new) AS changed FROM j GROUP BY doc_id)
SELECT doc_id, (CASE WHEN doc_id IN (SELECT doc_id FROM a) THEN 3 ELSE 0 END + CASE WHEN added + removed + changed > 0 THEN 1 ELSE 0 END)::BIGINT AS version, terms, added, removed, changed FROM g""",
}
