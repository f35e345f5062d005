"""The corpus pipeline: quality rules, line dedup, near duplicates, repeated strings, packing.

Rows keep their other columns, whatever their names, up to the last stage. Empty tables give no rows. Nulls, empty and very
long texts, ties and repeated rows go as the docstrings of the stages' operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import linededup, ngramjoin, packing, qualityrules, queries, suffixdedup
from quillspark.llm.shared import free_names, written


#: A repeated line of so many words goes even if the lines around it differ.
LINE_WORDS = 5


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no name among them meets one of an operator's."""
    others = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(None).alias("none")])).alias("others"))


def shaped(df: DataFrame, like: DataFrame, cut: bool = True) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now where it has been cut."""
    column = lambda c: F.col(c) if c in ("doc_id", "text") else F.length("text").cast("long").alias(c) if cut and c == "n_chars" else F.col("others").getField(c).alias(c)
    return df.select(*[column(c) for c in like.columns])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null texts have no words and go."""
    return shaped(qualityrules.judged(apart(docs), queries.table(spark, sf_dir, "labels")).where("kept"), docs, cut=False)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without later copies of runs of lines; texts may become empty."""
    return shaped(linededup.dedup_lines(apart(docs), min_words=LINE_WORDS), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with its id; rows without an id or without words stay."""
    (head,) = free_names(docs, "head")
    heads = ngramjoin.similar_components(docs.select("doc_id", "text")).where("doc_id = component_id").select(F.col("doc_id").alias(head)).distinct()
    return docs.join(heads, docs["doc_id"] == F.col(head), "left_semi").union(docs.where("doc_id is null"))


def cut_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the bytes of repeated strings; texts may become empty."""
    return shaped(suffixdedup.dedup_bytes(apart(docs)), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, public_tokenizers.path(queries.VOCABULARY))


STAGES = [("quality_rules", keep_good), ("line_dedup", cut_lines), ("ngram_jaccard", one_of_near_copies), ("suffix_dedup", cut_strings), ("packing", pack)]
#: SQL can't express learned rules and byte pair encoding; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
