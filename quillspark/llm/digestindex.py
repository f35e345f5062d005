"""Exact duplicates by a lasting index of digests, bucketed and sorted by digest.

A batch of texts is cut down to SHA-256 digests, grouped (with sums before the shuffle), and held by a sort-merge anti-join
against the index, whose side needs no shuffle: what is new is appended as first of its text, what is known as further
copies. The index is a log, and an aggregate inside its buckets gives the classes of all batches.

Texts are equal when they are after lower-casing A-Z alone. Within a batch the row with the largest doc_id stays; between
batches the one that was added first, as what has been published can't be taken back. Null texts are empty. A null
doc_id comes before all others; of rows equal in doc_id and text one stays. A text of any length is one digest. An empty
table gives no rows and an index without any. Further columns are kept, whatever their names (batch alone is replaced).

A batch that is added again, after a failure or by mistake, changes nothing. Two batches must not be added at once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import buckets, free_names, joined_by_key, new_path, quoted, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROWS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, size BIGINT, batch STRING, first BOOLEAN"


def normal(text: Column) -> Column:
    """text with A-Z in lower case, null as empty. Where all characters are single bytes, lower does the same."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text and a number of the row, as a table: each text is read once."""
    return written(docs.select("doc_id", F.unhex(F.sha2(normal(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


class DigestIndex:
    """The index below a folder that outlives the session. parts is the number of its buckets, fixed when it is made."""

    def __init__(self, spark: SparkSession, path: str, parts: int | None = None):
        self.spark, about = spark, f"{path}/about"
        has = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(about)
        if not has.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(has):
            spark.range(1).select(F.lit(parts or buckets(spark)).alias("parts")).coalesce(1).write.parquet(about)
        self.parts = spark.read.parquet(about).first()[0]
        self.name = f"digest_index_{hashlib.md5(path.encode()).hexdigest()}"
        rows = f"{path}/rows".replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({ROWS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.parts} BUCKETS LOCATION '{rows}'")

    def log(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, digests: DataFrame, batch: str) -> None:
        """Adds the rows of digested under the name of a batch."""
        groups = digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("size"))
        groups = written(groups.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), "size", F.lit(batch).alias("batch")), "groups")
        known, own = (self.log().where(where).select("digest").hint("merge") for where in (F.col("batch") != batch, F.col("batch") == batch))
        todo = groups.join(own, "digest", "left_anti")
        fresh = todo.join(known, "digest", "left_anti").withColumn("first", F.lit(True))
        again = todo.join(known, "digest", "left_semi").withColumn("first", F.lit(False))
        fresh.union(again).repartition(self.parts, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def classes(self) -> DataFrame:
        """digest, keep_id, keep_row, keep_batch and size of each text; inside the buckets, without a shuffle."""
        first = F.max(F.when(F.col("first"), F.struct("keep_id", "keep_row", "batch"))).alias("keep")
        found = self.log().groupBy("digest").agg(first, F.sum("size").alias("size"))
        return found.select("digest", "keep.keep_id", "keep.keep_row", F.col("keep.batch").alias("keep_batch"), "size")


def add_batch(index: DigestIndex, docs: DataFrame, batch: str) -> DataFrame:
    """The rows of docs whose text no earlier batch has, one for each text; they are in the index then."""
    (number,) = free_names(docs, "row_number")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "batch")
    digests = written(rows.select("doc_id", F.unhex(F.sha2(normal(F.col("text")), 256)).alias("digest"), F.col(number).alias("row")), "digests")
    index.add(digests, batch)
    kept = index.log().where(F.col("first") & (F.col("batch") == batch)).select(F.col("keep_row").alias(number))
    return rows.join(kept, number, "left_semi").select(*[quoted(c) for c in docs.columns])


def exact_copies(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row of docs, which come in two batches by doc_id, the upper
    half first, so that the largest doc_id of all stays. path: a folder for a new index, kept for batches to come."""
    spark = docs.sparkSession
    index, digests = DigestIndex(spark, path or new_path(spark, "digest_index")), digested(docs)
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    upper = F.coalesce(F.col("doc_id") > (0 if low is None else (low + high) // 2), F.lit(False))
    index.add(digests.where(upper), "upper")
    index.add(digests.where(~upper), "lower")
    found = joined_by_key(digests, written(index.classes(), "classes"), ["digest"], ["keep_id", "keep_row", "size"])
    return found.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
