"""Deletes later copies of runs of lines that repeat, within a document or across documents.

A suffix array over the sequences of line ids, by prefix doubling. Suffixes are ranked by their first line; the rank by
twice as many lines comes from the ranks of both halves, and doubling goes on with the suffixes whose rank others share,
until none does. Ranks are places in the order of all keys, by prefix sums over range-partitioned counts. Suffixes of one
rank are an interval of the array whose common prefix is as long as the ranks tell: a run that repeats. All its places but
the first, in the order of (doc_id, line), are later copies, and their lines go; what intervals of all lengths mark
adds up to the maximal runs.

Runs have min_lines lines at least; with min_words a single line of so many words is a run as well. Lines without a word
don't count: runs go across them, and those inside a deleted run go with it.

A null text has one empty line and comes back null. Rows equal in doc_id and text count as one document and
get the same result. A null doc_id comes before all others. An empty table gives no rows. A document of any length is one
row of lines. Further columns are kept; n_lines, n_removed and n_runs of docs are replaced by those of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import column, free_names, joined_by_key, written
from .sharding import with_prefix

WORD = r"[^\x20\x09-\x0D]"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def ranked(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """Of (doc_id, row, n) the rank by the columns of by, if others share it, and the first place with that rank.

    Keys are counted by a grouping that sums up before it shuffles.
    """
    place = F.struct("doc_id", "row", "n")
    keys = suffixes.groupBy(*by).agg(F.count("*").alias("size"), F.min(place).alias("name"), F.max(place).alias("last")).where("name != last").drop("last")
    keys = written(with_prefix(written(keys, "keys"), by, {"rank": "size"}), "ranks")
    return joined_by_key(suffixes, keys, by, ["rank", "name"]).drop(*by)


def has_words(line: Column, n: int) -> Column:
    """Whether line has n words at least; linear in its length, as nothing is tried twice."""
    return line.rlike(rf"^[\x20\x09-\x0D]*+(?:{WORD}++[\x20\x09-\x0D]++){{{n - 1}}}{WORD}")


def later_copies(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """doc_id, row, n and size (in lines) of runs that occur earlier; n counts the lines with a word. docs: doc_id, text."""
    line = F.col("line")
    worded = F.filter(lines_of(F.col("text")), lambda x: x.rlike(WORD))
    each = docs.select("doc_id", row_key().alias("row"), F.posexplode(worded).alias("n", "line"))
    long = [] if min_words is None else [has_words(line, min_words).alias("long")]
    ids = each.select("doc_id", "row", "n", F.xxhash64(line).alias("one"), F.xxhash64(F.lit(1), line, F.length(line)).alias("two"), *long)
    runs, length = written(ranked(ids, ["one", "two"]), "suffixes"), 1
    later = F.struct("doc_id", "row", "n") != F.col("name")
    mark = lambda rows: rows.select("doc_id", "row", "n", F.lit(length).alias("size"))
    found = mark(runs.where(F.col("long") & later)) if long else mark(runs.where("false"))
    while True:
        if length >= min_lines:
            found = found.union(mark(runs.where(later)))
        step = length if length >= min_lines else min(length, min_lines - length)
        ahead = Window.partitionBy("doc_id", "row").orderBy("n").rangeBetween(step, step)
        both = runs.select("doc_id", "row", "n", F.col("rank").alias("first"), F.max("rank").over(ahead).alias("second")).where("second is not null")
        runs, length = written(ranked(both, ["first", "second"]), "suffixes"), length + step
        if not runs.limit(1).count():
            return found


def dedup_lines(docs: DataFrame, min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """docs with text as what is kept, and n_lines, n_removed and n_runs (maximal deleted runs)."""
    row, lines, places, gone, runs, other, other_id = free_names(docs, "row", "lines", "places", "gone", "runs", "other", "other_id")
    marks = later_copies(docs.select("doc_id", "text"), min_lines, min_words)
    # of runs that begin at one line the longest
    longest = marks.groupBy("doc_id", "row", "n").agg(F.max("size").alias("size"))
    held = longest.groupBy(F.col("doc_id").alias(other_id), F.col("row").alias(other)).agg(F.collect_list(F.struct("n", "size")).alias(runs))
    found = docs.withColumn(row, row_key())
    found = found.join(held, found["doc_id"].eqNullSafe(held[other_id]) & (found[row] == held[other]), "left")
    found = found.withColumn(lines, lines_of(F.col("text")))
    worded = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(WORD))
    found = found.withColumn(places, F.when(F.col(runs).isNotNull(), worded))
    # each start of a longer run has a mark of its own, so min_lines of each are enough
    covered = F.transform(runs, lambda r: F.sequence(F.get(places, r["n"]), F.get(places, r["n"] + F.least(r["size"], F.lit(max(1, min_lines))) - 1)))
    found = found.withColumn(gone, F.array_sort(F.array_distinct(F.flatten(covered))))
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i)), "\n")
    begun = F.size(F.filter(gone, lambda n, i: F.coalesce(F.get(gone, i - 1) != n - 1, F.lit(True))))
    whole = F.col(gone).isNull()
    return found.select(
        *[F.when(whole, F.col("text")).otherwise(kept).alias("text") if c == "text" else column(found, c) for c in docs.columns if c not in ("n_lines", "n_removed", "n_runs")],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.size(gone)).cast("long").alias("n_removed"),
        F.when(whole, 0).otherwise(begun).cast("long").alias("n_runs"),
    )
