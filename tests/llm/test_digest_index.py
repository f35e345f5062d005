"""Exact duplicates against a plain version, over batches and over sessions."""

import collections
import hashlib

from pyspark.sql import functions as F

from quillspark.llm import digestindex, shared
from quillspark.llm.digestindex import DigestIndex

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda t: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
KEY = lambda r: tuple((x is not None, x) for x in r)


def test_same_as_plain(spark, docs, rows):
    more = spark.createDataFrame([(900, "É Ünder"), (901, "é Ünder"), (902, "É ünder"), (903, "É ÜNDER"), (904, "STRASSE"), (905, "strasse")], "doc_id long, text string")
    texts = [(r[0], r[1]) for r in rows] + [tuple(r) for r in more.collect()]
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[sha(t)].append(i)
    best = {k: max(v, key=lambda i: (i is not None, i)) for k, v in groups.items()}
    got = [tuple(r) for r in digestindex.exact_copies(docs.select("doc_id", "text").union(more)).collect()]
    assert sorted([(g[0], g[1], g[2], g[4]) for g in got], key=KEY) == sorted([(i, best[sha(t)], len(groups[sha(t)]), sha(t)) for i, t in texts], key=KEY)
    # one row of each text stays, also of rows that are equal in all
    assert collections.Counter(g[4] for g in got if g[3]) == dict.fromkeys(groups, 1)
    assert all(g[0] == g[1] for g in got if g[3])


def test_batches(spark, docs):
    path = shared.new_path(spark, "index")
    clash = docs.withColumns({"digest": F.lit(1), "row": F.lit(2), "batch": F.lit(3), "Row_number": F.lit(4), "keep_id": F.lit(5)})
    first = digestindex.add_batch(DigestIndex(spark, path, 3), clash.where("doc_id % 2 = 0"), "one")
    assert first.columns == clash.columns
    seen = {sha(r.text) for r in first.collect()}
    assert len(seen) == first.count() == docs.where("doc_id % 2 = 0").select(digestindex.normal(F.col("text"))).distinct().count()
    spark.sql(f"DROP TABLE {DigestIndex(spark, path).name}")  # as in another session
    index = DigestIndex(spark, path)
    assert index.parts == 3
    second = digestindex.add_batch(index, clash.where("doc_id % 2 = 1 or doc_id is null"), "two").collect()
    assert seen.isdisjoint(sha(r.text) for r in second) and len(second) > 10
    assert len(second) + len(seen) == docs.select(digestindex.normal(F.col("text"))).distinct().count()
    before = sorted(map(tuple, index.classes().collect()))
    again = digestindex.add_batch(index, clash.where("doc_id % 2 = 1 or doc_id is null"), "two")
    assert sorted(map(tuple, index.classes().collect())) == before
    assert again.count() == len(second) and sum(r[4] for r in before) == docs.count()


def test_index_side_needs_no_shuffle(spark, docs):
    index = DigestIndex(spark, shared.new_path(spark, "index"), 4)
    digests = digestindex.digested(docs)
    index.add(digests, "one")
    assert "Exchange" not in index.classes()._jdf.queryExecution().executedPlan().toString()
    plan = digests.join(index.log().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hash") == 1 and "SortMergeJoin" in plan


def test_empty(spark, docs):
    assert digestindex.exact_copies(docs.limit(0)).count() == 0
