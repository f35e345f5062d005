"""Runs against a plain version: every period of every text is tried."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import periodicruns, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p if i >= a else i] for i in range(n)]


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_few_words(least):
    rng = random.Random(least)
    texts = ["", "a", "aa", "a" * 50, "ab" * 40, "ababab" + "ababababababa" * 2 + "b", fibonacci(150), "".join("ab"[bin(i).count("1") % 2] for i in range(130))]
    texts += ["".join(rng.choices("ab", k=rng.randrange(1, 90))) for _ in range(150)]
    texts += ["".join(rng.choices("abc", k=rng.randrange(1, 8))) * rng.randrange(1, 12) for _ in range(100)]
    texts += ["".join("".join(rng.choices("ab", k=rng.randrange(1, 7))) * rng.randrange(1, 9) for _ in range(6)) for _ in range(150)]
    texts += [(t := "ab" * rng.randrange(1, 12) + "a") * 2 + t[: rng.randrange(len(t))] for _ in range(30)]
    words = np.array([ord(c) for t in texts for c in t], np.int64)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, end, period = periodicruns.runs_of(words, np.repeat(at[:-1], np.diff(at)), least)
    text = np.searchsorted(at, start, "right") - 1
    for k, t in enumerate(texts):
        mine = text == k
        got = list(zip((start[mine] - at[k]).tolist(), (end - start)[mine].tolist(), period[mine].tolist(), strict=True))
        assert got == plain(t, least), t


def test_query_of_all_texts(spark, tiny, docs, rows):
    given = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, tiny).collect()}
    assert len(got) == len(given)
    hit = 0
    for i, t in given:
        words = planted(i, WORD.findall(t or ""))
        runs = plain(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        want = (i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        assert tuple(got[i]) == want
        hit += bool(runs)
    assert 10 < hit < len(given)


def test_odd_cases(spark, docs, rows):
    clash = docs.withColumns({"runs": F.lit(1), "N_words": F.lit(2), "start": F.lit(3), "length": F.lit(4), "words": F.lit(5)}).withColumn("collapsed", F.lit(6))
    got = periodicruns.periodic_runs(clash)
    assert got.columns == [*docs.columns, "start", "length", "words", "n_words", "runs", "collapsed"]
    want = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        runs = plain(words)
        want.append((r[0], r[1], len(words), [*runs], collapsed(words, runs)))
    mine = [(r.doc_id, r.text, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert periodicruns.periodic_runs(docs.limit(0)).count() == 0
    # null ids, ids without words and repeated rows plant nothing and fail nothing
    odd = spark.createDataFrame([(i, t) for i in (None, *range(60)) for t in (None, "", " \t\n", "x y z w " * 30, "one")], "doc_id long, text string")
    back = {(r.doc_id, r.text): r.p for r in odd.join(periodicruns.with_planted_runs(odd.withColumn("t", F.col("text"))).select(F.col("doc_id").alias("i"), "t", F.col("text").alias("p")), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("text").eqNullSafe(F.col("t"))).collect()}
    for (i, t), p in back.items():
        assert WORD.findall(p or "") == planted(i, WORD.findall(t or ""))


def test_a_long_text(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(200_000)]
    words[50_000:90_000] = (words[50_000:50_777] * 60)[:40_000]
    text = " ".join(words)
    (got,) = periodicruns.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.start, r.period) for r in got.runs] == [(50_000, 777)] and got.runs[0].length >= 40_000
    assert len(WORD.findall(got.collapsed)) == 200_000 - got.runs[0].length + 777
