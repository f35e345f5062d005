"""Phrases against a plain version, with small tries, vocabularies and tables so that all of them are cut."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import phrases, shared

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f[lang].update(tuple(words[i : i + m]) for m in range(1, 6) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inner = {p[i : i + m] for p, a in held.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if counts[p[i : i + m]] <= a}
        found = []
        for p, a in held.items():
            if p not in inner:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


def some_rows():
    rng = random.Random(2)
    words = [f"W{chr(0xE9) * (k % 3)}o{k}" for k in range(60)] + ["a\x01", "a", "b", "\x0bé"]
    fixed = [[rng.choice(words) for _ in range(rng.randrange(2, 7))] for _ in range(25)]
    rows = [(None, "en"), ("", None), (" .,\n", "xx"), ("Ä", None), ("a b a b a b a b " * 40, None), (("x " * 30 + ". ") * 20, "de")]
    for k in range(400):
        said = [w for _ in range(rng.randrange(1, 12)) for w in (rng.choice(fixed) if rng.random() < 0.6 else [rng.choice(words)])]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", " ! "]) for w in said), rng.choice(["en", "EN", None, "de"])))
    return rows + rows[-40:]


@pytest.mark.parametrize(("least", "top", "bits"), [(10, 50, None), (3, 10_000, 16), (25, 5, 20)])
def test_same_as_plain(spark, monkeypatch, least, top, bits):
    for name, size in (("TEXT", 3000), ("VOCABULARY", 17), ("PHRASES", 40)):
        monkeypatch.setattr(phrases, name, size)
    rows = some_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, word int, ids string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, top, bits).collect())
    want = plain(rows, least, top)
    assert got == want and len(want) > 5


def test_trie_against_counts():
    rng = np.random.default_rng(4)
    for size in (1, 3, 40, 3000):
        ids = np.where(rng.random(20_000) < 0.1, 0, rng.integers(1, size + 1, 20_000) * 7).astype(np.int32)
        every = collections.Counter(tuple(ids[i : i + m].tolist()) for m in range(1, 6) for i in range(len(ids) - m + 1) if (ids[i : i + m] > 0).all())
        some = sorted({tuple(p) + (0,) * (5 - len(p)) for p in rng.permutation(np.array([*every], object))[:4000].tolist()} | {(5, 0, 0, 0, 0), (5, 14, 0, 0, 0)})
        trie = phrases.Trie(np.array(some, np.int32))
        total = trie.count(ids)
        for k, p in enumerate(some):
            (state,) = np.flatnonzero(trie.accepts == k)
            assert total[state] == every[tuple(x for x in p if x)]


def test_products_beyond_64_bits(spark):
    n = 3 * 10**13
    words = spark.createDataFrame([(1, "en", 10**12, n), (2, "en", 2 * 10**12, n)], "id int, lang string, f long, n long")
    found = spark.createDataFrame([([1, 2], 10**12)], "words array<int>, f long")
    (got,) = phrases.scored(found, words).collect()
    assert got.score == 1000 * 10**12 * n // (10**12 * 2 * 10**12)


def test_empty(spark, docs):
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.select("doc_id", F.lit(None).cast("string").alias("text"), "lang")).count() == 0
    assert phrases.collocations(docs, least=10**6).count() == 0
    assert shared.clear(spark) > 0
