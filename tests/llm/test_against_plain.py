"""Each operator against a plain version, on a small fixture with every odd case."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillspark.llm import linededup, ngramjoin, ngramlm, packing, qualityrules, sharding, suffixdedup, tokenfiles, transducer, vectorsearch  # noqa: E402
from quillspark.llm.bytebpe import Encoder, Merges, Transducer, encoder  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
KEY = lambda r: tuple((x is not None, x) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=KEY) == sorted(map(tuple, want), key=KEY)


@pytest.fixture(scope="module")
def ids(rows):
    library = Tokenizer.from_file(PATH)
    return [np.array(library.encode(r[1] or "", add_special_tokens=False).ids, "<u4") for r in rows]


def test_packing(docs, rows, ids):
    got = [r.asDict() for r in packing.packed_documents(docs, PATH, 512).collect()]
    want = collections.Counter((r[0], len(i) + 1, zlib.crc32(np.append(i, 1).astype("<u4"))) for r, i in zip(rows, ids, strict=True) if len(i) < 512)
    assert want == collections.Counter((g["doc_id"], g["doc_tokens"], g["ids_crc32"]) for g in got if g["doc_tokens"] <= 512)
    assert sum(len(i) + 1 for i in ids) == sum(g["length"] for g in got)
    # each piece of a document that is cut holds its ids from start on
    whole = collections.defaultdict(list)
    for r, i in zip(rows, ids, strict=True):
        whole[r[0], len(i) + 1].append(np.append(i, 1).astype("<u4"))
    for g in got:
        assert any(zlib.crc32(i[g["start"] : g["start"] + g["length"]]) == g["ids_crc32"] for i in whole[g["doc_id"], g["doc_tokens"]])
    assert any(g["start"] > 0 for g in got)
    used = collections.defaultdict(list)
    for g in got:
        used[g["sequence_id"]].append((g["offset"], g["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 512


def test_fill_finds_the_closest_total():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 40, 12)
        left = np.bincount(lengths, minlength=101)
        found = packing.fill(left, 100, 17)
        total = 17 + sum(a * b for a, b in found)
        sums = {17}
        for x in lengths.tolist():
            sums |= {s + x for s in sums if s + x <= 100}
        assert total == max(sums) and all(b <= left[a] for a, b in found)


def test_token_files(spark, docs, rows, ids):
    folder = tokenfiles.new_folder(spark)
    got = tokenfiles.read_files(tokenfiles.write_files(docs, PATH, folder), folder).collect()
    assert collections.Counter((r[0], len(i) + 1, zlib.crc32(np.append(i, 0).astype("<u4"))) for r, i in zip(rows, ids, strict=True)) == collections.Counter((g["doc_id"], g["n_tokens"], g["ids_crc32"]) for g in got)
    at = 0
    for g in sorted(got, key=lambda g: (g["doc_id"] is not None, g["doc_id"], g["start"])):
        assert g["start"] == at
        at += g["n_tokens"]


def test_transducer(docs, rows, ids):
    same(transducer.round_trip(docs, PATH).collect(), [(r[0], len(i), hashlib.sha256(i).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r, i in zip(rows, ids, strict=True)])


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 3000, " " * 3000 + "x", "é" * 2000, "-=" * 2000, "x'll 'll", "<|endoftext|>\n" * 400])
def test_streams_in_small_blocks(text):
    encoder = Encoder(PATH, block=16)
    found = np.concatenate([*encoder.stream(text)])
    assert found.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert "".join(encoder.decode(found, step=5)) == text


def test_shards(docs, rows):
    got = [r.asDict() for r in sharding.byte_shards(docs).collect()]
    size = lambda t: len((t or "").encode()) + 1
    assert collections.Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == collections.Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    by = collections.defaultdict(list)
    for g in got:
        by[g["shard"]].append(g["slot"])
    assert all(sorted(s) == [*range(len(s))] for s in by.values())
    sizes = [sum(g["size"] for g in got if g["shard"] == k) for k in range(8)]
    assert all(abs(n - sum(sizes) / 8) <= max(g["size"] for g in got) for n in sizes)
    got.sort(key=lambda g: (g["doc_id"] is not None, g["doc_id"], g["shard"], g["slot"]))
    assert [g["shard"] for g in got] == sorted(g["shard"] for g in got)


def test_suffix_dedup(docs, rows):
    size, seen = 200, collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        seen.update(b[p : p + size] for p in range(len(b) - size + 1))
    want = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - size + 1):
            if seen[b[p : p + size]] > 1:
                gone[p : p + size] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((r[0], len(b), int(gone.sum()), int(np.diff(gone.astype(int), prepend=0).clip(0).sum()), hashlib.sha256(left).hexdigest()))
    got = suffixdedup.dedup_bytes(docs.withColumn("row", F.lit(1)).withColumn("spans", F.lit(2)))
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), want)


WORD = re.compile(r"[^\x20\x09-\x0D]+")
low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_language_model(docs, rows):
    texts = [WORD.findall(low(r[1])) for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in rows]
    counts = collections.Counter(w for t, h in zip(texts, held, strict=True) if not h for w in [*t, None])
    whole = math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    want = [(r[0], h, len(t) + 1, sum(counts[w] > 0 for w in [*t, None]), sum(counts.values())) for r, t, h in zip(rows, texts, held, strict=True)]
    base = sorted(sum(math.log10(counts[w] + 0.1) - whole for w in [*t, None]) for t in texts)
    got = ngramlm.scores(docs).collect()
    same([g[:5] for g in got], want)
    assert np.allclose(sorted(g["base_score"] for g in got), base)
    assert all(g["score"] < 0 and math.isfinite(g["score"]) for g in got)


def test_scores_against_a_plain_model(docs, rows):
    """Exact counts in place of the filters' levels; a false hit of a filter may raise a score a little."""
    share, weight, begin = 0.7, 4.0, "<"
    texts = [[begin, *WORD.findall(low(r[1])), None] for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 10 == 0 for r in rows]
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip(t, t[1:], strict=False))
    three = collections.Counter(p for t in train for p in zip(t, t[1:], t[2:], strict=False))
    total = sum(one.values()) - one[begin]
    ends = lambda w: [32, *("" if w is None else w).encode(), 32]
    byte = collections.Counter()
    for w, c in one.items():
        if w != begin:
            for p in zip(ends(w), ends(w)[1:], strict=False):
                byte[p] += c
    after = collections.Counter()
    for (x, _), c in byte.items():
        after[x] += c
    level = lambda c: int(ngramlm.levels_of(np.array([c]))[0])

    def spelt(w):
        return math.prod((byte[x, y] + 1) / (after[x] + 225) for x, y in zip(ends(w), ends(w)[1:], strict=False))

    def unigram(w):
        return share * one[w] / total + (1 - share) * spelt(w)

    def bigram(h, w):
        return (ngramlm.LEAST[level(two[h, w])] + weight * unigram(w)) / (one[h] + weight)

    def trigram(g, h, w):
        context = ngramlm.GREATEST[level(two[g, h])]
        return (ngramlm.LEAST[level(three[g, h, w])] + weight * bigram(h, w)) / (context + weight)

    want = [math.log10(bigram(t[0], t[1])) + sum(math.log10(trigram(*p)) for p in zip(t, t[1:], t[2:], strict=False)) for t in texts]
    key = collections.defaultdict(list)
    for r, w, t in zip(rows, want, texts, strict=True):
        key[r[0], len(t) - 1].append(w)
    near = total_rows = 0
    for g in ngramlm.scores(docs).collect():
        best = min(key[g["doc_id"], g["n_tokens"]], key=lambda w: abs(w - g["score"]))
        near += abs(best - g["score"]) < 1e-6 * abs(best) + 1e-9
        total_rows += 1
        assert abs(best - g["score"]) < 0.02 * abs(best) + 1
    assert near >= 0.4 * total_rows
    known = [w for w in one if w != begin]
    for g, h in [(begin, texts[12][1]), *list(two)[5:200:20]]:
        if h is not None:
            assert sum(bigram(h, w) for w in known) <= 1 + 1e-9
            assert sum(trigram(g, h, w) for w in known) <= 1 + 1e-9


def test_spelling_is_a_distribution():
    symbols = [b for b in range(256) if b not in b"\x20\x09\x0a\x0b\x0c\x0d" and not 65 <= b <= 90] + [32]
    pairs = np.zeros((256, 256), np.int64)
    pairs[np.ix_(symbols, symbols)] = np.random.default_rng(4).integers(0, 50, (len(symbols),) * 2)
    p = 10 ** ngramlm.log_spelling(pairs.ravel()).reshape(256, 256)[np.ix_(symbols, symbols)]
    assert np.allclose(p.sum(1), 1)


def test_filter_counts():
    keys = np.arange(5000)
    counts = np.random.default_rng(2).integers(1, 10**6, 5000)
    held = ngramlm.CountFilter(keys, counts)
    found = held.levels(keys)
    assert (found >= ngramlm.levels_of(counts)).all() and (found == ngramlm.levels_of(counts)).mean() > 0.97
    assert (held.levels(keys + 10**6) > 0).mean() < 0.03
    every = np.arange(1, 3000)
    assert (ngramlm.LEAST[ngramlm.levels_of(every)] <= every).all() and (ngramlm.GREATEST[ngramlm.levels_of(every)] >= every).all()


def test_line_dedup(docs, rows):
    seen, want = {}, []
    for r in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=KEY) + [(None, "no id here " * 30), (None, None)]:
        lines = (r[1] or "").split("\n")
        gone = [False] * len(lines)
        for n, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if all(WORD.search(x) for x in pair) and seen.setdefault(pair, (r[0], n)) != (r[0], n):
                gone[n] = gone[n + 1] = True
        left = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        want.append((r[0], r[1], len(lines), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    got = linededup.dedup_lines(docs.withColumn("original", F.col("text"))).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    same({tuple(r) for r in got.select("doc_id", "original", "n_lines", "n_removed", "sha").collect()}, set(want))


def test_statistics(docs, rows):
    want = []
    for r in rows:
        t = r[1] or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        want.append((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered), failed))
    got = qualityrules.statistics(docs).select("doc_id", *qualityrules.STATISTICS, "base_failed").collect()
    same(got, want)


def test_rules_are_learned(spark, tiny):
    tiny = tiny.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "labels"))
    found = qualityrules.judged(docs, labels).join(labels, "doc_id").where("not base_failed")
    bad, good = (found.where(f"quality = {q}") for q in (0, 1))
    assert good.where("kept").count() >= 0.95 * good.count()
    assert qualityrules.learn(docs, labels.limit(0)) == []
    assert bad.count() == 0 or bad.where("not kept").count() > 0


def test_join(docs, rows):
    held, ids = collections.defaultdict(set), [r[0] for r in rows]
    for r in rows:
        w = WORD.findall(low(r[1]))
        held[r[0]] |= {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [held[i] for i in ids]
    parent = {i: i for i in ids if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ids[i] is not None and ids[j] is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(ids[i]), root(ids[j])))
                parent[b] = a
    want = {(i, len(s), root(i)) for i, s in zip(ids, sets, strict=True) if i is not None}
    got = {tuple(r) for r in ngramjoin.similar_components(docs).collect()}
    assert {g for g in got if g[0] is not None} == want


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(41), 100, 101, 200]], "node long")
    got = dict(map(tuple, ngramjoin.components(nodes, links).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}


def test_neighbours(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(100_000, None), (100_001, [0.0] * 64), (100_002, [float("nan")] * 64), (100_050, [1.0, None] * 32), (None, [1.0] * 64), (100_003, [1.0])], "vec_id long, embedding array<float>")
    rows = rows.union(odd)
    got = vectorsearch.neighbours(rows, rows.where("vec_id % 50 = 0")).collect()
    kept = [r for r in rows.collect() if r[0] is not None and r[1] and len(r[1]) == 64 and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    x, ids = np.array([r[1] for r in kept], float), np.array([r[0] for r in kept])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert {g["query_id"] for g in got} == {*asked} and len(got) == 5 * len(asked)
    hits = 0
    for q in asked:
        score = unit @ unit[ids == q][0]
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:5]
        mine = sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])
        hits += len({ids[i] for i in best} & {g["vec_id"] for g in mine})
        assert [g["rank"] for g in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score[ids == g["vec_id"]][0] - g["score"]) < 1e-9 for g in mine)
    assert hits >= 0.9 * 5 * len(asked)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for found in (packing.packed_documents(none, PATH), transducer.round_trip(none, PATH), sharding.byte_shards(none), suffixdedup.dedup_bytes(none), ngramlm.scores(none), linededup.dedup_lines(none), qualityrules.judged(none, spark.createDataFrame([], "doc_id long, quality int")), ngramjoin.similar_components(none), vectorsearch.neighbours(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2)):
        assert found.count() == 0
    folder = tokenfiles.new_folder(spark)
    assert tokenfiles.read_files(tokenfiles.write_files(none, PATH, folder), folder).count() == 0
