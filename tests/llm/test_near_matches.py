"""The second pass of the removal of repeated strings."""

import random

import numpy as np

from quillspark.llm import suffixdedup

SCHEMA = "doc_id long, text string"


def said(rng, n):
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


def removed(docs, size):
    return {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in suffixdedup.dedup_bytes(docs, size).collect()}


def plain(rows, size):
    seen = {}
    for d, t in rows:
        for p in range(len(t) - size + 1):
            seen[t[p : p + size]] = seen.get(t[p : p + size], 0) + 1
    want = set()
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p : p + size] = True
        want.add((d, len(t), int(gone.sum())))
    return want


def test_windows_of_a_common_string_spread(spark):
    rng = random.Random(1)
    size, seed, n = 200, 100, 16
    passage = said(rng, 190)
    texts = [(said(rng, 280) + passage + said(rng, 280)).encode() for _ in range(40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.arange(41) * 750
    row, pos, code, _ = suffixdedup.anchors(data, offsets, size, seed)
    hot = np.isin(code, [c for c, k in zip(*np.unique(code, return_counts=True), strict=True) if k >= 30])
    assert hot.any()
    row, pos, one, two = suffixdedup.windows(data, offsets, pos[hot] + offsets[row[hot]], size, seed)
    rows, _ = suffixdedup.batch_rows(0, n, row, pos, one, two)
    sizes = [len(r[2]) // 8 for r in rows]
    assert len(rows) == n and max(sizes) < 2 * sum(sizes) / n


def test_repeated_rows_in_several_partitions(spark):
    rng = random.Random(4)
    parts = [[] for _ in range(12)]
    for d in range(60):
        text = said(rng, 1500)
        for p in rng.sample(range(12), 5):
            parts[p].append((d, text))
        for k in range(12):
            at, long = rng.randrange(1100), rng.randrange(201, 400)
            rng.choice(parts).insert(0 if k % 2 else 10**6, (1000 + 12 * d + k, said(rng, 150) + text[at : at + long] + said(rng, 150)))
    docs = spark.createDataFrame(spark.sparkContext.parallelize(parts, 12).flatMap(list), SCHEMA)
    assert removed(docs, 200) == plain([r for p in parts for r in p], 200)


def test_all_lists_of_repeated_rows_are_kept(spark):
    lists = [(1, 5, None, [3]), (1, 5, None, [8, 9]), (1, 5, b"", None), (None, 6, None, [2]), (2, 6, b"", None)]
    first = spark.createDataFrame([(d, r, s, None if x is None else np.array(x, np.int64).tobytes()) for d, r, s, x in lists], suffixdedup.SPANS).repartition(3)
    got = {(r["_id"], r["_row"]): sorted(np.frombuffer(b"".join(r["near"]), np.int64).tolist()) for r in suffixdedup.near_places(first).collect()}
    assert got == {(1, 5): [3, 8, 9], (None, 6): [2]}
