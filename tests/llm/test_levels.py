"""The family of sorted arrays, against plain pairs, and what it costs."""

import collections

import numpy as np

from quillspark.llm.suffixdedup import Levels


def test_marks():
    rng = np.random.default_rng(1)
    for _ in range(30):
        batches = [np.unique(rng.integers(0, [12, 4], (rng.integers(1, 40), 2)), axis=0).astype(np.uint64) for _ in range(9)]
        index, at = Levels(sum(map(len, batches))), 0
        for b in batches:
            b = b[rng.permutation(len(b))]
            index.add(b[:, 0], b[:, 1], np.arange(at, at := at + len(b)))
            # the order of a batch doesn't matter for what is marked
        every = np.concatenate([np.concatenate([lv[0][:, None], lv[1][:, None]], 1) for lv in index.levels])
        assert len(np.unique(every, axis=0)) == len(every) == len({tuple(p) for b in batches for p in b.tolist()})
        pairs = collections.Counter(tuple(p) for b in batches for p in b.tolist())
        seeds = collections.defaultdict(set)
        for one, two in pairs:
            seeds[one].add(two)
        for one, two, number in zip(*(np.concatenate(c) for c in zip(*index.levels, strict=True)), strict=True):
            assert index.same[number] == (pairs[int(one), int(two)] > 1)
            assert index.near[number] == (len(seeds[int(one)]) > 1)
        for lv in index.levels:
            assert [*zip(lv[0].tolist(), lv[1].tolist(), strict=True)] == sorted(zip(lv[0].tolist(), lv[1].tolist(), strict=True))


def test_cost_of_many_batches():
    rng = np.random.default_rng(2)
    for n in (16, 64, 256):
        index = Levels(n * 100)
        for i in range(n):
            index.add(rng.integers(0, 2**63, 100, dtype=np.uint64), rng.integers(0, 2**63, 100, dtype=np.uint64), np.arange(100 * i, 100 * i + 100))
        assert len(index.levels) <= np.log2(n) + 1
        assert index.work <= 2.5 * n * 100 * (np.log2(n) + 1)
