"""Greedy groups against a plain fold."""

import random

import pytest

from quillspark.operators import structure


def plain(lengths, short, most, room):
    out, first, count, total = [], -1, 0, 0
    for place, n in enumerate(lengths):
        if first < 0 or n > short or count == most or total + n > room:
            first, count, total = place, 0, 0
        count, total = count + 1, total + n
        out.append(first)
        if n > short:
            first = -1
    return out


@pytest.mark.parametrize(("short", "most", "room"), [(420, 3, 900), (50, 5, 60), (10, 1, 10), (30, 2, 5)])
def test_groups(spark, short, most, room):
    rng = random.Random(short)
    docs = {d: [rng.choice([0, 1, 5, 20, 49, 50, 51, 419, 420, 421, 2000]) for _ in range(rng.choice([1, 2, 3, 17, 64, 65, 200]))] for d in range(40)}
    rows = [(d, 3 * i, n) for d, held in docs.items() for i, n in enumerate(held)]
    found = structure.greedy_groups(spark.createDataFrame(rows, "doc_id long, at int, n int").repartition(3), "doc_id", "at", "n", 200, short, most, room)
    got = {(r.doc_id, r.place): r.first for r in found.collect()}
    assert got == {(d, i): f for d, held in docs.items() for i, f in enumerate(plain(held, short, most, room))}


def test_no_python_and_one_shuffle(spark, tiny):
    plan = structure.merged_blocks(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and plan.count("Exchange hashpartitioning") == 1
