"""Figures against a plain fixed point, and the order of pages with one and two columns."""

import random

import numpy as np
import pytest

from quillspark.operators import figures


def plain(boxes, gx, gy):
    """The clusters of (id, x0, y0, x1, y1) by merging any two that touch until none do."""
    groups = [({i}, list(c)) for i, *c in boxes]
    again = True
    while again:
        again = False
        for a in range(len(groups)):
            for b in range(a + 1, len(groups)):
                (i, p), (j, q) = groups[a], groups[b]
                if p[0] - q[2] <= gx and q[0] - p[2] <= gx and p[1] - q[3] <= gy and q[1] - p[3] <= gy:
                    groups[a] = (i | j, [min(p[0], q[0]), min(p[1], q[1]), max(p[2], q[2]), max(p[3], q[3])])
                    del groups[b]
                    again = True
                    break
            if again:
                break
    return {x: min(g) for g, _ in groups for x in g}


def some_pages():
    rng = random.Random(1)
    rows, box = [], 0
    for page in range(60):
        for _ in range(rng.choice([1, 2, 5, 12, 30])):
            x, y = rng.randrange(0, 1000), rng.randrange(0, 1000)
            rows.append((page % 3, page, box, x, y, x + rng.choice([0, 5, 40, 200]), y + rng.choice([0, 5, 40, 200])))
            box += 1
    # a pinwheel, which no straight cut takes apart; a chain; and one box again and again
    rows += [(9, 0, 9000 + k, *c) for k, c in enumerate([(0, 0, 60, 20), (80, 0, 100, 60), (40, 80, 100, 100), (0, 40, 20, 100)])]
    rows += [(9, 1, 9100 + k, 30 * k, 30 * k, 30 * k + 20, 30 * k + 20) for k in range(40)]
    rows += [(9, 2, 9200 + k, 5, 5, 9, 9) for k in range(30)] + [(9, 3, 9300, None, 1, 2, 3)]
    return rows


@pytest.mark.parametrize("gap", [0, 10, 25])
def test_clusters_are_a_fixed_point(spark, gap):
    rows = some_pages()
    got = {(r.doc_id, r.page, r.box): r.cluster for r in figures.figure_clusters(spark.createDataFrame(rows, "doc_id long, page long, box long, x0 int, y0 int, x1 int, y1 int").repartition(5), gap, gap).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        mine = [r[2:] for r in rows if r[:2] == key and r[3] is not None]
        want |= {(*key, i): c for i, c in plain(mine, gap, gap).items()}
    assert got == want
    if gap == 10:
        assert len({got[9, 0, 9000 + k] for k in range(4)}) == 4 and len({got[9, 1, 9100 + k] for k in range(40)}) == 1


def test_many_boxes_in_strips(monkeypatch):
    monkeypatch.setattr(figures, "STRIP", 7)
    rng = np.random.default_rng(0)
    at = rng.integers(0, 400, (120, 2))
    corners = np.concatenate([at, at + rng.integers(0, 30, (120, 2))], axis=1).astype(float)
    group = figures.grown_together(corners, 6, 6)
    want = plain([(i, *c) for i, c in enumerate(corners.tolist())], 6, 6)
    assert len(set(zip(group.tolist(), [want[i] for i in range(120)], strict=True))) == len(set(want.values())) == len(set(group.tolist()))


def test_figures_of_vectors(spark, tiny):
    boxes = [tuple(r) for r in figures.drawings(spark, tiny).collect()]
    want = []
    for key in {r[:2] for r in boxes}:
        mine = [r[2:] for r in boxes if r[:2] == key and r[5] - r[3] >= 18 and r[6] - r[4] >= 18 and (r[5] - r[3]) * (r[6] - r[4]) >= 0.0025 * 1200 * 1600]
        groups = {}
        for i, c in plain(mine, 36, 48).items():
            groups.setdefault(c, []).append(next(b[1:] for b in mine if b[0] == i))
        for c, held in groups.items():
            x0, y0, x1, y1 = min(b[0] for b in held), min(b[1] for b in held), max(b[2] for b in held), max(b[3] for b in held)
            if (x1 - x0) * (y1 - y0) >= 0.018 * 1200 * 1600 and (x1 - x0 >= 264 or y1 - y0 >= 192):
                want.append((*key, c, len(held), x0, y0, x1, y1))
    got = [tuple(r) for r in figures.drawn_figures(spark, tiny).collect()]
    assert sorted(got) == sorted(want) and len({r[3] for r in got}) > 3


def test_order_of_columns(spark):
    two = [("title", 40, 0, 560, 20), ("l1", 40, 40, 290, 90), ("r1", 310, 30, 560, 95), ("l2", 40, 100, 290, 200), ("r2", 310, 100, 560, 150), ("mid", 40, 300, 560, 320), ("l3", 60, 330, 290, 350), ("r3", 310, 325, 560, 350), ("l4", 40, 360, 200, 380), ("r4", 400, 340, 560, 380), ("foot", 40, 900, 560, 920)]
    one = [("a", 40, 0, 300, 20), ("b", 350, 10, 400, 30), ("c", 40, 30, 320, 50), ("d", 40, 60, 300, 80)]
    ties = [("t2", 40, 5, 100, 9), ("t1", 40, 5, 100, 9), ("t0", 40, 5, 100, 9)]
    rows = [(1, page, i, x0, y0, x1, y1) for page, rows in enumerate((two, one, ties)) for i, x0, y0, x1, y1 in rows]
    got = figures.column_order(spark.createDataFrame(rows, "doc_id long, page long, idx string, x0 int, y0 int, x1 int, y1 int"), 600.0).collect()
    order = {p: [r.idx for r in sorted((r for r in got if r.page == p), key=lambda r: r.place)] for p in range(3)}
    assert order == {0: ["title", "l1", "l2", "r1", "r2", "mid", "l3", "l4", "r3", "r4", "foot"], 1: ["a", "b", "c", "d"], 2: ["t0", "t1", "t2"]}
