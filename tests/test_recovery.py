"""The chain of passes against a plain version, and the lines of all blocks, each once."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import recovery
from quillspark.operators.layout import TERMINAL
from quillspark.operators.repairs import CODE_LINE, SENTENCE

code, text = re.compile(CODE_LINE), lambda b: "\n".join(x for *_, x in b["lines"])
blank = lambda x: not x.strip(" ")


def flagged(b, flag):
    if flag not in b["flags"]:
        b["flags"].append(flag)


def runs(blocks, goes_on, flag):
    out = []
    for i, b in enumerate(blocks):
        if i and goes_on(blocks[i - 1], b):
            last = out[-1]
            last["lines"] = last["lines"] + b["lines"]
            last["last_page"] = max(last["last_page"], b["last_page"])
            last["flags"] = [*dict.fromkeys(last["flags"] + b["flags"])]
            last["joined"] = True
        else:
            out.append({**b, "flags": [*b["flags"]], "joined": False})
    for b in out:
        if b["joined"]:
            flagged(b, flag)
    return out


def near(a, b):
    return b["page"] - a["last_page"] <= 1


def plain(raw):
    """raw: sorted (idx, page, role, level, text) of one document."""
    bs = [{"at": (i, 0), "page": p, "last_page": p, "role": r, "level": v, "flags": [], "lines": [(i, n, x) for n, x in enumerate(t.split("\n"))]} for i, p, r, v, t in raw]
    pages = collections.defaultdict(list)
    for b in bs:
        pages[b["page"]].append(b)
    edges = [(k, b) for held in pages.values() if len(held) > 1 for k, b in (("header", held[0]), ("footer", held[-1]))]
    mask = lambda b: re.sub("[0-9]+", "#", text(b))
    same = collections.Counter((k, mask(b)) for k, b in edges)
    for k, b in edges:
        if same[k, mask(b)] >= 3 and not blank(mask(b)):
            b["role"] = k
            flagged(b, "edge_text")
    level = None
    for b in bs:
        if b["role"] == "heading":
            b["level"] = level = b["level"] or level or 1
    bs = runs(bs, lambda a, b: a["role"] == b["role"] == "heading" and a["level"] == b["level"] and near(a, b) and not re.search(TERMINAL, text(a)), "heading_joined")
    for b in bs:
        if b["role"] == "code" and len(re.findall(r"[^\s]+", text(b), re.ASCII)) >= 8 and not any(code.search(x) for *_, x in b["lines"]):
            b["role"] = "body"
            flagged(b, "prose")
    join_code = lambda bs: runs(bs, lambda a, b: a["role"] == b["role"] == "code" and near(a, b), "code_joined")
    bs = join_code(bs)
    cut = []
    for b in bs:
        if b["role"] not in ("code", "body"):
            cut.append(b)
            continue
        own = [None if blank(x) else "code" if code.search(x) else "body" for *_, x in b["lines"]]
        kinds, last = [], next((k for k in own if k), b["role"])
        for k in own:
            last = k or last
            kinds.append(last)
        pieces = []
        for k, line in zip(kinds, b["lines"], strict=True):
            if not pieces or pieces[-1][0] != k:
                pieces.append((k, []))
            pieces[-1][1].append(line)
        for n, (k, lines) in enumerate(pieces):
            cut.append({**b, "at": b["at"] if n == 0 else lines[0][:2], "role": k, "lines": lines, "flags": [*b["flags"]]})
            if len(pieces) > 1:
                flagged(cut[-1], "cut")
    bs = cut
    roles = [b["role"] for b in bs]
    for i in range(1, len(bs) - 1):
        if roles[i] == "body" and roles[i - 1] == roles[i + 1] == "code" and not re.search(SENTENCE, text(bs[i])):
            bs[i]["role"] = "code"
            flagged(bs[i], "promoted")
    bs = join_code(bs)
    width = lambda x: len(x.split("|"))
    for b in bs:
        if b["role"] == "body" and len(b["lines"]) > 1 and len({width(x) for *_, x in b["lines"]}) == 1 and width(b["lines"][0][2]) > 1:
            b["role"] = "table"
            flagged(b, "table")
    bs = runs(bs, lambda a, b: a["role"] == b["role"] == "table" and near(a, b) and width(a["lines"][0][2]) == width(b["lines"][0][2]), "table_joined")
    roles = [b["role"] for b in bs]
    for i, b in enumerate(bs):
        if b["role"] == "body" and re.search(recovery.CAPTION, text(b)) and any(0 <= j < len(bs) and roles[j] in ("table", "figure", "code") for j in (i - 1, i + 1)):
            b["role"] = "caption"
            flagged(b, "caption")
    return bs


@pytest.fixture(scope="module")
def raw(spark, tiny):
    return recovery.scanned_documents(spark, tiny).cache()


def test_same_as_plain(spark, tiny, raw):
    by = collections.defaultdict(list)
    for r in raw.collect():
        by[r.doc_id].append((r.idx, r.page, r.role, r.level, r.text))
    want, flags = [], collections.Counter()
    for d, rows in by.items():
        for b in plain(sorted(rows)):
            flags.update(b["flags"])
            want.append((d, *b["at"], b["page"], b["last_page"], b["role"], b["level"], len(b["lines"]), ",".join(dict.fromkeys(str(x[0]) for x in b["lines"])), ",".join(b["flags"]), hashlib.md5(text(b).encode()).hexdigest()))
    got = [tuple(r) for r in recovery.recovered_documents(spark, tiny).collect()]
    assert sorted(got, key=lambda r: r[:3]) == sorted(want, key=lambda r: r[:3])
    assert {*flags} >= {"edge_text", "heading_joined", "prose", "code_joined", "cut", "table", "table_joined", "caption"}


def test_lines_are_complete_and_disjoint(spark, raw):
    every = sorted((r.doc_id, r.idx, n, x) for r in raw.collect() for n, x in enumerate(r.text.split("\n")))
    for k in range(len(recovery.PASSES) + 1):
        if k in (0, 3, 6, len(recovery.PASSES)):
            found = recovery.recovered(raw, recovery.PASSES[:k]).select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.*")
            assert sorted(map(tuple, found.collect())) == every


def test_odd_blocks(spark):
    rows = spark.createDataFrame([(1, 0, None, None, None, None), (1, 1, 1, "code", None, "\n \n"), (1, 2, 1, "body", None, "\n\nx = f(1);\nSome prose here\n"), (None, 3, 2, "heading", None, "T"), (None, 4, 2, "heading", 1, "U")], "doc_id long, idx int, page int, role string, level int, text string")
    got = sorted((str(r.doc_id), r.at.idx, r.at.line, r.role, r.level, [x.line for x in r.lines], [*r.flags]) for r in recovery.recovered(rows).collect())
    assert got == [
        ("1", 0, 0, "body", None, [0], []), ("1", 1, 0, "code", None, [0, 1, 2, 0, 1, 2], ["cut", "code_joined"]), ("1", 2, 3, "body", None, [3, 4], ["cut"]),
        ("None", 3, 0, "heading", 1, [0, 0], ["heading_joined"]),
    ]


def test_one_shuffle(spark, raw):
    plan = recovery.recovered(raw)._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("Exchange hashpartitioning") == 1
