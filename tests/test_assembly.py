"""Blocks shown or absorbed, each once, with ties."""

import collections

import pytest

from quillspark.operators import assembly

BLOCKS = "doc_id long, page long, idx long, block_type string, role string, policy string, text string, target string, hidden boolean, image boolean, caption_idx long, caption_of long, protected boolean, top double, bottom double"


def block(idx, kind, text="x", target=None, page=0, **more):
    named = {"doc_id": 1, "page": page, "idx": idx, "block_type": kind, "role": "body", "policy": "translate", "text": text, "target": target, "hidden": None, "image": None, "caption_idx": None, "caption_of": None, "protected": None, "top": 100.0 * idx, "bottom": 100.0 * idx + 50}
    return tuple((named | more).values())


@pytest.fixture(scope="module")
def got(spark):
    rows = [
        block(0, "heading", "Title", "TITLE"),
        block(1, "figure", "pixels", None, caption_idx=2),
        block(2, "caption", "Figure 1. A", "CAP", caption_of=1),
        block(3, "paragraph", "why", "WHY"),
        block(4, "paragraph", "far", "FAR", top=1000.0, bottom=1050.0),
        block(5, "table", "a|b", None, caption_idx=6, top=1100.0, bottom=1150.0),
        block(6, "caption", "Table 1", "TAB", top=1200.0, bottom=1210.0),
        block(7, "equation", "e=1", None, caption_idx=6, top=1220.0, bottom=1230.0),  # asks for the table's caption as well
        block(8, "paragraph", "both ask", "BOTH", top=1240.0, bottom=1250.0),
        block(10, "paragraph", "https://example.org/x", "L", page=1),
        block(11, "paragraph", "def f(x):", "D", page=1),
        block(12, "paragraph", "p", "P", policy="protect", page=1),
        block(13, "paragraph", "m", "M", policy="mixed", page=1),
        block(14, "paragraph", "s", "", protected=True, page=1),
        block(15, "paragraph", None, None, page=1, role=None),
        block(16, "paragraph", "foot", "F", role="footer", page=1),
        block(17, "figure", "h", None, hidden=True, caption_idx=18, page=1),
        block(18, "caption", "lost", "LOST", page=1),
        block(19, "image", "i", "I", image=True, caption_idx=10, page=1),  # names no caption
        block(20, "table", "t", "T", page=1),
        block(21, "caption", "names one", "N", caption_of=20, page=1),
    ]
    return {r.idx: r for r in assembly.assembled(spark.createDataFrame(rows, BLOCKS).repartition(3)).collect()}


def test_modes_and_states(got):
    brief = {i: (r.state, r.owner, r.render_mode, r.artifact_kind, r.source_text, r.target_text, [*r.absorbed]) for i, r in got.items()}
    assert brief == {
        0: ("shown", None, assembly.TRANSLATED, None, "Title", "TITLE", []),
        1: ("shown", None, assembly.ANCHORED, "image", "Figure 1. A", "CAP", [2]),  # a caption ends the context
        2: ("absorbed", 1, None, None, None, None, []),
        3: ("shown", None, assembly.TRANSLATED, None, "why", "WHY", []),
        4: ("shown", None, assembly.TRANSLATED, None, "far", "FAR", []),
        5: ("shown", None, assembly.WRAPPED, "table", "a|b", "TAB", [6]),
        6: ("absorbed", 5, None, None, None, None, []),
        7: ("shown", None, assembly.WRAPPED, "equation", "e=1", "BOTH", [8]),
        8: ("absorbed", 7, None, None, None, None, []),
        10: ("shown", None, assembly.REFERENCE, "reference", "https://example.org/x", "L", []),
        11: ("shown", None, assembly.PRESERVED, "code", "def f(x):", "D", []),
        12: ("shown", None, assembly.PRESERVED, "protected_artifact", "p", "P", []),
        13: ("shown", None, assembly.INLINE, None, "m", "M", []),
        14: ("shown", None, assembly.INLINE, None, "s", None, []),
        15: ("shown", None, assembly.TRANSLATED, None, "", None, []),
        16: ("furniture", None, None, None, None, None, []),
        17: ("hidden", None, None, None, None, None, []),
        18: ("shown", None, assembly.TRANSLATED, None, "lost", "LOST", []),
        19: ("shown", None, assembly.ANCHORED, "image", "i", "I", []),
        20: ("shown", None, assembly.WRAPPED, "table", "t", "T", []),
        21: ("absorbed", 20, None, None, None, None, []),
    }


def test_each_block_once(spark, tiny):
    rows = assembly.chapter_blocks(spark, tiny)
    found = assembly.assembled(rows).collect()
    assert len(found) == rows.count() == len({(r.doc_id, r.idx) for r in found})
    owned = collections.Counter((r.doc_id, i) for r in found for i in r.absorbed)
    assert max(owned.values()) == 1
    states = collections.Counter(r.state for r in found)
    assert {*states} == {"shown", "absorbed", "hidden", "furniture"}
    by = {(r.doc_id, r.idx): r for r in found}
    for r in found:
        assert (r.owner is not None) == (r.state == "absorbed")
        for i in r.absorbed:
            assert by[r.doc_id, i].owner == r.idx
