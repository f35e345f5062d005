"""Which entry of a term holds, and when a version goes up."""

from quillspark.operators import termbase


def test_refresh(spark):
    entries = spark.createDataFrame(
        [
            (1, None, "Fox ", "locked doc", "locked", 9), (1, 4, "fox", "chapter", "suggested", 1), (1, 4, "FOX", "chapter newer", "suggested", 2),
            (1, None, "dog", "a", "preferred", 1), (1, None, "Dog", "b", "suggested", 7), (1, None, "cat  food", "same", "locked", 1), (1, None, "cat food", "other", "locked", 1),
            (1, None, " ", "x", "locked", 1), (1, None, "none", None, "locked", 1), (1, None, None, "x", "locked", 1), (2, None, "ant", "kept", "locked", 1), (4, None, "new", "n", "locked", 1),
        ],
        "doc_id long, chapter_id long, source string, target string, lock_level string, version int",
    )
    current = spark.createDataFrame([(1, 5, [("dog", "z", "preferred"), ("gone", "g", "locked")]), (2, 7, [("ant", "kept", "locked")]), (3, 2, [("old", "o", "locked")]), (5, 1, None)], f"doc_id long, version int, terms {termbase.TERMS}")
    got = {r.doc_id: (r.version, [tuple(t) for t in r.terms], r.added, r.removed, r.changed) for r in termbase.refreshed(entries, current).collect()}
    assert got == {
        1: (6, [("cat food", "same", "locked"), ("dog", "a", "preferred"), ("fox", "chapter newer", "suggested")], 2, 1, 1),
        2: (7, [("ant", "kept", "locked")], 0, 0, 0),
        3: (3, [], 0, 1, 0),
        4: (1, [("new", "n", "locked")], 1, 0, 0),
        5: (1, [], 0, 0, 0),
    }
    # what has been refreshed is not refreshed again
    once = termbase.refreshed(entries, current).select("doc_id", "version", "terms")
    assert all(r.added + r.removed + r.changed == 0 for r in termbase.refreshed(entries, once).collect())
