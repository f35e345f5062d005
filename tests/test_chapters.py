"""Pages of contents entries by each way, and ranges that have each page once."""

import pytest

from quillspark.operators import chapters


@pytest.fixture(scope="module")
def found(spark):
    entries = [(1, 0, 2, "Chapter 1: The Fox", 1), (1, 1, 2, "2.1 Of Dogs", 9), (1, 2, 2, "Other", 12), (1, 3, 2, " ", 3), (1, 4, 2, "None", None), (1, 5, 2, "Far", 400), (1, 6, 3, "of dogs", 11)]
    entries += [(2, 0, 1, "Cats", 4), (2, 1, 1, "Birds", 8), (3, 0, 1, "Bees", 5), (3, 1, 1, "Ants", 1), (4, 0, 1, "No sizes", 4)]
    headings = [(1, 2, "the fox"), (1, 4, "The  FOX"), (1, 7, "The fox"), (1, 12, "Chapter 7 of dogs"), (1, 3, "Of dogs"), (2, 50, "something"), (9, 4, "Cats")]
    footers = [(1, p, str(p - 1)) for p in range(3, 30)] + [(2, 1, "vii"), (2, 9, "vi"), (2, 10, "vii"), (2, 12, "x"), (2, 13, "no")]
    frame = spark.createDataFrame
    return chapters.resolved_contents(frame(entries, "doc_id long, entry long, page long, title string, printed_page long"), frame(headings, "doc_id long, page long, title string"), frame(footers, "doc_id long, page long, label string"), frame([(1, 40), (2, 20), (3, 9)], "doc_id long, last_page long"))


def test_ways(found):
    got = {(r.doc_id, r.entry): (r.start_page, r.way, r.page_offset) for r in found.collect()}
    assert got == {
        (1, 0): (4, "title_match", 3),  # the heading on the table's own page doesn't count, nor the later one
        (1, 1): (3, "title_match", -6),
        (1, 2): (13, "title_match_offset", 1),
        (1, 3): (None, "unresolved", None),
        (1, 4): (None, "unresolved", None),
        (1, 5): (None, "unresolved", None),
        (1, 6): (12, "title_match", 1),
        (2, 0): (7, "footer_offset", 3),
        (2, 1): (11, "footer_offset", 3),
        (3, 0): (5, "printed", 0),
        (3, 1): (None, "unresolved", None),
        (4, 0): (None, "unresolved", None),
    }


def test_ranges_have_each_page_once(spark, tiny):
    t = chapters.printed_books(spark, tiny)
    sizes = {r.doc_id: r.last_page for r in t["sizes"].collect()}
    pages, sources = {d: [] for d in sizes}, set()
    for r in chapters.chapter_pages_of_books(spark, tiny).collect():
        pages[r.doc_id] += range(r.start_page, r.end_page + 1)
        sources.add(r.source)
    assert all(sorted(pages[d]) == [*range(1, n + 1)] for d, n in sizes.items())
    assert {"outline", "toc", "front"} <= sources
    ways = {r.way for r in chapters.contents_pages(spark, tiny).collect()}
    assert ways >= {"title_match", "title_match_offset", "footer_offset", "printed"}


def test_starts(spark):
    frame = spark.createDataFrame
    outline = frame([(1, 2, 3, "b"), (1, 2, 3, "a"), (1, 3, 5, "deep"), (1, 2, 99, "outside"), (1, 2, 1, "one")], "doc_id long, level int, page long, title string")
    contents = frame([(1, 8, "toc"), (2, 4, "toc"), (2, None, "lost"), (3, None, "lost")], "doc_id long, start_page long, title string")
    headings = frame([(2, 6, "Part 2"), (3, 6, "Part 2"), (3, 7, "other"), (4, 2, "x")], "doc_id long, page long, title string")
    starts = chapters.chapter_starts(outline, contents, headings, "(?i)^(?:chapter|part|appendix)")
    assert sorted(map(tuple, starts.collect())) == [(1, 1, "one", "outline"), (1, 3, "a", "outline"), (1, 99, "outside", "outline"), (2, 4, "toc", "toc"), (3, 6, "Part 2", "heading")]
    sizes = frame([(d, 9) for d in (1, 2, 3, 4)], "doc_id long, last_page long")
    got = sorted(tuple(r)[:5] for r in chapters.chapter_ranges(starts, sizes).collect())
    assert got == [(1, 1, 2, "one", "outline"), (1, 3, 9, "a", "outline"), (2, 1, 3, None, "front"), (2, 4, 9, "toc", "toc"), (3, 1, 5, None, "front"), (3, 6, 9, "Part 2", "heading"), (4, 1, 9, None, "whole")]
