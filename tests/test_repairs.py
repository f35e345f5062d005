"""Operators over blocks, memories and work on small tables: nulls, ties, repeated rows, empty tables."""

from datetime import datetime

import pytest

from quillspark.operators import briefs, lifecycle, repairs, review


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_wrapped_code_is_one_line(spark):
    lines = ["f(a,", "  b)", "x = 1", None, ") y", "z +", "", "1"]
    got = repairs.reflowed(spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, idx int, text string"))
    assert rows(got, "first_idx", "parts", "text") == [(0, 2, "f(a, b)"), (2, 1, "x = 1"), (3, 1, ""), (4, 1, ") y"), (5, 1, "z +"), (6, 1, ""), (7, 1, "1")]


def test_code_goes_on_across_one_artifact(spark):
    given = [(0, 0, "code", "a"), (1, 0, "artifact", None), (2, 1, "code", "b"), (3, 1, "artifact", ""), (4, 1, "artifact", ""), (5, 1, "code", "c"), (6, 1, "body", "t"), (7, 1, "code", "d"), (8, 3, "code", "e")]
    got = repairs.continued_code(spark.createDataFrame([(1, *g) for g in given], "doc_id long, idx int, page long, role string, text string"))
    assert rows(got, "first_idx", "parts", "last_page", "text") == [(0, 2, 1, "a\nb"), (5, 1, 1, "c"), (7, 1, 1, "d"), (8, 1, 3, "e")]


def test_blocks_split_where_kind_changes(spark):
    given = spark.createDataFrame([(1, 0, "Some words\n\nx = f(y)\n\nreturn x\nMore words"), (1, 1, ""), (1, 2, None)], "doc_id long, idx int, text string")
    assert rows(repairs.split_blocks(given), "idx", "part", "kind", "lines") == [(0, 0, "prose", 2), (0, 1, "code", 3), (0, 2, "prose", 1), (1, 0, "prose", 1)]


def test_items_of_one_line(spark):
    given = spark.createDataFrame([(1, 0, "    • one • two •  "), (1, 1, "1) First 2) Second"), (1, 2, None), (1, 3, "")], "doc_id long, idx int, text string")
    assert rows(repairs.list_items(given), "idx", "level", "item", "text") == [(0, 2, 0, "one"), (0, 2, 1, "two"), (1, 0, 0, "1) First"), (1, 0, 1, "Second")]


def test_bodies_between_code(spark):
    given = [(0, "code", "x;"), (1, "body", "y z"), (2, "code", "w;"), (3, "body", "Plain words here."), (4, "code", None), (5, "body", None), (6, "body", "return 1")]
    got = repairs.late_promoted(spark.createDataFrame([(1, *g) for g in given], "doc_id long, idx int, role string, text string"))
    assert [r[1] for r in rows(got, "idx", "new_role")] == ["code", "code", "code", "body", "code", "body", "body"]


def test_prose_taken_for_code(spark):
    words = "these are some words that no code would hold"
    given = [(0, "code", words), (1, "code", words + "."), (2, "code", words), (3, "code", "x = f(y)"), (4, "body", words), (5, "code", None)]
    got = repairs.prose_chains(spark.createDataFrame([(1, *g) for g in given], "doc_id long, idx int, role string, text string"))
    assert rows(got, "first_idx", "parts") == [(0, 2), (2, 1)]


def test_relations_of_paragraphs(spark):
    texts = ["However it turns.", "This refers to a thing.", "", None, "Plain.", "Plain too."]
    got = briefs.discourse(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string"))
    assert [r[1] for r in rows(got, "idx", "relation")] == ["opens with an explicit bridge and then moves into transition", "uses a transition to enter a new concept definition", None, None, "opens a new local point as technical explanation", "continues the same technical explanation"]


def test_memories_that_hold(spark):
    memories = spark.createDataFrame([(1, 0, "An Agent acts", "智能体行动"), (1, 1, "An agent acts", "代理行动"), (1, 2, None, None), (1, 3, "agent", None), (2, 0, "agent", "x"), (1, 4, "weight of", "重量")], "doc_id long, idx int, source string, target string")
    terms = spark.createDataFrame([(1, " agent ", "智能体"), (1, "", "x"), (2, None, "y")], "doc_id long, source_term string, target_term string")
    assert rows(briefs.kept_memories(memories, terms, [("^weight", "重")]), "doc_id", "idx") == [(1, 0), (1, 2), (2, 0)]
    assert briefs.kept_memories(memories, terms.limit(0)).count() == 6


def test_locked_terms_may_vary(spark):
    given = [("the Big agent acts", "小模型", True), ("the big agent acts", "小模型", False), ("An agent", "模型", False), ("agent via Gate", "模型", False), ("agent Gate", "模型", True), ("reagent Gate", "模型", False), ("GPT-agent", "模型", True), ("agent Gate", "系统", False), (None, "模型", False), ("agent Gate", "", False)]
    frame = spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "i int, source string, target string, want boolean")
    from pyspark.sql import functions as F
    got = frame.select("i", "want", briefs.is_exempt(F.col("source"), F.col("target"), F.lit("agent"), F.lit("大模型"), F.lit(False)).alias("got"))
    assert rows(got, "i", "got") == rows(got, "i", "want")


def test_words_that_examples_agree_on(spark):
    given = spark.createDataFrame([("a", 0, "xx yyy zz"), ("a", 1, "yyy xx"), ("a", 2, "xx"), ("b", 0, "qq"), ("b", 1, None), ("c", 5, "bb aa")], "term string, place int, text string")
    got = briefs.agreed_tokens(given, "([a-z]{2,})", examples=2)
    assert sorted(map(str, rows(got, "term", "example_count", "token"))) == ["('a', 2, 'yyy')", "('b', 2, None)", "('c', 1, 'aa')"]


def test_edges_of_the_latest_run(spark):
    edges = spark.createDataFrame([("p", 0, 0), ("q", 0, 0), ("r", 0, 0)], "packet_id string, sentence_id long, segment_id long")
    good = '[{"sentence_id": 1, "segment_id": 2}, {"sentence_id": 1, "segment_id": 2}, {"sentence_id": 3}]'
    runs = spark.createDataFrame([("p", 1, "[]"), ("p", 2, good), ("q", 1, good), ("q", 2, "[{"), ("r", 1, None)], "packet_id string, run_id int, output string")
    assert rows(lifecycle.realigned(edges, runs), "packet_id", "sentence_id", "segment_id") == [("p", 1, 2), ("q", 0, 0), ("r", 0, 0)]
    assert lifecycle.realigned(edges, runs.limit(0)).count() == 3


def test_actions_to_follow_up(spark):
    found = spark.createDataFrame([(1, "p", "STYLE_DRIFT", True), (2, "p", "TERM_CONFLICT", False), (3, "p", "TERM_CONFLICT", True), (4, "q", "OTHER", True), (5, "r", "STYLE_DRIFT", False)], "action_id int, packet_id string, issue_type string, blocking boolean")
    done = spark.createDataFrame([(3,), (3,)], "action_id int")
    assert rows(lifecycle.followups(found, done), "packet_id", "action_id", "issue_count", "other_count") == [("p", 1, 3, 2), ("r", 5, 1, 0)]
    assert rows(lifecycle.followups(found, done.limit(0)), "packet_id", "action_id") == [("p", 3), ("r", 5)]


def test_owners_after_changes(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    given = [("a", "x", t[0], 1), ("a", None, t[1], 2), ("b", "x", t[0], 1), ("b", "y", t[0], 2), ("b", "y", t[2], 3), ("c", None, t[0], 1), ("c", "z", t[1], 2)]
    got = lifecycle.assigned(spark.createDataFrame(given, "chapter_id string, owner string, at timestamp_ntz, change_id int"))
    assert rows(got, "chapter_id", "owner", "since", "changes") == [("b", "y", t[0], 3), ("c", "z", t[1], 2)]


def test_states_and_reports(spark):
    chapters = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "doc_id int, chapter_id int")
    got = lifecycle.export_states(chapters, spark.createDataFrame([(10,), (10,), (20,), (99,)], "chapter_id int"))
    assert rows(got, "doc_id", "state") == [(1, "partially_exported"), (2, "exported"), (3, "active")]
    reports = spark.createDataFrame([(1, True, None), (2, None, {"canary_verdict": "pending", "n": "1"})], "proposal_id int, passed boolean, report map<string,string>")
    assert {r.proposal_id: (r.state, r.report) for r in lifecycle.validated(reports).collect()} == {1: ("validated", {"passed": "true", "canary_verdict": "passed"}), 2: ("rejected", {"passed": "false", "canary_verdict": "pending", "n": "1"})}


def test_titles_in_the_target_language(spark):
    titles = spark.createDataFrame([(1, "The Book", "A Story"), (2, "Lone", None), (3, None, None), (4, "", "x")], "doc_id int, title string, subtitle string")
    heads = [(1, 0, 0, "the  book", "Das Buch geht so weiter."), (1, 0, 1, "THE BOOK", "Das Buch"), (1, 1, 0, "The book", "Anders"), (1, 1, 1, "a story", "Eine Geschichte"), (2, 0, 0, "", "Nichts"), (2, 2, 0, "lone", "Allein"), (4, 0, 0, "", "Leer"), (3, 0, 0, None, "Null")]
    got = lifecycle.target_titles(titles, spark.createDataFrame(heads, "doc_id int, chapter int, idx int, source string, target string"))
    assert rows(got, "doc_id", "title") == [(1, "Das Buch：Eine Geschichte")]


@pytest.mark.parametrize("numbers,want", [([None, 1, 2, 2, 1, 3], [(0, 0), (1, 1), (2, 4), (5, 5)]), ([4, 1, 5], [(0, 1), (2, 2)]), ([None, 3, 2, 1], [(0, 2), (3, 3)])])
def test_visible_chapters(spark, numbers, want):
    frame = spark.createDataFrame([(1, i, None, n, False, False) for i, n in enumerate(numbers)], "doc_id int, idx int, signature string, number int, is_appendix boolean, is_front boolean")
    assert rows(lifecycle.visible_chapters(frame), "first_idx", "last_idx") == want


def test_chapters_that_came_before_go(spark):
    frame = spark.createDataFrame([(1, 0, "s", 1, False, False), (1, 1, "s", 2, False, False), (1, 2, "t", None, True, False), (1, 3, "u", None, False, True)], "doc_id int, idx int, signature string, number int, is_appendix boolean, is_front boolean")
    assert rows(lifecycle.visible_chapters(frame), "first_idx", "last_idx", "parts") == [(0, 0, 1), (2, 3, 2)]


def test_advisory_risk(spark):
    pages = [(c, p, 0.9, "medium" if p == 1 else "none", ["multi_column"] if p == 1 else [], True) for c in ("a", "b", "c") for p in range(4)]
    pages += [("b", 4, 0.9, "high", ["multi_column"], True), ("c", 4, 0.9, "low", None, True), ("d", 0, None, None, None, None)]
    got = lifecycle.advisory_chapters(spark.createDataFrame(pages, "chapter_id string, page int, confidence double, risk string, reasons array<string>, is_anchored boolean"))
    assert rows(got, "chapter_id", "advisory") == [("a", True), ("b", False), ("c", False), ("d", False)]


def test_packets_built_again(spark):
    packets = spark.createDataFrame([("p", 1, 1), ("p", 1, 2), ("q", 2, 1)], "packet_id string, chapter_id int, version int")
    got = lifecycle.rebuilt(packets, spark.createDataFrame([(1,), (1,), (None,)], "chapter_id int"))
    assert rows(got, "packet_id", "version", "state") == [("p", 1, "superseded"), ("p", 2, "superseded"), ("p", 3, "current"), ("q", 1, "current")]


def test_ranks_as_one_window(spark):
    from pyspark.sql import functions as F
    given = sorted((i % 3, i * 7 % 4, (i * 5 + i * i) % 6, i) for i in range(200))
    got = review.ranked(spark.createDataFrame(given, "a int, b int, c int, id int").repartition(5), ["a"], ["b"], [F.col("c"), F.col("id")], "rank")
    assert [r[1:] for r in rows(got, "rank", "a", "b", "c", "id")] == given
    assert [r[0] for r in rows(got, "rank")] == list(range(1, 201))
    assert review.ranked(spark.createDataFrame([], "a int, b int, c int, id int"), ["a"], ["b"], [F.col("id")], "rank").count() == 0
