"""Replacements in pages: everything that isn't replaced stays, character by character."""

from pyspark.sql import functions as F

from quillspark.sinks import patches

PAGE = '<?xml version="1.0"?>\n<html><!-- <p id="a"> --><head><meta charset="utf-8"><script>var t = "</p>";</script></head>\n<body  CLASS=\'x>y\'>'
END = "</body></html>\n"

CASES = {
    "text": ("<p id='a'>one <b>two</b> three</p> tail", {"a": "ONE & <2>"}, "<p id='a'>ONE &amp; &lt;2&gt;<b></b></p> tail", 1),
    "link": ('<p id="a">see <a href="u">note <i>x</i></a> and <em>y</em><img src="i"/> z</p>', {"a": "T"}, '<p id="a">T<a href="u">note <i></i></a><em></em><img src="i"/></p>', 1),
    "deep link": ('<p id="a">see <b>q<a href="u">note</a></b></p>', {"a": "T"}, '<p id="a">T<b><a href="u"></a></b></p>', 1),
    "nested": ('<div id="a">x<p id="b">y</p>z<p>q</p></div><p>r</p>', {"a": "A", "b": "B"}, '<div id="a">A<p id="b">B</p><p></p></div><p>r</p>', 2),
    "nested twice": ('<div id="a">1<div id="b">2<div id="c">3</div>4</div>5<div>6</div></div>', {"a": "A", "c": "C"}, '<div id="a">A<div id="b">2<div id="c">C</div></div><div></div></div>', 2),
    "repeated id": ('<p id="a">x</p><p id="a">y</p>', {"a": "A"}, '<p id="a">A</p><p id="a">y</p>', 1),
    "blank": ('<p id="a"> \n<b> </b></p>', {"a": "A"}, '<p id="a"> \n<b> </b></p>', 0),
    "by place": ("<p>x</p><P>y</P><p>z", {"p:2": "Y", "p:3": "Z"}, "<p>x</p><P>Y</P><p>z", 1),
    "not closed inside": ('<p id="a">x<b>y</p><p id="c">z</p>', {"a": "A", "c": "C"}, '<p id="a">x<b>y</p><p id="c">C</p>', 1),
    "no such": ("<p>x</p> 1 < 2 <br> &amp;", {"q": "Q"}, "<p>x</p> 1 < 2 <br> &amp;", 0),
    "comment stays": ('<p id="a">x<!-- <b> -->y</p>', {"a": "A"}, '<p id="a">A<!-- <b> --></p>', 1),
}


def run(spark, cases, **more):
    pages = spark.createDataFrame([(k, PAGE + body + END) for k, (body, *_) in cases.items()] + [("null", None), ("empty", "")], "page_id string, html string")
    given = [(k, a, t) for k, (_, targets, *_) in cases.items() for a, t in targets.items()]
    return pages, {r.page_id: r for r in patches.patched_pages(pages, spark.createDataFrame([*given, *given, ("text", "a", None), ("gone", "a", "A")], "page_id string, anchor string, target string"), **more).collect()}


def test_cases(spark):
    _, got = run(spark, CASES)
    assert {*got} == {*CASES, "null", "empty"}
    for k, (_, _, want, n) in CASES.items():
        assert (got[k].html, got[k].n_patched) == (PAGE + want + END, n), k
    assert got["null"].html is None and got["empty"].html == ""


def test_whole_pages_only(spark):
    _, got = run(spark, {k: CASES[k] for k in ("text", "not closed inside", "by place")}, whole_pages=True)
    assert got["text"].n_patched == 1
    for k in ("not closed inside", "by place"):
        assert (got[k].html, got[k].n_patched) == (PAGE + CASES[k][0] + END, 0)


def test_parts_cover_each_page(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    parts = patches.page_parts(pages)
    cut = parts.join(pages.select("page_id", "html"), "page_id").where(F.expr("substr(html, start + 1, length(part)) != part"))
    assert cut.count() == 0
    whole = parts.groupBy("page_id").agg(F.sum(F.length("part")).alias("n")).join(pages, "page_id").where(F.col("n") != F.length("html"))
    assert whole.count() == 0
    none = patches.patched_pages(pages, spark.createDataFrame([], "page_id long, anchor string, target string"))
    assert sorted((r.page_id, r.html) for r in none.collect()) == sorted((r.page_id, r.html) for r in pages.collect())


def test_spans_that_are_not_replaced_are_equal(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    rows = patches.patched_parts(pages, patches.own_texts(pages, patches.TRIED))
    kept = [(r.page_id, r.part, r.out, r.target, r.kind) for r in rows.collect()]
    assert sum(t is not None for *_, t, _ in kept) > 100
    for _, part, out, target, kind in kept:
        assert out == part or (target is not None and out.startswith(part)) or (kind == "text" and out == "")


def test_one_shuffle_by_page(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    given = spark.createDataFrame([(1, "p:1", "x")], "page_id long, anchor string, target string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = patches.patched_pages(pages, given)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(page_id") == 3  # pages, replacements by anchor, and these by page
