"""EPUB files, exports and streams against small data of known content."""

import datetime as dt
import zipfile

import pytest

from quillspark.sinks import books as made
from quillspark.sinks import exports
from quillspark.sources import epub
from quillspark.streaming import activity

CONTAINER = '<container xmlns="urn:c"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="urn:p" xmlns:dc="urn:d"><metadata><dc:title>A Book</dc:title><dc:creator>Someone</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="a" href="one%20a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="two.xhtml" media-type="application/xhtml+xml"/><item id="c" href="bad.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest>
<spine><itemref idref="a"/><itemref idref="i"/><itemref idref="b" linear="no"/><itemref idref="c"/><itemref idref="a"/></spine></package>"""
ONE = "<html xmlns='urn:h'><head><title>x</title></head><body><div><h1>One</h1><p>First <b>bold</b>\n text</p><p> </p><ul><li>item</li></ul></div><pre> a\n b</pre></body></html>"


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    (folder / "deep").mkdir()
    with zipfile.ZipFile(folder / "deep/good.epub", "w") as z:
        for name, text in (("META-INF/container.xml", CONTAINER), ("OEBPS/book.opf", PACKAGE), ("OEBPS/one a.xhtml", ONE), ("OEBPS/two.xhtml", ONE), ("OEBPS/bad.xhtml", "<p>open")):
            z.writestr(name, text)
    (folder / "broken.epub").write_bytes(b"no zip")
    (folder / "other.txt").write_text("not read")
    return str(folder)


def test_epub_blocks_follow_the_spine(spark, books):
    rows = epub.read_epub(spark, books).collect()
    good = sorted((r.chapter, r.ordinal, r.tag, r.text) for r in rows if r.text and not r.repaired)
    assert good == [(0, 0, "h1", "One"), (0, 1, "p", "First bold text"), (0, 2, "li", "item"), (0, 3, "pre", " a\n b")]
    assert {(r.title, r.creator, r.language) for r in rows if r.text} == {("A Book", "Someone", "en")}
    assert [r.href for r in rows if r.error] == [None]
    assert [(r.chapter, r.href, r.text) for r in rows if r.repaired] == [(1, "OEBPS/bad.xhtml", "open")]


def test_pages_that_are_no_xml_are_repaired():
    raw = b"<head><title>t</title></head><body><h2>A &nbsp;B</h2><p>one<br>two<p>three &amp; <b>four</b><pre> x\n y</pre><ul><li>i<li>j</ul><script>no()</script>\x01"
    assert epub.page_texts(raw) == (True, [("h2", "A B"), ("p", "onetwo"), ("p", "three & four"), ("pre", " x\n y"), ("li", "i"), ("li", "j")])
    assert epub.page_texts(b"") == (True, [])


def test_books_come_back_from_their_files(spark, tmp_path):
    rows = [(7, "T <1>", "en", c, o, "h1" if o == 0 else "p", f"{c} & {o}") for c in (0, 1) for o in (0, 1)] + [(8, None, None, 0, 0, "p", "only"), (8, None, None, 0, 1, "p", None), (9, None, None, 0, 0, "p", None)]
    found = made.books(spark.createDataFrame(rows, "doc_id long, title string, language string, chapter int, ordinal int, tag string, text string")).collect()
    assert sorted(r.name for r in found) == ["7.epub", "8.epub"]
    for r in found:
        (tmp_path / r.name).write_bytes(r.content)
    back = epub.read_epub(spark, str(tmp_path)).collect()
    assert sorted((r.title, r.language, r.chapter, r.ordinal, r.tag, r.text, r.toc_title) for r in back if "/7.epub" in r.path) == [("T <1>", "en", c, o, "h1" if o == 0 else "p", f"{c} & {o}", f"{c} & 0") for c in (0, 1) for o in (0, 1)]
    assert [(r.title, r.text, r.error) for r in back if "/8.epub" in r.path] == [("Document 8", "only", None)]


def test_reading_chapters_leave_out_contents(spark):
    rows = [("b", 0, "x/toc.xhtml", "p", "t")] + [("b", 1, "x/a.xhtml", "li", "i")] * 5 + [("b", 2, "x/tocsin.xhtml", "p", "t"), ("b", 3, None, "p", None)]
    got = epub.reading_chapters(spark.createDataFrame(rows, "path string, chapter int, href string, tag string, text string")).collect()
    assert [r.chapter for r in got] == [2]


def test_files_lists_only_the_pattern(spark, books):
    assert epub.files(spark, books).select("sha256").distinct().count() == 2


def test_writers_give_back_their_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b\nc"), (3, None)], "id long, text string")
    exports.write_jsonl(rows, f"{tmp_path}/j")
    assert sorted((r.id, r.text) for r in spark.read.schema(rows.schema).json(f"{tmp_path}/j").collect()) == [(1, "a"), (2, "b\nc"), (3, None)]
    exports.write_texts(rows.where("text is not null"), "id", "text", f"{tmp_path}/t")
    assert spark.read.text(f"{tmp_path}/t/id=2").count() == 2


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, text string, v int")
    new = exports.last_by_id(spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], old.schema), "id", "v")
    assert sorted(tuple(r) for r in exports.merge_last(old, new, "id").collect()) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]


def test_streams_agree_with_tables(spark, tmp_path):
    """Events in two files, a repeated one among them; a far later event moves the watermark past all others."""
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=7 * i), i % 3, "x" if i % 2 else "y", i / 4) for i in range(60)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    end = (999, at + dt.timedelta(days=9), 7, "end", 0.0)
    spark.createDataFrame([*rows, rows[5]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame([end], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    whole = spark.createDataFrame(rows, schema)
    for name, operator in (("hours", activity.hourly), ("sessions", activity.sessions)):
        stream = operator(activity.once(activity.follow(spark, f"{tmp_path}/in/*", schema, 1)))
        query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert {tuple(r) for r in spark.table(name).collect()} == {tuple(r) for r in operator(whole).collect()}


def test_pages_keep_text_behind_inner_tags(spark):
    from quillspark.sources import web

    html = "<DIV><P Class='x'>H<sub>2</sub>O is <B>wet</B> &amp; cold&nbsp;!</P></DIV><ul><li><a href='#'>one</a><li>two</ul><p> <p>three<br/>four<!-- no --></p><script>var x = '<p>no</p>'</script>"
    got = web.html_blocks(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(1, 0, "p", "H2O is wet & cold !"), (1, 1, "li", "one"), (1, 2, "li", "two"), (1, 3, "p", "three four")]


def test_a_bad_book_does_not_end_the_job(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "no_href.epub", "w") as z:
        for name, text in (("META-INF/container.xml", CONTAINER), ("OEBPS/book.opf", PACKAGE.replace('href="two.xhtml"', "")), ("OEBPS/one a.xhtml", ONE), ("OEBPS/bad.xhtml", "<p>open")):
            z.writestr(name, text)
    with zipfile.ZipFile(tmp_path / "deep.epub", "w") as z:
        for name, text in (("META-INF/container.xml", CONTAINER), ("OEBPS/book.opf", PACKAGE), ("OEBPS/one a.xhtml", "<body>" + "<div>" * 9000 + "x" + "</div>" * 9000 + "</body>"), ("OEBPS/bad.xhtml", "<p>open")):
            z.writestr(name, text)
    rows = epub.read_epub(spark, str(tmp_path)).collect()
    assert {r.text for r in rows if "/no_href" in r.path} >= {"One", "open"}
    assert any("/deep" in r.path for r in rows)


def test_last_of_ties_is_the_same_each_time(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "c", 1)], "id long, text string, v int")
    assert [tuple(r) for r in exports.last_by_id(rows.repartition(3), "id", "v").collect()] == [(1, "b", 2)]
