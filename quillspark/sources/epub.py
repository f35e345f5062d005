"""EPUB files as rows of blocks. Each file is read by one task; a file that can't be read gives one row with an error."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path string, title string, creator string, language string, chapter int, href string, ordinal int, tag string, text string, error string, toc_title string, repaired boolean"
#: Elements whose text is a block of its own.
TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre table figcaption".split())
#: Elements that end an open paragraph, with those above.
ENDING = TAGS | frozenset("div ul ol dl section article nav aside header footer main figure form hr".split())


def files(spark: SparkSession, folder: str, pattern: str = "*.epub") -> DataFrame:
    """path, length and sha256 of the files below a folder, whatever the depth, with their content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def texts(node: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """Tag and text of the outermost blocks below node, in reading order."""
    for child in node:
        if local(child) in TAGS:
            text = "".join(child.itertext())
            text = text if local(child) == "pre" else " ".join(text.split())
            if text.strip():
                yield local(child), text
        else:
            yield from texts(child)


class Blocks(HTMLParser):
    """The outermost blocks of a page that is no well-formed XML, from its tags one by one; open ones end with the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: str | None = None
        self.depth, self.hidden = 0, 0
        self.parts: list[str] = []

    def finish(self) -> None:
        text = "".join(self.parts)
        text = text if self.open == "pre" else " ".join(text.split())
        if self.open and text.strip():
            self.found.append((self.open, text))
        self.open, self.parts, self.depth = None, [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "head"):
            self.hidden += 1
            return
        if self.open == "p" and tag in ENDING or self.open == "li" and tag == "li":
            # a paragraph or item that wasn't closed ends where the next block begins
            self.finish()
        if self.open is None and tag in TAGS:
            self.open, self.depth = tag, 1
        elif tag == self.open:
            self.depth += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == self.open:
            self.depth -= 1
            if not self.depth:
                self.finish()

    def handle_data(self, data: str) -> None:
        if self.open and not self.hidden:
            self.parts.append(data)


def page_texts(raw: bytes) -> tuple[bool, list[tuple[str, str]]]:
    """Whether a page had to be repaired, and its blocks."""
    try:
        page = ElementTree.fromstring(raw)
        return False, [*texts(next((n for n in page.iter() if local(n) == "body"), page))]
    except ElementTree.ParseError:
        reader = Blocks()
        reader.feed(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", raw.decode("utf-8", "replace")))
        reader.close()
        reader.finish()
        return True, reader.found


def contents(book: zipfile.ZipFile, href: str) -> dict[str, str]:
    """Title by file, from a page of navigation: its table of contents if it names one, else its first list."""
    try:
        page = ElementTree.fromstring(book.read(href))
    except (ElementTree.ParseError, KeyError):
        return {}
    lists = [n for n in page.iter() if local(n) == "nav"]
    lists.sort(key=lambda n: "toc" not in " ".join(v for k, v in n.items() if k.endswith("type")).split())
    found: dict[str, str] = {}
    for link in (n for top in lists[:1] for n in top.iter() if local(n) == "a" and n.get("href")):
        target = posixpath.normpath(posixpath.join(posixpath.dirname(href), unquote(link.get("href").partition("#")[0])))
        found.setdefault(target, " ".join("".join(link.itertext()).split()))
    return found


def blocks_of(path: str, content: bytes) -> Iterator[tuple]:
    """The blocks of a book's chapters along its spine; items that aren't linear and repeated files are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    root = next(n.get("full-path") for n in container.iter() if local(n) == "rootfile")
    package = ElementTree.fromstring(book.read(root))
    about: dict[str, str] = {}
    items: dict[str, tuple[str, str]] = {}
    spine: list[str] = []
    titles: dict[str, str] = {}
    for node in package.iter():
        name = local(node)
        if name in ("title", "creator", "language"):
            about.setdefault(name, (node.text or "").strip())
        elif name == "item" and node.get("href"):
            items[node.get("id")] = (posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(node.get("href")))), node.get("media-type"))
            if "nav" in (node.get("properties") or "").split():
                titles = contents(book, items[node.get("id")][0])
        elif name == "itemref" and node.get("linear") != "no":
            spine.append(node.get("idref"))
    kinds = ("application/xhtml+xml", "text/html")
    chapters = dict.fromkeys(items[i][0] for i in spine if i in items and items[i][1] in kinds)
    head = (path, about.get("title"), about.get("creator"), about.get("language"))
    for chapter, href in enumerate(chapters):
        try:
            repaired, found = page_texts(book.read(href))
        except KeyError as e:
            yield *head, chapter, href, None, None, None, str(e), titles.get(href), False
            continue
        for ordinal, (tag, text) in enumerate(found):
            yield *head, chapter, href, ordinal, tag, text, None, titles.get(href), repaired


def read_epub(spark: SparkSession, folder: str) -> DataFrame:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [*blocks_of(path, content)]
                except Exception as e:  # whatever is wrong with a book is told in its row, and the others are read
                    rows = [(path, *[None] * 8, f"{type(e).__name__}: {e}", None, None)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"chapter": "Int32", "ordinal": "Int32", "repaired": "boolean"})

    return files(spark, folder).select("path", "content").mapInPandas(read, SCHEMA)


def reading_chapters(rows: DataFrame) -> DataFrame:
    """Blocks of chapters meant for reading: those of covers, title pages and tables of contents are left out.

    A chapter is taken for one by its file's name, or if it has five blocks or more and four in five are list items.
    """
    chapter = Window.partitionBy("path", "chapter")
    listed = F.count_if(F.col("tag") == "li").over(chapter)
    total = F.count("*").over(chapter)
    name = F.coalesce(F.regexp_extract("href", "([^/]*)$", 1).rlike("(?i)^(cover|title-?page|toc|nav|contents)[^a-z]"), F.lit(False))
    return rows.where("text is not null").withColumn("_skip", name | ((total >= 5) & (5 * listed >= 4 * total))).where("not _skip").drop("_skip")
