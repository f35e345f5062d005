"""EPUB files made from rows: one book of each document, built by the task that holds the document."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the container format.
KIND = "application/epub+zip"
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container" version="1.0"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def book_of(name: str, title: str, language: str, chapters: list[tuple[str, list[tuple[str, str]]]]) -> bytes:
    """A book whose chapters are a title and blocks (tag, text). The same input gives the same bytes."""
    page = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{}</title></head><body>{}</body></html>'
    names = [f"chapter{i:04}.xhtml" for i in range(len(chapters))]
    links = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, (t, _) in zip(names, chapters, strict=True))
    items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
    package = f"""<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(name)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{escape(language)}</dc:language></metadata>
<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{"".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))}</spine></package>"""
    parts = [("mimetype", KIND), ("META-INF/container.xml", CONTAINER), ("OEBPS/book.opf", package), ("OEBPS/nav.xhtml", page.format(escape(title), f'<nav epub:type="toc"><ol>{links}</ol></nav>'))]
    parts += [(f"OEBPS/{n}", page.format(escape(t), "".join(f"<{tag}>{escape(text)}</{tag}>" for tag, text in blocks))) for n, (t, blocks) in zip(names, chapters, strict=True)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, text in parts:
            z.writestr(zipfile.ZipInfo(path), text, zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def books(rows: DataFrame) -> DataFrame:
    """name and content of a book for each doc_id of rows (doc_id, title, language, chapter, ordinal, tag, text).

    A chapter's title is its first block's text. Blocks without a text, or with a control character for a text, are left out.
    """

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for doc_id, title, language, blocks in zip(frame["doc_id"], frame["title"], frame["language"], frame["blocks"], strict=True):
                chapters: dict[int, list[tuple[str, str]]] = {}
                for b in blocks:
                    chapters.setdefault(b["chapter"], []).append((b["tag"], b["text"]))
                content = book_of(f"urn:document:{doc_id}", title or f"Document {doc_id}", language or "und", [(c[0][1], c) for c in chapters.values()])
                made.append((doc_id, f"{doc_id}.epub", content))
            yield pd.DataFrame(made, columns=["doc_id", "name", "content"])

    text = F.regexp_replace("text", "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    good = rows.withColumn("text", text).where("text is not null and text != ''")
    block = F.struct("chapter", "ordinal", "tag", "text")
    each = good.groupBy("doc_id").agg(F.min("title").alias("title"), F.min("language").alias("language"), F.array_sort(F.collect_list(block)).alias("blocks"))
    return each.mapInPandas(build, "doc_id long, name string, content binary")
