"""Extraction of readable text: HTML and EPUB to Markdown, page marks, and the mirror's manifest."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The elements whose text goes, and those that end a paragraph.
SKIPPED = {"script", "style", "head", "title"}
BLOCKS = {"p", "div", "li", "tr", "blockquote", "pre", "section", "article", "table", "figcaption", "dt", "dd"}
RANK = {"epub": 0, "pdf": 1, "mobi": 2, "azw3": 2, "azw": 2}
#: Under so many characters a page, a PDF of more than 3 pages needs optical recognition.
OCR_CHARS, OCR_PAGES = 100, 3


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.run, self.skip, self.level = [], [], 0, 0

    def _close(self):
        # runs of text are words apart, whatever element ends between them
        text = " ".join(" ".join(self.run).split())
        if text:
            self.out.append("#" * self.level + " " * bool(self.level) + text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self._close()
            self.level = int(tag[1])
        elif tag in BLOCKS:
            self._close()

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag):
            self._close()
            self.level = 0
        elif tag in BLOCKS:
            self._close()

    def handle_data(self, data):
        if not self.skip:
            self.run.append(data)


def html_to_markdown(html: str) -> str:
    """Headings become # lines and block elements paragraphs; scripts, styles and heads go; white space is one space."""
    p = _Markdown()
    # a head that is never closed must not swallow the body
    body = re.search(r"<body\b", html, re.I)
    p.feed(html[body.start() :] if body else html)
    p.close()
    p._close()
    return "\n\n".join(p.out) + "\n" * bool(p.out)


def html_files(files: DataFrame) -> DataFrame:
    """HTML files (path, text) as Markdown files: path with .md."""

    def worked(batches):
        for batch in batches:
            texts = [html_to_markdown(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return files.select(F.regexp_replace("path", r"\.[^./]*$", ".md").alias("path"), "text").mapInArrow(worked, "path string, text string")


def epub_to_markdown(data: bytes) -> str:
    """Chapters of an EPUB in the order of its spine, as Markdown."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ET.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ET.fromstring(z.read(opf))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item") or e.tag == "item"}
        spine = [items[e.attrib["idref"]] for e in package.iter() if e.tag.endswith("itemref") and e.attrib.get("idref") in items]
        out = []
        for href in spine:
            name = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href.partition("#")[0]))
            if name in z.namelist():
                out.append(html_to_markdown(z.read(name).decode("utf-8", "replace")))
        return "\n".join(filter(None, out))


def page_marks(text: Column) -> Column:
    """Form feeds of an extracted PDF as page marks: a mark before the text of every page."""
    pages = F.split(text, "\f", -1)
    return F.array_join(F.transform(pages, lambda p, i: F.concat(F.lit("<!-- p."), (i + 1).cast("string"), F.lit(" -->\n"), p)), "\n")


def status(kind: Column, chars: Column, pages: Column, failed: Column) -> Column:
    """ok, empty, ocr, failed or ignored of an extraction."""
    return (
        F.when(~kind.isin(*RANK), "ignored")
        .when(failed, "failed")
        .when((kind == "pdf") & (pages > OCR_PAGES) & (chars / pages < OCR_CHARS), "ocr")
        .when(chars == 0, "empty")
        .otherwise("ok")
    )


def books(files: DataFrame) -> DataFrame:
    """path, kind, stem, place: books in several formats are one book, the best format first, whatever its letter case."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), kind), F.lit(9))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    order = Window.partitionBy("stem").orderBy("format", "path")
    return files.withColumn("kind", kind).withColumn("stem", stem).withColumn("format", rank).withColumn("place", F.row_number().over(order)).drop("format")


def extract_library(files: DataFrame) -> DataFrame:
    """path, stem, status, out_bytes, text of a library of binary files (path, content): a manifest with its texts.

    The first format of a book that can be read wins and the others are duplicates.  EPUB is read here; formats that
    need programs of their own are failed, so that another format of the book can win.
    """

    def worked(batches):
        for batch in batches:
            rows = []
            for path, kind, stem, place, content in zip(*(batch.column(i).to_pylist() for i in range(5))):
                try:
                    text = epub_to_markdown(content) if kind == "epub" else None
                except Exception:  # any malformed book is a failed one
                    text = None
                state = "ignored" if kind not in RANK else "failed" if text is None else "ok" if text.strip() else "empty"
                rows.append((path, stem, place, state, len((text or "").encode()), text))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()])], names=["path", "stem", "place", "status", "out_bytes", "text"])

    read = books(files).select("path", "kind", "stem", "place", "content").mapInArrow(worked, "path string, stem string, place int, status string, out_bytes long, text string")
    won = F.min(F.when(F.col("status").isin("ok", "empty"), F.col("place"))).over(Window.partitionBy("stem"))
    out = read.withColumn("won", won)
    duplicate = F.col("won").isNotNull() & (F.col("place") != F.col("won")) & (F.col("status") != "ignored")
    return out.select("path", "stem", F.when(duplicate, "duplicate").otherwise(F.col("status")).alias("status"), F.when(duplicate, 0).otherwise(F.col("out_bytes")).alias("out_bytes"), F.when(~duplicate, F.col("text")).alias("text"))


def front_matter(source: Column, mtime: Column, extractor: Column, text: Column) -> Column:
    """The text behind a header that says where it came from."""
    return F.concat_ws("\n", F.lit("---"), F.concat(F.lit("source: "), source), F.concat(F.lit("source_mtime: "), mtime), F.concat(F.lit("extractor: "), extractor), F.lit("---"), F.lit(""), text)


def to_do(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files that have to be extracted: all but those with an output that isn't empty and has the same time to the second."""
    have = done.where("out_bytes > 0").select(F.col("path"), F.col("mtime").cast("timestamp").cast("long").alias("_s"))
    return files.withColumn("_s", F.col("mtime").cast("long")).join(have, ["path", "_s"], "left_anti").drop("_s")


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("out_bytes").alias("bytes"))
