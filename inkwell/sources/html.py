"""HTML and EPUB to blocks and typed sections.

Nesting rules of our own, as real files are malformed: a block tag closes an
open paragraph; void tags never open; an end tag closes up to its start if
there is one, else it is ignored; script and style are dropped.
"""

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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import headings as H
from inkwell.functions import text as T

# Fixed values.
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
BLOCKS = frozenset([*HEADINGS, *"p blockquote li figcaption div".split()])
HEADING_TYPES = frozenset("title subtitle ordinal fulltitle".split())
UNSPOKEN = frozenset("footnote endnote toc pagebreak".split())
NOT_READ = frozenset("titlepage halftitlepage imprint copyright-page colophon cover toc landmarks loi".split())
SKIPPED_NAMES = "nav toc cover colophon imprint illustration copyright uncopyright titlepage half-title halftitle".split()
LEAST_WORDS = 50
INVISIBLE = dict.fromkeys(map(ord, "﻿​‌‍⁠"))

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = frozenset("script style template".split())
_SECTIONS = frozenset("section article body".split())
_HAN = re.compile("[㐀-鿿豈-﫿\U00020000-\U0003134f]")


def clean(text: str) -> str:
    return " ".join(text.translate(INVISIBLE).split())


class Blocks(HTMLParser):
    """Leaf blocks in order: tag, text, spoken, heading, id, the section they are in and its type."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.blocks: list[dict] = []
        self.sections = 0
        self.body_types: set[str] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._text("\n")
        if tag in _VOID:
            return
        known = dict(attrs)
        if tag in BLOCKS and self.open and self.open[-1]["tag"] == "p":
            self._close(len(self.open) - 1)
        types = frozenset((known.get("epub:type") or "").casefold().split())
        node = {"tag": tag, "types": types, "classes": frozenset((known.get("class") or "").split()), "id": known.get("id") or "", "parts": [], "leaf": True, "section": 0}
        if tag in _SECTIONS:
            self.sections += 1
            node["section"] = self.sections
            self.body_types |= types
        if tag in BLOCKS:
            for outer in self.open:
                outer["leaf"] = False
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._text("\n")

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at]["tag"] == tag:
                self._close(at)
                return

    def handle_data(self, data: str) -> None:
        self._text(data)

    def _text(self, data: str) -> None:
        tags = {n["tag"] for n in self.open}
        if tags & _DROPPED or tags & {"sup", "sub"}:
            return
        for node in self.open:
            if node["tag"] in BLOCKS:
                node["parts"].append(data)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            node = self.open.pop()
            if node["tag"] == "a" and self.open and clean("".join(node["parts"])).isdigit():
                continue
            if node["tag"] not in BLOCKS or not node["leaf"]:
                continue
            raw = ("" if _HAN.search("".join(node["parts"])) else " ").join(node["parts"]) if len(node["parts"]) > 1 and not any(p.isspace() or p[:1].isspace() or p[-1:].isspace() for p in node["parts"]) else "".join(node["parts"])
            text = clean(raw)
            if not text:
                continue
            path = [*self.open, node]
            section = next((n for n in reversed(path) if n["section"]), None)
            self.blocks.append({
                "tag": node["tag"], "text": text, "element_id": node["id"],
                "spoken": not any(n["types"] & UNSPOKEN for n in path),
                "heading": node["tag"] in HEADINGS or bool(node["types"] & HEADING_TYPES),
                "section": section["section"] if section else 0,
                "section_type": next((t for t in sorted(section["types"]) if t == "chapter" or t in H.SECTION_TYPES), None) if section else None,
            })

    def finish(self) -> list[dict]:
        self.close()
        self._close(0)
        return self.blocks


def html_blocks(html: str | None) -> list[dict]:
    """Blocks of one document; null and broken documents give what can be read."""
    if not html:
        return []
    parser = Blocks()
    parser.feed(html)
    blocks = parser.finish()
    return [] if parser.body_types & NOT_READ else blocks


BLOCK_SCHEMA = "block int, tag string, text string, element_id string, spoken boolean, heading boolean, section int, section_type string"


def explode_html(df: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per leaf block of each document, in document order."""
    src = df.select(*keys, F.col(html).alias("__html"))
    schema = ", ".join([*(f"{k} {t}" for k, t in df.select(*keys).dtypes), BLOCK_SCHEMA])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*key, i, b["tag"], b["text"], b["element_id"], b["spoken"], b["heading"], b["section"], b["section_type"]) for *key, html_text in frame.itertuples(index=False) for i, b in enumerate(html_blocks(html_text))]
            yield pd.DataFrame(rows, columns=[*keys, "block", "tag", "text", "element_id", "spoken", "heading", "section", "section_type"])

    return src.mapInPandas(run, schema)


def typed_sections(blocks: DataFrame, keys: list[str], name: str | None = None) -> DataFrame:
    """Blocks to sections: type, ordinal, heading, spoken paragraphs; short unrecognised ones are left out.

    A section begins at a section element or, in flat documents, at a heading
    that follows text: an island, numbered by a running sum.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("block")
    begins = (F.col("section") != F.lag("section", 1, -1).over(w)) | F.col("heading") & ~F.coalesce(F.lag("heading").over(w), F.lit(True))
    parts = blocks.withColumn("part", F.sum(begins.cast("int")).over(w))
    inside = Window.partitionBy(*keys, "part").orderBy("block")
    body_seen = F.max((~F.col("heading")).cast("int")).over(inside)
    parts = parts.withColumn("is_heading", F.col("heading") & (body_seen == 0))
    said = F.col("spoken") & ~F.col("is_heading")
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("block", "text")))), lambda x: x["text"])
    grouped = parts.groupBy(*keys, "part").agg(F.max("section_type").alias("semantic"), ordered(F.col("is_heading")).alias("headings"), ordered(said).alias("paragraphs"), F.sum(F.when(said, T.unit_count(F.col("text"))).otherwise(0)).alias("words"))
    first = F.coalesce(F.get("headings", F.lit(0)), F.lit(""))
    kind = H.heading_class(first)
    stem = F.lower(F.regexp_extract(F.col(name), "([^/]+?)(?:\\.[^./]*)?$", 1)) if name else F.lit("")
    out = grouped.withColumn("k", kind).withColumn("section_type", H.section_type(F.col("semantic"), F.col("k.section_type"), F.lit(None).cast("string"), stem, F.size("headings") > 0))
    known = F.col("semantic").isNotNull() | F.col("k.section_type").isNotNull() | (F.size("headings") > 0)
    kept = out.filter(known | (F.col("words") >= LEAST_WORDS))
    number = F.row_number().over(Window.partitionBy(*[k for k in keys if k != name]).orderBy(*([name] if name else []), "part")) if [k for k in keys if k != name] else F.row_number().over(Window.partitionBy(*keys).orderBy("part"))
    return kept.select(*keys, number.alias("sequence"), "section_type", F.col("k.ordinal").alias("ordinal"), first.alias("display_label"), F.col("k.remainder").alias("display_title"), "paragraphs", F.array_join("paragraphs", "\n\n").alias("text"), F.col("words").cast("int").alias("word_count"))


def _package(archive: zipfile.ZipFile) -> tuple[str, ElementTree.Element]:
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    path = next(e.get("full-path") for e in container.iter() if e.tag.endswith("rootfile"))
    return posixpath.dirname(path), ElementTree.fromstring(archive.read(path))


def read_epub(content: bytes) -> dict:
    """Metadata and the documents of an EPUB, those of the spine first, each once."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        base, package = _package(archive)
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        meta = {}
        for e in package.iter():
            if local(e) in ("title", "creator", "language") and e.text and local(e) not in meta:
                meta[local(e)] = clean(e.text)
        items = {e.get("id"): e for e in package.iter() if local(e) == "item"}
        spine = [e.get("idref") for e in package.iter() if local(e) == "itemref"]
        documents, seen = [], set()
        for i in [*spine, *items]:
            item = items.get(i)
            if item is None or "html" not in (item.get("media-type") or ""):
                continue
            path = posixpath.normpath(posixpath.join(base, unquote(item.get("href") or "")))
            if path in seen or path not in archive.namelist():
                continue
            seen.add(path)
            if any(word in path.lower() for word in SKIPPED_NAMES):
                continue
            documents.append((path, archive.read(path).decode("utf-8", "replace")))
    return {"title": meta.get("title"), "author": meta.get("creator"), "language": meta.get("language", "en"), "documents": documents}


def epub_documents(files: DataFrame) -> DataFrame:
    """``path, content`` (as of the binaryFile source) to one row per document; unreadable files give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    book = read_epub(bytes(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, StopIteration, TypeError):
                    continue
                rows += [(path, i, name, book["title"], book["author"], book["language"], html) for i, (name, html) in enumerate(book["documents"])]
            yield pd.DataFrame(rows, columns=["path", "place", "name", "title", "author", "language", "html"])

    return files.select("path", "content").mapInPandas(run, "path string, place int, name string, title string, author string, language string, html string")
