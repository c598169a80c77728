"""Parts of pages and packages: contents links, bodies without furniture, covers, navigation labels."""

from __future__ import annotations

import io
import posixpath
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote, urldefrag, urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import has_han
from inkwell.sources.html import _VOID, _package, clean

# Classes whose elements aren't part of a page's text, and the marks of a provider's own notices.
FURNITURE = frozenset("ws-noexport ws-summary ws-header header navigation navbox mw-editsection license licensetpl copyright references".split())
NOTICE_IDS = frozenset("pg-header pg-footer pg-start-separator pg-end-separator pg-machine-header".split())
NOTICE_CLASSES = frozenset("pg-boilerplate pgheader pgfooter".split())
NOTICE_MARKERS = ("license", "start of the project gutenberg ebook", "end of the project gutenberg ebook")
COVER_BYTES = 5000

_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote div pre".split())


class _Page(HTMLParser):
    """A tree-less walk: the open elements, the texts of leaf blocks and the links of the contents list."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.blocks: list[str] = []
        self.links: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data("\n")
        if tag in _VOID:
            return
        known = dict(attrs)
        classes = frozenset((known.get("class") or "").split())
        if tag in _LEAVES and self.open and self.open[-1]["tag"] == "p":
            self._close(len(self.open) - 1)
        inside = self.open[-1] if self.open else {"off": False, "toc": False}
        off = inside["off"] or tag in ("script", "style") or bool(classes & (FURNITURE | NOTICE_CLASSES)) or known.get("id") in NOTICE_IDS or tag == "sup" and "reference" in classes
        toc = inside["toc"] or "ws-summary" in classes
        if tag == "a" and toc and known.get("href"):
            self.links.append(known["href"])
        if tag in _LEAVES:
            for node in self.open:
                node["leaf"] = False
        self.open.append({"tag": tag, "off": off, "toc": toc, "leaf": True, "parts": []})

    def handle_endtag(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at]["tag"] == tag:
                self._close(at)
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["off"]:
            return
        for node in self.open:
            if node["tag"] in _LEAVES:
                node["parts"].append(data)

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            node = self.open.pop()
            text = " ".join("".join(node["parts"]).split())
            if node["tag"] in _LEAVES and node["leaf"] and text:
                self.blocks.append(text)


def _walk(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    page._close(0)
    return page


def body_paragraphs(html: str | None) -> list[str]:
    """Texts of a page's leaf blocks without scripts, furniture, notices and reference marks."""
    return _walk(html).blocks


def chapter_links(html: str | None, language: str) -> list[str] | None:
    """Page titles the contents list links to, in order; None where one is foreign, special or repeated."""
    host, out = f"{language}.wikisource.org", []
    for href in _walk(html).links:
        url = urlsplit(urljoin(f"https://{host}", href))
        title = unquote(url.path[len("/wiki/") :]).replace("_", " ")
        if url.scheme != "https" or url.netloc != host or not url.path.startswith("/wiki/") or url.query or url.fragment or ":" in title or title in out:
            return None
        out.append(title)
    return out


def is_notice(text: Column) -> Column:
    """A document of the provider's own: its name and one of the marks."""
    low = F.lower(text)
    marked = F.lit(False)
    for marker in NOTICE_MARKERS:
        marked = marked | F.contains(low, F.lit(marker))
    return F.contains(low, F.lit("project gutenberg")) & marked


def is_separator(text: Column) -> Column:
    return text.rlike("(?i)^\\*{3}\\s+(START|END)\\s+OF\\s+THE\\s+PROJECT\\s+GUTENBERG\\s+EBOOK\\b")


def cover(content: bytes) -> tuple[str, bytes] | None:
    """An EPUB's cover: the item marked so, the one the metadata names, one named so, else its largest image over 5,000 bytes."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        base, package = _package(archive)
        names = frozenset(archive.namelist())
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        images = []
        named = next((e.get("content") for e in package.iter() if local(e) == "meta" and e.get("name") == "cover"), None)
        for e in package.iter():
            path = posixpath.normpath(posixpath.join(base, unquote(e.get("href") or "")))
            if local(e) == "item" and (e.get("media-type") or "").startswith("image/") and path in names:
                rank = 0 if "cover-image" in (e.get("properties") or "").split() else 1 if e.get("id") == named else 2 if "cover" in path.lower() else 3
                images.append((rank, path, archive.read(path)))
    for rank, path, data in sorted((i for i in images if i[2]), key=lambda i: (i[0], -len(i[2]) if i[0] == 3 else 0)):
        if rank < 3 or len(data) > COVER_BYTES:
            return path, data
    return None


def navigation_labels(content: bytes) -> dict[str, str]:
    """Labels by path and by path with fragment, from the package's navigation; the first of a target counts."""
    labels: dict[str, str] = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        base, package = _package(archive)
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        found = [e.get("href") for e in package.iter() if local(e) == "item" and ("nav" in (e.get("properties") or "").split() or (e.get("media-type") or "").endswith("dtbncx+xml"))]
        for href in found:
            path = posixpath.normpath(posixpath.join(base, href))
            root = ElementTree.fromstring(archive.read(path))
            pairs = [("".join(e.itertext()), e.get("href")) for e in root.iter() if local(e) == "a" and e.get("href")]
            for point in (e for e in root.iter() if local(e) == "navPoint"):
                text = next(("".join(t.itertext()) for t in point.iter() if local(t) == "text"), "")
                pairs.append((text, next((c.get("src") for c in point if local(c) == "content"), None)))
            for text, target in pairs:
                if target and clean(text):
                    whole = posixpath.normpath(posixpath.join(posixpath.dirname(path), unquote(target)))
                    labels.setdefault(urldefrag(whole)[0], clean(text))
                    labels.setdefault(whole, clean(text))
    return labels


def majority_language(text: Column, hint: Column) -> Column:
    """The hint, else Chinese where Han signs outnumber Latin words, else English."""
    han = F.size(F.regexp_extract_all(text, F.lit("\\p{IsHan}"), F.lit(0)))
    latin = F.size(F.regexp_extract_all(text, F.lit("\\p{IsLatin}+"), F.lit(0)))
    return F.coalesce(F.nullif(hint, F.lit("")), F.when(han > latin, "zh").otherwise("en"))


def indented_paragraphs(text: Column) -> Column:
    """Paragraphs at blank lines and, in Chinese text, at indented lines."""
    parts = F.when(has_han(text), F.split(text, "\\n\\s*\\n|\\n(?=[\\u3000 ]{2})")).otherwise(F.split(text, "\\n\\s*\\n"))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[\\s\\u3000]+|[\\s\\u3000]+$", "")), lambda p: p != "")
