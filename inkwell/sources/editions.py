"""Edition pages and search listings, and what an edition file must satisfy."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.functions.text import collapse_space
from inkwell.sources.catalogs import PUBLIC_DOMAIN

# The statement of a page that admits an edition, limits of names and files.
FREE_PAGE = "This ebook is thought to be free of copyright restrictions in the United States\\."
SITE = "https://standardebooks.org"
TITLE_CHARS, AUTHOR_CHARS, SEARCH_BOOKS = 300, 200, 10
MAX_ENTRIES, MAX_FILE_BYTES, MAX_EXPANDED_BYTES, MAX_TEXT_CHARS = 10_000, 100 << 20, 500 << 20, 2_000_000
SLUG, SECTION_NUMBER, BUILD = "^[a-z0-9]+(?:-[a-z0-9]+)*$", "^\\d{1,3}$", "^[a-f0-9]{16}$"
BANNER = re.compile(r"this\s+is\s+a\s+copyrighted\s+project\s+gutenberg\s+ebook", re.I)

#: Text of a piece of HTML: tags out, entities read, spaces made one.
plain_text = F.pandas_udf(lambda s: s.map(lambda t: " ".join(html.unescape(re.sub(r"<[^>]*>", "", t)).split()) if t is not None else None), StringType())


def edition_page(pages: DataFrame) -> DataFrame:
    """``path, html`` of edition pages to title, author and file address, with ``fault`` where a page doesn't admit its edition.

    Defined cases: a null page has every fault's first, ``rights``; of several
    names the first counts.
    """
    page = F.coalesce("html", F.lit(""))
    canonical = F.regexp_extract(page, "<link\\b[^>]*rel=[\"']canonical[\"'][^>]*href=[\"']([^\"']+)", 1)
    link = F.concat(F.lit("/ebooks/"), F.col("path"), F.lit("/downloads/"), F.translate("path", "/", "_"), F.lit(".epub"))
    title = plain_text(F.regexp_extract(page, "(?s)<h1\\b[^>]*property=[\"']schema:name[\"'][^>]*>(.*?)</h1>", 1))
    author = plain_text(F.regexp_extract(page, "(?s)<a\\b[^>]*property=[\"']schema:author[\"'][^>]*>.*?<span\\b[^>]*property=[\"']schema:name[\"'][^>]*>(.*?)</span>", 1))
    fault = (
        F.when(~page.rlike("class=[\"']us-pd-warning[\"'][^>]*>\\s*" + FREE_PAGE), "rights")
        .when(canonical != F.concat(F.lit(SITE + "/ebooks/"), F.col("path")), "canonical")
        .when(~F.contains(page, F.concat(F.lit('href="'), link, F.lit('"'))), "file")
        .when(~F.length("title").between(1, TITLE_CHARS) | ~F.length("author").between(1, AUTHOR_CHARS), "names")
    )
    rows = pages.withColumns({"title": title, "author": author})
    return rows.select("path", "title", "author", F.concat(F.lit(SITE), link).alias("epub_url"), F.sha2(page, 256).alias("rights_sha256"), fault.alias("fault"))


def search_listing(pages: DataFrame, most: int = SEARCH_BOOKS) -> DataFrame:
    """``page, html`` of search answers to the first ``most`` editions each: free, named, each once."""
    entry = F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<li\\b[^>]*>.*?</li>"), F.lit(0)))
    rows = pages.select("page", entry.alias("place", "li")).withColumn("tag", F.regexp_extract("li", "^<li\\b([^>]*)>", 1))
    rows = rows.filter(F.col("tag").rlike("\\btypeof=[\"']schema:Book[\"']") & ~F.col("tag").rlike("\\bclass=[\"'](?:[^\"']*\\s)?not-pd(?:\\s[^\"']*)?[\"']"))
    names = F.regexp_extract_all("li", F.lit("(?is)<span\\b[^>]*\\bproperty=[\"']schema:name[\"'][^>]*>(.*?)</span>"), F.lit(1))
    rows = rows.select("page", "place", F.regexp_extract("tag", "\\babout=[\"']/ebooks/([^\"']+)[\"']", 1).alias("path"), names.alias("names")).filter((F.col("path") != "") & (F.size("names") >= 2))
    rows = rows.withColumns({"title": plain_text(F.get("names", F.lit(0))), "author": plain_text(F.get("names", F.lit(1)))})
    rows = rows.filter(F.length("title").between(1, TITLE_CHARS) & F.length("author").between(1, AUTHOR_CHARS))
    first = rows.groupBy("page", "path").agg(F.min_by(F.struct("place", "title", "author"), "place").alias("b"))
    listed = first.groupBy("page").agg(F.slice(F.array_sort(F.collect_list(F.struct("b.place", "path", "b.title", "b.author"))), 1, most).alias("l"))
    return listed.select("page", F.posexplode("l").alias("rank", "b")).select("page", "rank", F.concat(F.lit("standardebooks:"), F.col("b.path")).alias("source_id"), F.col("b.title").alias("title"), F.col("b.author").alias("author"))


def parameters_fault(slug: Column, section: Column, build: Column) -> Column:
    """The first of a request's parameters that isn't of its form."""
    return F.when(~F.coalesce(slug, F.lit("")).rlike(SLUG), "slug").when(~F.coalesce(section, F.lit("")).rlike(SECTION_NUMBER), "section").when(~F.coalesce(build, F.lit("")).rlike(BUILD), "build")


def upload_fault(content: Column, kind: Column) -> Column:
    """What keeps an upload from being of its kind: its first bytes, or a text that is blank, broken, too long or holds NUL."""
    head = F.hex(F.substring(content, 1, 5))
    text = F.try_validate_utf8(content)
    body = text.cast("string")
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) == 0, "empty")
        .when((kind == "pdf") & (head != "255044462D"), "not a PDF")
        .when((kind == "docx") & (F.left(head, F.lit(8)) != "504B0304"), "not a package")
        .when((kind == "txt") & text.isNull(), "not UTF-8")
        .when((kind == "txt") & ((F.trim(F.regexp_replace(body, "(?U)\\s+", " ")) == "") | F.contains(body, F.lit("\x00")) | (F.length(body) > MAX_TEXT_CHARS)), "no text")
        .when(~kind.isin("pdf", "docx", "txt"), "kind")
    )


def clean_upload(text: Column) -> Column:
    """An owner's text with line ends made one and control characters out; null if it holds NUL or is blank."""
    body = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    return F.when(~F.contains(text, F.lit("\x00")) & (collapse_space(body) != ""), body)


def epub_fault(content: bytes | None, source_id: str, language: str | None = None) -> str | None:
    """The first rule an edition file breaks: archive, limits, package, rights, identifier, banner, media type, language, words."""
    if not content or len(content) > MAX_FILE_BYTES:
        return "size"
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        entries = archive.infolist()
        if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_EXPANDED_BYTES:
            return "limits"
        if archive.testzip() is not None or "META-INF/container.xml" not in archive.namelist():
            return "archive"
        packages = [e for e in entries if e.filename.lower().endswith(".opf")]
        if len(packages) != 1:
            return "package"
        package = ElementTree.fromstring(archive.read(packages[0]))
    except (zipfile.BadZipFile, ElementTree.ParseError, EOFError):
        return "archive"
    said = lambda name: [e.text.strip() for e in package.iter(f"{{http://purl.org/dc/elements/1.1/}}{name}") if e.text]
    if said("rights") != [PUBLIC_DOMAIN]:
        return "rights"
    number = re.fullmatch(r"gutenberg:(\d+)", source_id or "")
    if number and not set(said("identifier")) <= {f"{scheme}://www.gutenberg.org/{part}{number[1]}" for scheme in ("http", "https") for part in ("ebooks/", "")}:
        return "identifier"
    words = 0
    for entry in entries:
        if entry.filename.lower().endswith((".htm", ".html", ".xhtml", ".txt")):
            text = html.unescape(re.sub(r"<[^>]*>", " ", archive.read(entry).decode("utf-8", "ignore")))
            if BANNER.search(text):
                return "banner"
            words += len(text.split())
    if "mimetype" not in archive.namelist() or archive.read("mimetype") != b"application/epub+zip":
        return "media type"
    if language is not None and [x.split("-")[0].lower() for x in said("language")][:1] != [language]:
        return "language"
    return None if words else "no words"


def epub_faults(files: DataFrame) -> DataFrame:
    """``source_id, content, language`` of edition files to ``source_id, fault``; null for a sound file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            faults = [epub_fault(bytes(c) if c is not None else None, i, l) for c, i, l in zip(frame["content"], frame["source_id"], frame["language"])]
            yield pd.DataFrame({"source_id": frame["source_id"], "fault": pd.Series(faults, dtype=object)})

    return files.select("source_id", "content", "language").mapInPandas(run, "source_id string, fault string")
