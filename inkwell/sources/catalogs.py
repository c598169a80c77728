"""Catalog feeds: CSV, JSON pages, HTML listings, RDF archives, owner documents and artifacts."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.text import collapse_space

# The columns of a catalog file, and the rights statement that admits an edition.
CSV_COLUMNS = ["Text#", "Type", "Title", "Language", "Authors"]
PUBLIC_DOMAIN = "Public domain in the USA."
ARTIFACT_VERSION = 2


def catalog_csv(spark: SparkSession, path: str, after_id: int = 0, max_books: int | None = None) -> DataFrame:
    """Editions of a (gz) catalog file with decimal id, in narrated languages, titled; in order of id."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(*[F.col(f"`{c}`") for c in CSV_COLUMNS])
    number = F.col("`Text#`").try_cast("bigint")
    codes = F.transform(F.split("Language", ";"), lambda x: F.trim(x))
    language = F.when(F.array_contains(codes, "zh"), "zh").when(F.array_contains(codes, "en"), "en")
    author = F.coalesce(F.nullif(collapse_space(F.col("Authors")), F.lit("")), F.lit("Unknown"))
    out = rows.select(number.alias("number"), F.col("Type").alias("kind"), F.left(collapse_space(F.col("Title")), F.lit(300)).alias("title"), F.left(author, F.lit(200)).alias("author"), language.alias("language"))
    out = out.filter((F.col("kind") == "Text") & (F.col("number") > after_id) & F.col("language").isNotNull() & (F.col("title") != "")).orderBy("number")
    out = out.limit(max_books) if max_books is not None else out
    return out.select(F.concat(F.lit("gutenberg:"), F.col("number").cast("string")).alias("source_id"), "title", "author", "language")


def json_feed(pages: DataFrame, narrated: tuple[str, ...] = ("en", "zh")) -> DataFrame:
    """Books of paginated JSON answers: free, text, in a narrated language; first author."""
    book = F.explode(F.from_json("value", "results array<struct<id:bigint,title:string,authors:array<struct<name:string>>,languages:array<string>,copyright:boolean,media_type:string>>")["results"])
    b = pages.select(book.alias("b")).filter("b.copyright = false and b.media_type = 'Text'")
    b = b.filter(F.arrays_overlap("b.languages", F.array(*map(F.lit, narrated))))
    return b.select(F.concat(F.lit("gutenberg:"), F.col("b.id").cast("string")).alias("source_id"), F.col("b.title").alias("title"), F.coalesce(F.get("b.authors", F.lit(0))["name"], F.lit("Unknown")).alias("author"), F.get(F.filter("b.languages", lambda x: x.isin(*narrated)), F.lit(0)).alias("language"))


def listing_paths(pages: DataFrame, html: str = "html") -> DataFrame:
    """Edition paths of listing pages: entries with a schema, except those marked not free; without any, all links."""
    entry = F.regexp_extract_all(F.col(html), F.lit('(?s)<li[^>]*about="/ebooks/[^"]+"[^>]*>'), F.lit(0))
    free = F.filter(entry, lambda e: ~e.rlike('class="[^"]*\\bnot-pd\\b'))
    about = F.transform(free, lambda e: F.regexp_extract(e, 'about="/ebooks/([^"]+)"', 1))
    links = F.regexp_extract_all(F.col(html), F.lit('href="/ebooks/([a-z0-9-]+/[a-z0-9/_-]+)"'), F.lit(1))
    return pages.select(F.explode(F.when(F.size(entry) > 0, about).otherwise(links)).alias("path")).distinct()


def rights_record(data: bytes) -> dict | None:
    """Id, rights and file addresses of one RDF record; none with a DOCTYPE or ENTITY."""
    if re.search(rb"<!(DOCTYPE|ENTITY)", data):
        return None
    root = ElementTree.fromstring(data)
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    about = lambda e: next((v for k, v in e.attrib.items() if k.endswith("about")), "")
    ebook = next((about(e) for e in root.iter() if local(e) == "ebook"), "")
    rights = next((e.text for e in root.iter() if local(e) == "rights"), None)
    urls = [about(e) for e in root.iter() if local(e) == "file" and ".epub" in about(e)]
    return {"number": int(re.search(r"(\d+)$", ebook).group(1)) if re.search(r"(\d+)$", ebook) else None, "rights": rights, "urls": urls}


def rights_archive(files: DataFrame) -> DataFrame:
    """``content`` of tar.bz2 archives to source_id, rights and the preferred file address of each record."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(bytes(content)), mode="r:*") as archive:
                    for member in archive:
                        if not (member.isfile() and re.search(r"pg\d+\.rdf$", member.name)):
                            continue
                        try:
                            record = rights_record(archive.extractfile(member).read())
                        except ElementTree.ParseError:
                            record = None
                        if record and record["number"] is not None:
                            images = [u for u in record["urls"] if "-images" in u]
                            rows.append((f"gutenberg:{record['number']}", record["rights"], (images or record["urls"] or [None])[0]))
            yield pd.DataFrame(rows, columns=["source_id", "rights", "epub_url"])

    return files.select("content").mapInPandas(run, "source_id string, rights string, epub_url string")


def verified(candidates: DataFrame, rights: DataFrame) -> DataFrame:
    """Candidates whose record admits them and has a file."""
    return candidates.join(rights.filter((F.col("rights") == PUBLIC_DOMAIN) & F.col("epub_url").isNotNull()), "source_id")


def edition_manifest(spark: SparkSession, path: str, max_books: int = 1000) -> DataFrame:
    """Editions of a JSON list file, the first ``max_books`` in the file's order."""
    text = spark.read.text(path, wholetext=True)
    editions = F.from_json("value", "array<struct<language:string,page_id:bigint,revision:bigint,title:string,author:string,chapters:array<struct<page_id:bigint,revision:bigint,title:string>>>>")
    return text.select(F.posexplode(F.slice(editions, 1, max_books)).alias("place", "e")).select("place", "e.*")


def edition_snapshot(editions: DataFrame) -> DataFrame:
    """A stable id of an edition: language, page, revision and a hash over its chapters' pages and revisions."""
    body = F.array_join(F.transform("chapters", lambda c: F.concat_ws(":", c["page_id"].cast("string"), c["revision"].cast("string"))), ",")
    distinct = F.size(F.array_distinct(F.transform("chapters", lambda c: c["page_id"]))) == F.size("chapters")
    digest = F.left(F.sha2(F.concat_ws("|", "language", F.col("page_id").cast("string"), F.col("revision").cast("string"), body), 256), F.lit(16))
    return editions.withColumn("source_id", F.concat_ws(":", F.lit("wikisource"), "language", F.col("page_id").cast("string"), F.col("revision").cast("string"), digest)).withColumn("valid", distinct & (F.size("chapters") > 0))


def artifacts(spark: SparkSession, path: str, schema: str, version: int = ARTIFACT_VERSION) -> DataFrame:
    """JSON artifacts of the one version that is read; others fail the read."""
    rows = spark.read.schema(f"version int, {schema}").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.filter(F.assert_true(F.col("version").eqNullSafe(F.lit(version)), F.lit("unsupported artifact version")).isNull())


def owner_text(content: bytes, kind: str) -> list[tuple[str, str]] | None:
    """Titled sections of an owner's TXT or DOCX; None for anything that isn't one."""
    if kind == "txt":
        try:
            text = content.decode("utf-8-sig")
        except UnicodeDecodeError:
            return None
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        return [("", text)] if text.strip() and "\x00" not in text else None
    if kind != "docx":
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            data = archive.read("word/document.xml")
    except (zipfile.BadZipFile, KeyError):
        return None
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        return None
    paragraphs = []
    for p in ElementTree.fromstring(data).iter():
        if p.tag.endswith("}p"):
            marks = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n"}
            paragraphs.append("".join(marks[e.tag.rsplit("}", 1)[-1]](e) for e in p.iter() if e.tag.rsplit("}", 1)[-1] in marks))
    text = "\n\n".join(x for x in paragraphs if x.strip())
    return [("", text)] if text else None


def owner_documents(files: DataFrame) -> DataFrame:
    """``path, content`` to one row per section; files of no known kind give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                for i, (title, text) in enumerate(owner_text(bytes(content), path.rsplit(".", 1)[-1].lower()) or []):
                    rows.append((path, i, title, text))
            yield pd.DataFrame(rows, columns=["path", "section", "title", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, section int, title string, text string")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Book manifests under ``root``/books/<author>/<title>/, with the slugs their path gives."""
    files = spark.read.option("pathGlobFilter", "manifest.json").option("recursiveFileLookup", True).text(root, wholetext=True).select("value", F.input_file_name().alias("file"))
    pattern = "books/([a-z0-9-]+)/([a-z0-9-]+)/manifest\\.json$"
    body = F.from_json("value", "title string, author string, source string, renditions map<string,struct<voice:string,engine:string,current_build:string,available_builds:array<string>>>")
    return files.filter(F.col("file").rlike(pattern)).select(F.regexp_extract("file", pattern, 1).alias("author_slug"), F.regexp_extract("file", pattern, 2).alias("title_slug"), body.alias("m")).select("author_slug", "title_slug", "m.*")


def builds_of(books: DataFrame) -> DataFrame:
    """One row per rendition and available build, the current one flagged, in the manifest's order."""
    r = books.select("author_slug", "title_slug", F.explode("renditions").alias("rendition", "r"))
    return r.select("author_slug", "title_slug", "rendition", F.posexplode(F.array_distinct("r.available_builds")).alias("place", "build"), F.col("r.current_build").alias("current")).withColumn("is_current", F.col("build") == F.col("current")).drop("current")


