"""Plans of catalog feeds: pages and records made of the catalog's own rows and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import identity as I
from inkwell.functions import text as T
from inkwell.sources import catalogs as C
from inkwell.sources import editions as E
from inkwell.sources import pages as P
from inkwell.session import table

HOSTS = ["books.example", "mirror.example"]


def _books(s: SparkSession, d: str) -> DataFrame:
    """The last sync of each edition."""
    b = table(s, d, "source_books").filter("book_id is not null")
    r = b.groupBy("book_id").agg(F.max_by(F.struct("source_id", "title", "author", "language", "epub_url", "epub_sha256"), F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("r"))
    return r.select("book_id", "r.*")


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _named(s: SparkSession, d: str) -> DataFrame:
    b = _books(s, d).filter("title is not null and author is not null")
    return b.select("book_id", "source_id", "title", "author", F.concat(F.lit("a"), (F.col("book_id") % 97).cast("string"), F.lit("/b"), F.col("book_id").cast("string")).alias("path"))


def feed_editions(s, d):
    """Edition pages of every book, some without their rights, link or file."""
    b = _named(s, d)
    rights = F.when(F.col("book_id") % 7 == 0, "<p>All rights reserved.</p>").otherwise('<p class="us-pd-warning">This ebook is thought to be free of copyright restrictions in the United States.</p>')
    canonical = F.concat(F.lit('<link rel="canonical" href="https://standardebooks.org/ebooks/'), F.when(F.col("book_id") % 11 == 0, F.lit("x/y")).otherwise(F.col("path")), F.lit('"/>'))
    file = F.when(F.col("book_id") % 13 == 0, F.lit("")).otherwise(F.concat(F.lit('<a href="/ebooks/'), F.col("path"), F.lit("/downloads/"), F.translate("path", "/", "_"), F.lit('.epub">file</a>')))
    page = F.concat(canonical, rights, F.lit('<h1 property="schema:name">'), _escaped(F.col("title")), F.lit('</h1><a property="schema:author" href="#"><span property="schema:name">'), _escaped(F.col("author")), F.lit("</span></a>"), file)
    return E.edition_page(b.select("path", page.alias("html"))).select("path", "title", "author", "epub_url", "fault")


def feed_search(s, d):
    """Search answers of a hundred books each, their first ten free editions."""
    b = _named(s, d)
    entry = F.concat(F.lit('<li typeof="schema:Book"'), F.when(F.col("book_id") % 3 == 0, ' class="ribbon not-pd"').otherwise(""), F.lit(' about="/ebooks/'), F.col("path"), F.lit('"><span property="schema:name">'), _escaped(F.col("title")), F.lit('</span><span property="schema:name">'), _escaped(F.col("author")), F.lit("</span></li>"))
    pages = b.groupBy(F.floor(F.col("book_id") / 100).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("book_id", entry.alias("li")))), lambda x: x["li"]), "\n").alias("html"))
    return E.search_listing(pages)


def feed_json(s, d):
    """A page of JSON for each book, read as a feed: free texts in narrated languages."""
    b = _books(s, d).filter("title is not null")
    book = F.struct(F.col("book_id").alias("id"), "title", F.when(F.col("author").isNull(), F.array().cast("array<struct<name:string>>")).otherwise(F.array(F.struct(F.col("author").alias("name")))).alias("authors"), F.array(T.normalize_language(F.coalesce("language", F.lit("und")))).alias("languages"), (F.col("book_id") % 5 == 0).alias("copyright"), F.when(F.col("book_id") % 9 == 0, "Sound").otherwise("Text").alias("media_type"))
    return C.json_feed(b.select(F.to_json(F.struct(F.array(book).alias("results"))).alias("value")))


def feed_listing(s, d):
    """Paths of listing pages, entries that aren't free left out."""
    b = _named(s, d)
    return C.listing_paths(b.select(F.concat(F.lit('<ul><li typeof="schema:Book" about="/ebooks/'), F.col("path"), F.lit('"'), F.when(F.col("book_id") % 4 == 0, ' class="not-pd"').otherwise(""), F.lit("></li></ul>")).alias("html")))


def source_addresses(s, d):
    """Each edition's address: on a known host and for its own number, its id by host and path, its file's name."""
    b = _books(s, d).filter("epub_url is not null and source_id is not null")
    own = F.concat(F.lit("https://www.gutenberg.org/ebooks/"), F.regexp_extract("source_id", "(\\d+)$", 1), F.lit(".epub"))
    return b.select("book_id", I.edition_url(F.col("epub_url"), F.col("source_id"), HOSTS).alias("address"), I.source_of_url(own).alias("edition"), I.download_name(F.translate("source_id", ":", "/")).alias("file"))


def upload_checks(s, d):
    """Documents as uploads, each in turn said to be text, PDF and package."""
    kind = F.get(F.array(F.lit("txt"), F.lit("pdf"), F.lit("docx"), F.lit("exe")), (F.col("doc_id") % 4).cast("int"))
    return table(s, d, "documents").groupBy(kind.alias("kind"), E.upload_fault(F.encode("text", "UTF-8"), kind).alias("fault")).agg(F.count("*").alias("n"))


def upload_cleaned(s, d):
    """Documents as owners' texts: line ends made one, control characters out."""
    return table(s, d, "documents").select("doc_id", F.sha2(E.clean_upload(F.col("text")), 256).alias("hash"))


def request_checks(s, d):
    """Catalog rows as requests: the first parameter that isn't of its form."""
    p = table(s, d, "published_books").distinct()
    return p.groupBy(E.parameters_fault(F.col("title_slug"), F.col("section_count").cast("string"), F.left(F.sha2(F.col("current_build"), 256), F.lit(16))).alias("fault")).agg(F.count("*").alias("n"))


def notice_texts(s, d):
    """Documents of a provider's own, and lines that set its part apart."""
    t = table(s, d, "documents").filter("text is not null")
    return t.groupBy(P.is_notice(F.col("text")).alias("notice"), P.is_separator(F.col("text")).alias("separator")).agg(F.count("*").alias("n"))


def majority_languages(s, d):
    """The language of each text by its hint, else by its signs."""
    t = table(s, d, "documents").filter("text is not null")
    return t.groupBy(P.majority_language(F.col("text"), F.when(F.col("lang") == "fr", F.col("lang"))).alias("language")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (feed_editions, feed_search, feed_json, feed_listing, source_addresses, upload_checks, upload_cleaned, request_checks, notice_texts, majority_languages)}

_B = "b as (select book_id, source_id, title, author, language, epub_url from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at desc nulls last, coalesce(title, '') desc) = 1), nm as (select *, 'a' || (book_id % 97) || '/b' || book_id as path from b where title is not null and author is not null)"
_WS = r"[\s\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ONE = lambda c: f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"
ORACLES = {
    "feed_editions": f"with {_B} select path, {_ONE('title')} as title, {_ONE('author')} as author, 'https://standardebooks.org/ebooks/' || path || '/downloads/' || replace(path, '/', '_') || '.epub' as epub_url, case when book_id % 7 = 0 then 'rights' when book_id % 11 = 0 then 'canonical' when book_id % 13 = 0 then 'file' when {_ONE('title')} = '' or {_ONE('author')} = '' then 'names' end as fault from nm",
    "feed_search": f"with {_B}, r as (select book_id // 100 as page, path, {_ONE('title')} as title, {_ONE('author')} as author, book_id, row_number() over (partition by book_id // 100 order by book_id) - 1 as rank from nm where book_id % 3 <> 0 and {_ONE('title')} <> '' and {_ONE('author')} <> '') select page, rank::int as rank, 'standardebooks:' || path as source_id, title, author from r where rank < 10",
    "feed_json": f"with {_B}, l as (select *, case split_part(replace(lower(language), '_', '-'), '-', 1) when 'a' then 'en' when 'b' then 'en' when 'eng' then 'en' when 'z' then 'zh' when 'zho' then 'zh' when 'chi' then 'zh' else split_part(replace(lower(language), '_', '-'), '-', 1) end as lang from b where title is not null) select 'gutenberg:' || book_id as source_id, title, coalesce(author, 'Unknown') as author, lang as language from l where book_id % 5 <> 0 and book_id % 9 <> 0 and lang in ('en', 'zh')",
    "feed_listing": f"with {_B} select path from nm where book_id % 4 <> 0",
    "source_addresses": f"with {_B} select book_id, case when regexp_matches(source_id, '^[a-z]+:\\d+$') and contains(regexp_extract(epub_url, '^https://[^/]+(/.*)$', 1), regexp_extract(source_id, ':(\\d+)$', 1)) then 'https://books.example' || regexp_extract(epub_url, '^https://[^/]+(/.*)$', 1) end as address, case when regexp_matches(source_id, '\\d$') then 'gutenberg:' || regexp_extract(source_id, '(\\d+)$', 1) end as edition, replace(replace(source_id, '_', '-'), ':', '_') || '.epub' as file from b where epub_url is not null and source_id is not null",
    "upload_checks": f"with k as (select *, (['txt', 'pdf', 'docx', 'exe'])[doc_id % 4 + 1] as kind from documents) select kind, case when coalesce(strlen(text), 0) = 0 then 'empty' when kind = 'pdf' and not starts_with(text, '%PDF-') then 'not a PDF' when kind = 'docx' and not starts_with(text, 'PK' || chr(3) || chr(4)) then 'not a package' when kind = 'txt' and {_ONE('text')} = '' then 'no text' when kind = 'exe' then 'kind' end as fault, count(*) as n from k group by all",
    "upload_cleaned": r"select doc_id, case when trim(regexp_replace(x, '" + _WS + r"+', ' ', 'g')) <> '' then sha256(x) end as hash from (select doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') as x from documents)",
    "request_checks": "with p as (select distinct * from published_books) select case when not regexp_full_match(coalesce(title_slug, ''), '[a-z0-9]+(?:-[a-z0-9]+)*') then 'slug' when not regexp_full_match(coalesce(section_count::varchar, ''), '\\d{1,3}') then 'section' when current_build is null then 'build' end as fault, count(*) as n from p group by 1",
    "notice_texts": "select contains(lower(text), 'project gutenberg') and regexp_matches(lower(text), '" + "|".join(m.replace("'", "''").replace("(", "\\(").replace(")", "\\)").replace(".", "\\.").replace("*", "\\*") for m in P.NOTICE_MARKERS) + "') as notice, regexp_matches(text, '(?i)^\\*{3}\\s+(START|END)\\s+OF\\s+THE\\s+PROJECT\\s+GUTENBERG\\s+EBOOK\\b') as separator, count(*) as n from documents where text is not null group by all",
    "majority_languages": r"select case when lang = 'fr' then 'fr' when len(regexp_extract_all(text, '\p{Han}')) > len(regexp_extract_all(text, '\p{Latin}+')) then 'zh' else 'en' end as language, count(*) as n from documents where text is not null group by 1",
}
