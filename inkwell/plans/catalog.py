"""Catalog plans: editions, published books, renditions and builds (joins, aggregates, pages)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import relational as R
from inkwell.session import table

DEFAULT_RENDITION = "narrator-reed"
RETAIN = 2


def _sources(s: SparkSession, d: str) -> DataFrame:
    """The last sync of each edition."""
    return R.latest(table(s, d, "source_books"), ["book_id"], F.col("updated_at"), F.coalesce("title", F.lit("")))


def _published(s: SparkSession, d: str) -> DataFrame:
    return R.latest(table(s, d, "published_books"), ["catalog_id"], F.col("updated_at"), F.coalesce("current_build", F.lit("")), F.coalesce("revision", F.lit("")))


_SRC = "src as (select * from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at desc nulls last, coalesce(title,'') desc) = 1)"
_PUB = "pub as (select * from published_books where catalog_id is not null qualify row_number() over (partition by catalog_id order by updated_at desc nulls last, coalesce(current_build,'') desc, coalesce(revision,'') desc) = 1)"
#: Sections of each build with their length: the last word's end.
_SEC = "sec as (select source_id, rendition, build, sequence, max(end_s) as duration_s, count(*) as n_words from word_times where word is not null and end_s >= 0 group by all)"


def _build_sections(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "word_times").filter("word is not null and end_s >= 0")
    return words.groupBy("source_id", "rendition", "build", "sequence").agg(F.max("end_s").alias("duration_s"), F.count("*").alias("n_words"))


def source_latest(s, d):
    return _sources(s, d).select("book_id", "source_id", "title", "author", "language", "updated_at")


def source_cached_counts(s, d):
    """Editions by language, read from provider and cache state; language codes normalised."""
    b = _sources(s, d).select(T.normalize_language(F.col("language")).alias("language"), F.substring_index("source_id", ":", 1).alias("provider"), F.col("epub_sha256").isNotNull().alias("cached"))
    return b.groupBy("language", "provider").agg(F.count("*").alias("editions"), F.count_if("cached").alias("cached"))


def source_browse(s, d):
    """One page of cached editions in English that aren't private, with the total."""
    b = _sources(s, d).filter((T.normalize_language(F.col("language")) == "en") & F.col("epub_sha256").isNotNull() & ~F.startswith("source_id", F.lit("owner:")))
    return R.page(b.select("source_id", "title"), [F.col("title").asc_nulls_first(), F.col("source_id")], 20, 20)


def catalog_page(s, d):
    """Catalog in search order, third page of ten, with the total."""
    cols = ["author_search", "title_search", "author_slug", "title_slug", "catalog_id"]
    return R.page(_published(s, d).select(cols), [F.col(c).asc_nulls_first() for c in cols], 20, 10)


def catalog_keyset(s, d):
    """Ten rows beyond a cursor on (author_slug, title_slug, catalog_id)."""
    return R.keyset_page(_published(s, d).select("author_slug", "title_slug", "catalog_id").dropna(), ["author_slug", "title_slug", "catalog_id"], ["c", "", 0], 10)


def catalog_contains(s, d):
    p = _published(s, d)
    return p.filter(F.contains("title_search", F.lit("bells")) | F.contains("author_search", F.lit("bells"))).select("catalog_id", "title_search")


def catalog_inner(s, d):
    """Published books with their editions."""
    return _published(s, d).join(_sources(s, d).select("source_id", F.col("title").alias("edition_title"), "language"), F.col("source") == F.col("source_id")).select("catalog_id", "source_id", "title", "edition_title", "language")


def catalog_unpublished(s, d):
    """Editions nothing was published of."""
    return _sources(s, d).join(_published(s, d).select(F.col("source").alias("source_id")), "source_id", "left_anti").select("book_id", "source_id")


def catalog_available(s, d):
    """Editions something was published of, and their public state."""
    b, p = _sources(s, d), _published(s, d).select(F.col("source").alias("source_id"), F.lit(True).alias("has")).distinct()
    state = F.when(F.col("has") & F.col("author_slug").isNotNull() & F.col("title_slug").isNotNull(), "available").when(F.col("has"), "running").when(F.col("epub_sha256").isNull(), "queued").otherwise("ready_to_generate")
    return b.join(p, "source_id", "left").select("book_id", state.alias("state"))


def catalog_latest_delivery(s, d):
    """Each edition with the id of its newest section data, if any."""
    newest = R.latest(table(s, d, "section_data").select("source_id", "data_id", "received_at"), ["source_id"], F.col("received_at"), F.col("data_id"))
    return _sources(s, d).select("book_id", "source_id").join(newest, "source_id", "left").select("book_id", "data_id", "received_at")


def build_durations(s, d):
    """Duration and number of sections of each build."""
    return _build_sections(s, d).groupBy("source_id", "rendition", "build").agg(F.round(F.sum("duration_s"), 3).alias("total_duration_seconds"), F.count("*").alias("section_count"), F.sum("n_words").alias("n_words"))


def build_retention(s, d):
    """Builds newest first; the published one leads, the next ``RETAIN`` - 1 stay, the rest go."""
    newest = table(s, d, "word_times").groupBy("source_id", "rendition", "build").agg(F.max("synced_at").alias("synced_at")).dropna(subset=["source_id", "rendition", "build"])
    current = _published(s, d).select(F.col("source").alias("source_id"), "rendition", F.col("current_build").alias("build"), F.lit(1).alias("current")).distinct()
    w = Window.partitionBy("source_id", "rendition").orderBy(F.desc("current"), F.desc("synced_at"), "build")
    ranked = newest.join(current, ["source_id", "rendition", "build"], "left").fillna(0, ["current"]).withColumn("place", F.row_number().over(w))
    return ranked.select("source_id", "rendition", "build", (F.col("current") == 1).alias("is_current"), "place", (F.col("place") <= RETAIN).alias("kept"))


def rendition_default(s, d):
    """The default rendition of each edition if it has it, else the first by name."""
    r = _published(s, d).filter("source is not null and rendition is not null")
    return r.groupBy("source").agg(F.min_by("rendition", F.struct((F.col("rendition") != DEFAULT_RENDITION).alias("other"), F.col("rendition"))).alias("rendition"), F.count_distinct("rendition").alias("renditions"))


def rendition_builds(s, d):
    """Ordered distinct builds of each edition and rendition, the current one flagged by place."""
    b = table(s, d, "character_profiles").select("source_id", "build").dropna().distinct()
    return b.groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_list("build")), ",").alias("builds"), F.count("*").alias("n"))


def build_missing_sections(s, d):
    """Sections an edition has but a build of it lacks."""
    want = table(s, d, "sections").select("source_id", "sequence").dropna().distinct()
    builds = table(s, d, "word_times").select("source_id", "rendition", "build").dropna().distinct()
    have = table(s, d, "word_times").select("source_id", "rendition", "build", "sequence").dropna().distinct()
    return builds.join(want, "source_id").join(have, ["source_id", "rendition", "build", "sequence"], "left_anti")


def section_dedupe_check(s, d):
    """Rows, distinct ids and repeated rows of the tables that are delivered more than once."""
    out = None
    for t, k in (("sections", "section_id"), ("chunks", "chunk_id"), ("source_books", "book_id"), ("published_books", "catalog_id"), ("character_profiles", "character_id"), ("section_data", "data_id")):
        one = table(s, d, t).agg(F.count("*").alias("n"), F.count_distinct(k).alias("ids")).select(F.lit(t).alias("tab"), "n", "ids", (F.col("n") - F.col("ids")).alias("repeats"))
        out = one if out is None else out.unionByName(one)
    return out


def languages_narrated(s, d):
    """Editions whose language is among those narrated; a set intersection test."""
    langs = F.array_remove(F.array(T.normalize_language(F.col("language"))), F.lit(""))
    return _sources(s, d).filter(F.arrays_overlap(langs, F.array(F.lit("en"), F.lit("zh")))).select("book_id")


def duplicate_active(s, d):
    """Keys that break "one rendition of an edition at a time"."""
    return _published(s, d).filter("source is not null").groupBy("source", "rendition").agg(F.count("*").alias("n")).filter("n > 1")


def order_totals(s, d):
    """Builds and sections over the order tables: sum, count, average and completeness of each order."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 4).alias("duration"), F.count("*").alias("sections"), F.count_distinct("l_linenumber").alias("sequences"), F.max("l_linenumber").alias("last"))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority")
    return o.join(li, "l_orderkey").select("l_orderkey", "o_custkey", "o_orderpriority", "duration", "sections", ((F.col("sequences") == F.col("sections")) & (F.col("last") == F.col("sections"))).alias("complete"))


def order_retention(s, d):
    """The two newest orders of each customer and priority: retention per rendition."""
    return R.first_rows(table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_orderdate"), ["o_custkey", "o_orderpriority"], RETAIN, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderpriority", "o_orderkey", "rank")


def queue_order(s, d):
    """The twenty next orders: open ones first, by priority, then age."""
    return table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate").orderBy((F.col("o_orderstatus") == "O").desc(), F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")).limit(20)


QUERIES = {f.__name__: f for f in (source_latest, source_cached_counts, source_browse, catalog_page, catalog_keyset, catalog_contains, catalog_inner, catalog_unpublished, catalog_available, catalog_latest_delivery, build_durations, build_retention, rendition_default, rendition_builds, build_missing_sections, section_dedupe_check, languages_narrated, duplicate_active, order_totals, order_retention, queue_order)}

_LANG = "case split_part(translate(lower(language),'_','-'),'-',1) when 'a' then 'en' when 'b' then 'en' when 'eng' then 'en' when 'z' then 'zh' when 'zho' then 'zh' when 'chi' then 'zh' else split_part(translate(lower(language),'_','-'),'-',1) end"
ORACLES = {
    "source_latest": f"with {_SRC} select book_id, source_id, title, author, language, updated_at from src",
    "source_cached_counts": f"with {_SRC} select {_LANG} as language, split_part(source_id,':',1) as provider, count(*) as editions, count(*) filter (epub_sha256 is not null) as cached from src group by 1, 2",
    "source_browse": f"with {_SRC}, b as (select source_id, title from src where {_LANG} = 'en' and epub_sha256 is not null and not starts_with(source_id, 'owner:')) select source_id, title, (select count(*) from b) as total from b order by title nulls first, source_id limit 20 offset 20",
    "catalog_page": f"with {_PUB} select author_search, title_search, author_slug, title_slug, catalog_id, (select count(*) from pub) as total from pub order by author_search nulls first, title_search nulls first, author_slug nulls first, title_slug nulls first, catalog_id limit 10 offset 20",
    "catalog_keyset": f"with {_PUB} select author_slug, title_slug, catalog_id from pub where author_slug is not null and title_slug is not null and (author_slug, title_slug, catalog_id) > ('c', '', 0) order by 1, 2, 3 limit 10",
    "catalog_contains": f"with {_PUB} select catalog_id, title_search from pub where contains(title_search, 'bells') or contains(author_search, 'bells')",
    "catalog_inner": f"with {_SRC}, {_PUB} select p.catalog_id, s.source_id, p.title, s.title as edition_title, s.language from pub p join src s on p.source = s.source_id",
    "catalog_unpublished": f"with {_SRC}, {_PUB} select book_id, source_id from src s where not exists (select 1 from pub p where p.source = s.source_id)",
    "catalog_available": f"with {_SRC}, {_PUB} select book_id, case when has and author_slug is not null and title_slug is not null then 'available' when has then 'running' when epub_sha256 is null then 'queued' else 'ready_to_generate' end as state from src left join (select distinct source, true as has from pub) p on p.source = src.source_id",
    "catalog_latest_delivery": f"with {_SRC}, n as (select source_id, data_id, received_at from section_data where source_id is not null qualify row_number() over (partition by source_id order by received_at desc nulls last, data_id desc) = 1) select book_id, data_id, received_at from src left join n using (source_id)",
    "build_durations": f"with {_SEC} select source_id, rendition, build, round(sum(duration_s), 3) as total_duration_seconds, count(*) as section_count, sum(n_words)::bigint as n_words from sec group by 1, 2, 3",
    "build_retention": f"with {_PUB}, n as (select source_id, rendition, build, max(synced_at) as synced_at from word_times where source_id is not null and rendition is not null and build is not null group by all), c as (select distinct source, rendition, current_build from pub) select n.source_id, n.rendition, n.build, c.source is not null as is_current, row_number() over w as place, row_number() over w <= {RETAIN} as kept from n left join c on n.source_id = c.source and n.rendition = c.rendition and n.build = c.current_build window w as (partition by n.source_id, n.rendition order by (c.source is not null)::int desc, n.synced_at desc nulls last, n.build)",
    "rendition_default": f"with {_PUB} select source, coalesce(max(rendition) filter (rendition = '{DEFAULT_RENDITION}'), min(rendition)) as rendition, count(distinct rendition) as renditions from pub where source is not null and rendition is not null group by 1",
    "rendition_builds": "with b as (select distinct source_id, build from character_profiles where source_id is not null and build is not null) select source_id, string_agg(build, ',' order by build) as builds, count(*) as n from b group by 1",
    "build_missing_sections": "with w as (select distinct source_id, sequence from sections where source_id is not null and sequence is not null), b as (select distinct source_id, rendition, build from word_times where source_id is not null and rendition is not null and build is not null), h as (select distinct source_id, rendition, build, sequence from word_times) select b.source_id, b.rendition, b.build, w.sequence from b join w using (source_id) where not exists (select 1 from h where h.source_id = b.source_id and h.rendition = b.rendition and h.build = b.build and h.sequence = w.sequence)",
    "section_dedupe_check": " union all ".join(f"select '{t}' as tab, count(*) as n, count(distinct {k}) as ids, count(*) - count(distinct {k}) as repeats from {t}" for t, k in (("sections", "section_id"), ("chunks", "chunk_id"), ("source_books", "book_id"), ("published_books", "catalog_id"), ("character_profiles", "character_id"), ("section_data", "data_id"))),
    "languages_narrated": f"with {_SRC} select book_id from src where {_LANG} in ('en', 'zh')",
    "duplicate_active": f"with {_PUB} select source, rendition, count(*) as n from pub where source is not null group by 1, 2 having count(*) > 1",
    "order_totals": "with l as (select l_orderkey, round(sum(l_quantity), 4) as duration, count(*) as sections, count(distinct l_linenumber) as sequences, max(l_linenumber) as last from lineitem group by 1) select l_orderkey, o_custkey, o_orderpriority, duration, sections, sequences = sections and last = sections as complete from orders join l on o_orderkey = l_orderkey",
    "order_retention": f"select o_custkey, o_orderpriority, o_orderkey, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey desc) as rank from orders qualify rank <= {RETAIN}",
    "queue_order": "select o_orderkey, o_orderstatus, o_orderpriority, o_orderdate from orders order by (o_orderstatus = 'O') desc, o_orderpriority, o_orderdate, o_orderkey limit 20",
}
