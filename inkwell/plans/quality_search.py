"""Search, identity and quality plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import identity as I
from inkwell.functions import search as S
from inkwell.operators import quality as Q
from inkwell.operators import search as X
from inkwell.session import table


def _books(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_books").filter("source_id is not null").groupBy("source_id").agg(F.max_by(F.struct("title", "author", "language"), F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("b")).select("source_id", "b.*")


def search_index(s, d):
    return X.token_index(_books(s, d))


def _search(query: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        books = _books(s, d)
        return X.search(books, X.written_index(X.token_index(books)), query)

    return run


def search_prefix_scan(s, d):
    """Indexed tokens that begin with "be", with their editions."""
    return X.written_index(search_index(s, d)).filter(F.startswith("token", F.lit("be")))


def search_swaps(s, d):
    """All single changes of neighbouring letters of the words of title slugs."""
    w = table(s, d, "source_books").filter("title_slug is not null").select(F.explode(F.split("title_slug", "-")).alias("word")).filter("length(word) between 3 and 12").distinct()
    return w.select("word", F.explode(S.swaps(F.col("word"))).alias("variant"))


def search_distances(s, d):
    """Edit distance of each catalog title's slug from its source's, where it is at most three; null beyond."""
    a = table(s, d, "source_books").filter("title_slug is not null").select("source_id", F.col("title_slug").alias("x")).distinct()
    b = table(s, d, "published_books").filter("title_slug is not null").select(F.col("source").alias("source_id"), F.col("title_slug").alias("y")).distinct()
    return a.join(b, "source_id").select("source_id", "x", "y", F.nullif(F.levenshtein("x", "y", 3), F.lit(-1)).alias("distance"))


def search_matches(s, d):
    """Editions the words "of the bells" are all found in, in any order."""
    return _books(s, d).filter(S.matches(F.lit("bells of the"), F.col("title"))).select("source_id", "title")


def identity_checks(s, d):
    """Keys, hashes and formats of published books."""
    p = table(s, d, "published_books").dropDuplicates(["catalog_id"])
    key = I.artifact_key(F.col("author_slug"), F.col("title_slug"), F.col("rendition"), F.col("current_build"))
    total = F.coalesce("total_duration_seconds", F.lit(0.0))
    return p.select("catalog_id", I.provider(F.col("source")).alias("provider"), key.alias("key"), I.fixture_key(F.col("author_slug"), F.col("title_slug")).alias("fixture"), I.duration_text(F.floor(total)).alias("length"), I.clock_text(F.floor(total)).alias("clock"), I.section_name(F.coalesce("section_count", F.lit(0))).alias("last"))


def identity_fingerprints(s, d):
    """Editions by the fingerprint of their provenance: equal JSON under any spelling of it."""
    b = table(s, d, "source_books").filter("provenance is not null")
    return b.groupBy(I.fingerprint(F.col("provenance")).alias("fingerprint")).agg(F.count("*").alias("n"))


def quality_word_errors(s, d):
    """Error rate of each chunk's text against the next one's."""
    w = Window.partitionBy("section_id").orderBy("chunk_index")
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("section_id is not null").select("chunk_id", F.col("text").alias("a"), F.lead("text").over(w).alias("b"))
    return Q.error_rates(c.filter("b is not null"), ["chunk_id"], "a", "b").withColumn("wer", F.round("wer", 6))


def quality_word_error_summary(s, d):
    e = quality_word_errors(s, d)
    return e.agg(F.count("*").alias("pairs"), F.round(F.avg("wer"), 6).alias("average"), F.max("wer").alias("most"), F.count_if(F.col("wer") > 0.3).alias("over"))


def quality_completeness(s, d):
    """Sections of each edition and which of text, words and pauses they have."""
    want = table(s, d, "sections").select("source_id", "sequence").dropna()
    have = table(s, d, "chunks").select("source_id", "sequence", F.lit("chunks").alias("kind")).unionByName(table(s, d, "word_times").select("source_id", "sequence", F.lit("words").alias("kind"))).unionByName(table(s, d, "seam_audits").select("source_id", "sequence", F.lit("pauses").alias("kind")))
    keys = ["source_id", "sequence"]
    return Q.verdicts(want, Q.missing_artifacts(want, have, keys, {"chunks": True, "words": True, "pauses": False}), keys)


def quality_skipped(s, d):
    """Tracks with skipped words (-1) and the share they make."""
    return table(s, d, "word_times").filter("track_id is not null").groupBy("track_id").agg(F.count_if((F.col("start_s") < 0) | (F.col("word_index") < 0)).alias("skipped"), F.count("*").alias("n")).filter("skipped > 0")


def quality_redelivered(s, d):
    """Fields in which the first and last sync of an edition differ."""
    b = table(s, d, "source_books")
    fields = ["title", "author", "language", "author_slug", "title_slug"]
    first = b.groupBy("book_id").agg(F.min_by(F.struct(*fields), F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("r")).select("book_id", "r.*")
    last = b.groupBy("book_id").agg(F.max_by(F.struct(*fields), F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("r")).select("book_id", "r.*")
    return Q.mismatches(first, last, ["book_id"], fields).select("book_id", F.array_join("fields", ",").alias("fields"))


def quality_duration_ratio(s, d):
    """Spoken length of each track against its words at 2.5 a second."""
    w = table(s, d, "word_times").filter("track_id is not null and word is not null and end_s >= 0").groupBy("track_id").agg(F.max("end_s").alias("long"), F.count_distinct("word_index").alias("words"))
    ratio = F.round(F.col("long") / (F.col("words") / 2.5), 6)
    return w.select("track_id", ratio.alias("ratio"), ((ratio > 0.5) & (ratio < 2)).alias("sane"))


QUERIES = {f.__name__: f for f in (search_index, search_prefix_scan, search_swaps, search_distances, search_matches, identity_checks, identity_fingerprints, quality_word_errors, quality_word_error_summary, quality_completeness, quality_skipped, quality_redelivered, quality_duration_ratio)}
QUERIES |= {"search_prefix": _search("ferrymen"), "search_typo": _search("lanetrns"), "search_author": _search("eudora"), "search_han": _search("演义")}

_B = "b as (select * from source_books where source_id is not null qualify row_number() over (partition by source_id order by updated_at desc nulls last, coalesce(title,'') desc) = 1)"
ORACLES = {
    "identity_fingerprints": "with j as (select try_cast(provenance as json) as j from source_books where provenance is not null) select case when len(json_keys(j)) = 0 then sha256('{}') else sha256('{\"origin\":' || (j -> '$.origin')::varchar || ',\"rev\":' || (j ->> '$.rev') || '}') end as fingerprint, count(*) as n from j group by 1",
    "search_swaps": "with w as (select distinct word from (select unnest(string_split(title_slug, '-')) as word from source_books where title_slug is not null) where length(word) between 3 and 12), v as (select word, unnest(range(1, length(word)::bigint)) as i from w) select distinct word, left(word, i - 1) || substring(word, i + 1, 1) || substring(word, i, 1) || substring(word, i + 2) as variant from v",
    "search_distances": "with a as (select distinct source_id, title_slug as x from source_books where title_slug is not null), b as (select distinct source as source_id, title_slug as y from published_books where title_slug is not null) select source_id, x, y, case when levenshtein(x, y) <= 3 then levenshtein(x, y)::int end as distance from a join b using (source_id)",
    "identity_checks": "with p as (select * from published_books qualify row_number() over (partition by catalog_id order by catalog_id) = 1), s as (select *, floor(coalesce(total_duration_seconds, 0))::bigint as t from p) select catalog_id, split_part(source, ':', 1) as provider, concat_ws('/', 'books', author_slug, title_slug, 'renditions', rendition, 'builds', current_build) as key, substring(sha256(author_slug || title_slug), 1, 16) as fixture, case when t >= 3600 then (t // 3600) || 'h ' || ((t % 3600) // 60) || 'm' else (t // 60) || 'm' end as length, (t // 60) || ':' || lpad((t % 60)::varchar, 2, '0') as clock, 'section-' || lpad(coalesce(section_count, 0)::varchar, greatest(2, length(coalesce(section_count, 0)::varchar))::int, '0') as last from s",
    "quality_completeness": "with w as (select distinct source_id, sequence from sections where source_id is not null and sequence is not null), k as (select 'chunks' as kind, 'error' as level union all select 'words', 'error' union all select 'pauses', 'warning'), h as (select distinct source_id, sequence, 'chunks' as kind from chunks union all select distinct source_id, sequence, 'words' from word_times union all select distinct source_id, sequence, 'pauses' from seam_audits), m as (select w.*, k.kind, k.level from w cross join k where not exists (select 1 from h where h.source_id = w.source_id and h.sequence = w.sequence and h.kind = k.kind)), c as (select source_id, sequence, count(*) filter (level = 'error') as errors, count(*) filter (level = 'warning') as warnings from m group by all) select w.source_id, w.sequence, coalesce(errors, 0) as errors, coalesce(warnings, 0) as warnings, case when errors > 0 then 'fail' when warnings > 0 then 'warn' else 'ok' end as status from w left join c using (source_id, sequence)",
    "quality_skipped": "select track_id, count(*) filter (start_s < 0 or word_index < 0) as skipped, count(*) as n from word_times where track_id is not null group by 1 having skipped > 0",
    "quality_redelivered": "with f as (select * from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at, coalesce(title,'')) = 1), l as (select * from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at desc, coalesce(title,'') desc) = 1) select f.book_id, array_to_string(list_filter([case when f.title is distinct from l.title then 'title' end, case when f.author is distinct from l.author then 'author' end, case when f.language is distinct from l.language then 'language' end, case when f.author_slug is distinct from l.author_slug then 'author_slug' end, case when f.title_slug is distinct from l.title_slug then 'title_slug' end], lambda x: x is not null), ',') as fields from f join l using (book_id) where f.title is distinct from l.title or f.author is distinct from l.author or f.language is distinct from l.language or f.author_slug is distinct from l.author_slug or f.title_slug is distinct from l.title_slug",
    "quality_duration_ratio": "with w as (select track_id, max(end_s) as long, count(distinct word_index) as words from word_times where track_id is not null and word is not null and end_s >= 0 group by 1) select track_id, round(long / (words / 2.5), 6) as ratio, round(long / (words / 2.5), 6) > 0.5 and round(long / (words / 2.5), 6) < 2 as sane from w",
}
