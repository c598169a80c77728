"""Plans of formats, certification, calls, receipts and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import identity as I
from inkwell.functions import text as T
from inkwell.operators import certify as V
from inkwell.operators import quality as Q
from inkwell.operators import registry as R
from inkwell.operators import timeline as L
from inkwell.operators import upserts as U
from inkwell.plans import dialogues
from inkwell.plans.artifacts import _CK, _SEC, _WC, _reader
from inkwell.plans.timelines import _W, _words
from inkwell.session import table

NOW = "2026-06-01 00:00:00"
SECRETS = ["ledger", "the ledger", "lantern"]
LOG_PATTERNS = {"missing": "(?i)\\bnot found\\b", "denied": "(?i)\\bdenied\\b", "failed": "(?i)\\berror\\b"}


def _published(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "published_books").filter("catalog_id is not null").select("catalog_id", "source", "rendition", "current_build", "title", "total_duration_seconds", "section_count", "updated_at").distinct()


def section_titles(s, d):
    x = table(s, d, "sections").dropDuplicates(["section_id"]).filter("section_type is not null")
    return x.select("section_id", I.section_title(F.col("heading.display_label"), F.col("heading.display_title"), F.col("section_type")).alias("shown"))


def title_hues(s, d):
    """Colour angles of the plain slugs."""
    return table(s, d, "source_books").filter("title_slug is not null").select("title_slug").distinct().select("title_slug", I.hue(F.col("title_slug")).alias("hue"))


def sync_ages(s, d):
    """How long ago books were synced, seen from a fixed time; and their durations as shown."""
    return table(s, d, "source_books").filter("book_id is not null").select("book_id", "updated_at").distinct().select("book_id", "updated_at", I.age_text(F.col("updated_at"), F.lit(NOW).cast("timestamp_ntz")).alias("age"))


def duration_texts(s, d):
    p = _published(s, d).filter("total_duration_seconds is not null")
    return p.select("catalog_id", "updated_at", I.duration_text(F.floor("total_duration_seconds")).alias("duration"), I.clock_text(F.floor("total_duration_seconds")).alias("clock")).distinct()


def error_codes(s, d):
    """Event kinds as error codes: some known, the others one."""
    return table(s, d, "events").groupBy(I.error_text(F.when(F.col("event_type") != "view", F.col("event_type")), ["error", "click"], "OTHER").alias("code")).agg(F.count("*").alias("n"))


def byte_ranges(s, d):
    """Ranges of each document's bytes: from a place on, up to one, the last ones, and none that can be met."""
    t = table(s, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("bigint").alias("size"))
    at = (F.col("doc_id") % 700).cast("string")
    header = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("bytes="), at, F.lit("-"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("bytes=-"), at)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("bytes="), at, F.lit("-"), (F.col("doc_id") % 700 + 99).cast("string"))).otherwise("bytes=a-b")
    r = I.byte_range(header, F.col("size"))
    return t.select("doc_id", r["offset"].alias("offset"), r["length"].alias("length"))


def redacted_texts(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.sha2(I.redact(F.col("text"), SECRETS), 256).alias("hash"))


def manifest_keys(s, d):
    """Slugs read back from manifest paths made of the catalog's."""
    p = table(s, d, "published_books").filter("author_slug is not null and title_slug is not null").select("author_slug", "title_slug").distinct()
    k = I.parse_manifest_key(F.concat_ws("/", F.lit("books"), "author_slug", "title_slug", F.lit("manifest.json")))
    return p.select("author_slug", "title_slug", k["author_slug"].alias("author"), k["title_slug"].alias("title"))


def voice_names(s, d):
    return table(s, d, "word_times").filter("rendition is not null").select("rendition").distinct().select("rendition", T.voice_display(F.translate("rendition", "-", "_")).alias("shown"))


def quality_calls(s, d):
    """Documents as prompts: the kind their wording tells."""
    marks = [m for ms in V.CALL_KINDS.values() for m in ms] + ["nothing of the kind"]
    mark = F.get(F.array(*map(F.lit, marks)), (F.col("doc_id") % len(marks)).cast("int"))
    return table(s, d, "documents").groupBy(V.call_kind(F.concat_ws(" ", "text", mark)).alias("kind")).agg(F.count("*").alias("n"))


def _latency(s: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "attribution").when(F.col("event_type") == "click", "emotion").otherwise(F.col("event_type"))
    return V.latency(table(s, d, "events").filter("value is not null").select(kind.alias("kind"), F.col("value").alias("seconds")))


def quality_latency(s, d):
    return _latency(s, d)


def quality_projection(s, d):
    """What directing 40 chapters of 900 chunks would take at the measured means."""
    return V.projection(_latency(s, d), F.lit(40), F.lit(900))


def quality_rtf(s, d):
    """Tenths of a second a word against the audio of each track, and of all."""
    w = _words(s, d).filter("start_s >= 0 and end_s > start_s")
    t = w.groupBy("track_id").agg((F.count("*") / 10).alias("elapsed"), F.max("end_s").alias("audio"))
    each = t.select("track_id", V.real_time_factor(F.col("elapsed"), F.col("audio")).alias("rtf"))
    return each.unionByName(t.agg(F.round(F.sum("elapsed"), 6).alias("e"), F.round(F.sum("audio"), 6).alias("a")).select(F.lit(None).cast("bigint").alias("track_id"), V.real_time_factor(F.col("e"), F.col("a")).alias("rtf")))


def quality_alignment(s, d):
    """Tracks whose words hold together, with their coverage of the words there are."""
    w = _words(s, d)
    length = w.groupBy("track_id").agg(F.max(F.when(F.col("end_s") < 1e6, F.col("end_s"))).alias("duration"), F.count("*").alias("units"))
    said = w.filter("word is not null").join(length.select("track_id", "duration"), "track_id")
    return V.alignment_report(said, length.select("track_id", "units"), ["track_id"]).select("track_id", "words", "broken", "coverage", "ok")


def quality_certified(s, d):
    """Sections of the words by whether they are finished, or why not."""
    w = table(s, d, "word_times").filter("word is not null and chunk_index is not null and word_index >= 0 and source_id is not null and sequence is not null")
    c = w.groupBy("source_id", "sequence", "chunk_index").agg(F.coalesce(F.min(F.when(F.col("start_s") >= 0, F.col("start_s"))), F.lit(-1.0)).alias("first"), F.max("end_s").alias("last"), F.countDistinct("word_index").alias("aligned"))
    both = _reader(s, d).join(c, ["source_id", "sequence", "chunk_index"], "left")
    g = both.groupBy("source_id", "sequence").agg(F.count("*").alias("expected"), F.count("aligned").alias("chunks"), F.min(F.coalesce("first", F.lit(-1.0))).alias("least"), F.sum("reader").alias("reader"), F.coalesce(F.sum("aligned"), F.lit(0)).alias("aligned"), F.max("last").alias("last"))
    fault = V.section_fault(F.col("chunks"), F.col("expected"), F.col("least"), F.col("reader"), F.col("reader"), L.coverage_ratio(F.col("aligned"), F.col("reader")), F.col("last"), F.lit(900.0))
    return g.select("source_id", "sequence", fault.alias("fault"))


def quality_checkpoints(s, d):
    """Kept regions of each track by whether they can be taken up again."""
    w = _words(s, d)
    sound = F.coalesce((F.col("start_s") >= 0) & (F.col("end_s") >= F.col("start_s")), F.lit(False))
    g = w.groupBy("track_id", "region").agg(F.bool_and(sound).alias("sound"), F.max("end_s").alias("last"))
    n = F.col("track_id") % 9
    fault = V.checkpoint_fault(F.when(n == 1, 2).otherwise(1), F.when(n == 2, "old").otherwise("new"), F.lit("new"), F.when(n == 3, 44100).otherwise(24000), F.floor(F.coalesce("last", F.lit(0.0)) * 24000), F.col("sound"), 24000)
    return g.select("track_id", "region", fault.alias("fault"))


def quality_writes(s, d):
    """Each catalog row's last state written over its first: created, the same, replaced by force, or in conflict."""
    p = _published(s, d)
    pick = lambda f: p.groupBy("catalog_id").agg(f(F.struct("current_build", "section_count"), F.struct("updated_at", "title", "current_build")).alias("r")).select("catalog_id", "r.*")
    return V.write_verdicts(pick(F.min_by).filter("catalog_id % 5 <> 0"), pick(F.max_by), ["catalog_id"], ["current_build", "section_count"], F.col("catalog_id") % 2 == 0)


def publication_verified(s, d):
    """Published editions against their sources and the sections delivered for their build."""
    words = table(s, d, "word_times").filter("source_id is not null and build is not null").groupBy("source_id", "build").agg(F.countDistinct("sequence").alias("sections"))
    p = _published(s, d).groupBy("catalog_id").agg(F.max_by(F.struct("source", "current_build", "section_count"), F.struct("updated_at", "title", "current_build")).alias("r")).select("catalog_id", "r.*")
    return V.published_verified(p, table(s, d, "source_books").filter("source_id is not null"), words)


def spoken_floor(s, d):
    """Units of all sections of each book, body and headings, and whether there is anything to speak."""
    x = table(s, d, "sections").dropDuplicates(["section_id"]).filter("source_id is not null")
    n = lambda c: T.word_count(F.coalesce(c, F.lit("")))
    return x.groupBy("source_id").agg(F.sum(n(F.col("text")) + n(F.col("heading.spoken_text"))).alias("units")).withColumn("spoken", F.col("units") >= 1)


def log_issues(s, d):
    """Lines of the documents that read as failures, by kind, with how much context each has."""
    t = table(s, d, "documents").filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\\n")).alias("n", "line"))
    return Q.log_issues(t, ["doc_id"], "n", "line", LOG_PATTERNS).groupBy("issue").agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("chars"))


def log_tails(s, d):
    """The last three lines of each document."""
    lines = F.split("text", "\\n")
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3), "\n").alias("tail"))


def receipts_reusable(s, d):
    """Sections as receipts over their chunks' hashes: those all of whose chunks are there unchanged."""
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("section_id is not null and text is not null")
    files = c.select(F.col("section_id").alias("receipt"), F.col("chunk_id").alias("file"), F.sha2("text", 256).alias("sha"))
    kept = files.withColumns({"version": F.lit(2), "fingerprint": F.when(F.col("receipt") % 5 == 0, "old").otherwise("new"), "sha": F.when(F.col("file") % 17 == 0, "other").otherwise(F.col("sha"))})
    return U.reusable_receipts(kept, files, "new")


def rows_reconciled(s, d):
    """Catalog rows without those whose objects are gone and that haven't changed since."""
    p = _published(s, d).groupBy("catalog_id").agg(F.max("current_build").alias("current_build"))
    seen = p.select("catalog_id", F.when(F.col("catalog_id") % 3 == 0, "changed").otherwise(F.col("current_build")).alias("current_build"), (F.col("catalog_id") % 2 == 0).alias("valid"))
    return U.reconciled(p, seen, ["catalog_id"], "current_build").select("catalog_id")


def states_merged(s, d):
    """Two copies of each book's state: the later one, of equal times the second only for the same edition."""
    b = table(s, d, "source_books").filter("book_id is not null")
    pick = lambda f: b.groupBy("book_id").agg(f(F.struct("source_id", "title", "updated_at"), F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("r")).select("book_id", "r.*")
    return U.later(pick(F.min_by), pick(F.max_by), ["book_id"], "source_id", "updated_at")


def token_words(s, d):
    """Each track's words cut into two tokens apiece and put together again."""
    w = _words(s, d).filter("word is not null and start_s >= 0 and end_s > start_s")
    half = F.ceil(F.length("word") / 2).cast("int")
    parts = F.array(F.struct((F.col("word_index") * 2).alias("i"), F.substring(F.col("word"), F.lit(1), half).alias("token")), F.struct((F.col("word_index") * 2 + 1).alias("i"), F.concat(F.substring(F.col("word"), half + 1, F.length("word")), F.lit(" ")).alias("token")))
    tokens = w.select("track_id", "start_s", "end_s", F.inline(parts))
    return L.merged_tokens(tokens, ["track_id"], "i").groupBy("track_id").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("chars"))


def registry_cleaned(s, d):
    """Profiles cleaned: trimmed, aliases listed once, nameless ones and the narrator out."""
    p = table(s, d, "character_profiles").dropDuplicates(["character_id"])
    c = R.cleaned(p.withColumn("canonical", F.when(F.col("character_id") % 13 == 0, " Narrator ").otherwise(F.col("canonical"))))
    return c.select("character_id", "canonical", F.size("aliases").alias("aliases"), "gender")


def registry_added(s, d):
    """Odd profiles of each book added to the even ones: those with evidence and a new name."""
    p = dialogues._profiles(s, d).select("source_id", "character_id", "canonical", "aliases", "first_evidence_quote")
    return R.merged(p.filter("character_id % 2 = 0"), p.filter("character_id % 2 = 1"), "source_id").groupBy("source_id").agg(F.count("*").alias("n"))


def texts_observed(s, d):
    """Capitalised forms each chunk names, in order of appearance."""
    return dialogues._chunks(s, d).select("chunk_id", F.array_join(R.observed_names(F.col("text")), "|").alias("names"))


QUERIES = {
    f.__name__: f
    for f in (section_titles, title_hues, sync_ages, duration_texts, error_codes, byte_ranges, redacted_texts, manifest_keys, voice_names, quality_calls, quality_latency, quality_projection, quality_rtf, quality_alignment, quality_certified, quality_checkpoints, quality_writes,
              publication_verified, spoken_floor, log_issues, log_tails, receipts_reusable, rows_reconciled, states_merged, token_words, registry_cleaned, registry_added, texts_observed)
}

_PB = "pb as (select distinct catalog_id, source, rendition, current_build, title, total_duration_seconds, section_count, updated_at from published_books where catalog_id is not null)"
_PICK = lambda which: f"(select * from pb qualify row_number() over (partition by catalog_id order by updated_at {which} nulls {'first' if which == 'asc' else 'last'}, title {which} nulls {'first' if which == 'asc' else 'last'}, current_build {which} nulls {'first' if which == 'asc' else 'last'}) = 1)"
_HUE = "list_reduce(list_prepend(0::hugeint, list_transform(string_split(title_slug, ''), lambda c: unicode(c)::hugeint)), lambda h, c: c + (((((h % 4294967296) + 4294967296) % 4294967296) * 32 + 2147483648) % 4294967296 - 2147483648) - h)"
_KIND = "case " + " ".join(f"when {' or '.join(f'contains(t, {chr(39)}{m}{chr(39)})' for m in ms)} then '{k}'" for k, ms in V.CALL_KINDS.items()) + " else 'other' end"
_MARKS = [m for ms in V.CALL_KINDS.values() for m in ms] + ["nothing of the kind"]
_LAT = "lt as (select case event_type when 'view' then 'attribution' when 'click' then 'emotion' else event_type end as kind, count(*) as calls, round(avg(value), 6) as mean_s, min(value) as least_s, max(value) as most_s from events where value is not null group by 1)"
_NORM = "trim(regexp_replace(lower(canonical), '\\s+', ' ', 'g'))"
_NAMES = r"nk2 as (select source_id, character_id, trim(regexp_replace(lower(n), '\s+', ' ', 'g')) as k from (select source_id, character_id, unnest(list_concat([canonical], coalesce(aliases, []))) as n from pr) where n is not null), fn as (select source_id, character_id, k as key from nk2 where k <> '' union all select source_id, character_id, regexp_replace(k, '^(?:the|an|a) ', '') from nk2 where k <> '')"
_FORMS = R.NAME_FORM.replace("'", "''")
ORACLES = {
    "section_titles": f"with {_SEC} select section_id, case when coalesce(heading.display_label, '') <> '' and coalesce(heading.display_title, '') <> '' then heading.display_label || ' — ' || heading.display_title when coalesce(heading.display_label, '') <> '' then heading.display_label when coalesce(heading.display_title, '') <> '' then heading.display_title else upper(section_type[1]) || section_type[2:] end as shown from sec where section_type is not null",
    "title_hues": f"with t as (select distinct title_slug from source_books where title_slug is not null) select title_slug, ((({_HUE}) % 360 + 360) % 360)::int as hue from t",
    "sync_ages": f"with t as (select distinct book_id, updated_at, greatest(0, epoch(timestamp '{NOW}')::bigint - floor(epoch(updated_at))::bigint) as s from source_books where book_id is not null) select book_id, updated_at, case when updated_at is null then '—' when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' when s < 86400 then (s // 3600) || 'h' else (s // 86400) || 'd' end as age from t",
    "duration_texts": f"with {_PB}, f as (select catalog_id, updated_at, floor(total_duration_seconds)::bigint as s from pb where total_duration_seconds is not null) select distinct catalog_id, updated_at, case when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' else (s // 60) || 'm' end as duration, (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') as clock from f",
    "error_codes": "select case when event_type = 'view' then null when event_type in ('error', 'click') then event_type else 'OTHER' end as code, count(*) as n from events group by 1",
    "byte_ranges": "with t as (select doc_id, coalesce(n_chars, 0) as z, doc_id % 700 as a, doc_id % 4 as k from documents) select doc_id, case when k = 0 and a < z then a when k = 1 and a > 0 and z > 0 then greatest(z - a, 0) when k = 2 and a < z then a end as offset, case when k = 0 and a < z then z - a when k = 1 and a > 0 and z > 0 then least(a, z) when k = 2 and a < z then least(a + 99, z - 1) - a + 1 end as length from t",
    "redacted_texts": "select doc_id, sha256(replace(replace(replace(text, 'the ledger', '[redacted]'), 'lantern', '[redacted]'), 'ledger', '[redacted]')) as hash from documents where text is not null",
    "manifest_keys": "with p as (select distinct author_slug, title_slug from published_books where author_slug is not null and title_slug is not null), k as (select *, regexp_full_match(author_slug, '[a-z0-9-]+') and regexp_full_match(title_slug, '[a-z0-9-]+') as ok from p) select author_slug, title_slug, case when ok then author_slug end as author, case when ok then title_slug end as title from k",
    "voice_names": "with r as (select distinct rendition, replace(rendition, '-', '_') as v from word_times where rendition is not null), n as (select rendition, replace(case when contains(v, '_') then regexp_extract(v, '^[^_]*_(.*)$', 1) else v end, '_', ' ') as n from r) select rendition, array_to_string(list_transform(string_split(n, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as shown from n",
    "quality_calls": f"with t as (select concat_ws(' ', text, (list_value({', '.join(chr(39) + m + chr(39) for m in _MARKS)}))[doc_id % {len(_MARKS)} + 1]) as t from documents) select {_KIND} as kind, count(*) as n from t group by 1",
    "quality_latency": f"with {_LAT} select * from lt",
    "quality_projection": f"with {_LAT} select round(40 * coalesce(max(mean_s) filter (kind = 'attribution'), 0) + 900 * coalesce(max(mean_s) filter (kind = 'emotion'), 0), 4) as projected_s from lt",
    "quality_rtf": f"with {_W}, t as (select track_id, count(*) / 10 as e, max(end_s) as a from ww where start_s >= 0 and end_s > start_s group by 1) select track_id, case when a > 0 then round_even(e / a, 4) end as rtf from t union all select null, case when sum(a) > 0 then round_even(round(sum(e), 6) / round(sum(a), 6), 4) end from t",
    "quality_alignment": f"with {_W}, l as (select track_id, max(end_s) filter (end_s < 1e6) as duration, count(*) as units from ww group by 1), f as (select ww.track_id, count(*) as words, count(*) filter (not coalesce(start_s >= 0 and end_s >= start_s and end_s <= duration, false)) as broken from ww join l using (track_id) where word is not null group by 1) select l.track_id, coalesce(words, 0) as words, coalesce(broken, 0) as broken, round_even(coalesce(words, 0) / greatest(units, 1), 4) as coverage, coalesce(words, 0) > 0 and coalesce(broken, 0) = 0 as ok from l left join f using (track_id)",
    "quality_certified": f"with {_CK}, rd as (select source_id, sequence, chunk_index, sum({_WC(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')})::bigint as reader from ck where source_id is not null and sequence is not null and chunk_index is not null group by all), c as (select source_id, sequence, chunk_index, coalesce(min(start_s) filter (start_s >= 0), -1.0) as first, max(end_s) as last, count(distinct word_index) as aligned from word_times where word is not null and chunk_index is not null and word_index >= 0 and source_id is not null and sequence is not null group by all), g as (select source_id, sequence, count(*) as expected, count(aligned) as chunks, min(coalesce(first, -1.0)) as least, sum(reader) as reader, coalesce(sum(aligned), 0) as aligned, max(last) as last from rd left join c using (source_id, sequence, chunk_index) group by all) select source_id, sequence, case when chunks <> expected then 'chunks' when least < 0 then 'skipped' when (case when reader = 0 then case when aligned = 0 then 1.0 else 0.0 end else round_even(aligned / reader, 4) end) < 0.98 then 'coverage' when not coalesce(last <= 900.1, false) then 'times' end as fault from g",
    "quality_checkpoints": f"with {_W}, g as (select track_id, region, max(end_s) as last, bool_or(not coalesce(start_s >= 0 and end_s >= start_s, false)) as bad from ww group by all) select track_id, region, case when track_id % 9 = 1 then 'version' when track_id % 9 = 2 then 'fingerprint' when track_id % 9 = 3 then 'rate' when floor(coalesce(last, 0) * 24000) <= 0 then 'frames' when bad then 'words' end as fault from g",
    "quality_writes": f"with {_PB}, a as {_PICK('asc')}, b as {_PICK('desc')} select b.catalog_id, case when a.catalog_id is null or a.catalog_id % 5 = 0 then 'create' when a.current_build is not distinct from b.current_build and a.section_count is not distinct from b.section_count then 'same' when b.catalog_id % 2 = 0 then 'replace' else 'conflict' end as verdict from b left join a using (catalog_id)",
    "publication_verified": f"with {_PB}, p as {_PICK('desc')}, h as (select source_id, build, count(distinct sequence) as sections from word_times where source_id is not null and build is not null group by all) select p.catalog_id, exists (select 1 from source_books b where b.source_id = p.source) as known, h.sections is not null as delivered, coalesce(h.sections >= p.section_count, false) as complete from p left join h on h.source_id = p.source and h.build = p.current_build",
    "spoken_floor": f"with {_SEC}, u as (select source_id, sum({_WC(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} + {_WC(chr(99) + 'oalesce(heading.spoken_text, ' + chr(39) * 2 + ')')})::bigint as units from sec where source_id is not null group by 1) select source_id, units, units >= 1 as spoken from u",
    "log_issues": "with t as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as n from documents where text is not null), i as (select *, case when regexp_matches(line, '(?i)\\bnot found\\b') then 'missing' when regexp_matches(line, '(?i)\\bdenied\\b') then 'denied' when regexp_matches(line, '(?i)\\berror\\b') then 'failed' end as issue, sum(length(line)) over w + count(*) over w - 1 as chars from t window w as (partition by doc_id order by n rows between 4 preceding and 4 following)) select issue, count(*) as n, sum(chars)::bigint as chars from i where issue is not null group by 1",
    "log_tails": "select doc_id, array_to_string(string_split(text, chr(10))[greatest(len(string_split(text, chr(10))) - 2, 1):], chr(10)) as tail from documents where text is not null",
    "receipts_reusable": f"with {_CK}, c as (select section_id, chunk_id from ck where section_id is not null and text is not null) select section_id as receipt from c where section_id % 5 <> 0 group by 1 having count(*) filter (chunk_id % 17 = 0) = 0",
    "rows_reconciled": f"with {_PB}, p as (select catalog_id, max(current_build) as b from pb group by 1) select catalog_id from p where not (catalog_id % 2 <> 0 and (catalog_id % 3 <> 0 or b is not distinct from 'changed'))",
    "states_merged": "with l as (select * from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at desc nulls last, coalesce(title, '') desc) = 1) select book_id, source_id, title, updated_at from l",
    "token_words": f"with {_W}, w as (select track_id, trim(word) as word from ww where word is not null and start_s >= 0 and end_s > start_s) select track_id, count(*) as words, sum(length(word))::bigint as chars from w where word <> '' group by 1",
    "registry_cleaned": "with p as (select * from character_profiles qualify row_number() over (partition by character_id order by character_id) = 1) select character_id, trim(canonical) as canonical, len(list_distinct(list_filter(list_transform(coalesce(aliases, []), lambda a: trim(a)), lambda a: a is not null and a <> '')))::int as aliases, coalesce(nullif(trim(coalesce(gender, '')), ''), 'unknown') as gender from p where character_id % 13 <> 0 and trim(coalesce(canonical, '')) <> ''",
    "registry_added": f"with {dialogues._PR}, {_NAMES}, k as (select distinct source_id, key from fn where character_id % 2 = 0), n as (select distinct source_id, {_NORM} as key from pr where character_id % 2 = 1 and length(trim(coalesce(first_evidence_quote, ''))) > 0) select source_id, sum(n)::bigint as n from (select source_id, count(*) as n from pr where character_id % 2 = 0 group by 1 union all select source_id, count(*) from n where not exists (select 1 from k where k.source_id = n.source_id and k.key = n.key) group by 1) group by 1",
    "texts_observed": f"with {dialogues._CH}, f as (select chunk_id, list_transform(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*(?:[\\x{{c0}}-\\x{{963}}\\x{{966}}-\\x{{1fff}}\\x{{3040}}-\\x{{9fff}}\\x{{ac00}}-\\x{{d7a3}}][A-Za-z0-9_]*)+', '·', 'g'), '{_FORMS}'), lambda x: regexp_replace(x, '\\s+', ' ', 'g')) as l from ch) select chunk_id, array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(l, lambda x: [x])), lambda a, x: case when list_contains(list_transform(a, lambda y: lower(y)), lower(x[1])) then a else list_concat(a, x) end), '|') as names from f",
}
