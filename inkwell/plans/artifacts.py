"""Plans of nested artifacts and of timelines built and repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import audio as A
from inkwell.functions import headings as H
from inkwell.functions import text as T
from inkwell.operators import artifacts as X
from inkwell.plans.texts import _SPELL, _STOP
from inkwell.plans.timelines import _ED, _POL, _S, _W, _edits, _seams, _words
from inkwell.session import table

LEAD = 12_000
GAP_MS = 600


def _sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sections").dropDuplicates(["section_id"])


def heading_built(s, d):
    """Headings made anew from each section's own lines."""
    x = _sections(s, d).filter("section_type is not null")
    texts = F.filter(F.array(T.clean_extracted(F.coalesce("heading.display_label", F.lit(""))), T.clean_extracted(F.coalesce("heading.display_title", F.lit("")))), lambda t: t != "")
    h = X.build_heading(F.col("section_type"), F.when(F.col("ordinal") > 0, F.col("ordinal")), texts, F.lit(""), F.coalesce("epub_item_name", F.lit("")), F.when(F.col("section_id") % 2 == 0, "en").otherwise("de"))
    return x.select("section_id", h["display_label"].alias("label"), h["display_title"].alias("title"), h["spoken_text"].alias("spoken"))


def section_elements(s, d):
    return X.elements(_sections(s, d), "section_id", "sequence", "paragraphs")


def artifact_parse(s, d):
    """Sections as nested artifacts: what stands in each."""
    x = _sections(s, d)
    a = X.parse_artifact(x, X.elements(x, "section_id", "sequence", "paragraphs"), "section_id")
    return a.select("section_id", F.col("artifact.version").alias("version"), F.col("artifact.sequence").alias("sequence"), F.size("artifact.elements").alias("elements"), F.sha2(F.array_join(F.transform("artifact.elements", lambda e: F.concat_ws("|", e["id"], e["text"])), "\n"), 256).alias("hash"))


def artifact_chunks(s, d):
    """Chunks of each section as one artifact: their number, hashes and first to last paragraph."""
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("text is not null and section_id is not null")
    a = X.chunk_artifact(_sections(s, d), c, "section_id")
    k = F.col("artifact.chunks")
    return a.select("section_id", F.col("artifact.sequence").alias("sequence"), F.size(k).alias("chunks"), F.sha2(F.array_join(k["text_hash"], ","), 256).alias("hash"), F.element_at(k, 1)["para_start"].alias("para_start"), F.element_at(k, -1)["para_end"].alias("para_end"))


def _reader(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("source_id is not null and sequence is not null and chunk_index is not null")
    return c.groupBy("source_id", "sequence", "chunk_index").agg(F.sum(T.word_count(F.coalesce("text", F.lit(""))).cast("bigint")).alias("reader"))


def artifact_sync(s, d):
    """Alignment artifacts of sections: chunk starts, coverage and heading words."""
    w = table(s, d, "word_times").filter("word is not null and source_id is not null and sequence is not null and word_index >= 0").groupBy("source_id", "sequence", "region", "chunk_index", "word_index").agg(F.min("word").alias("word"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    a = X.sync_artifact(w, _reader(s, d), ["source_id", "sequence"])
    starts = F.array_join(F.transform("chunks", lambda c: F.when(c["audio_start"] < 0, "-1").otherwise(F.bround(c["audio_start"] * 10_000).cast("bigint").cast("string"))), ",")
    return a.select("source_id", "sequence", starts.alias("starts"), F.coalesce(F.size("heading_words"), F.lit(0)).alias("heading_words"), "reader", "aligned", "ratio", "first_missing")


def _durations(s: SparkSession, d: str) -> DataFrame:
    """Frames each chunk of a track sounds, from its first start to its last end; null where that is nothing."""
    w = _words(s, d).filter("chunk_index is not null")
    span = F.bround(F.max("end_s") * A.FRAME_RATE).cast("bigint") - F.bround(F.min(F.when(F.col("start_s") >= 0, F.col("start_s"))) * A.FRAME_RATE).cast("bigint")
    return w.groupBy("track_id", "chunk_index").agg(span.alias("n")).select("track_id", "chunk_index", F.when(F.col("n") > 0, F.col("n")).alias("frames"))


def timeline_built(s, d):
    """Sections laid out anew: a lead-in, chunks and the gaps between them; failed chunks at -1."""
    return X.section_timeline(_durations(s, d), ["track_id"], LEAD, F.lit(A.FRAME_RATE * GAP_MS // 1000))


def timeline_units(s, d):
    """The frame cursor over the chunks of each track as units, with the seams their ends call for."""
    u = _durations(s, d).filter("frames is not null")
    kinds = F.array(*map(F.lit, ("sentence", "phrase", "word", "paragraph")))
    u = u.withColumn("break_type", F.get(kinds, (F.col("chunk_index") % 4).cast("int")))
    return X.unit_ledger(u, ["track_id"], ["chunk_index"]).select("track_id", "chunk_index", "start_frame", "end_frame", "pause_end_frame")


def render_breaks(s, d):
    """Units of each chunk and the breaks between them, counted."""
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("text is not null")
    return X.render_units(c, "chunk_id", "text").groupBy("chunk_id").agg(F.count("*").alias("units"), *(F.count_if(F.col("break_type") == k).alias(k) for k in ("sentence", "phrase", "quote", "paragraph")))


def seam_shifted_times(s, d):
    """Word bounds in seconds after the pauses were put right."""
    w = _words(s, d).filter("start_s >= 0 and end_s >= 0")
    return X.shifted_times(w, _edits(s, d), ["track_id"])


def seam_shifted_seams(s, d):
    """Seams after the edits: where they begin, how long they are."""
    x = _seams(s, d).filter("track_id is not null and pause_start_frame >= 0").select("track_id", "kind", "break_type", "pause_start_frame").distinct()
    return X.shifted_seams(x, _edits(s, d), ["track_id"]).select("track_id", "kind", "break_type", "pause_start_frame", F.col("new_frame").alias("new_start"), "new_end", "new_ms")


def seam_flattened(s, d):
    """Seams nested by chunk and flattened again, with the chunk they follow."""
    x = _seams(s, d).filter("track_id is not null and pause_start_frame is not null")
    nested = x.groupBy("track_id", "after_chunk_index").agg(F.collect_list(F.struct("kind", "break_type", "pause_start_frame", "pause_end_frame")).alias("seams"))
    return nested.select("track_id", F.coalesce("after_chunk_index", F.lit(-1)).alias("chunk"), F.inline("seams"))


def coverage_lines(s, d):
    """Coverage reports, a line a section."""
    a = artifact_sync(s, d)
    return a.select("source_id", X.coverage_line(F.col("sequence"), F.col("aligned"), F.col("reader"), F.col("ratio")).alias("line"))


def audio_scalars(s, d):
    """Sample arrays made of each chunk's word lengths: peak, normalised sum, faded sum, kept length, level."""
    w = _words(s, d).filter("chunk_index is not null and start_s >= 0 and end_s > start_s")
    ordered = F.array_sort(F.collect_list(F.struct("word_index", F.bround(F.col("end_s") - F.col("start_s"), 4).alias("x"))))
    a = w.groupBy("track_id", "chunk_index").agg(ordered.alias("l")).select("track_id", "chunk_index", F.transform("l", lambda x: x["x"]).alias("audio"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, x: t + x), 6)
    audio = F.col("audio")
    return a.select("track_id", "chunk_index", A.peak(audio).alias("peak"), total(A.normalize(audio)).alias("normal"), total(A.fade(audio, 1000, 3)).alias("faded"), F.round(A.rms(audio, F.lit(0), 4), 6).alias("level"), F.size(A.limit_silence(audio, 1000, 2, 0.2, 0.5)).alias("kept"), A.silence_length(audio, F.lit(0), F.size(audio), 2, 0.3).cast("int").alias("silent"))


QUERIES = {f.__name__: f for f in (heading_built, section_elements, artifact_parse, artifact_chunks, artifact_sync, timeline_built, timeline_units, render_breaks, seam_shifted_times, seam_shifted_seams, seam_flattened, coverage_lines, audio_scalars)}

_SEC = "sec as (select * from sections qualify row_number() over (partition by section_id order by section_id) = 1)"
_CK = "ck as (select * from chunks qualify row_number() over (partition by chunk_id order by chunk_id) = 1)"
_WS = r"[\s\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_CLEAN = lambda c: f"trim(regexp_replace(regexp_replace({c}, '[\\x{{feff}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}]', '', 'g'), '{_WS}+', ' ', 'g'))"
_EL = f"el as (select section_id, sequence, unnest(l) as text, unnest(range(len(l)))::int as place from (select section_id, coalesce(sequence, 0) as sequence, list_filter(list_transform(paragraphs, lambda p: {_CLEAN('coalesce(p, chr(32))')}), lambda p: p <> '') as l from sec)), ei as (select section_id, place, 'sec' || sequence || '-el' || lpad(place::varchar, 4, '0') as element_id, text from el)"
_WC = lambda c: f"len(list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w <> ''))"
_SY = f"""{_CK}, rd as (select source_id, sequence, chunk_index, sum({_WC("coalesce(text, '')")})::bigint as reader from ck where source_id is not null and sequence is not null and chunk_index is not null group by all),
wd as (select source_id, sequence, region, chunk_index, word_index, min(start_s) as start_s from word_times where word is not null and source_id is not null and sequence is not null and word_index >= 0 group by all),
al as (select source_id, sequence, chunk_index, count(*) as aligned, min(start_s) filter (start_s >= 0) as first from wd where chunk_index is not null group by all),
hd as (select source_id, sequence, count(*)::int as heading_words from wd where chunk_index is null group by all),
cv as (select rd.*, coalesce(aligned, 0) as aligned, first, coalesce(sum(reader) over (partition by source_id, sequence order by chunk_index rows between unbounded preceding and 1 preceding), 0) as before from rd left join al using (source_id, sequence, chunk_index)),
ct as (select source_id, sequence, string_agg(case when first is null then '-1' else round_even(first * 10000, 0)::bigint::varchar end, ',' order by chunk_index) as starts, sum(reader)::bigint as reader, sum(aligned)::bigint as aligned, min(case when aligned < reader then before + aligned end)::bigint as first_missing from cv group by all),
sy as (select ct.source_id, ct.sequence, starts, coalesce(heading_words, 0) as heading_words, reader, aligned, (case when reader = 0 then case when aligned = 0 then 1.0 else 0.0 end else round_even(aligned / reader, 4) end)::double as ratio, first_missing from ct left join hd using (source_id, sequence))"""
_DU = f"{_W}, du as (select track_id, chunk_index, case when n > 0 then n end as frames from (select track_id, chunk_index, round_even(max(end_s) * 24000, 0)::bigint - round_even(min(start_s) filter (start_s >= 0) * 24000, 0)::bigint as n from ww where chunk_index is not null group by all))"
_SH = "rn as (select track_id, old_end, sum(delta) over (partition by track_id order by old_end) as shift from ed)"
_MV = lambda rows, at: f"(select p.*, coalesce(r.shift, 0) as shift from {rows} p asof left join rn r on p.track_id = r.track_id and p.{at} >= r.old_end)"
_TEN = lambda c: f'(({c} + shift) * 10000)'
_SEC4 = lambda c: f'(({_TEN(c)} // 24000 + case when {_TEN(c)} % 24000 > 12000 or {_TEN(c)} % 24000 = 12000 and ({_TEN(c)} // 24000) % 2 = 1 then 1 else 0 end) / 10000)'
_LVL = "sqrt(list_sum(list_transform(a[i + 1:i + 2], lambda x: x * x)) / 2)"
_NUMBERED = f"(regexp_matches(f, '{H.CHAPTER}') or regexp_matches(f, '{H.ORDINAL}'))"
_HB = f"""hb as (select section_id, section_type as kind, case when ordinal > 0 then ordinal end as o, list_filter([{_CLEAN("coalesce(heading.display_label, '')")}, {_CLEAN("coalesce(heading.display_title, '')")}], lambda x: x <> '') as ts, coalesce(epub_item_name, '') as nav, section_id % 2 = 0 as en from sec where section_type is not null),
hc as (select *, coalesce(ts[1], '') as f, coalesce(ts[2], '') as g, len(ts) as n, case when kind = 'other' then '' else upper(kind[1]) || kind[2:] end as def from hb),
hd as (select *, {_NUMBERED} as num, regexp_replace(lower(f), '^[ .:]+|[ .:]+$', '', 'g') = kind as same from hc),
he as (select *, case when kind = 'chapter' then case when n > 0 and num then f else '' end when n = 0 then case when def <> '' then def else nav end when same then f else def end as label,
case when kind = 'chapter' then case when n = 0 then nav when num then g when n > 1 then f || ' — ' || g else f end when n = 0 then case when def <> '' and nav <> '' and lower(nav) <> lower(def) then nav else '' end when same then g else array_to_string(ts, ' — ') end as title from hd)"""
ORACLES = {
    "heading_built": f"with {_SEC}, {_HB} select section_id, label, title, case when kind <> 'chapter' then {_STOP("concat_ws('. ', nullif(label, ''), nullif(title, ''))")} when o is not null and en then {_STOP(f"concat_ws('. ', 'Chapter ' || {_SPELL('o')}, nullif(title, ''))")} when o is not null then {_STOP("coalesce(nullif(array_to_string(ts, ' '), ''), concat_ws(' ', nullif(label, ''), nullif(title, '')))")} when title <> '' then title else label end as spoken from he",
    "section_elements": f"with {_SEC}, {_EL} select * from ei",
    "artifact_parse": f"with {_SEC}, {_EL} select sec.section_id, 2 as version, sec.sequence, count(ei.place)::int as elements, sha256(coalesce(string_agg(element_id || '|' || ei.text, chr(10) order by place), '')) as hash from sec left join ei using (section_id) group by all",
    "artifact_chunks": f"with {_SEC}, {_CK}, c as (select * from ck where text is not null and section_id is not null) select section_id, any_value(sec.sequence) as sequence, count(*)::int as chunks, sha256(string_agg('sha256:' || sha256(c.text), ',' order by chunk_index, chunk_id)) as hash, first(para_start order by chunk_index, chunk_id) as para_start, last(para_end order by chunk_index, chunk_id) as para_end from c join sec using (section_id) group by section_id",
    "artifact_sync": f"with {_SY} select * from sy",
    "coverage_lines": f"with {_SY} select source_id, 'section ' || case when sequence < 10 then '0' else '' end || sequence || ': ' || aligned || '/' || reader || ' words (' || format('{{:.1f}}', round_even(ratio * 1000, 0) / 10) || '%)' as line from sy",
    "timeline_built": f"with {_DU}, g as (select *, coalesce(sum(frames) over w, 0) as earlier, coalesce(sum((frames is not null)::int) over w, 0) as before from du window w as (partition by track_id order by chunk_index rows between unbounded preceding and 1 preceding)), k as (select *, {LEAD} + earlier + sum(case when frames is not null and before > 0 then 14400 else 0 end) over (partition by track_id order by chunk_index) as pos from g) select track_id, chunk_index, frames, (case when frames is null then -1 else pos end)::bigint as start_frame, (case when frames is not null then pos + frames end)::bigint as end_frame from k",
    "timeline_units": f"with {_DU}, u as (select *, case chunk_index % 4 when 0 then 8400 when 1 then 4320 when 2 then 2880 when 3 then 14400 else 0 end as p from du where frames is not null), c as (select *, sum(frames) over (partition by track_id order by chunk_index) + coalesce(sum(p) over (partition by track_id order by chunk_index rows between unbounded preceding and 1 preceding), 0) as fin from u) select track_id, chunk_index, (fin - frames)::bigint as start_frame, fin::bigint as end_frame, (fin + p)::bigint as pause_end_frame from c",
    "seam_shifted_times": f"with {_ED}, {_W}, {_SH}, f as (select track_id, word_index, floor(start_s * 24000 + 0.5)::bigint as a, floor(end_s * 24000 + 0.5)::bigint as b from ww where start_s >= 0 and end_s >= 0), x as (select track_id, word_index, b, {_SEC4('a')} as start_s from {_MV('f', 'a')}), y as (select track_id, word_index, start_s, {_SEC4('b')} as end_s from {_MV('x', 'b')}) select * from y",
    "seam_shifted_seams": f"with {_ED}, {_SH}, x as (select distinct track_id, kind, break_type, pause_start_frame from se where track_id is not null and pause_start_frame >= 0), y as (select *, pause_start_frame + shift as ns from {_MV('x', 'pause_start_frame')}) select track_id, kind, break_type, pause_start_frame, ns::bigint as new_start, (ns + {_POL} * 24)::bigint as new_end, {_POL} as new_ms from y",
    "seam_flattened": f"with {_S} select track_id, coalesce(after_chunk_index, -1) as chunk, kind, break_type, pause_start_frame, pause_end_frame from se where track_id is not null and pause_start_frame is not null",
    "audio_scalars": f"with {_W}, l as (select track_id, chunk_index, list(round_even(end_s - start_s, 4) order by word_index) as a from ww where chunk_index is not null and start_s >= 0 and end_s > start_s group by all), m as (select *, len(a) as n, list_max(a) as p, least(3, len(a) // 2) as r from l), k as (select *, list_filter(range(n), lambda i: a[i + 1] >= greatest(0.2, p * 0.5)) as v, list_filter(range(0, greatest(1, n - 1), 2), lambda i: {_LVL} >= 0.3) as loud from m) select track_id, chunk_index, p as peak, round(list_sum(list_transform(a, lambda x: x * (0.89 / p))), 6) as normal, round(list_sum(list_transform(range(n), lambda i: a[i + 1] * case when r <= 1 then case when i < r or i >= n - r then 0.0 else 1.0 end else least(1.0, i / (r - 1), (n - 1 - i) / (r - 1)) end)), 6) as faded, round(sqrt(list_sum(list_transform(a[1:4], lambda x: x * x)) / len(a[1:4])), 6) as level, (case when len(v) = 0 then n else least(list_max(v) + 3, n) - greatest(list_min(v) - 2, 0) end)::int as kept, (case when n < 2 then 0 when len(loud) > 0 then list_min(loud) else len(range(0, greatest(1, n - 1), 2)) * 2 end)::int as silent from k",
}
