"""Dialogue and direction plans over chunks, documents and character profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import direction as D
from inkwell.functions import text as T
from inkwell.operators import dialogue as O
from inkwell.session import table

#: Speakers in turn, as the plans need an assignment and the tables hold none.
CAST = ("First Reader", "Second Reader", "narrator")


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("text is not null and section_id is not null")


def _profiles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "character_profiles").dropDuplicates(["character_id"]).filter("source_id is not null and canonical is not null")


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return O.quotes(_chunks(s, d).select("section_id", "chunk_index", "chunk_id", "text"), ["section_id"], ["chunk_index", "chunk_id"])


def _said(s: SparkSession, d: str) -> DataFrame:
    turn = F.pmod(F.col("quote_id"), F.lit(len(CAST)))
    return _quotes(s, d).withColumn("speaker", F.element_at(F.array(*map(F.lit, CAST)), turn + 1))


def _spans(s: SparkSession, d: str) -> DataFrame:
    return O.tiled_spans(_chunks(s, d), _said(s, d), "chunk_id")


def quote_spans(s, d):
    return _quotes(s, d).select("section_id", "chunk_index", "chunk_id", "quote_id", "batch", "start", "end", "text")


def quote_context(s, d):
    """Each quote with 120 characters on either side."""
    q = _quotes(s, d).select("chunk_id", "quote_id", "start", "end").join(_chunks(s, d).select("chunk_id", "text"), "chunk_id")
    low = F.greatest(F.col("start") - 120, F.lit(0))
    return q.select("chunk_id", "quote_id", F.expr("substring(text, greatest(start - 120, 0) + 1, start - greatest(start - 120, 0))").alias("before"), F.expr("substring(text, end + 1, 120)").alias("after"), low.alias("from_pos"))


def quote_need(s, d):
    return table(s, d, "documents").filter("text is not null").groupBy("source").agg(F.count_if(D.has_quote(F.col("text"))).alias("quoted"), F.count("*").alias("n"))


def spans_tiled(s, d):
    return _spans(s, d)


def spans_invalid(s, d):
    """Violations of the tiling; of what this engine makes there are none."""
    return O.span_violations(_chunks(s, d), _spans(s, d), "chunk_id")


def spans_clipped(s, d):
    """Spans of each chunk clipped to its first 200 characters and moved to its start."""
    a, b = F.greatest("start", F.lit(0)), F.least("end", F.lit(200))
    return _spans(s, d).filter((F.col("start") < 200) & (F.col("end") > 0)).select("chunk_id", "speaker", a.alias("start"), b.alias("end"))


def spans_exchange(s, d):
    spans = _spans(s, d).join(_chunks(s, d).select("chunk_id", "section_id", "chunk_index"), "chunk_id")
    return O.exchanges(spans.withColumn("place", F.col("chunk_index") * 1_000_000 + F.col("start")), ["section_id"], "place").groupBy("section_id", "exchange").agg(F.count("*").alias("n"))


def span_tags(s, d):
    """Texts that directly follow a quote, by whether they are dialogue tags."""
    q = _quotes(s, d).select("chunk_id", "end").join(_chunks(s, d).select("chunk_id", "text"), "chunk_id")
    return q.groupBy(D.is_dialogue_tag(F.expr("substring(text, end + 1, 60)")).alias("tag")).agg(F.count("*").alias("n"))


def segment_direction(s, d):
    """Speed, intensity, pause and controls of each tiled span, read as a segment."""
    x = _spans(s, d).join(_chunks(s, d).select("chunk_id", "text"), "chunk_id").withColumn("text", F.expr("substring(text, start + 1, end - start)"))
    emotion = F.element_at(F.array(*map(F.lit, D.EMOTIONS)), F.pmod(F.col("start"), F.lit(len(D.EMOTIONS))) + 1)
    x = x.withColumn("emotion", emotion).withColumn("level", D.intensity(F.col("emotion"), F.lit(0.7), F.col("text"), F.col("delivery_type")))
    c = D.engine_controls(F.col("emotion"), F.col("level"))
    return x.select("chunk_id", "start", "emotion", D.speed(F.lit("fast"), F.col("speaker"), F.col("text")).alias("speed"), "level", D.pause_after(F.lit(200), F.lit("normal"), F.col("voice_policy"), F.col("delivery_type")).alias("pause_ms"), c["exaggeration"].alias("exaggeration"), c["cfg_weight"].alias("cfg_weight"))


def segment_speeds(s, d):
    """Histogram of speeds, with how many are above one and how many of these are the narrator's."""
    x = segment_direction(s, d)
    return x.groupBy(F.format_number("speed", 2).alias("speed")).agg(F.count("*").alias("n"), F.count_if(F.col("speed") > 1).alias("above"))


def segment_merged(s, d):
    """Runs of seams of one break type within each track merged: the adjacent-merge pattern."""
    from inkwell.operators.relational import islands

    x = table(s, d, "seam_audits").filter("track_id is not null and pause_start_frame is not null").select("track_id", "pause_start_frame", "break_type").distinct()
    runs = islands(x, ["track_id"], ["pause_start_frame", "break_type"], ["break_type"])
    return runs.groupBy("track_id", "run", "break_type").agg(F.count("*").alias("n"), F.min("pause_start_frame").alias("first"))


def direction_batches(s, d):
    """Chunks of each edition packed into batches under 1500 words and 10000 characters."""
    c = _chunks(s, d).filter("source_id is not null").select("source_id", F.concat_ws("-", F.lpad(F.col("sequence").cast("string"), 6, "0"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"), F.lpad(F.col("chunk_id").cast("string"), 12, "0")).alias("place"), T.token_count(F.col("text")).cast("bigint").alias("words"), F.length("text").cast("bigint").alias("chars"))
    return O.batches(c, ["source_id"], "place", "words", "chars").groupBy("source_id", "batch").agg(F.count("*").alias("chunks"), F.min("place").alias("first"))


def registry_names(s, d):
    return O.names_of(_profiles(s, d), ["source_id", "build"])


def registry_resolved(s, d):
    """Each alias as a speaker, resolved within its book and build; null where none or several fit."""
    p = _profiles(s, d)
    speakers = p.select("source_id", "build", F.explode("aliases").alias("speaker")).filter("speaker is not null").distinct()
    return O.resolve(speakers, O.names_of(p, ["source_id", "build"]), ["source_id", "build"])


def registry_personas(s, d):
    """Personas with the profile they mask, in the same book and build."""
    p = _profiles(s, d)
    parent = p.select("source_id", "build", F.col("canonical").alias("persona_of"), F.col("character_id").alias("masked_id"))
    return p.filter("persona_of is not null").select("source_id", "build", "character_id", "persona_of").join(parent, ["source_id", "build", "persona_of"], "left").select("character_id", "masked_id")


def registry_unknown(s, d):
    """Builds' characters that the book's other builds don't know by name."""
    p = _profiles(s, d).select("source_id", "build", "character_id", D.norm(F.col("canonical")).alias("key"))
    other = p.select("source_id", F.col("build").alias("other"), "key").distinct()
    known = p.join(other, ["source_id", "key"]).filter("build <> other").select("character_id").distinct()
    return p.join(known, "character_id", "left_anti").select("character_id")


def registry_repairs(s, d):
    """Canonical names missing among a book's alias texts, repaired to the only alias form one edit away."""
    p = _profiles(s, d)
    last = lambda c: F.element_at(F.split(D.norm(c), " "), -1)
    asked = p.select("source_id", last(F.col("canonical")).alias("name"))
    seen = p.select("source_id", F.explode("aliases").alias("a")).filter("a is not null").select("source_id", D.norm(F.col("a")).alias("form"))
    return O.spelling_repairs(asked, seen, ["source_id"])


def registry_pov(s, d):
    """Profiles whose own words mark the main character."""
    text = F.lower(F.concat_ws(" ", "canonical", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "), "description", "age"))
    hit = F.lit(False)
    for m in D.POV_MARKERS:
        hit = hit | F.contains(text, F.lit(m))
    return _profiles(s, d).groupBy(hit.alias("pov")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (quote_spans, quote_context, quote_need, spans_tiled, spans_invalid, spans_clipped, spans_exchange, span_tags, segment_direction, segment_speeds, segment_merged, direction_batches, registry_names, registry_resolved, registry_personas, registry_unknown, registry_repairs, registry_pov)}

_PR = "pr as (select * from character_profiles where source_id is not null and canonical is not null qualify row_number() over (partition by character_id order by character_id) = 1)"
_CH = "ch as (select * from chunks where text is not null and section_id is not null qualify row_number() over (partition by chunk_id order by chunk_id) = 1)"
_TILES = '(?s)[^“"]+|“[^”]*(?:”|\\z)|"[^"”]*(?:["”]|\\z)'
_QU = f"""ti as (select section_id, chunk_index, chunk_id, regexp_extract_all(text, '{_TILES}') as l from ch),
tl as (select section_id, chunk_index, chunk_id, unnest(l) as t, unnest(range(len(l))) as i from ti),
tp as (select *, sum(length(t)) over (partition by chunk_id order by i) as fin from tl),
qs as (select section_id, chunk_index, chunk_id, (fin - length(t))::int as start, fin::int as "end", t as text from tp where regexp_full_match(t, '(?s)“[^”]*”|"[^"”]*["”]')),
qn as (select *, row_number() over (partition by section_id order by chunk_index, chunk_id, start) - 1 as quote_id from qs)"""
_TI = f"""{_CH}, {_QU}, sd as (select *, case quote_id % 3 when 0 then 'First Reader' when 1 then 'Second Reader' else 'narrator' end as speaker from qn),
b as (select chunk_id, coalesce(lag("end") over (partition by chunk_id order by start), 0) as prev, start, "end", speaker from sd),
al as (select chunk_id, prev as start, start as "end", 'narrator' as speaker from b union all select chunk_id, start, "end", speaker from b union all select ch.chunk_id, coalesce(max(b."end"), 0), length(any_value(ch.text)), 'narrator' from ch left join b using (chunk_id) group by ch.chunk_id),
f as (select * from al where "end" > start),
g as (select *, case when speaker = lag(speaker) over (partition by chunk_id order by start) then 0 else 1 end as new from f),
r as (select *, sum(new) over (partition by chunk_id order by start) as run from g),
sp as (select chunk_id, speaker, case when speaker = 'narrator' then 'written_text' else 'spoken_dialogue' end as delivery_type, case when speaker = 'narrator' then 'narrator' else 'character' end as voice_policy, min(start)::int as start, max("end")::int as "end" from r group by chunk_id, run, speaker)"""
_NM = r"""nk as (select source_id, build, character_id, trim(regexp_replace(lower(n), '\s+', ' ', 'g')) as k from (select source_id, build, character_id, unnest(list_concat([canonical], coalesce(aliases, []))) as n from pr) where n is not null),
pt as (select *, string_split(trim(regexp_replace(translate(k, ',', ' '), '\s+', ' ', 'g')), ' ') as p from nk),
nm as (select distinct source_id, build, character_id, key, form from (select source_id, build, character_id, k as key, 'full' as form from pt union all select source_id, build, character_id, regexp_replace(k, '^(?:the|an|a) ', ''), 'full' from pt union all select source_id, build, character_id, p[len(p)], 'short' from pt where len(p) > 1) where key is not null and key <> '')"""
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}"
_TOKENS = f"len(regexp_extract_all(t, '{_WORD}'']+'))"
_SEG = f"""{_TI}, tx as (select sp.*, substring(ch.text, start + 1, "end" - start) as t from sp join ch using (chunk_id)),
em as (select *, (['neutral', 'happy', 'sad', 'angry', 'anxious', 'surprised', 'amused'])[start % 7 + 1] as emotion, {_TOKENS} as words, len(regexp_extract_all(translate(t, chr(39), ' '), '{_WORD}]+')) as plain_words from tx),
cq as (select *, left(trim(t), 1) in ('"', '“', '‘') and right(regexp_replace(trim(t), '[ \\t\\r\\n,.;:!?)\\]}}]+$', ''), 1) in ('"', '”', '’') as quoted from em),
lv as (select *, case when emotion = 'neutral' then 0.7 else least(0.7, case when words < 12 or length(trim(t)) < 60 then case when quoted then 0.6 else 0.45 end when words < 24 then 0.65 else 0.8 end) end as level from cq),
tg as (select *, case emotion when 'happy' then 0.72 when 'sad' then 0.38 when 'angry' then 0.85 when 'anxious' then 0.78 when 'surprised' then 0.82 when 'amused' then 0.68 else 0.5 end as ex, case emotion when 'happy' then 0.42 when 'sad' then 0.58 when 'angry' then 0.34 when 'anxious' then 0.36 when 'surprised' then 0.38 when 'amused' then 0.44 else 0.5 end as cw from lv),
sg as (select chunk_id, start, emotion, (case when speaker <> 'narrator' then 1.05 when plain_words > 24 then 0.95 else 1.0 end)::double as speed, level::double as level, case when voice_policy = 'narrator_compatible' then 0 else 120 end as pause_ms, round_even(0.5 + (ex - 0.5) * level, 4)::double as exaggeration, round_even(0.5 + (cw - 0.5) * level, 4)::double as cfg_weight from tg)"""
_FLUSH = "(a[len(a)].w + y[1].w > 1500 or a[len(a)].c + y[1].c > 10000)"
_TAG = D.DIALOGUE_TAG.replace("(?iU)", "(?i)").replace("\\s", "[\\s\\x{a0}\\x{2000}-\\x{200a}\\x{202f}\\x{3000}]")
ORACLES = {
    "span_tags": f"with {_CH}, {_QU}, f as (select substring(ch.text, \"end\" + 1, 60) as t from qn q join ch using (chunk_id)) select length(trim(t)) <= 120 and regexp_matches(t, '{_TAG}') as tag, count(*) as n from f group by 1",
    "segment_direction": f"with {_SEG} select * from sg",
    "segment_speeds": f"with {_SEG} select format('{{:.2f}}', speed) as speed, count(*) as n, count(*) filter (speed > 1) as above from sg group by 1",
    "spans_exchange": f"with {_TI}, q as (select section_id, chunk_index * 1000000 + start as place, speaker, delivery_type from sp join ch using (chunk_id) where speaker <> 'narrator'), n as (select *, list_concat(coalesce(list(case when delivery_type = 'spoken_dialogue' then speaker end) over (partition by section_id order by place rows between 4 preceding and 1 preceding), []), coalesce(list(case when delivery_type = 'spoken_dialogue' then speaker end) over (partition by section_id order by place rows between 1 following and 4 following), [])) as near from q), e as (select section_id, delivery_type = 'spoken_dialogue' and len(list_filter(near, lambda x: x is not null and x <> speaker)) > 0 as exchange from n) select section_id, exchange, count(*) as n from e group by all",
    "direction_batches": f"with {_CH}, w as (select source_id, lpad(sequence::varchar, 6, '0') || '-' || lpad(chunk_index::varchar, 6, '0') || '-' || lpad(chunk_id::varchar, 12, '0') as place, text as t, length(text) as chars from ch where source_id is not null), l as (select source_id, list(struct_pack(p := place, w := {_TOKENS}, c := chars, b := 0) order by place) as l from w group by 1), f as (select source_id, list_reduce(list_transform(l, lambda x: [x]), lambda a, y: list_append(a, struct_pack(p := y[1].p, w := case when {_FLUSH} then y[1].w else a[len(a)].w + y[1].w end, c := case when {_FLUSH} then y[1].c else a[len(a)].c + y[1].c end, b := a[len(a)].b + case when {_FLUSH} then 1 else 0 end))) as r from l), u as (select source_id, unnest(r) as x from f) select source_id, x.b as batch, count(*) as chunks, min(x.p) as first from u group by 1, 2",
    "quote_spans": f'with {_CH}, {_QU} select section_id, chunk_index, chunk_id, quote_id, (quote_id // 20)::int as batch, start, "end", text from qn',
    "quote_context": f'with {_CH}, {_QU} select q.chunk_id, quote_id, substring(ch.text, greatest(start - 120, 0) + 1, start - greatest(start - 120, 0)) as before, substring(ch.text, "end" + 1, 120) as after, greatest(start - 120, 0) as from_pos from qn q join ch using (chunk_id)',
    "quote_need": "select source, count(*) filter (regexp_matches(text, '[\"“”]')) as quoted, count(*) as n from documents where text is not null group by 1",
    "spans_tiled": f'with {_TI} select chunk_id, speaker, delivery_type, voice_policy, start, "end" from sp',
    "spans_invalid": f"""with {_TI}, p as (select *, coalesce(lag("end") over (partition by chunk_id order by start, "end"), 0) as prev from sp), e as (select ch.chunk_id, coalesce(max(sp."end"), 0) as fin, length(any_value(ch.text)) as n from ch left join sp using (chunk_id) group by ch.chunk_id) select chunk_id, start, 'not contiguous' as violation from p where start <> prev union all select chunk_id, start, 'empty span' from p where "end" <= start union all select chunk_id, fin, 'does not cover the text' from e where fin <> n""",
    "spans_clipped": f'with {_TI} select chunk_id, speaker, greatest(start, 0) as start, least("end", 200) as "end" from sp where start < 200 and "end" > 0',
    "segment_merged": "with x as (select distinct track_id, pause_start_frame, break_type from seam_audits where track_id is not null and pause_start_frame is not null), g as (select *, case when break_type is not distinct from lag(break_type) over w and row_number() over w > 1 then 0 else 1 end as new from x window w as (partition by track_id order by pause_start_frame, break_type nulls first)), r as (select *, sum(new) over (partition by track_id order by pause_start_frame, break_type nulls first)::bigint as run from g) select track_id, run, break_type, count(*) as n, min(pause_start_frame) as first from r group by all",
    "registry_names": f"with {_PR}, {_NM} select * from nm",
    "registry_resolved": f"with {_PR}, {_NM}, sk as (select distinct source_id, build, speaker from (select source_id, build, unnest(aliases) as speaker from pr) where speaker is not null), j as (select sk.source_id, sk.build, sk.speaker, character_id, form from sk left join nm on nm.source_id = sk.source_id and nm.build = sk.build and nm.key = trim(regexp_replace(lower(sk.speaker), '\\s+', ' ', 'g'))), c as (select source_id, build, speaker, count(distinct case when form = 'full' then character_id end) as full_matches, count(distinct case when form = 'short' then character_id end) as short_matches, max(case when form = 'full' then character_id end) as f, max(case when form = 'short' then character_id end) as s from j group by all) select source_id, build, speaker, case when full_matches = 1 then f when full_matches = 0 and short_matches = 1 then s end as character_id, full_matches, short_matches from c",
    "registry_personas": f"with {_PR} select a.character_id, b.character_id as masked_id from pr a left join pr b on a.source_id = b.source_id and a.build = b.build and a.persona_of = b.canonical where a.persona_of is not null",
    "registry_unknown": f"with {_PR}, k as (select source_id, build, character_id, trim(regexp_replace(lower(canonical), '\\s+', ' ', 'g')) as key from pr) select character_id from k where not exists (select 1 from k o where o.source_id = k.source_id and o.key = k.key and o.build <> k.build)",
    "registry_repairs": f"with {_PR}, nmx as (select distinct source_id, list_last(string_split(trim(regexp_replace(lower(canonical), '\\s+', ' ', 'g')), ' ')) as name from pr), fm as (select distinct source_id, trim(regexp_replace(lower(a), '\\s+', ' ', 'g')) as form from (select source_id, unnest(aliases) as a from pr) where a is not null), c as (select n.source_id, name, form from nmx n join fm using (source_id) where length(name) >= 7 and levenshtein(name, form) = 1 and not exists (select 1 from fm f2 where f2.source_id = n.source_id and f2.form = n.name)) select source_id, name, min(form) as repair from c group by 1, 2 having count(*) = 1",
    "registry_pov": f"with {_PR} select regexp_matches(lower(concat_ws(' ', canonical, array_to_string(aliases, ' '), description, age)), '{'|'.join(D.POV_MARKERS)}') as pov, count(*) as n from pr group by 1",
}
