"""Plans over text made ready for speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import synthesis as S
from inkwell.operators import folds
from inkwell.plans import dialogues
from inkwell.plans.texts import _HAN, _RUN, _UC, _WS
from inkwell.session import table

#: A pool of voices with their sex.
POOL = (("reed", "female"), ("oak", "male"), ("ash", "female"), ("elm", "male"))


def _chunks(s, d):
    return table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("text is not null")


def synth_units(s, d):
    """Chunks in units of at most 320 characters."""
    return _chunks(s, d).select("chunk_id", F.posexplode(S.char_units(F.col("text"))).alias("place", "unit"))


def synth_paragraphs(s, d):
    """Chunks in units between true paragraph breaks."""
    return _chunks(s, d).select("chunk_id", F.posexplode(S.paragraph_units(F.col("text"))).alias("place", "unit"))


def synth_spoken(s, d):
    """Each chunk cleaned of cues and tags, whether anything is left to say, and its last sentence."""
    t = F.col("text")
    return _chunks(s, d).select("chunk_id", F.length(S.sanitize(t)).alias("chars"), S.has_spoken(t).alias("spoken"), S.last_sentence(t).alias("context"))


def synth_groups(s, d):
    """Tiled spans grouped into units of performance."""
    spans = dialogues.spans_tiled(s, d).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "speaker", "delivery_type", "voice_policy"))).alias("spans"))
    rows = dialogues._chunks(s, d).select("chunk_id", "text").join(spans, "chunk_id")
    return folds.per_row(rows, ["chunk_id"], ["text", "spans"], "unit int, start int, end int, speaker string, voice_policy string, join_policy string", ["unit", "start", "end", "speaker", "voice_policy", "join_policy"], folds.performance_groups)


def synth_candidates(s, d):
    """Candidate units of each chunk read as one segment."""
    make = lambda text: [(i, u) for i, u in enumerate(folds.candidate_units(text))]
    return folds.per_row(_chunks(s, d).select("chunk_id", "text"), ["chunk_id"], ["text"], "unit int, text string", ["unit", "text"], make)


def synth_voices(s, d):
    """Voices for the characters of each book and build, in order of id."""
    p = table(s, d, "character_profiles").dropDuplicates(["character_id"]).filter("source_id is not null and build is not null and canonical is not null")
    sex = F.when(F.lower(F.left("gender", F.lit(1))) == "f", "female").when(F.lower(F.left("gender", F.lit(1))) == "m", "male").otherwise("unknown")
    cast = p.groupBy("source_id", "build").agg(F.array_sort(F.collect_list(F.struct("character_id", F.col("canonical").alias("name"), sex.alias("gender"), F.lit(None).cast("string").alias("hint")))).alias("cast"))
    return folds.per_row(cast, ["source_id", "build"], ["cast"], "name string, voice string", ["name", "voice"], lambda c: folds.assigned_voices(c, POOL))


def synth_aligned(s, d):
    """Text of each chunk cut at the words of its section data, counted."""
    words = table(s, d, "word_times").filter("word is not null and chunk_index is not null and word_index >= 0").select("source_id", "sequence", "chunk_index", "word_index", "word").distinct()
    lists = words.groupBy("source_id", "sequence", "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_index", "word"))), lambda x: x["word"]).alias("words"))
    rows = _chunks(s, d).select("chunk_id", "source_id", "sequence", "chunk_index", "text").join(lists, ["source_id", "sequence", "chunk_index"])
    parts = folds.per_row(rows, ["chunk_id"], ["text", "words"], "part string, word int", ["part", "word"], lambda t, w: [(p, i) for p, i in folds.aligned_parts(t, w)])
    return parts.groupBy("chunk_id").agg(F.count("word").alias("placed"), F.count("*").alias("parts"), F.sum(F.length("part")).alias("chars"))


QUERIES = {f.__name__: f for f in (synth_units, synth_paragraphs, synth_spoken, synth_groups, synth_candidates, synth_voices, synth_aligned)}
_OF = lambda sex: [v for v, x in POOL if x == sex]
_FREE = lambda sex: f"list_filter({[v for v, _ in POOL]}, lambda v: not list_contains(a.u, v)" + (f" and (e.g = 'female' and list_contains({_OF('female')}, v) or e.g = 'male' and list_contains({_OF('male')}, v)))" if sex else ")")
_CHOICE = f"coalesce({_FREE(True)}[1], {_FREE(False)}[1], ({[v for v, _ in POOL]})[a.turn % {len(POOL)} + 1])"
_BARE = f"trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '\ufeff', ''), '{S._CUE}', '', 'g'), '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g'))"
_UNIT_AND = f"(?:{_HAN}|{_RUN}(?:[''’]{_RUN})*)[^\\p{{L}}\\p{{N}}]*"
ORACLES = {
    "synth_voices": f"""with p as (select * from character_profiles where source_id is not null and build is not null and canonical is not null qualify row_number() over (partition by character_id order by character_id) = 1),
l as (select source_id, build, list(struct_pack(n := canonical, g := case when lower(gender) like 'f%' then 'female' when lower(gender) like 'm%' then 'male' else 'unknown' end, u := []::varchar[], turn := 0, o := []::struct(name varchar, voice varchar)[]) order by character_id) as l from p group by all),
r as (select source_id, build, list_reduce(list_prepend(struct_pack(n := '', g := '', u := []::varchar[], turn := 0, o := []::struct(name varchar, voice varchar)[]), l), lambda a, e: struct_pack(n := e.n, g := e.g, u := list_append(a.u, {_CHOICE}), turn := a.turn + (len({_FREE(False)}) = 0)::int, o := list_append(a.o, struct_pack(name := e.n, voice := {_CHOICE})))) as r from l),
o as (select source_id, build, unnest(r.o) as x from r) select source_id, build, x.name as name, x.voice as voice from o""",
    "synth_spoken": f"""with c as (select chunk_id, {_BARE} as b from (select * from chunks where text is not null qualify row_number() over (partition by chunk_id order by chunk_id) = 1)),
h as (select *, regexp_matches(b, '{_HAN}') as han, list_last(list_filter(regexp_extract_all(b, '[^。！？!?]+[。！？!?]*[”’」』]*|[。！？!?]+'), lambda s: trim(s) <> '')) as hs, string_split(trim(list_last(regexp_extract_all(b, '[^.!?]+[.!?]["''”’]*|[^.!?]+$'))), ' ') as ls from c)
select chunk_id, length(b)::int as chars, regexp_matches(b, '[\\p{{L}}\\p{{N}}]') as spoken, case when b = '' then '' when han then case when {_UC('hs')} > 30 then array_to_string(regexp_extract_all(hs, '{_UNIT_AND}')[-30:], '') else hs end else coalesce(case when len(ls) > 30 then array_to_string(ls[-30:], ' ') else array_to_string(ls, ' ') end, '') end as context from h""",
}
