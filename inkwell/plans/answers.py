"""Registry and answer plans: names in texts, grounding, coverage of answers, reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import direction as D
from inkwell.operators import registry as R
from inkwell.plans import dialogues
from inkwell.session import table


def registry_mentions(s, d):
    """Characters whose full canonical name stands in their own evidence or description."""
    p = dialogues._profiles(s, d)
    text = F.concat_ws(" ", "first_evidence_quote", "description")
    return p.groupBy(R.contains_name(text, F.col("canonical")).alias("mentioned")).agg(F.count("*").alias("n"))


def registry_observed(s, d):
    """Names each chunk shows, of seven letters or more, by how many chunks have them."""
    forms = dialogues._chunks(s, d).select("chunk_id", F.explode(R.observed_names(F.col("text"))).alias("form")).filter("length(form) >= 7").distinct()
    return forms.groupBy("form").agg(F.count("*").alias("chunks"))


def registry_grounded(s, d):
    """Profiles that some chunk of their book names, or names with one letter other; how it spells them."""
    p = dialogues._profiles(s, d).select("source_id", "character_id", "canonical", "aliases")
    texts = dialogues._chunks(s, d).filter("source_id is not null").select("source_id", "text")
    return R.grounded(p, texts, "source_id").select("character_id", "canonical")


def answers_checked(s, d):
    """Quotes against a set of answers that skips each seventh and repeats each eleventh: the faults."""
    q = dialogues._quotes(s, d).select("section_id", "quote_id")
    a = q.filter("quote_id % 7 <> 3")
    a = a.unionByName(a.filter("quote_id % 11 = 5"))
    return R.answer_faults(q, a, ["section_id", "quote_id"])


def answers_patched(s, d):
    """Seam break types with sparse edits laid over; a track with a repeated edit keeps its own."""
    seams = table(s, d, "seam_audits").filter("track_id is not null and pause_start_frame is not null").groupBy("track_id", "pause_start_frame").agg(F.min("break_type").alias("break_type"))
    edits = seams.filter("pause_start_frame % 5 = 0").withColumn("break_type", F.lit("word"))
    edits = edits.unionByName(edits.filter("track_id % 4 = 1"))
    return R.patched(seams, edits, ["track_id", "pause_start_frame"], ["break_type"], ["track_id"])


def direction_reused(s, d):
    """Sections whose chunk texts another section of the book has alike: kept results that can be used again."""
    c = dialogues._chunks(s, d).filter("source_id is not null")
    texts = c.groupBy("source_id", "section_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))), lambda x: x["text"]).alias("texts"))
    kept = texts.select("source_id", "texts", F.col("section_id").alias("at"), F.col("section_id").alias("result"))
    return R.reusable(texts, kept, ["source_id"], "at").select("source_id", "section_id", F.col("result").alias("newest"))


QUERIES = {f.__name__: f for f in (registry_mentions, registry_observed, registry_grounded, answers_checked, answers_patched, direction_reused)}
# Runs with letters beyond ASCII are taken out first, as this dialect's word edges know only ASCII.
_FOREIGN = "[A-Za-z0-9_]*(?:[\\x{c0}-\\x{963}\\x{966}-\\x{1fff}\\x{3040}-\\x{9fff}\\x{ac00}-\\x{d7a3}][A-Za-z0-9_]*)+"
_FORM = R.NAME_FORM.replace("'", "''")
_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"
ORACLES = {
    "registry_mentions": f"with {dialogues._PR} select coalesce(trim(canonical) <> '' and regexp_matches(lower(concat_ws(' ', first_evidence_quote, description)), '(?:^|{_EDGE})' || regexp_escape(lower(trim(canonical))) || '(?:$|{_EDGE})'), false) as mentioned, count(*) as n from pr group by 1",
    "registry_observed": f"with {dialogues._CH}, f as (select chunk_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '{_FOREIGN}', '·', 'g'), '{_FORM}')), '\\s+', ' ', 'g') as form from ch), o as (select chunk_id, first(form order by n) as form from (select *, row_number() over (partition by chunk_id) as n from f) group by chunk_id, lower(form)) select form, count(*) as chunks from o where length(form) >= 7 group by 1",
    "registry_grounded": f"""with {dialogues._CH}, {dialogues._PR}, nn as (select source_id, character_id, unnest(list_concat([canonical], coalesce(aliases, []))) as n from pr),
h as (select distinct character_id from nn where n is not null and trim(n) <> '' and exists (select 1 from ch where ch.source_id = nn.source_id and regexp_matches(lower(ch.text), '(?:^|{_EDGE})' || regexp_escape(lower(trim(n))) || '(?:$|{_EDGE})'))),
f as (select source_id, chunk_id, regexp_replace(unnest(regexp_extract_all(regexp_replace(text, '{_FOREIGN}', '·', 'g'), '{_FORM}')), '\\s+', ' ', 'g') as form from ch where source_id is not null), fn as (select *, row_number() over (partition by chunk_id) as n from f), o as (select distinct source_id, form from (select source_id, first(form order by n) as form from fn group by source_id, chunk_id, lower(form))),
l as (select distinct source_id, canonical as name from pr where character_id not in (select character_id from h) and length(canonical) >= 7),
r as (select l.source_id, l.name, min(form) as repair from l join o on o.source_id = l.source_id and levenshtein(l.name, o.form) = 1 where not exists (select 1 from o x where x.source_id = l.source_id and x.form = l.name) group by all having count(*) = 1)
select character_id, canonical from pr where character_id in (select character_id from h) union all select character_id, repair from pr join r on r.source_id = pr.source_id and r.name = pr.canonical where character_id not in (select character_id from h)""",
    "answers_checked": f"with {dialogues._CH}, {dialogues._QU}, a as (select section_id, quote_id from qn where quote_id % 7 <> 3), b as (select * from a union all select * from a where quote_id % 11 = 5), c as (select section_id, quote_id, count(*) as n from b group by all) select q.section_id, q.quote_id, case when n is null then 'missing' else 'repeated' end as fault from qn q left join c on q.section_id = c.section_id and q.quote_id = c.quote_id where n is null or n > 1",
    "answers_patched": "with s as (select track_id, pause_start_frame, min(break_type) as break_type from seam_audits where track_id is not null and pause_start_frame is not null group by all), bad as (select distinct track_id from s where track_id % 4 = 1 and pause_start_frame % 5 = 0) select track_id, pause_start_frame, case when pause_start_frame % 5 = 0 and track_id not in (select track_id from bad) then 'word' else break_type end as break_type from s",
    "direction_reused": f"with {dialogues._CH}, t as (select source_id, section_id, list(text order by chunk_index, chunk_id) as texts from ch where source_id is not null group by all), k as (select source_id, texts, max(section_id) as newest from t group by all) select t.source_id, t.section_id, k.newest from t left join k on t.source_id = k.source_id and t.texts = k.texts",
}
