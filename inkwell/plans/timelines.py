"""Timeline plans over word times and seam audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import audio as A
from inkwell.functions import text as T
from inkwell.operators import relational as R
from inkwell.operators import timeline as L
from inkwell.session import table

GRID_S = 5


def _words(s: SparkSession, d: str) -> DataFrame:
    """Each word once, with real bounds."""
    w = table(s, d, "word_times").select("track_id", "region", "chunk_index", "word_index", "word", "start_s", "end_s").filter("track_id is not null and word_index >= 0")
    order = F.struct(F.coalesce("start_s", F.lit(1e18)), F.coalesce("end_s", F.lit(1e18)), F.coalesce("word", F.lit("")), F.coalesce("chunk_index", F.lit(-1)), F.coalesce("region", F.lit("")))
    return w.groupBy("track_id", "word_index").agg(F.min_by(F.struct("region", "chunk_index", "word", "start_s", "end_s"), order).alias("w")).select("track_id", "word_index", "w.*")


def _seams(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "seam_audits").drop("synced_at", "source_id", "sequence").distinct()


_W = "ww as (select track_id, word_index, region, chunk_index, word, start_s, end_s from word_times where track_id is not null and word_index >= 0 qualify row_number() over (partition by track_id, word_index order by coalesce(start_s, 1e18), coalesce(end_s, 1e18), coalesce(word, ''), coalesce(chunk_index, -1), coalesce(region, '')) = 1)"


def _chunk_starts(s: SparkSession, d: str) -> DataFrame:
    """Chunks of each track with their first word's start; -1 where none is known."""
    w = table(s, d, "word_times").filter("track_id is not null and chunk_index is not null")
    return w.groupBy("track_id", "chunk_index").agg(F.coalesce(F.min(F.when(F.col("start_s") >= 0, F.col("start_s"))), F.lit(-1.0)).alias("start_s"))


_C = "c as (select track_id, chunk_index, coalesce(min(start_s) filter (start_s >= 0), -1.0) as start_s from word_times where track_id is not null and chunk_index is not null group by all)"


def timeline_next_start(s, d):
    return L.next_starts(_chunk_starts(s, d), ["track_id"])


def timeline_word_chunk(s, d):
    """Words with a start assigned to the chunk whose start is the last at or before theirs; counted per chunk."""
    words = table(s, d, "word_times").filter("track_id is not null and start_s >= 0").select("track_id", "word_index", "start_s").distinct()
    steps = _chunk_starts(s, d).filter("start_s >= 0").groupBy("track_id", "start_s").agg(F.max("chunk_index").alias("chunk_index"))
    return R.as_of(words, steps, ["track_id"], "start_s", "start_s", ["chunk_index"]).groupBy("track_id", F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index")).agg(F.count("*").alias("words"))


def timeline_active_word(s, d):
    """The word spoken at every fifth second of each track; -1 before the first."""
    starts = table(s, d, "word_times").filter("track_id is not null and word_index >= 0 and start_s >= 0").groupBy("track_id", F.floor(F.col("start_s") * 10_000 + 0.5).alias("t")).agg(F.max("word_index").alias("word_index"))
    ends = starts.groupBy("track_id").agg(F.max("t").alias("last"))
    grid = ends.select("track_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / (GRID_S * 10_000)))).alias("k")).select("track_id", (F.col("k") * GRID_S * 10_000).alias("at"))
    return R.as_of(grid, starts, ["track_id"], "at", "t", ["word_index"]).select("track_id", "at", F.coalesce("word_index", F.lit(-1)).alias("word_index"))


def timeline_violations(s, d):
    """Broken invariants of each track's words, counted by kind."""
    w = _words(s, d)
    facts = table(s, d, "word_times").filter("track_id is not null").groupBy("track_id").agg(F.round(F.percentile("end_s", 0.5) * 2, 4).alias("duration"), (F.max("chunk_index") + 1).alias("chunks"))
    found = L.violations(w.join(facts, "track_id"), ["track_id"], ["word_index"], "duration", "chunks")
    return found.groupBy("track_id", "violation").agg(F.count("*").alias("n"))


def timeline_coverage(s, d):
    """Aligned words against the reader's words, per chunk of a section."""
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).join(table(s, d, "sections").dropDuplicates(["section_id"]).select("section_id", F.col("sequence").alias("seq")), "section_id")
    reader = c.select("source_id", F.col("seq").alias("sequence"), "chunk_index", T.word_count(F.col("text")).cast("bigint").alias("reader"))
    reader = reader.groupBy("source_id", "sequence", "chunk_index").agg(F.sum("reader").alias("reader"))
    words = table(s, d, "word_times").filter("word is not null and chunk_index is not null").select("source_id", "sequence", "chunk_index", "word_index").distinct()
    aligned = words.groupBy("source_id", "sequence", "chunk_index").agg(F.count("*").alias("aligned"))
    both = reader.join(aligned, ["source_id", "sequence", "chunk_index"], "left").fillna(0, ["aligned"])
    return L.coverage(both, ["source_id", "sequence"])


def timeline_coverage_totals(s, d):
    return L.coverage_totals(timeline_coverage(s, d), ["source_id", "sequence"])


def timeline_monotonic(s, d):
    """Words of each track made to follow each other; ten-thousandths of a second."""
    w = _words(s, d).filter("start_s is not null and end_s is not null")
    ticks = lambda c: F.floor(F.col(c) * 10_000 + 0.5)
    placed = w.select("track_id", "word_index", (F.row_number().over(Window.partitionBy("track_id").orderBy("word_index")) - 1).alias("i"), ticks("start_s").alias("from_pos"), ticks("end_s").alias("to_pos"))
    return L.monotonic(placed, ["track_id"], "i", "from_pos", "to_pos").select("track_id", "word_index", "from_pos", "to_pos")


def seam_policy(s, d):
    """Recorded pauses against the policy, by break type."""
    x = _seams(s, d).filter("pause_end_frame > pause_start_frame and pause_start_frame >= 0")
    want = A.frames(A.pause_ms(F.col("break_type")))
    have = F.col("pause_end_frame") - F.col("pause_start_frame")
    return x.groupBy("kind", "break_type").agg(F.count("*").alias("n"), F.count_if(have == want).alias("kept"), F.count_if(F.abs(have / 24 - F.col("pause_ms")) > 1).alias("ms_wrong"), F.sum(have - want).alias("frames_over"))


def seam_classified(s, d):
    """The break type the texts on both sides call for, against the recorded one."""
    x = _seams(s, d).filter("before_text is not null and after_text is not null")
    return x.groupBy("break_type", A.break_type(F.col("before_text"), F.col("after_text"), F.col("break_type") == "paragraph").alias("called_for")).agg(F.count("*").alias("n"))


def _edits(s: SparkSession, d: str) -> DataFrame:
    x = L.pause_edits(_seams(s, d).filter("track_id is not null"))
    return x.groupBy("track_id", "old_end").agg(F.max("delta").alias("delta"))


def seam_edits(s, d):
    return _edits(s, d)


def seam_shifted_words(s, d):
    """Word starts in frames after the pauses were put right."""
    w = _words(s, d).filter("start_s >= 0").select("track_id", "word_index", F.floor(F.col("start_s") * A.FRAME_RATE + 0.5).cast("bigint").alias("frame"))
    return L.shifted(w, _edits(s, d), ["track_id"]).select("track_id", "word_index", "frame", "new_frame")


def seam_gap_by_kind(s, d):
    """Average pause in milliseconds by kind, paragraphs against the rest."""
    x = _seams(s, d).filter("pause_end_frame > pause_start_frame and pause_start_frame >= 0")
    ms = (F.col("pause_end_frame") - F.col("pause_start_frame")) / 24
    return x.groupBy("kind").agg(F.round(F.avg(F.when(F.col("break_type") == "paragraph", ms)), 4).alias("paragraph_ms"), F.round(F.avg(F.when(F.col("break_type") != "paragraph", ms)), 4).alias("other_ms"))


def seam_ledger(s, d):
    """Running frames of pause within each track, in frame order."""
    x = _seams(s, d).filter("track_id is not null and pause_end_frame > pause_start_frame and pause_start_frame >= 0").groupBy("track_id", "pause_start_frame").agg(F.max(F.col("pause_end_frame") - F.col("pause_start_frame")).alias("frames"))
    w = Window.partitionBy("track_id").orderBy("pause_start_frame")
    return x.select("track_id", "pause_start_frame", "frames", F.sum("frames").over(w).alias("cursor"))


def timeline_segments(s, d):
    """Each chunk's time shared among its sentences by units."""
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).filter("text is not null").select("chunk_id", F.col("chunk_index").cast("double").alias("start_s"), (F.col("chunk_index") + 1).cast("double").alias("end_s"), T.plain_sentences(F.col("text")).alias("sentences"))
    c = c.withColumn("units", F.transform("sentences", T.unit_count))
    return L.sentence_segments(c, "sentences", "units").groupBy("chunk_id").agg(F.count("*").alias("segments"), F.round(F.max("to_s"), 6).alias("last_s"))


QUERIES = {f.__name__: f for f in (timeline_next_start, timeline_word_chunk, timeline_active_word, timeline_violations, timeline_coverage, timeline_coverage_totals, timeline_monotonic, timeline_segments, seam_policy, seam_classified, seam_edits, seam_shifted_words, seam_gap_by_kind, seam_ledger)}

_S = "se as (select distinct track_id, kind, break_type, after_chunk_index, after_segment_index, after_unit_index, pause_start_frame, pause_end_frame, pause_ms, before_text, after_text from seam_audits)"
_POL = "case break_type when 'paragraph' then 600 when 'sentence' then 350 when 'phrase' then 180 when 'quote' then 180 when 'inner_thought' then 180 when 'technical' then 0 else 120 end"
_ED = f"{_S}, ed as (select track_id, old_end, max(delta) as delta from (select track_id, pause_end_frame as old_end, pause_start_frame + {_POL} * 24 - pause_end_frame as delta from se where track_id is not null and pause_start_frame >= 0 and pause_end_frame >= pause_start_frame) where delta <> 0 group by all)"
_COV = "ch as (select * from chunks qualify row_number() over (partition by chunk_id order by chunk_id) = 1), sc as (select section_id, sequence as seq from sections qualify row_number() over (partition by section_id order by section_id) = 1), rd as (select ch.source_id, seq as sequence, chunk_index, sum(len(list_filter(regexp_split_to_array(text, '[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> ''))) as reader from ch join sc using (section_id) group by all), al as (select source_id, sequence, chunk_index, count(distinct word_index) as aligned from word_times where word is not null and chunk_index is not null and word_index is not null group by all), cv as (select rd.source_id, rd.sequence, rd.chunk_index, reader::bigint as reader, coalesce(aligned, 0) as aligned from rd left join al on rd.source_id = al.source_id and rd.sequence = al.sequence and rd.chunk_index = al.chunk_index), cc as (select *, case when reader = 0 then case when aligned = 0 then 1.0 else 0.0 end else round_even(aligned / reader, 4) end as ratio, case when aligned < reader then aligned end as first_missing, coalesce(sum(reader) over (partition by source_id, sequence order by chunk_index rows between unbounded preceding and 1 preceding), 0) + case when aligned < reader then aligned end as missing_at from cv)"
_Q = "\"''“”‘’"
_BARE = f"regexp_replace(rtrim(before_text), '[{_Q})\\]}}]+$', '')"
_LAST = f"case when {_BARE} = '' then right(rtrim(before_text), 1) else right({_BARE}, 1) end"
_HAN = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3134f}]"
_WS = r"[\s\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SAID = f"list_filter(case when regexp_matches(text, '{_HAN}') then regexp_extract_all(text, '[^。！？!?]+[。！？!?]*[”’」』]*|[。！？!?]+') else string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(2), 'g'), chr(2)) end, lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g')) <> '')"
ORACLES = {
    "timeline_segments": f"with c as (select * from chunks where text is not null qualify row_number() over (partition by chunk_id order by chunk_id) = 1) select chunk_id, len({_SAID}) as segments, (chunk_index + 1)::double as last_s from c where len({_SAID}) > 0",
    "timeline_violations": f"with {_W}, fa as (select track_id, round(quantile_cont(end_s, 0.5) * 2, 4) as duration, max(chunk_index) + 1 as chunks from word_times where track_id is not null group by 1), x as (select ww.*, duration, chunks, lag(start_s) over (partition by ww.track_id order by word_index) as prev from ww join fa using (track_id)), v as (select track_id, unnest(list_filter([case when trim(coalesce(word, '')) = '' then 'empty word' end, case when start_s < 0 then 'start negative' end, case when end_s < 0 then 'end negative' end, case when start_s > duration then 'start beyond' end, case when end_s > duration then 'end beyond' end, case when chunk_index < 0 or chunk_index >= chunks then 'chunk out of range' end, case when start_s < prev then 'start backward' end], lambda y: y is not null)) as violation from x) select track_id, violation, count(*) as n from v group by all",
    "seam_classified": f"with {_S} select break_type, case when break_type = 'paragraph' then 'paragraph' when trim(before_text) = '' or trim(after_text) = '' then 'word' when {_LAST} in ('.', '?', '!') then 'sentence' when {_LAST} in (',', ';', ':', '-', '–', '—') then 'phrase' when contains('{_Q}', right(rtrim(before_text), 1)) or contains('{_Q}', left(ltrim(after_text), 1)) then 'quote' else 'word' end as called_for, count(*) as n from se where before_text is not null and after_text is not null group by all",
    "timeline_next_start": f"with {_C} select *, (select min_by(c2.start_s, c2.chunk_index) from c c2 where c2.track_id = c.track_id and c2.chunk_index > c.chunk_index and c2.start_s >= 0) as next_start from c",
    "timeline_word_chunk": f"with {_C}, st as (select track_id, start_s, max(chunk_index) as chunk_index from c where start_s >= 0 group by all), w as (select distinct track_id, word_index, start_s from word_times where track_id is not null and start_s >= 0), j as (select w.track_id, coalesce(st.chunk_index, -1) as chunk_index from w asof left join st on w.track_id = st.track_id and w.start_s >= st.start_s) select track_id, chunk_index, count(*) as words from j group by all",
    "timeline_active_word": f"with st as (select track_id, floor(start_s * 10000 + 0.5)::bigint as t, max(word_index) as word_index from word_times where track_id is not null and word_index >= 0 and start_s >= 0 group by all), g as (select track_id, unnest(range(0, (max(t) // {GRID_S * 10000}) + 1)) * {GRID_S * 10000} as at from st group by track_id) select g.track_id, g.at, coalesce(st.word_index, -1) as word_index from g asof left join st on g.track_id = st.track_id and g.at >= st.t",
    "timeline_coverage": f"with {_COV} select source_id, sequence, chunk_index, reader, aligned, ratio, first_missing, missing_at from cc",
    "timeline_coverage_totals": f"with {_COV}, t as (select source_id, sequence, sum(reader) as reader, sum(aligned) as aligned, min(missing_at) as first_missing from cc group by all) select *, case when reader = 0 then case when aligned = 0 then 1.0 else 0.0 end else round_even(aligned / reader, 4) end as ratio from t",
    "timeline_monotonic": f"with {_W}, v as (select track_id, word_index, row_number() over (partition by track_id order by word_index) - 1 as i, floor(start_s * 10000 + 0.5)::bigint as s, floor(end_s * 10000 + 0.5)::bigint as e from ww where start_s is not null and end_s is not null), m as (select *, 10 * i + max(greatest(e, s + 10, 10) - 10 * i) over (partition by track_id order by i) as fin from v) select track_id, word_index, greatest(s, coalesce(lag(fin) over (partition by track_id order by i), 0)) as from_pos, fin as to_pos from m",
    "seam_policy": f"with {_S} select kind, break_type, count(*) as n, count(*) filter (pause_end_frame - pause_start_frame = {_POL} * 24) as kept, count(*) filter (abs((pause_end_frame - pause_start_frame) / 24 - pause_ms) > 1) as ms_wrong, sum(pause_end_frame - pause_start_frame - {_POL} * 24)::bigint as frames_over from se where pause_end_frame > pause_start_frame and pause_start_frame >= 0 group by all",
    "seam_edits": f"with {_ED} select * from ed",
    "seam_shifted_words": f"with {_ED}, {_W}, p as (select track_id, word_index, floor(start_s * 24000 + 0.5)::bigint as frame from ww where start_s >= 0), r as (select track_id, old_end, sum(delta) over (partition by track_id order by old_end) as shift from ed) select p.track_id, p.word_index, p.frame, (p.frame + coalesce(r.shift, 0))::bigint as new_frame from p asof left join r on p.track_id = r.track_id and p.frame >= r.old_end",
    "seam_gap_by_kind": f"with {_S} select kind, round(avg((pause_end_frame - pause_start_frame) / 24) filter (break_type = 'paragraph'), 4) as paragraph_ms, round(avg((pause_end_frame - pause_start_frame) / 24) filter (break_type <> 'paragraph'), 4) as other_ms from se where pause_end_frame > pause_start_frame and pause_start_frame >= 0 group by all",
    "seam_ledger": f"with {_S}, x as (select track_id, pause_start_frame, max(pause_end_frame - pause_start_frame) as frames from se where track_id is not null and pause_end_frame > pause_start_frame and pause_start_frame >= 0 group by all) select *, sum(frames) over (partition by track_id order by pause_start_frame)::bigint as cursor from x",
}
