"""Nested artifacts of sections and tracks: headings, elements, chunks, alignment, synthesis units and their repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import audio as A
from inkwell.functions import headings as H
from inkwell.functions import text as T
from inkwell.operators import timeline as L

VERSION = 2


def build_heading(kind: Column, ordinal: Column, texts: Column, inline: Column, nav: Column, language: Column) -> Column:
    """display_label, display_title and spoken_text of a section from its heading lines, inline title and navigation label."""
    blank = F.lit("")
    first, second = F.coalesce(F.get(texts, F.lit(0)), blank), F.coalesce(F.get(texts, F.lit(1)), blank)
    many, none = F.size(texts) > 1, F.size(texts) == 0
    joined = F.array_join(texts, " — ")
    numbered = first.rlike(H.CHAPTER) | first.rlike(H.ORDINAL) | first.rlike(H.CHINESE_CHAPTER)
    titled = F.coalesce(F.nullif(inline, blank), second)
    label_c = F.when(none | ~numbered, blank).otherwise(first)
    title_c = F.when(none, nav).when(numbered, titled).when(many, joined).otherwise(first)
    english = F.startswith(F.lower(language), F.lit("en"))
    source = F.coalesce(F.nullif(F.array_join(texts, " "), blank), F.concat_ws(" ", F.nullif(label_c, blank), F.nullif(title_c, blank)))
    spoken_c = F.when(ordinal.isNotNull() & english, H.chapter_spoken(ordinal, title_c, language)).when(ordinal.isNotNull(), T.terminal_punctuation(source)).otherwise(F.coalesce(F.nullif(title_c, blank), label_c))
    default = F.when(kind == "other", blank).otherwise(F.initcap(F.translate(kind, "_", " ")))
    named = F.regexp_replace(F.lower(first), "^[ .:]+|[ .:]+$", "") == kind
    label_o = F.when(none, F.coalesce(F.nullif(default, blank), nav)).when(named, first).otherwise(default)
    title_o = F.when(none, F.when((default != "") & (nav != "") & (F.lower(nav) != F.lower(default)), nav).otherwise(blank)).when(named, titled).otherwise(joined)
    spoken_o = T.terminal_punctuation(F.concat_ws(". ", F.nullif(label_o, blank), F.nullif(title_o, blank)))
    chapter = kind == "chapter"
    return F.struct(F.when(chapter, label_c).otherwise(label_o).alias("display_label"), F.when(chapter, title_c).otherwise(title_o).alias("display_title"), F.when(chapter, spoken_c).otherwise(spoken_o).alias("spoken_text"))


def elements(sections: DataFrame, key: str, sequence: str, paragraphs: str) -> DataFrame:
    """The nonempty elements of each section, numbered, with ids that name section and place."""
    filled = F.filter(F.transform(paragraphs, lambda p: T.clean_extracted(F.coalesce(p, F.lit("")))), lambda p: p != "")
    rows = sections.select(key, F.coalesce(sequence, F.lit(0)).alias("__s"), F.posexplode(filled).alias("place", "text"))
    return rows.select(key, "place", F.format_string("sec%d-el%04d", "__s", "place").alias("element_id"), "text")


def parse_artifact(sections: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """One nested row a section: version, its heading and counts, and its elements in order."""
    grouped = made.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", F.col("element_id").alias("id"), "text"))).alias("elements"))
    body = F.struct(F.lit(VERSION).alias("version"), "sequence", "section_type", "ordinal", "heading", "word_count", F.coalesce("elements", F.array().cast("array<struct<place:int,id:string,text:string>>")).alias("elements"))
    return sections.join(grouped, key, "left").select(key, body.alias("artifact"))


def chunk_artifact(sections: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One nested row a section: version, heading, and its chunks in order with their hashes."""
    item = F.struct(F.col("chunk_index").alias("index"), "text", "para_start", "para_end", T.text_hash(F.col("text")).alias("text_hash"))
    grouped = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", item.alias("c")))).alias("l")).select(key, F.transform("l", lambda x: x["c"]).alias("chunks"))
    body = F.struct(F.lit(VERSION).alias("version"), "sequence", "section_type", "ordinal", "heading", "chunks")
    return sections.join(grouped, key).select(key, body.alias("artifact"))


def sync_artifact(words: DataFrame, reader: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One nested row a section: chunk starts (-1 where skipped), coverage and words of each chunk, heading words apart.

    ``words`` has the keys, region, chunk_index, word_index, word, start_s, end_s;
    ``reader`` the keys, chunk_index and the reader's word count.
    """
    keys = list(keys)
    entry = F.struct("word_index", "word", "start_s", "end_s")
    chunked = words.filter("chunk_index is not null").groupBy(*keys, "chunk_index").agg(F.array_sort(F.collect_list(entry)).alias("words"), F.min(F.when(F.col("start_s") >= 0, F.col("start_s"))).alias("first"))
    both = reader.join(chunked, [*keys, "chunk_index"], "left").withColumns({"words": F.coalesce("words", F.array().cast("array<struct<word_index:int,word:string,start_s:double,end_s:double>>")), "first": F.coalesce("first", F.lit(-1.0))}).withColumn("aligned", F.size("words").cast("bigint"))
    covered = L.coverage(both, keys)
    chunk = F.struct("chunk_index", F.col("first").alias("audio_start"), "reader", "aligned", "ratio", "first_missing", "missing_at", "words")
    body = covered.groupBy(*keys).agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.sum("reader").alias("reader"), F.sum("aligned").alias("aligned"), F.min("missing_at").alias("first_missing"))
    heading = words.filter("chunk_index is null").groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("heading_words"))
    return body.join(heading, keys, "left").withColumn("ratio", L.coverage_ratio(F.col("aligned"), F.col("reader")))


def section_timeline(chunks: DataFrame, keys: Sequence[str], lead_frames: int, gap: Column) -> DataFrame:
    """Where each chunk begins and ends on its section's audio, in frames: a lead-in, then chunks with gaps between them.

    ``chunks`` has the keys, chunk_index and frames (null for a chunk that
    failed).  A failed chunk starts at -1 and takes no room; the gap stands
    before every chunk but the first that sounds.
    """
    w = Window.partitionBy(*keys).orderBy("chunk_index")
    sounds = F.col("frames").isNotNull()
    earlier = F.coalesce(F.sum(F.when(sounds, F.col("frames"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.coalesce(F.sum(sounds.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("__g", F.when(sounds & (before > 0), gap).otherwise(0))
    start = F.lit(lead_frames) + earlier + F.sum("__g").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("start_frame", F.when(sounds, start).otherwise(-1).cast("bigint")).withColumn("end_frame", F.when(sounds, F.col("start_frame") + F.col("frames")).cast("bigint")).drop("__g")


def unit_ledger(units: DataFrame, keys: Sequence[str], order: Sequence[str], rate: int = A.FRAME_RATE) -> DataFrame:
    """A running frame cursor over units: each unit's interval, and behind it the seam its break type calls for.

    ``units`` has the keys, the order, frames and break_type (null behind the last).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    pause = F.when(F.col("break_type").isNull(), 0).otherwise(A.frames(A.pause_ms(F.col("break_type")), rate))
    rows = units.withColumn("__p", pause).withColumn("end_frame", F.sum("frames").over(w) + F.coalesce(F.sum("__p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("start_frame", F.col("end_frame") - F.col("frames")).withColumn("pause_end_frame", F.col("end_frame") + F.col("__p")).drop("__p")


def render_units(segments: DataFrame, key: str, text: str, most: int = 400) -> DataFrame:
    """A segment's sentences, longer ones by windows of words, with the break behind each but the last."""
    sentences = T.plain_sentences(F.col(text))
    units = F.flatten(F.transform(sentences, lambda s: F.when(F.length(s) > most, T.word_windows(s, 40)).otherwise(F.array(s))))
    rows = segments.select(key, units.alias("u")).select(key, "u", F.posexplode("u").alias("unit_index", "unit"))
    after = F.get("u", F.col("unit_index") + 1)
    return rows.select(key, "unit_index", "unit", F.when(after.isNotNull(), A.break_type(F.col("unit"), after, F.lit(False))).alias("break_type"))


def shifted_times(words: DataFrame, edits: DataFrame, keys: Sequence[str], rate: int = A.FRAME_RATE) -> DataFrame:
    """Starts and ends in seconds moved by the pause edits, by way of frames, to four places; negative ones stay."""
    frames = lambda c: F.floor(F.col(c) * rate + 0.5).cast("bigint")
    ends = words.select(*keys, "word_index", F.inline(F.array(F.struct(F.lit("start_s").alias("bound"), frames("start_s").alias("frame")), F.struct(F.lit("end_s").alias("bound"), frames("end_s").alias("frame"))))).filter("frame is not null")
    moved = L.shifted(ends, edits, list(keys))
    ten = F.col("new_frame") * 10_000
    whole, rest = F.floor(ten / rate), F.pmod(ten, F.lit(rate)) * 2
    even = whole + ((rest > rate) | ((rest == rate) & (whole % 2 == 1))).cast("bigint")
    value = F.when(F.col("frame") < 0, -1.0).otherwise(even / 10_000)
    return moved.groupBy(*keys, "word_index").agg(F.max(F.when(F.col("bound") == "start_s", value)).alias("start_s"), F.max(F.when(F.col("bound") == "end_s", value)).alias("end_s"))


def shifted_seams(seams: DataFrame, edits: DataFrame, keys: Sequence[str], rate: int = A.FRAME_RATE) -> DataFrame:
    """Seams after the edits: moved, and each as long as the policy says."""
    moved = L.shifted(seams.withColumn("frame", F.col("pause_start_frame")), edits, list(keys))
    ms = A.pause_ms(F.col("break_type"))
    return moved.withColumn("new_end", F.col("new_frame") + A.frames(ms, rate)).withColumn("new_ms", ms)


def coverage_line(sequence: Column, aligned: Column, reader: Column, ratio: Column) -> Column:
    """A section's coverage as a line of a report."""
    return F.format_string("section %02d: %d/%d words (%.1f%%)", sequence, aligned, reader, F.bround(ratio * 1000) / 10)
