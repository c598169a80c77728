"""Predicates that certify sections, checkpoints, publications and writes; calls and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a prompt's wording tells of its kind, and the least coverage of a finished section.
CALL_KINDS = {
    "registry": ("casting voices",),
    "attribution": ("labeling who speaks", "assigning speakers", "audiobook performance direction to pre-extracted"),
    "emotion": ("directing an audiobook performance",),
    "chapter_pass": ("one full audiobook chapter",),
}
LEAST_COVERAGE = 0.98
SLACK_S = 0.1


def call_kind(prompt: Column) -> Column:
    """The kind of a model call by its system prompt."""
    out = F.lit("other")
    for kind, marks in reversed(CALL_KINDS.items()):
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(prompt, F.lit(mark))
        out = F.when(hit, kind).otherwise(out)
    return out


def latency(calls: DataFrame, kind: str = "kind", seconds: str = "seconds") -> DataFrame:
    """Calls of each kind: number, mean, least and most seconds; kinds without calls have no row."""
    return calls.groupBy(kind).agg(F.count("*").alias("calls"), F.round(F.avg(seconds), 6).alias("mean_s"), F.min(seconds).alias("least_s"), F.max(seconds).alias("most_s"))


def projection(means: DataFrame, attribution_units: Column, emotion_units: Column, kind: str = "kind") -> DataFrame:
    """Seconds a whole book's direction would take: units of each pass by the mean of its calls."""
    of = lambda k: F.coalesce(F.max(F.when(F.col(kind) == k, F.col("mean_s"))), F.lit(0.0))
    return means.agg(of("attribution").alias("__a"), of("emotion").alias("__e")).select(F.round(attribution_units * F.col("__a") + emotion_units * F.col("__e"), 4).alias("projected_s"))


def real_time_factor(elapsed: Column, audio: Column) -> Column:
    """Seconds of work a second of audio, to four places; null for silence."""
    return F.when(audio > 0, F.bround(elapsed / audio, 4))


def alignment_report(words: DataFrame, reader: DataFrame, keys: Sequence[str], duration: str = "duration") -> DataFrame:
    """Each track's aligned words, coverage and broken intervals; ``ok`` where there are words and none is broken.

    ``words`` has the keys, start_s, end_s and the track's duration; ``reader``
    the keys and the reader's units.
    """
    sound = (F.col("start_s") >= 0) & (F.col("end_s") >= F.col("start_s")) & (F.col("end_s") <= F.col(duration))
    found = words.groupBy(*keys).agg(F.count("*").alias("words"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("broken"))
    both = reader.join(found, list(keys), "left").fillna(0, ["words", "broken"])
    ratio = F.bround(F.col("words") / F.greatest(F.col("units"), F.lit(1)), 4)
    return both.withColumn("coverage", ratio).withColumn("ok", (F.col("words") > 0) & (F.col("broken") == 0))


def section_fault(chunks: Column, expected: Column, least_start: Column, reader: Column, expected_reader: Column, ratio: Column, last_s: Column, duration: Column) -> Column:
    """The first reason why a section isn't finished: chunks, skipped starts, words, coverage, or times beyond the audio."""
    return (
        F.when(chunks != expected, "chunks")
        .when(least_start < 0, "skipped")
        .when(reader != expected_reader, "words")
        .when(ratio < LEAST_COVERAGE, "coverage")
        .when(~F.coalesce((duration > 0) & (last_s <= duration + SLACK_S), F.lit(False)), "times")
    )


def checkpoint_fault(version: Column, fingerprint: Column, wanted: Column, rate: Column, frames: Column, sound: Column, expected_rate: int) -> Column:
    """Why a kept region can't be taken up again; ``sound`` tells that every word of it has a start and a later end."""
    return F.when(~version.eqNullSafe(F.lit(1)), "version").when(~fingerprint.eqNullSafe(wanted), "fingerprint").when(~rate.eqNullSafe(F.lit(expected_rate)), "rate").when(F.coalesce(frames, F.lit(0)) <= 0, "frames").when(~sound, "words")


def write_verdicts(current: DataFrame, incoming: DataFrame, keys: Sequence[str], fields: Sequence[str], force: Column) -> DataFrame:
    """What writing each incoming record would do: create it, nothing, replace it by force, or conflict."""
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    a, b = current.select(*keys, digest.alias("__a")), incoming.select(*keys, digest.alias("__b"), force.alias("__f"))
    both = b.join(a, list(keys), "left")
    verdict = F.when(F.col("__a").isNull(), "create").when(F.col("__a") == F.col("__b"), "same").when(F.col("__f"), "replace").otherwise("conflict")
    return both.select(*keys, verdict.alias("verdict"))


def published_verified(published: DataFrame, sources: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Published editions with whether their source is known and each of their sections was delivered with its build.

    ``published``: catalog_id, source, current_build, section_count; ``sources``:
    source_id; ``deliveries``: source_id, build, sections.
    """
    known = sources.select(F.col("source_id").alias("source")).distinct().withColumn("known", F.lit(True))
    had = deliveries.groupBy(F.col("source_id").alias("source"), F.col("build").alias("current_build")).agg(F.max("sections").alias("sections"))
    rows = published.join(known, "source", "left").join(had, ["source", "current_build"], "left")
    return rows.select("catalog_id", F.coalesce("known", F.lit(False)).alias("known"), F.col("sections").isNotNull().alias("delivered"), F.coalesce(F.col("sections") >= F.col("section_count"), F.lit(False)).alias("complete"))
