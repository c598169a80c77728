"""Pause policy and sample-array scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PAUSES_MS = {"paragraph": 600, "sentence": 350, "phrase": 180, "quote": 180, "inner_thought": 180, "word": 120, "technical": 0}
FRAME_RATE = 24_000
QUOTES = "\"'“”‘’"


def pause_ms(break_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PAUSES_MS.items() for x in pair))
    return F.coalesce(table[break_type], F.lit(PAUSES_MS["word"]))


def frames(ms: Column, rate: Column | int = FRAME_RATE) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.bround(rate * ms / 1000).cast("bigint")


def break_type(before: Column, after: Column, paragraph: Column, now: Column | None = None, then: Column | None = None) -> Column:
    """Which pause lies between two texts: paragraph, inner thought, then by their edge signs."""
    b, a = F.regexp_replace(before, "(?U)\\s+$", ""), F.regexp_replace(after, "(?U)^\\s+", "")
    bare = F.regexp_replace(b, f"[{QUOTES})\\]}}]+$", "")
    last = F.when(bare == "", F.right(b, F.lit(1))).otherwise(F.right(bare, F.lit(1)))
    thought = F.lit(False)
    for kind in (now, then):
        if kind is not None:
            thought = thought | F.coalesce(kind == "inner_thought", F.lit(False))
    return (
        F.when(paragraph | F.contains(F.right(before, F.lit(4)), F.lit("\n\n")) | F.startswith(after, F.lit("\n\n")), "paragraph")
        .when(thought, "inner_thought")
        .when((b == "") | (a == ""), "word")
        .when(last.isin(".", "?", "!"), "sentence")
        .when(last.isin(",", ";", ":", "-", "–", "—"), "phrase")
        .when(F.right(b, F.lit(1)).isin(*QUOTES) | F.left(a, F.lit(1)).isin(*QUOTES), "quote")
        .otherwise("word")
    )


def peak(audio: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(audio, lambda x: F.abs(x))), F.lit(0.0))


def normalize(audio: Column, target: float = 0.89) -> Column:
    """Scaled so that the loudest sample has the target; silence stays."""
    top = peak(audio)
    return F.when(top > 0, F.transform(audio, lambda x: x * (F.lit(target) / top))).otherwise(audio)


def fade(audio: Column, rate: int, ms: int) -> Column:
    """Linear ramps at both ends, together at most the whole."""
    n = F.size(audio)
    ramp = F.least(F.lit(rate * ms // 1000), F.floor(n / 2).cast("int"))
    scale = lambda i: F.when(ramp <= 1, F.when((i < ramp) | (i >= n - ramp), 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), i / (ramp - 1), (n - 1 - i) / (ramp - 1)))
    return F.transform(audio, lambda x, i: x * scale(i))


def limit_silence(audio: Column, rate: int, most_ms: int, floor: float = 0.005, share: float = 0.02) -> Column:
    """At most ``most_ms`` of silence kept before the first and behind the last voiced sample."""
    level = F.greatest(F.lit(floor), peak(audio) * share)
    voiced = F.filter(F.transform(audio, lambda x, i: F.when(F.abs(x) >= level, i)), lambda i: i.isNotNull())
    keep = rate * most_ms // 1000
    start = F.greatest(F.array_min(voiced) - keep, F.lit(0))
    end = F.least(F.array_max(voiced) + 1 + keep, F.size(audio))
    return F.when(F.size(voiced) == 0, audio).otherwise(F.slice(audio, start + 1, end - start))


def rms(audio: Column, start: Column, length: int) -> Column:
    window = F.slice(audio, start + 1, length)
    square = F.aggregate(window, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return F.when(F.size(window) > 0, F.sqrt(square / F.size(window))).otherwise(0.0)


def silence_length(audio: Column, start: Column, end: Column, step: int, level: float = 0.01) -> Column:
    """Samples of silence from ``start`` on: whole steps whose root mean square is under the level."""
    starts = F.sequence(start, F.greatest(start, end - step), F.lit(step))
    loud = F.filter(F.transform(starts, lambda s: F.when(rms(audio, s, step) >= level, s)), lambda s: s.isNotNull())
    return F.when(end - start < step, 0).otherwise(F.coalesce(F.get(loud, F.lit(0)) - start, F.size(starts) * step))
