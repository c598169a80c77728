"""Scalars of dialogue and performance direction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import token_count

# Fixed values.
SPEEDS = {"slow": 0.85, "normal": 0.95, "fast": 1.05}
NARRATOR = "narrator"
DELIVERY_TYPES = "spoken_dialogue internal_thought self_talk recitation written_text embedded_text ambiguous narration".split()
VOICE_POLICIES = "narrator narrator_compatible character distinct_character".split()
COMPATIBLE = "internal_thought self_talk written_text embedded_text ambiguous".split()
LONG_WORDS, SHORT_WORDS, MEDIUM_WORDS, SHORT_CHARS = 24, 12, 24, 60
CAPS = {"short_prose": 0.45, "short_expressive": 0.6, "medium": 0.65, "long": 0.8}
EMOTIONS = {
    "neutral": (0.5, 0.5),
    "happy": (0.72, 0.42),
    "sad": (0.38, 0.58),
    "angry": (0.85, 0.34),
    "anxious": (0.78, 0.36),
    "surprised": (0.82, 0.38),
    "amused": (0.68, 0.44),
}
TAG_NAMES = "he|she|it|they|we|i|alice|rabbit|queen|king|hatter|gryphon|mock turtle|dormouse|mouse|duchess|cat"
TAG_VERBS = "said|thought|cried|replied|asked|answered|continued|went on|whispered|shouted|muttered|remarked|exclaimed|called|sang|sighed|sobbed"
DIALOGUE_TAG = f"(?iU)^\\s*[,;:!?—-]*\\s*(?:(?:{TAG_NAMES})\\s+)?(?:{TAG_VERBS})\\b"
POV_MARKERS = ["main pov", "main character", "protagonist", "central character", "title character", "heroine", "hero"]
BATCH_WORDS, BATCH_CHARS, QUOTE_BATCH = 1500, 10_000, 20


def norm(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "(?U)\\s+", " "))


def has_quote(text: Column) -> Column:
    return text.rlike('["“”]')


def quote_spans(text: Column) -> Column:
    """Double-quoted spans: a curly quote ends at ”, a straight one at the next " or ”; unended ones don't count.

    A pattern tiles the text into gaps and quotes, so a span's start is the
    length of the tiles before it; an unended quote swallows the rest, as
    nothing behind it can open.
    """
    tiles = F.regexp_extract_all(text, F.lit('(?s)[^“"]+|“[^”]*(?:”|\\z)|"[^"”]*(?:["”]|\\z)'), F.lit(0))
    empty = F.struct(F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"), F.lit(0).alias("at"))

    def step(acc: Column, tile: Column) -> Column:
        end = acc["at"] + F.length(tile)
        quoted = tile.rlike('(?s)^(?:“[^”]*”|"[^"”]*["”])$')
        span = F.struct(acc["at"].alias("start"), end.alias("end"), tile.alias("text"))
        return F.struct(F.when(quoted, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"), end.alias("at"))

    return F.aggregate(tiles, empty, step, lambda a: a["spans"])


def is_dialogue_tag(text: Column) -> Column:
    return (F.length(F.trim(text)) <= 120) & text.rlike(DIALOGUE_TAG)


def delivery_type(value: Column, speaker: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v.isin(*DELIVERY_TYPES), v).when(norm(speaker) == NARRATOR, "written_text").otherwise("spoken_dialogue")


def voice_policy(value: Column, speaker: Column, delivery: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v.isin(*VOICE_POLICIES), v).when(norm(speaker) == NARRATOR, "narrator").when(delivery.isin(*COMPATIBLE), "narrator_compatible").otherwise("character")


def complete_quote(text: Column) -> Column:
    """Begins with an opening quote and ends, trailing signs aside, with a closing one behind it."""
    t = F.trim(text)
    bare = F.regexp_replace(t, "[ \\t\\r\\n,.;:!?)\\]}]+$", "")
    return (t != "") & F.left(t, F.lit(1)).isin('"', "“", "‘") & F.right(bare, F.lit(1)).isin('"', "”", "’")


def short_unit(text: Column) -> Column:
    return (token_count(text) < SHORT_WORDS) | (F.length(F.trim(text)) < SHORT_CHARS)


def boundary_tail(text: Column) -> Column:
    """The last sign, closers and white space aside."""
    return F.right(F.regexp_replace(text, "(?U)[\"”’')\\]}\\s]+$", ""), F.lit(1))


def boundary_allowed(left: Column, right: Column) -> Column:
    ends = boundary_tail(left).isin(".", "!", "?") | complete_quote(left)
    return (F.trim(left) != "") & (F.trim(right) != "") & (ends | boundary_tail(left).isin(":", "—", "-") & complete_quote(right))


def speed(label: Column, speaker: Column, text: Column) -> Column:
    """The label's rate; the narrator's at most 1, and at most normal beyond 24 words."""
    table = F.create_map(*(F.lit(x) for pair in SPEEDS.items() for x in pair))
    cap = F.when(norm(speaker) != NARRATOR, 9.0).when(token_count(F.translate(text, "'", " ")) > LONG_WORDS, SPEEDS["normal"]).otherwise(1.0)
    return F.least(table[label], cap)


def intensity_cap(text: Column, delivery: Column) -> Column:
    expressive = delivery.isin("internal_thought", "self_talk") | complete_quote(text)
    return F.when(short_unit(text), F.when(expressive, CAPS["short_expressive"]).otherwise(CAPS["short_prose"])).when(token_count(text) < MEDIUM_WORDS, CAPS["medium"]).otherwise(CAPS["long"])


def intensity(emotion: Column, value: Column, text: Column, delivery: Column) -> Column:
    given = F.coalesce(value, F.lit(0.5))
    return F.when(emotion == "neutral", given).otherwise(F.least(given, intensity_cap(text, delivery)))


def pause_after(value: Column, join_policy: Column, policy: Column, delivery: Column) -> Column:
    """0..120 ms; none where the text runs on; null for values outside 0..2000."""
    v = F.coalesce(value, F.lit(0))
    tight = (join_policy == "tight") | (policy == "narrator_compatible") | delivery.isin("internal_thought", "self_talk")
    return F.when(v.between(0, 2000), F.when(tight, 0).otherwise(F.least(v, F.lit(120))))


def engine_controls(emotion: Column, value: Column) -> Column:
    """Controls between neutral and the emotion's target, by intensity, to four places."""
    base = EMOTIONS["neutral"]
    level = F.least(F.greatest(F.coalesce(value, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))
    target = lambda i: F.coalesce(F.create_map(*(F.lit(x) for k, v in EMOTIONS.items() for x in (k, v[i])))[F.coalesce(emotion, F.lit("neutral"))], F.lit(base[i]))
    mixed = lambda i, low, high: F.bround(F.least(F.greatest(F.lit(base[i]) + (target(i) - base[i]) * level, F.lit(low)), F.lit(high)), 4)
    return F.struct(F.bround(level, 4).alias("intensity"), mixed(0, 0.25, 1.2).alias("exaggeration"), mixed(1, 0.2, 1.0).alias("cfg_weight"))
