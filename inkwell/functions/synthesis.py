"""Text made ready for speech: cues, units under a length, joins, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import HAN, UNIT, _let, chinese_sentences, collapse_space, has_han, token_count, unit_count

# Fixed values.
CUES = "anxious anxiously breathy bright brightly calm curious excited gentle neutral sigh singing sings soft softly somber tense warm warmly weary whisper"
UNIT_CHARS, LEAST_WORDS, LEAST_CHARS = 320, 8, 40
CHAPTER_LABEL = "(?i)^(?:chapter\\s+)?(?:[ivxlcdm]+|\\d+)\\.?$"
SENTENCE_END = "[.!?。！？][\"'”’」』)\\]]*\\s*$"

_CUE = "(?i)\\[\\s*(?:{0})(?:\\s*,\\s*(?:{0}))*\\s*\\]".format("|".join(CUES.split()))
_STRINGS = "array<string>"


def sanitize(text: Column) -> Column:
    """Without byte-order marks, bracketed cues and tags; white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("﻿"), F.lit("")), _CUE, ""), "<[^>]+>", " ")
    return collapse_space(bare)


def has_spoken(text: Column) -> Column:
    return sanitize(text).rlike("[\\p{L}\\p{N}]")


def words_of(text: Column) -> Column:
    return F.when(has_han(text), unit_count(text)).otherwise(F.size(F.regexp_extract_all(text, F.lit("(?U)\\b[\\w']+\\b"), F.lit(0))))


def sentence_units(text: Column) -> Column:
    """Sentences of collapsed text, each with its closing quotes."""
    found = F.regexp_extract_all(collapse_space(text), F.lit("(?s).+?(?:[.!?][\"'”’)\\]]*(?=\\s+|$)|$)"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def last_sentence(text: Column, most: int = 30) -> Column:
    """The last sentence, at most its last ``most`` units."""

    def of(clean: Column) -> Column:
        han = F.element_at(chinese_sentences(clean), -1)
        tail = F.regexp_extract(han, f"(?:{UNIT}[^\\p{{L}}\\p{{N}}{HAN}]*+){{{most}}}$", 0)
        chinese = F.when(unit_count(han) > most, tail).otherwise(han)
        latin = F.trim(F.element_at(F.regexp_extract_all(clean, F.lit("[^.!?]+[.!?][\"'”’]*|[^.!?]+$"), F.lit(0)), -1))
        parts = F.split(latin, " ")
        short = F.when(F.size(parts) > most, F.array_join(F.slice(parts, -most, most), " ")).otherwise(latin)
        return F.when(clean == "", "").when(has_han(clean), chinese).otherwise(F.coalesce(short, F.lit("")))

    return _let(sanitize(text), of)


def _packed(parts: Column, most: int) -> Column:
    """Parts joined by spaces while they fit into ``most`` characters; a longer part stands alone."""
    empty = F.struct(F.array().cast(_STRINGS).alias("done"), F.lit("").alias("open"))
    done = lambda a: F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"])

    def step(a: Column, part: Column) -> Column:
        joined = F.when(a["open"] == "", part).otherwise(F.concat_ws(" ", a["open"], part))
        fits = (a["open"] == "") | (F.length(joined) <= most)
        return F.struct(F.when(fits, a["done"]).otherwise(done(a)).alias("done"), F.when(fits, joined).otherwise(part).alias("open"))

    return F.aggregate(parts, empty, step, done)


def _short(unit: Column) -> Column:
    return (token_count(unit) < LEAST_WORDS) | (F.length(unit) < LEAST_CHARS)


def rebalanced(units: Column, most: int = UNIT_CHARS) -> Column:
    """A short last unit joined to the one before while both stay under the soft limit.

    Folded from the end: the tail takes in the unit before it as long as the
    rule holds, then the rest is kept.
    """
    soft = most + min(80, max(24, int(most * 0.15)))
    empty = F.struct(F.array().cast(_STRINGS).alias("kept"), F.lit(None).cast("string").alias("tail"))

    def step(a: Column, unit: Column) -> Column:
        both = F.concat_ws(" ", unit, a["tail"])
        grow = (F.size(a["kept"]) == 0) & a["tail"].isNotNull() & _short(a["tail"]) & (F.length(both) <= soft)
        return (
            F.when(a["tail"].isNull(), F.struct(a["kept"].alias("kept"), unit.alias("tail")))
            .when(grow, F.struct(a["kept"].alias("kept"), both.alias("tail")))
            .otherwise(F.struct(F.array_append(a["kept"], a["tail"]).alias("kept"), unit.alias("tail")))
        )

    return F.aggregate(F.reverse(units), empty, step, lambda a: F.reverse(F.when(a["tail"].isNull(), a["kept"]).otherwise(F.array_append(a["kept"], a["tail"]))))


def word_pack(text: Column, most: int = UNIT_CHARS) -> Column:
    return rebalanced(_packed(F.filter(F.split(text, "(?U)\\s+"), lambda w: w != ""), most), most)


def char_units(text: Column, most: int = UNIT_CHARS) -> Column:
    """A long text in units of at most ``most`` characters: whole sentences packed, longer ones by words."""
    empty = F.struct(F.array().cast(_STRINGS).alias("done"), F.lit("").alias("open"))
    done = lambda a: F.when(a["open"] != "", F.array_append(a["done"], a["open"])).otherwise(a["done"])

    def step(a: Column, s: Column) -> Column:
        joined = F.when(a["open"] == "", s).otherwise(F.concat_ws(" ", a["open"], s))
        return (
            F.when(F.length(s) > most, F.struct(F.concat(done(a), word_pack(s, most)).alias("done"), F.lit("").alias("open")))
            .when((a["open"] != "") & (F.length(joined) > most), F.struct(done(a).alias("done"), s.alias("open")))
            .otherwise(F.struct(a["done"].alias("done"), joined.alias("open")))
        )

    packed = F.aggregate(sentence_units(text), empty, step, done)
    return F.when(F.length(text) <= most, F.array(text)).otherwise(_let(packed, lambda p: F.when(F.size(p) <= 1, F.array(text)).otherwise(p)))


def true_break(left: Column, right: Column) -> Column:
    """Whether a blank line parts two paragraphs, not a label or fragment from what it belongs to."""
    a, b = sanitize(left), sanitize(right)
    return (a != "") & (b != "") & ~a.rlike(CHAPTER_LABEL) & a.rlike(SENTENCE_END) & ((words_of(b) >= 4) | F.left(b, F.lit(1)).isin('"', "“"))


def joined_fragments(left: Column, right: Column) -> Column:
    """Fragments as one text; Han signs join directly, a short open one gets a full stop."""
    a, b = sanitize(left), sanitize(right)
    open_ = ~a.rlike(SENTENCE_END) & (words_of(a) <= 8) & ~a.rlike("[,;:—-]$")
    return F.when(a == "", b).when(b == "", a).when(has_han(F.concat(a, b)), F.concat(a, b)).otherwise(F.trim(F.concat_ws(" ", F.when(open_, F.concat(a, F.lit("."))).otherwise(a), b)))


def paragraph_units(text: Column) -> Column:
    """Units between true paragraph breaks; other blank lines are joined over."""
    parts = F.filter(F.transform(F.split(text, "\\n\\s*\\n+"), lambda p: F.regexp_replace(p, "(?U)^\\s+|\\s+$", "")), lambda p: p != "")
    empty = F.struct(F.array().cast(_STRINGS).alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a: Column, p: Column) -> Column:
        return (
            F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), p.alias("open")))
            .when(true_break(a["open"], p), F.struct(F.array_append(a["done"], a["open"]).alias("done"), p.alias("open")))
            .otherwise(F.struct(a["done"].alias("done"), joined_fragments(a["open"], p).alias("open")))
        )

    folded = F.aggregate(parts, empty, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["open"])))
    return F.when(F.size(parts) <= 1, F.array(text)).otherwise(folded)
