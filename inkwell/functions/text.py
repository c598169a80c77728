"""Text scalars as JVM column expressions: language, units, hashing, cleaning, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HAN = "\\u3400-\\u9fff\\uf900-\\ufaff\\x{20000}-\\x{3134f}"
LANGUAGE_ALIASES = {"a": "en", "b": "en", "eng": "en", "z": "zh", "zho": "zh", "chi": "zh"}
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St Gen Gov Sgt Cpl Pvt Rev Hon Pres Vol Dept Univ Inc Corp Ltd Co vs etc approx Mt Ft Capt Lt Maj Col"
CHUNK_WORDS = 200
HASH_PREFIX = "sha256:"

_ALNUM = "\\p{L}\\p{N}"
_NOT_HAN_ALNUM = f"[{_ALNUM}&&[^{HAN}]]"
UNIT = f"(?:[{HAN}]|{_NOT_HAN_ALNUM}++(?:['’]{_NOT_HAN_ALNUM}++)*+)"
_BETWEEN = f"[^{_ALNUM}{HAN}]"
_SPACE = "(?U)\\s+"


def normalize_language(code: Column) -> Column:
    """First subtag in small letters, with the aliases of the two narrated languages resolved."""
    first = F.substring_index(F.translate(F.lower(code), "_", "-"), "-", 1)
    aliases = F.create_map(*(F.lit(x) for pair in LANGUAGE_ALIASES.items() for x in pair))
    return F.coalesce(aliases[first], first)


def has_han(text: Column) -> Column:
    return text.rlike(f"[{HAN}]")


def words(text: Column) -> Column:
    """White-space separated words, of any script."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def unit_count(text: Column) -> Column:
    """Han characters and other words where there is Han, else white-space words."""
    return F.when(has_han(text), F.size(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)))).otherwise(word_count(text))


def token_count(text: Column) -> Column:
    """Runs of letters, digits, underscores and apostrophes: the count used in direction."""
    return F.size(F.regexp_extract_all(text, F.lit("(?U)[\\w']+"), F.lit(0)))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.sha2(text, 256))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def clean_extracted(text: Column) -> Column:
    """Without invisible format controls, white space collapsed."""
    return collapse_space(F.regexp_replace(text, "[\\ufeff\\u200b\\u200c\\u200d\\u2060]", ""))


def slug(text: Column) -> Column:
    """Small letters; every run of others than a-z and 0-9 a hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def log_name(text: Column) -> Column:
    safe = F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "-")), "^[-.]+|[-.]+$", "")
    return F.when(safe == "", "pipeline").otherwise(safe)


def terminal_punctuation(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "", "").when(t.rlike("[.?!。！？]$"), t).otherwise(F.concat(t, F.lit(".")))


def voice_display(voice: Column) -> Column:
    """A voice id as shown: what follows the first underscore, as a title."""
    name = F.when(F.instr(voice, "_") > 0, F.regexp_extract(voice, "^[^_]*_(.*)$", 1)).otherwise(voice)
    return F.initcap(F.translate(name, "_", " "))


def rendition(engine: Column, voice: Column) -> Column:
    """Engine and voice with hyphens, the engine named once."""
    v = F.translate(voice, "_", "-")
    return F.when(F.startswith(v, F.concat(engine, F.lit("-"))), v).otherwise(F.concat_ws("-", engine, v))


def english_sentences(text: Column) -> Column:
    """Split behind . ! ? and white space, not behind an abbreviation or a lone capital."""
    guarded = F.regexp_replace(text, "\\b(" + "|".join(ABBREVIATIONS.split()) + "|[A-Z])\\.", "$1\x00")
    parts = F.split(guarded, "(?U)(?<=[.!?])\\s+")
    return F.filter(F.transform(parts, lambda s: F.replace(s, F.lit("\x00"), F.lit("."))), lambda s: F.length(collapse_space(s)) > 0)


def chinese_sentences(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit("[^。！？!?]+[。！？!?]*[”’」』]*|[。！？!?]+"), F.lit(0)), lambda s: F.length(collapse_space(s)) > 0)


def plain_sentences(text: Column) -> Column:
    """Terminators of the script: Chinese rules where there is Han, else a split behind . ! ?"""
    latin = F.filter(F.split(text, "(?U)(?<=[.!?])\\s+"), lambda s: F.length(collapse_space(s)) > 0)
    return F.when(has_han(text), chinese_sentences(text)).otherwise(latin)


def word_windows(text: Column, most: int) -> Column:
    """Windows of ``most`` words."""
    w = words(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(most)), lambda i: F.array_join(F.slice(w, i, most), " "))


def _let(value: Column, build) -> Column:
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _packed(parts: Column, size, most: int, glue: str, wide=None) -> Column:
    """Greedy packing of ``parts`` into groups of at most ``most``; a part over it alone.

    ``wide`` gives the pieces an oversized part is cut into; they aren't packed
    further.  The groups' texts, in order.
    """
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], F.array_join(acc["open"], glue))).otherwise(acc["done"])

    def step(acc: Column, part: Column) -> Column:
        def placed(n: Column) -> Column:
            fits = F.struct(acc["done"].alias("done"), F.array_append(acc["open"], part).alias("open"), (acc["n"] + n).alias("n"))
            opened = F.struct(closed(acc).alias("done"), F.array(part).alias("open"), n.alias("n"))
            out = F.when(acc["n"] + n <= most, fits)
            if wide is not None:
                cut = F.struct(F.concat(closed(acc), wide(part)).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))
                out = out.when(n > most, cut)
            else:
                out = F.when((F.size(acc["open"]) == 0) | (acc["n"] + n <= most), fits)
            return out.otherwise(opened)

        return _let(size(part), placed)

    return F.aggregate(parts, empty, step, closed)


def comma_groups(sentence: Column, most: int = CHUNK_WORDS) -> Column:
    """Parts between commas, packed; only the last group is cut into word windows when too long."""
    groups = _packed(F.split(sentence, ", "), word_count, most, ", ")
    return _let(groups, lambda g: F.concat(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), F.when(word_count(F.element_at(g, -1)) > most, word_windows(F.element_at(g, -1), most)).otherwise(F.array(F.element_at(g, -1)))))


def paragraph_pieces(paragraph: Column, most: int = CHUNK_WORDS) -> Column:
    """An oversized paragraph by sentences, too long ones by commas or words."""
    wide = lambda s: F.when(F.contains(s, F.lit(", ")), comma_groups(s, most)).otherwise(word_windows(s, most))
    return _let(english_sentences(paragraph), lambda s: F.when(F.size(s) > 0, _packed(s, word_count, most, " ", wide)).otherwise(F.array(paragraph)))


def chinese_pieces(text: Column, most: int = CHUNK_WORDS) -> Column:
    """Fragments at Chinese punctuation, packed; an oversized one cut every ``most`` units, its rest carried on."""
    fragments = F.regexp_extract_all(text, F.lit("[^。！？!?；，]+[。！？!?；，]*[”’」』]*|[。！？!?；，]+"), F.lit(0))
    windows = f"{_BETWEEN}*(?:{UNIT}{_BETWEEN}*+){{1,{most}}}+|{_BETWEEN}+"
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        joined = F.concat(acc["open"], part)
        flushed = F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
        cut = _let(F.regexp_extract_all(part, F.lit(windows), F.lit(0)), lambda w: F.struct(F.concat(flushed, F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0)))).alias("done"), F.element_at(w, -1).alias("open")))
        return F.when(unit_count(joined) <= most, F.struct(acc["done"].alias("done"), joined.alias("open"))).otherwise(cut)

    return F.aggregate(fragments, empty, step, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))


def chunks(paragraphs: Column, language: Column, element_ids: Column | None = None, most: int = CHUNK_WORDS) -> Column:
    """Paragraphs to chunks of at most ``most`` units: text, para_start, para_end, el_start, el_end.

    Null and blank paragraphs are skipped; oversized ones are cut first; then
    units are packed in order.  One row's fold, no shuffle.
    """
    chinese = normalize_language(language) == "zh"
    count = lambda t: F.when(F.coalesce(chinese, F.lit(False)), unit_count(t)).otherwise(word_count(t))
    stripped = lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "(?U)^\\s+|\\s+$", "")

    def units(p: Column, i: Column) -> Column:
        def cut(t: Column) -> Column:
            pieces = F.when(t == "", F.array().cast("array<string>")).when(count(t) <= most, F.array(t)).when(F.coalesce(chinese, F.lit(False)), chinese_pieces(t, most)).otherwise(paragraph_pieces(t, most))
            return F.transform(pieces, lambda u: F.struct(u.alias("text"), i.alias("at"), count(u).alias("n")))

        return _let(stripped(p), cut)

    parts = F.flatten(F.transform(paragraphs, units))
    chunk = "array<struct<text:string,para_start:int,para_end:int>>"
    empty = F.struct(F.array().cast(chunk).alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def closed(acc: Column) -> Column:
        made = F.struct(F.array_join(acc["open"], "\n\n").alias("text"), acc["a"].alias("para_start"), acc["b"].alias("para_end"))
        return F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], made)).otherwise(acc["done"])

    def step(acc: Column, u: Column) -> Column:
        first = F.size(acc["open"]) == 0
        fits = F.struct(acc["done"].alias("done"), F.array_append(acc["open"], u["text"]).alias("open"), (acc["n"] + u["n"]).alias("n"), F.when(first, u["at"]).otherwise(acc["a"]).alias("a"), u["at"].alias("b"))
        opened = F.struct(closed(acc).alias("done"), F.array(u["text"]).alias("open"), u["n"].alias("n"), u["at"].alias("a"), u["at"].alias("b"))
        return F.when(acc["n"] + u["n"] <= most, fits).otherwise(opened)

    made = F.aggregate(parts, empty, step, closed)
    if element_ids is None:
        return F.transform(made, lambda c: F.struct(c["text"].alias("text"), c["para_start"].alias("para_start"), c["para_end"].alias("para_end"), F.lit("").alias("el_start"), F.lit("").alias("el_end")))
    at = lambda i: F.coalesce(F.get(element_ids, i), F.lit(""))
    return F.transform(made, lambda c: F.struct(c["text"].alias("text"), c["para_start"].alias("para_start"), c["para_end"].alias("para_end"), at(c["para_start"]).alias("el_start"), at(c["para_end"]).alias("el_end")))
