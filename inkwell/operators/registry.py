"""Character registries and model answers: cleaning, grounding, merging, patches, reuse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import direction as D
from inkwell.operators import dialogue

#: Capitalised names, hyphens and apostrophes inside, several words together.
NAME_FORM = "\\b[A-Z][A-Za-z]+(?:[-'][A-Za-z]+)?(?:\\s+[A-Z][A-Za-z]+(?:[-'][A-Za-z]+)?)*\\b"


def contains_name(text: Column, name: Column) -> Column:
    """The name as whole words, in any case; an empty name is in no text."""
    quoted = F.concat(F.lit("\\Q"), F.replace(F.trim(name), F.lit("\\E"), F.lit("")), F.lit("\\E"))
    return (F.trim(name) != "") & F.coalesce(F.regexp_like(text, F.concat(F.lit("(?iU)(?<!\\w)"), quoted, F.lit("(?!\\w)"))), F.lit(False))


def observed_names(text: Column) -> Column:
    """Distinct capitalised forms in order of appearance, white space collapsed."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NAME_FORM), F.lit(0)), lambda x: F.regexp_replace(x, "\\s+", " "))
    return F.aggregate(found, F.array().cast("array<string>"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.array_append(a, x)))


def cleaned(raw: DataFrame) -> DataFrame:
    """Raw characters with trimmed texts and listed aliases; the narrator and nameless ones left out."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    aliases = F.array_distinct(F.filter(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: F.coalesce(a != "", F.lit(False))))
    return raw.withColumns({"canonical": text(F.col("canonical")), "aliases": aliases, "gender": F.coalesce(F.nullif(text(F.col("gender")), F.lit("")), F.lit("unknown"))}).filter((F.col("canonical") != "") & (D.norm(F.col("canonical")) != D.NARRATOR))


def grounded(characters: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Characters any text of their key names, by canonical or alias; others by their only form one edit away, or left out.

    ``texts`` has key and text.  Result: the characters, each once, with their
    canonical as the texts spell it.  A name is looked for only in texts that
    have its first word, found through an index of words, so that no character
    meets every text of a large book.

    Defined cases: null and empty names and texts are never found; repeated
    characters give repeated rows; no rows give no rows.
    """
    first_word = lambda c: F.regexp_extract(F.lower(c), "(?U)\\w+", 0)
    every = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    known = characters.withColumn("__c", F.xxhash64("canonical", "aliases"))
    names = known.select(key, "__c", F.explode(every).alias("__name")).filter("__name is not null").withColumn("__w", first_word(F.col("__name"))).filter("__w <> ''")
    source = texts.filter("text is not null").select(key, "text", F.xxhash64("text").alias("__i"))
    words = source.select(key, "__i", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?U)\\w+"), F.lit(0)))).alias("__w"))
    likely = names.select(key, "__name", "__w").distinct().join(words, [key, "__w"]).select(key, "__name", "__i").distinct()
    seen_names = likely.join(source.distinct(), [key, "__i"]).filter(contains_name(F.col("text"), F.col("__name"))).select(key, "__name").distinct()
    hits = names.join(seen_names, [key, "__name"]).select(key, "__c").distinct().withColumn("__hit", F.lit(True))
    marked = known.join(hits, [key, "__c"], "left").drop("__c").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    lost = marked.filter(~F.col("__hit")).select(key, F.col("canonical").alias("name")).distinct()
    seen = texts.select(key, F.explode(observed_names(F.col("text"))).alias("form"))
    repairs = dialogue.spelling_repairs(lost, seen, [key]).withColumnRenamed("name", "canonical")
    joined = marked.join(repairs, [key, "canonical"], "left")
    return joined.filter("__hit or repair is not null").withColumn("canonical", F.when(F.col("__hit"), F.col("canonical")).otherwise(F.col("repair"))).drop("__hit", "repair")


def merged(known: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Known characters and those found with evidence whose name resolves to none of them, each name once."""
    names = dialogue.names_of(known.withColumn("character_id", F.monotonically_increasing_id()), [key]).filter("form = 'full'").select(key, F.col("key").alias("__n")).distinct()
    new = found.filter(F.length(F.trim(F.coalesce("first_evidence_quote", F.lit("")))) > 0).withColumn("__n", D.norm(F.col("canonical"))).join(names, [key, "__n"], "left_anti").dropDuplicates([key, "__n"]).drop("__n")
    return known.unionByName(new, allowMissingColumns=True)


def answer_faults(expected: DataFrame, answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items an answer must cover exactly once and doesn't: missing, repeated or not asked for."""
    counted = answers.groupBy(*keys).agg(F.count("*").alias("__n"))
    both = expected.select(*keys).distinct().withColumn("__asked", F.lit(True)).join(counted, list(keys), "full")
    fault = F.when(F.col("__n").isNull(), "missing").when(F.col("__asked").isNull(), "not asked for").when(F.col("__n") > 1, "repeated")
    return both.withColumn("fault", fault).filter("fault is not null").select(*keys, "fault")


def patched(segments: DataFrame, edits: DataFrame, keys: Sequence[str], fields: Sequence[str], whole: Sequence[str]) -> DataFrame:
    """Sparse edits laid over segments; a group (``whole``) with a repeated or unknown edit keeps its neutral values."""
    faults = answer_faults(segments, edits, keys).filter("fault <> 'missing'").select(*whole).distinct().withColumn("__bad", F.lit(True))
    best = edits.select(*keys, *(F.col(f).alias(f"__{f}") for f in fields)).dropDuplicates(list(keys))
    rows = segments.join(best, list(keys), "left").join(faults, list(whole), "left")
    return rows.withColumns({f: F.when(F.col("__bad").isNull(), F.coalesce(F.col(f"__{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}).drop("__bad", *(f"__{f}" for f in fields))


def first_success(*attempts: Column) -> Column:
    """The first attempt that isn't null: an answer, its repair, the neutral value."""
    return F.coalesce(*attempts)


def reusable(wanted: DataFrame, kept: DataFrame, keys: Sequence[str], newest: str) -> DataFrame:
    """For each wanted item the newest kept result with the same keys and the same texts, if there is one.

    ``texts`` (an array) is compared through its hash and then itself, so the
    join key stays small.
    """
    digest = F.sha2(F.to_json(F.struct("texts")), 256)
    a = wanted.withColumn("__h", digest)
    b = kept.select(*keys, digest.alias("__h"), F.col("texts").alias("__t"), newest, "result")
    best = b.groupBy(*keys, "__h", "__t").agg(F.max_by("result", newest).alias("result"), F.max(newest).alias(newest))
    return a.join(best, [*keys, "__h"], "left").withColumn("result", F.when(F.col("texts") == F.col("__t"), F.col("result"))).drop("__h", "__t")


def json_answer(text: Column, schema: str) -> Column:
    """The JSON of a model's answer: without thinking and fences, else between the outermost braces."""
    bare = F.regexp_replace(F.regexp_replace(text, "(?s)<think>.*?</think>", ""), "(?s)^\\s*```[a-z]*\\s*|\\s*```\\s*$", "")
    return F.coalesce(F.from_json(F.when(F.ltrim(bare).rlike("^\\{"), bare), schema), F.from_json(F.nullif(F.regexp_extract(bare, "(?s)(\\{.*\\})", 1), F.lit("")), schema))
