"""Quotes, speaker spans and name resolution."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import direction as D
from inkwell.operators.relational import islands


def quotes(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text") -> DataFrame:
    """One row per quote, numbered over the chunks of each key, in batches of twenty."""
    return numbered(df.select(*keys, *order, F.inline(D.quote_spans(F.col(text)))), keys, order)


def numbered(found: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Quotes of each key numbered in order, in batches of twenty."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, "start")) - 1
    return found.withColumn("quote_id", number).withColumn("batch", F.floor(number / D.QUOTE_BATCH).cast("int"))


def tiled_spans(texts: DataFrame, said: DataFrame, key: str, chars: Column | None = None) -> DataFrame:
    """Quotes with speakers to spans that tile each text: gaps are the narrator's, equal neighbours merge.

    ``texts`` has key and text, or instead of the text its length, ``chars``;
    ``said`` key, start, end, speaker.  Each text's end is a mark behind its
    quotes, so gaps come from the ends before them in one pass and nothing is
    joined; runs of equal speakers are islands.
    """
    w = Window.partitionBy(key).orderBy("__mark", "start")
    quoted = said.select(key, "start", "end", "speaker", F.lit(False).alias("__mark"))
    length = F.length("text") if chars is None else chars
    marks = texts.select(key, length.alias("start"), length.alias("end"), F.lit(D.NARRATOR).alias("speaker"), F.lit(True).alias("__mark"))
    before = F.when(F.col("__mark"), F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))).otherwise(F.lag("end").over(w))
    rows = quoted.unionByName(marks).withColumn("__before", F.coalesce(before, F.lit(0)))
    spans = rows.select(key, F.inline(F.array(F.struct(F.col("__before").alias("start"), F.col("start").alias("end"), F.lit(D.NARRATOR).alias("speaker")), F.struct("start", "end", "speaker")))).filter("end > start")
    spans = spans.withColumn("delivery_type", D.delivery_type(F.lit(None).cast("string"), F.col("speaker")))
    spans = spans.withColumn("voice_policy", D.voice_policy(F.lit(None).cast("string"), F.col("speaker"), F.col("delivery_type")))
    runs = islands(spans, [key], ["start"], ["speaker", "delivery_type", "voice_policy"])
    return runs.groupBy(key, "run", "speaker", "delivery_type", "voice_policy").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def span_violations(texts: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """What keeps spans from tiling their texts: a gap or overlap, an empty span, a wrong end."""
    w = Window.partitionBy(key).orderBy("start", "end")
    rows = spans.withColumn("__before", F.coalesce(F.lag("end").over(w), F.lit(0)))
    local = rows.select(key, "start", F.explode(F.array_compact(F.array(F.when(F.col("start") != F.col("__before"), F.lit("not contiguous")), F.when(F.col("end") <= F.col("start"), F.lit("empty span"))))).alias("violation"))
    ends = texts.select(key, F.length("text").alias("__len")).join(spans.groupBy(key).agg(F.max("end").alias("__end")), key, "left")
    wrong = ends.filter(F.coalesce("__end", F.lit(0)) != F.col("__len")).select(key, F.coalesce("__end", F.lit(0)).alias("start"), F.lit("does not cover the text").alias("violation"))
    return local.unionByName(wrong)


def names_of(profiles: DataFrame, scope: Sequence[str], id_col: str = "character_id") -> DataFrame:
    """Names each profile goes by: canonical and aliases, less a leading article; and the last part of longer ones."""
    every = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    named = profiles.select(*scope, id_col, F.explode(every).alias("name")).filter("name is not null")
    key = D.norm(F.col("name"))
    parts = F.split(F.trim(F.regexp_replace(F.translate(key, ",", " "), "(?U)\\s+", " ")), " ")
    forms = F.array(F.struct(key.alias("key"), F.lit("full").alias("form")), F.struct(F.regexp_replace(key, "^(?:the|an|a) ", "").alias("key"), F.lit("full").alias("form")), F.struct(F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("key"), F.lit("short").alias("form")))
    return named.select(*scope, id_col, F.inline(forms)).filter("key is not null and key <> ''").distinct()


def resolve(speakers: DataFrame, names: DataFrame, scope: Sequence[str], speaker: str = "speaker", id_col: str = "character_id") -> DataFrame:
    """Each speaker's profile: the only one of that full name, else (no full match) the only one of that short name.

    The names are never broadcast: the optimizer takes them for as large as the profiles they were exploded from.
    """
    hit = speakers.withColumn("__key", D.norm(F.col(speaker))).join(names.withColumnRenamed("key", "__key").hint("merge"), [*scope, "__key"], "left")
    of = lambda form: F.when(F.col("form") == form, F.col(id_col))
    full, short = F.count_distinct(of("full")), F.count_distinct(of("short"))
    one = F.when(full == 1, F.max(of("full"))).when((full == 0) & (short == 1), F.max(of("short")))
    return hit.groupBy(*scope, speaker).agg(one.alias(id_col), full.alias("full_matches"), short.alias("short_matches"))


def exchanges(spans: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Spoken spans with another speaker among the four quoted spans before or behind them."""
    quoted = spans.filter(D.norm(F.col("speaker")) != D.NARRATOR)
    w = Window.partitionBy(*keys).orderBy(order)
    spoken = F.when(F.col("delivery_type") == "spoken_dialogue", F.col("speaker"))
    near = F.array_union(F.collect_set(spoken).over(w.rowsBetween(-4, -1)), F.collect_set(spoken).over(w.rowsBetween(1, 4)))
    other = F.size(F.array_remove(near, F.col("speaker"))) > 0
    return quoted.withColumn("exchange", (F.col("delivery_type") == "spoken_dialogue") & other)


def batches(df: DataFrame, keys: Sequence[str], order: str, words: str, chars: str, most_words: int = D.BATCH_WORDS, most_chars: int = D.BATCH_CHARS) -> DataFrame:
    """Rows of each key packed in order into batches under both limits; a row over them stands alone.

    The rows are sorted by key and order within their partitions and read once
    with one batch's sums in hand, never over texts: a key of any size spills to
    disk but is never held whole.  Defined cases: null counts are 0; equal
    orders keep any order; no rows give no rows.
    """
    keys = list(keys)
    rows = df.select(*keys, order, F.coalesce(words, F.lit(0)).cast("bigint").alias("w"), F.coalesce(chars, F.lit(0)).cast("bigint").alias("c"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    names = [*keys, order, "batch"]
    kinds = dict(df.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, batch, w, c = None, 0, 0, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key, n_words, n_chars = row[: len(keys)], row[-2], row[-1]
                if key != current:
                    current, batch, w, c = key, 0, n_words, n_chars
                elif w + n_words > most_words or c + n_chars > most_chars:
                    batch, w, c = batch + 1, n_words, n_chars
                else:
                    w, c = w + n_words, c + n_chars
                out.append((*row[:-2], batch))
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in [*keys, order]), "batch int"]))


def spelling_repairs(names: DataFrame, observed: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Names of seven letters or more that a text lacks, to its only form one edit away.

    Candidates share the name less one letter, so no pair is formed but of near
    forms; the distance is then bounded and checked in the JVM.  Neither side is
    broadcast: the optimizer's estimates know nothing of the exploded rows, so a
    side far over its threshold would be built on the driver.
    """
    less = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    asked = names.filter(F.length("name") >= 7).join(observed.select(*scope, F.col("form").alias("name")).hint("merge"), [*scope, "name"], "left_anti").distinct()
    a = asked.select(*scope, "name", F.explode(less(F.col("name"))).alias("__k"))
    b = observed.filter(F.length("form") >= 6).distinct().select(*scope, "form", F.explode(less(F.col("form"))).alias("__k"))
    near = a.join(b.hint("merge"), [*scope, "__k"]).select(*scope, "name", "form").distinct().filter(F.levenshtein("name", "form", 1) == 1)
    return near.groupBy(*scope, "name").agg(F.count("*").alias("n"), F.min("form").alias("repair")).filter("n = 1").drop("n")
