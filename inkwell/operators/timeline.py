"""Word timing, coverage, seams and pause edits, on integer positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import audio as A

#: Least length of a word in ten-thousandths of a second.
LEAST = 10


def next_starts(chunks: DataFrame, keys: Sequence[str], index: str = "chunk_index", start: str = "start_s") -> DataFrame:
    """Each chunk with the next start that isn't negative (skipped); null behind the last."""
    w = Window.partitionBy(*keys).orderBy(index).rowsBetween(1, Window.unboundedFollowing)
    return chunks.withColumn("next_start", F.first(F.when(F.col(start) >= 0, F.col(start)), ignorenulls=True).over(w))


def sentence_segments(chunks: DataFrame, sentences: str, units: str, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """A chunk's time shared among its sentences by their units; skipped and empty chunks give nothing.

    ``sentences`` and ``units`` are parallel arrays.  One row's fold, no shuffle.
    """
    total = F.aggregate(F.col(units), F.lit(0), lambda a, u: a + u)
    made = F.transform(F.sequence(F.lit(0), F.size(units) - 1), lambda i: F.struct(F.get(F.col(sentences), i).alias("sentence"), F.aggregate(F.slice(F.col(units), F.lit(1), i), F.lit(0), lambda a, u: a + u).alias("before"), F.get(F.col(units), i).alias("n")))
    rows = chunks.filter((F.col(start) >= 0) & (F.col(end) > F.col(start)) & (F.size(units) > 0)).withColumn("__total", F.greatest(total, F.lit(1))).withColumn("__s", F.explode(made))
    length = F.col(end) - F.col(start)
    share = lambda n: F.col(start) + length * n / F.col("__total")
    return rows.select(*[c for c in chunks.columns if c not in (sentences, units, start, end)], F.col("__s.sentence").alias("sentence"), share(F.col("__s.before")).alias("from_s"), share(F.col("__s.before") + F.col("__s.n")).alias("to_s"))


def violations(words: DataFrame, keys: Sequence[str], order: Sequence[str], duration: str, chunks: str) -> DataFrame:
    """One row per broken invariant of a word: empty, negative, beyond the end, unknown chunk, backward."""
    before = F.lag("start_s").over(Window.partitionBy(*keys).orderBy(*order))
    word = F.trim(F.coalesce("word", F.lit("")))
    checks = {
        "empty word": word == "",
        "start negative": F.col("start_s") < 0,
        "end negative": F.col("end_s") < 0,
        "start beyond": F.col("start_s") > F.col(duration),
        "end beyond": F.col("end_s") > F.col(duration),
        "chunk out of range": (F.col("chunk_index") < 0) | (F.col("chunk_index") >= F.col(chunks)),
        "start backward": F.col("start_s") < before,
    }
    found = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in checks.items())))
    return words.withColumn("__found", found).filter(F.size("__found") > 0).select(*keys, *order, F.explode("__found").alias("violation"))


def coverage_ratio(aligned, reader):
    """Aligned to reader words, four places; nothing to read is 1, words without text 0."""
    return F.when(reader == 0, F.when(aligned == 0, 1.0).otherwise(0.0)).otherwise(F.bround(aligned / reader, 4))


def coverage(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per chunk and running: ratio, first missing word in the chunk and its place in the section.

    ``chunks`` has the keys, chunk_index, reader and aligned counts.
    """
    before = F.coalesce(F.sum("reader").over(Window.partitionBy(*keys).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    missing = F.when(F.col("aligned") < F.col("reader"), F.col("aligned"))
    return chunks.withColumn("ratio", coverage_ratio(F.col("aligned"), F.col("reader"))).withColumn("first_missing", missing).withColumn("missing_at", before + missing)


def coverage_totals(covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    sums = covered.groupBy(*keys).agg(F.sum("reader").alias("reader"), F.sum("aligned").alias("aligned"), F.min("missing_at").alias("first_missing"))
    return sums.withColumn("ratio", coverage_ratio(F.col("aligned"), F.col("reader")))


def monotonic(words: DataFrame, keys: Sequence[str], index: str, start: str, end: str, least: int = LEAST, block: int = 1 << 16) -> DataFrame:
    """Starts and ends moved forward so that words follow each other, each at least ``least`` long.

    The recurrence end = max(end, max(start, end before) + least) has a closed
    form: end - least * i is the running maximum of max(end, start + least) -
    least * i.  The maximum runs inside blocks of ``block`` places, joined by one
    over the blocks' maxima, so a track of any length spreads over many tasks.
    ``index`` numbers the words of a key from 0 without gaps; positions are whole.
    """
    keys = list(keys)
    floor = F.greatest(F.col(end), F.col(start) + least) - least * F.col(index)
    rows = words.withColumn("__b", F.floor(F.col(index) / block)).withColumn("__m", F.greatest(floor, least - least * F.col(index)))
    tops = rows.groupBy(*keys, "__b").agg(F.max("__m").alias("__top"))
    over = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, "__b", F.max("__top").over(over).alias("__carry"))
    inside = Window.partitionBy(*keys, "__b").orderBy(index)
    reached = F.greatest(F.max("__m").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__carry")
    earlier = F.greatest(F.max("__m").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "__carry")
    out = rows.join(carried, [*keys, "__b"]).withColumn("__end", reached + least * F.col(index)).withColumn("__before", F.coalesce(earlier + least * (F.col(index) - 1), F.lit(0)))
    return out.withColumn(start, F.greatest(start, "__before")).withColumn(end, F.col("__end")).drop("__b", "__m", "__carry", "__end", "__before")


def pause_edits(seams: DataFrame, rate: int = A.FRAME_RATE) -> DataFrame:
    """Seams whose recorded pause isn't the policy's: old_end, new_end and the difference in frames."""
    target = F.col("pause_start_frame") + A.frames(A.pause_ms(F.col("break_type")), rate)
    real = seams.filter("pause_start_frame >= 0 and pause_end_frame >= pause_start_frame")
    return real.withColumn("old_end", F.col("pause_end_frame")).withColumn("new_end", target).withColumn("delta", F.col("new_end") - F.col("old_end")).filter("delta <> 0")


def shifted(points: DataFrame, edits: DataFrame, keys: Sequence[str], at: str = "frame") -> DataFrame:
    """Points moved by the edits that ended at or before them: a prefix sum carried forward, no pair formed."""
    keys = list(keys)
    steps = edits.groupBy(*keys, F.col("old_end").alias("__t")).agg(F.sum("delta").alias("__d"))
    both = points.select(*points.columns, F.col(at).alias("__t"), F.lit(0).cast("bigint").alias("__d"), F.lit(1).alias("__p")).unionByName(
        steps.select(*(F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in points.dtypes), "__t", "__d", F.lit(0).alias("__p"))
    )
    w = Window.partitionBy(*keys).orderBy("__t", "__p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shift", F.sum("__d").over(w)).filter("__p = 1").drop("__t", "__d", "__p").withColumn(f"new_{at}", F.col(at) + F.col("shift"))


def merged_tokens(tokens: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Tokens to words: a word ends with a token that ends in white space."""
    w = Window.partitionBy(*keys).orderBy(order)
    ends = F.col("token").rlike("(?U)\\s$").cast("int")
    word = F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = tokens.withColumn("__w", word).groupBy(*keys, F.col("__w").alias("word_index"))
    joined = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "token"))), lambda x: x["token"]), ""))
    return grouped.agg(joined.alias("word"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).filter("word <> ''")
