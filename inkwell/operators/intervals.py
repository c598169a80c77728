"""Sweep-line algebra over integer intervals: covered periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a time block in positions.  A block holds at most this many distinct
#: positions whatever the data, so no task ever sees an unbounded group.
BLOCK = 1 << 22


def to_ticks(seconds: Column, per_second: int) -> Column:
    """Seconds to whole ticks, rounded to the nearest; NaN and infinities become null."""
    scaled = seconds * F.lit(per_second)
    finite = ~F.isnan(scaled) & (F.abs(scaled) < F.lit(9.0e18))
    return F.when(finite, F.round(scaled).cast("bigint"))


def valid_intervals(df: DataFrame, start: str = "from_pos", end: str = "to_pos") -> DataFrame:
    """Rows that are intervals: both bounds present, start not negative, end after start."""
    return df.filter((F.col(start) >= 0) & (F.col(end) > F.col(start)))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str = "from_pos", end: str = "to_pos", block: int = BLOCK) -> DataFrame:
    """Maximal covered periods and the gaps between neighbours, for each key.

    ``df`` has one row per interval [start, end) with BIGINT bounds.  Result:
    the keys, ``piece`` ('period' or 'gap'), ``from_pos``, ``to_pos``.

    Sweep line: each interval becomes +1 at its start and -1 at its end; deltas
    are summed per position (touching ends cancel); a prefix sum gives the
    active count; a period begins where the count leaves zero and ends where
    it returns.  The prefix sum runs inside time blocks, with the count carried
    in from a sum over per-block totals, so a key that holds most of the rows
    is spread over many tasks and only its block totals meet in one.

    Defined cases: rows that aren't intervals (null bound, negative start, end
    not after start) and rows with a null key are left out; repeated rows and
    ties change nothing; no rows give no rows; other columns are ignored.
    """
    keys = list(keys)
    here = keys + ["__block"]
    src = df.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"))
    src = valid_intervals(src, "__s", "__e").dropna(subset=keys)
    events = (
        src.select(*keys, F.inline(F.array(F.struct(F.col("__s").alias("__pos"), F.lit(1).alias("__d")), F.struct(F.col("__e").alias("__pos"), F.lit(-1).alias("__d")))))
        .groupBy(*keys, "__pos")
        .agg(F.sum("__d").alias("__d"))
        .filter("__d <> 0")
        .withColumn("__block", F.floor(F.col("__pos") / F.lit(block)))
        .filter("__pos is not null and __block is not null")
        .repartition(*here)
    )
    over_blocks = Window.partitionBy(*keys).orderBy("__block")
    # the last position and the filter above keep both readers' columns and filters alike, so that the
    # totals read the very exchange of the events, not another scan
    totals = events.groupBy(*here).agg(F.sum("__d").alias("__total"), F.max("__pos").alias("__last"))
    carried = totals.select(*here, "__last", F.coalesce(F.sum("__total").over(over_blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__carry"))
    in_block = Window.partitionBy(*here).orderBy("__pos")
    swept = (
        events.join(carried, here)
        .filter("__pos <= __last")
        .withColumn("__now", F.col("__carry") + F.sum("__d").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("__now") == 0) | (F.col("__now") == F.col("__d")))
        .select(*here, "__pos", (F.col("__now") > 0).alias("__opens"))
    )
    firsts = swept.groupBy(*here).agg(F.min("__pos").alias("__first"))
    following = firsts.select(*here, F.lead("__first").over(over_blocks).alias("__beyond"))
    return (
        swept.join(following, here)
        .withColumn("__next", F.coalesce(F.lead("__pos").over(in_block), F.col("__beyond")))
        .filter("__next is not null")
        .select(*keys, F.when(F.col("__opens"), "period").otherwise("gap").alias("piece"), F.col("__pos").alias("from_pos"), F.col("__next").alias("to_pos"))
    )
