"""Relational building blocks used by the catalog, job and timeline plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in ``order``; rows with a null key are left out.

    One aggregation with map-side combine (a whole row as the value), so a key
    delivered any number of times reaches the shuffle as one row per task.
    """
    ranked = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*ranked), F.struct(*order)) if ranked else None
    grouped = df.dropna(subset=list(keys)).groupBy(*keys)
    return grouped.agg(best.alias("__row")).select(*keys, "__row.*")


def first_rows(df: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes groups before the shuffle (group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """One page with the total of all rows beside it; the page is a top-k, not a full sort."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(total)


def keyset_page(df: DataFrame, keys: Sequence[str], after: Sequence[object] | None, limit: int) -> DataFrame:
    """The next ``limit`` rows beyond the cursor, in key order."""
    if after is not None:
        cursor = F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, after)))
        df = df.filter(F.struct(*(F.col(k) for k in keys)) > cursor)
    return df.orderBy(*keys).limit(limit)


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str], run: str = "run") -> DataFrame:
    """Number the runs of rows that agree in ``same`` with the row before them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    agree = F.lit(True)
    for c in same:
        agree = agree & F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("__new", F.when(first | ~agree, 1).otherwise(0)).withColumn(run, F.sum("__new").over(w)).drop("__new")


def as_of(points: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, since: str, carry: Sequence[str]) -> DataFrame:
    """For each point the last step at or before it, by a merge of both in one sorted pass.

    No pair is formed: both sides are stacked, sorted by key and time, and the
    last step's columns are carried forward.
    """
    p = points.select(*points.columns, F.col(at).alias("__t"), F.lit(1).alias("__side"), *(F.lit(None).alias(f"__{c}") for c in carry))
    s = steps.select(*(F.col(c) if c in keys else F.lit(None).alias(c) for c in points.columns), F.col(since).alias("__t"), F.lit(0).alias("__side"), *(F.col(c).alias(f"__{c}") for c in carry))
    w = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    stacked = s.unionByName(p)
    seen = F.last(F.when(F.col("__side") == 0, F.struct(*(F.col(f"__{c}").alias(c) for c in carry))), ignorenulls=True).over(w)
    return stacked.withColumn("__seen", seen).filter("__side = 1").select(*points.columns, *(F.col(f"__seen.{c}").alias(c) for c in carry))
