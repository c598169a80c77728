"""Error rates, completeness and log diagnosis."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_PUNCTUATION = str.maketrans("", "", string.punctuation)


def word_errors(reference: str | None, hypothesis: str | None) -> float:
    """Word edit distance over the reference's words; 0 for two empty texts, 1 for an empty reference.

    One row of the table at a time: deletions and substitutions element-wise,
    insertions as a running minimum.
    """
    ref = (reference or "").lower().translate(_PUNCTUATION).split()
    hyp = (hypothesis or "").lower().translate(_PUNCTUATION).split()
    if not ref:
        return 1.0 if hyp else 0.0
    codes: dict[str, int] = {}
    coded = np.array([codes.setdefault(w, len(codes)) for w in hyp], np.int64)
    place = np.arange(len(hyp) + 1)
    row = place.copy()
    for i, word in enumerate(ref, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[1:] + 1, row[:-1] + (coded != codes.get(word, -1)))
        row = np.minimum.accumulate(best - place) + place
    return float(row[-1]) / len(ref)


def error_rates(df: DataFrame, keys: Sequence[str], reference: str, hypothesis: str) -> DataFrame:
    """The keys and ``wer`` of each pair; rates may exceed 1 where words are inserted."""
    src = df.select(*keys, F.col(reference).alias("__r"), F.col(hypothesis).alias("__h"))
    schema = ", ".join([*(f"{k} {t}" for k, t in df.select(*keys).dtypes), "wer double"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[list(keys)].copy()
            out["wer"] = [word_errors(r, h) for r, h in zip(f["__r"], f["__h"])]
            yield out

    return src.mapInPandas(run, schema)


def missing_artifacts(expected: DataFrame, present: DataFrame, keys: Sequence[str], kinds: dict[str, bool]) -> DataFrame:
    """Expected keys without an artifact of a kind, as errors (required) or warnings."""
    spark = expected.sparkSession
    wanted = spark.createDataFrame([(k, "error" if needed else "warning") for k, needed in kinds.items()], "kind string, level string")
    each = expected.select(*keys).distinct().join(F.broadcast(wanted))
    return each.join(present.select(*keys, "kind").distinct(), [*keys, "kind"], "left_anti")


def verdicts(expected: DataFrame, missing: DataFrame, keys: Sequence[str]) -> DataFrame:
    counted = missing.groupBy(*keys).agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    out = expected.select(*keys).distinct().join(counted, list(keys), "left").fillna(0, ["errors", "warnings"])
    return out.withColumn("status", F.when(F.col("errors") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("ok"))


def log_issues(lines: DataFrame, keys: Sequence[str], order: str, line: str, patterns: dict[str, str], around: int = 4) -> DataFrame:
    """Lines that match a pattern (the first named wins) with their neighbours as context."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        kind = F.when(F.col(line).rlike(pattern), name).otherwise(kind)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-around, around)
    return lines.withColumn("issue", kind).withColumn("context", F.array_join(F.collect_list(line).over(w), "\n")).filter("issue is not null")


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields in which two versions of a record differ, null equal to null."""
    both = a.select(*keys, F.struct(*fields).alias("__a")).join(b.select(*keys, F.struct(*fields).alias("__b")), list(keys))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"__a.{f}").eqNullSafe(F.col(f"__b.{f}")), F.lit(f)) for f in fields)))
    return both.select(*keys, differ.alias("fields")).filter(F.size("fields") > 0)
