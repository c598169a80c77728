"""Tables kept by key from later deliveries: upserts with frozen fields, reconciliation, receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], frozen: Sequence[str] = (), when: Column | None = None) -> DataFrame:
    """Rows of both, the incoming ones replacing the current; ``frozen`` fields keep their value where ``when`` holds of the current row.

    One full outer join on the keys.  Both sides must hold a key once (see
    ``relational.latest``); null keys never meet and are kept.
    """
    keys = list(keys)
    fields = [c for c in current.columns if c not in keys]
    a = current.select(*keys, F.struct(*fields).alias("__a"), (when if when is not None else F.lit(False)).alias("__frozen"))
    b = incoming.select(*keys, F.struct(*fields).alias("__b"))
    both = a.join(b, keys, "full")

    def value(field: str) -> Column:
        new = F.when(F.col("__b").isNull(), F.col(f"__a.{field}")).otherwise(F.col(f"__b.{field}"))
        return F.when(F.coalesce("__frozen", F.lit(False)) & F.col("__a").isNotNull(), F.col(f"__a.{field}")).otherwise(new) if field in frozen else new

    return both.select(*keys, *(value(f).alias(f) for f in fields))


def reconciled(rows: DataFrame, seen: DataFrame, keys: Sequence[str], revision: str) -> DataFrame:
    """Rows without those whose objects are gone; a row changed since it was looked at stays.

    ``seen`` has the keys, the revision looked at and ``valid``.
    """
    gone = seen.filter(~F.coalesce("valid", F.lit(False))).select(*keys, revision)
    on = [rows[k] == gone[k] for k in keys] + [rows[revision].eqNullSafe(gone[revision])]
    return rows.join(gone, on, "left_anti")


def later(a: DataFrame, b: DataFrame, keys: Sequence[str], identity: str, at: str) -> DataFrame:
    """Of two states of a key the later one; of equal times ``b`` only if it is of the same identity."""
    keys = list(keys)
    fields = [c for c in a.columns if c not in keys]
    both = a.select(*keys, F.struct(*fields).alias("__a")).join(b.select(*keys, F.struct(*fields).alias("__b")), keys, "full")
    take_b = F.col("__a").isNull() | F.col("__b").isNotNull() & ((F.col(f"__b.{at}") > F.col(f"__a.{at}")) | (F.col(f"__b.{at}") == F.col(f"__a.{at}")) & (F.col(f"__b.{identity}") == F.col(f"__a.{identity}")))
    return both.select(*keys, *(F.when(take_b, F.col(f"__b.{f}")).otherwise(F.col(f"__a.{f}")).alias(f) for f in fields))


def reusable_receipts(receipts: DataFrame, files: DataFrame, fingerprint: str, version: int = 2) -> DataFrame:
    """Receipts of this version and fingerprint all of whose files are there with the same hash, and no others.

    ``receipts``: receipt, version, fingerprint, file, sha; ``files``: receipt, file, sha.
    """
    mine = receipts.filter((F.col("version") == version) & (F.col("fingerprint") == fingerprint)).select("receipt", "file", F.col("sha").alias("__want"))
    both = mine.join(files.select("receipt", "file", F.col("sha").alias("__have")), ["receipt", "file"], "full")
    whole = both.groupBy("receipt").agg(F.bool_and(F.col("__want").eqNullSafe(F.col("__have"))).alias("whole"))
    return mine.select("receipt").distinct().join(whole.filter("whole"), "receipt").select("receipt")


def pending(items: DataFrame, done: DataFrame, keys: Sequence[str], fingerprint: str) -> DataFrame:
    """Items not yet done under their present fingerprint: what an expensive step still has to compute."""
    return items.join(done.select(*keys, fingerprint).distinct(), [*keys, fingerprint], "left_anti")
