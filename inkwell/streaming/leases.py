"""Leased work folded from an event log, in batch and as a stream.

The fold is the same code in both.  In batch the log is sorted by key and time
inside its partitions and read once, with one key's state in hand: a key with
any number of events never has to fit in memory.  As a stream the state lives
in the state store, and leases run out by event time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_S = 120
ATTEMPTS = 3
#: Event kinds: create, claim, heartbeat, finish, fail, cancel, retry.
RESULT = "state string, attempts int, lease_until double, accepted int, rejected int"


@dataclass
class Lease:
    """One key's work.  An event that its state doesn't allow is counted as rejected and changes nothing."""

    state: str = "none"
    attempts: int = 0
    lease_until: float = 0.0
    accepted: int = 0
    rejected: int = 0

    def expire(self, now: float) -> None:
        """A lease that ran out before ``now`` with no attempt left fails."""
        if self.state == "running" and self.lease_until < now and self.attempts >= ATTEMPTS:
            self.state, self.lease_until = "failed", 0.0

    def apply(self, kind: str | None, now: float, lease_s: float = LEASE_S) -> None:
        self.expire(now)
        running = self.state == "running"
        held = running and self.lease_until > now
        claimable = self.attempts < ATTEMPTS and (self.state == "queued" or running and self.lease_until < now)
        ok = True
        if kind == "create" and self.state not in ("queued", "running"):
            self.state, self.attempts = "queued", 0
        elif kind == "claim" and claimable:
            self.state, self.attempts, self.lease_until = "running", self.attempts + 1, now + lease_s
        elif kind == "heartbeat" and held:
            self.lease_until = now + lease_s
        elif kind in ("finish", "fail") and held:
            self.state, self.lease_until = "completed" if kind == "finish" else "failed", 0.0
        elif kind == "cancel" and self.state in ("queued", "running"):
            self.state, self.lease_until = "canceled", 0.0
        elif kind == "retry" and self.state in ("failed", "canceled") and self.attempts < ATTEMPTS:
            self.state = "queued"
        else:
            ok = False
        self.accepted += ok
        self.rejected += not ok


def fold(log: DataFrame, key: str, at: str = "at_s", order: str = "seq", kind: str = "kind", lease_s: float = LEASE_S) -> DataFrame:
    """``key`` and its final state.

    Defined cases: events of one time go by ``order``; rows with a null key or
    time are left out; a null or unknown kind is rejected; repeated ``order``
    numbers of a key count once; no rows give no rows.
    """
    rows = log.select(key, F.col(at).cast("double").alias("at_s"), F.col(order).cast("bigint").alias("seq"), F.col(kind).alias("kind")).dropna(subset=[key, "at_s"])
    rows = rows.repartition(key).sortWithinPartitions(key, "at_s", "seq")
    schema = f"{key} {dict(log.dtypes)[key]}, {RESULT}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, lease, last = None, None, None
        for frame in frames:
            out = []
            for k, now, seq, what in frame.itertuples(index=False):
                if lease is None or k != current:
                    if lease is not None:
                        out.append((current, *asdict(lease).values()))
                    current, lease, last = k, Lease(), None
                if last != (now, seq):
                    lease.apply(what, now, lease_s)
                last = (now, seq)
            yield pd.DataFrame(out, columns=[key, *asdict(Lease())])
        if lease is not None:
            yield pd.DataFrame([(current, *asdict(lease).values())], columns=[key, *asdict(Lease())])

    return rows.mapInPandas(run, schema)


def fold_stream(log: DataFrame, key: str, at: str = "ts", order: str = "seq", kind: str = "kind", watermark: str = "10 minutes", lease_s: float = LEASE_S) -> DataFrame:
    """The same fold as a stream: one row per key and trigger with its state so far.

    Events behind the watermark are dropped, as a late heartbeat would be; a key
    whose lease runs out gets a timeout and may fail without a further event.
    """
    state_type = "state string, attempts int, lease_until double, accepted int, rejected int"
    schema = f"{key} {dict(log.dtypes)[key]}, {RESULT}"

    def step(keys, frames, state):
        lease = Lease(*state.get) if state.exists else Lease()
        if state.hasTimedOut:
            lease.expire(state.getCurrentWatermarkMs() / 1000)
        else:
            rows = pd.concat(list(frames)).sort_values(["at_s", "seq"], kind="stable").drop_duplicates(["at_s", "seq"])
            for now, what in zip(rows["at_s"], rows["kind"]):
                lease.apply(what, now, lease_s)
        state.update(tuple(asdict(lease).values()))
        if lease.state == "running" and lease.lease_until * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(lease.lease_until * 1000) + 1)
        yield pd.DataFrame([(keys[0], *asdict(lease).values())], columns=[key, *asdict(Lease())])

    rows = log.withWatermark(at, watermark).select(key, at, F.unix_micros(at).cast("double").__truediv__(1e6).alias("at_s"), F.col(order).cast("bigint").alias("seq"), F.col(kind).alias("kind"))
    return rows.groupBy(key).applyInPandasWithState(step, schema, state_type, "update", "EventTimeTimeout")


def rate_windows(events: DataFrame, key: str, at: str, seconds: int, limit: int, watermark: str | None = None) -> DataFrame:
    """Events per key in tumbling windows and how many of them the limit lets through.

    Works on a batch and, with a watermark, on a stream; counts combine on the
    map side, so a hot key costs one row per task and window.
    """
    rows = events.withWatermark(at, watermark) if watermark else events
    counted = rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.window(at, f"{seconds} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("window_start"), "n", F.least("n", F.lit(limit)).alias("allowed"))
