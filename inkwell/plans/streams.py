"""Event-log plans: leases and rates, in batch and streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.session import table
from inkwell.streaming import leases, runs

#: What the events of the test table stand for.
KINDS = {"signup": "create", "view": "claim", "click": "heartbeat", "purchase": "finish", "error": "fail"}
LEASE_S = 6 * 3600
RATE = (3600, 2)


def _log(events: DataFrame) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), kinds[F.col("event_type")].alias("kind"))


def job_states(s: SparkSession, d: str) -> DataFrame:
    log = _log(table(s, d, "events")).withColumn("at_s", F.unix_micros("ts") / 1e6)
    return leases.fold(log, "key", lease_s=LEASE_S)


def job_state_counts(s, d):
    return job_states(s, d).groupBy("state", "attempts").agg(F.count("*").alias("n"), F.sum("rejected").alias("rejected"))


def event_rates(s, d):
    """Events of each user in hourly windows and how many a limit of two lets through."""
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return leases.rate_windows(e, "user_id", "ts", *RATE).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_rates(s, d):
    """The same windows from a stream with a watermark, run over what is there."""
    stream = runs.read_events(s, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    plan = leases.rate_windows(stream, "user_id", "ts", *RATE, watermark="400 days")
    return runs.run_now(plan, "update").groupBy("user_id", "window_start").agg(F.max("n").alias("n"), F.max("allowed").alias("allowed")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_job_states(s, d):
    """Final states folded by the stream; equal to the batch fold."""
    stream = _log(runs.read_events(s, f"{d}/events.parquet"))
    out = runs.run_now(leases.fold_stream(stream, "key", watermark="400 days", lease_s=LEASE_S), "update")
    return out.groupBy("key").agg(F.max_by(F.struct("state", "attempts", "lease_until", "accepted", "rejected"), "batch").alias("r")).select("key", "r.*")


QUERIES = {f.__name__: f for f in (job_states, job_state_counts, event_rates, stream_rates, stream_job_states)}
_RATES = f"with w as (select user_id, time_bucket(interval '{RATE[0]} seconds', ts::timestamp, timestamp '1970-01-01') as window_start, count(*) as n from events where user_id is not null and ts is not null group by all) select user_id, window_start, n, least(n, {RATE[1]}) as allowed from w"
# The fold as a reduction of each key's ordered events, the state carried in the element.
_OUT = "(a.s = 'running' and a.u < e.t and a.n >= 3)"
_ST, _LU = f"(case when {_OUT} then 'failed' else a.s end)", f"(case when {_OUT} then 0.0 else a.u end)"
_HELD = f"({_ST} = 'running' and {_LU} > e.t)"
_RULES = {
    "create": f"e.k = 'create' and {_ST} not in ('queued', 'running')",
    "claim": f"e.k = 'claim' and a.n < 3 and ({_ST} = 'queued' or {_ST} = 'running' and {_LU} < e.t)",
    "beat": f"e.k = 'heartbeat' and {_HELD}",
    "end": f"e.k in ('finish', 'fail') and {_HELD}",
}
_OK = " or ".join(f"({r})" for r in _RULES.values())
_STEP = f"""struct_pack(k := e.k, t := e.t, s := case when {_RULES['create']} then 'queued' when {_RULES['claim']} then 'running' when {_RULES['end']} then case e.k when 'finish' then 'completed' else 'failed' end else {_ST} end,
n := case when {_RULES['create']} then 0 when {_RULES['claim']} then a.n + 1 else a.n end, u := case when {_RULES['claim']} or {_RULES['beat']} then e.t + {LEASE_S}.0 when {_RULES['end']} then 0.0 else {_LU} end,
y := a.y + coalesce({_OK}, false)::int, x := a.x + (not coalesce({_OK}, false))::int)"""
_JOBS = f"""with ev as (select distinct user_id as key, event_id as seq, epoch_us(ts::timestamp) / 1e6 as t, case event_type when 'signup' then 'create' when 'view' then 'claim' when 'click' then 'heartbeat' when 'purchase' then 'finish' when 'error' then 'fail' end as k from events where user_id is not null and ts is not null),
li as (select key, list(struct_pack(k := k, t := t, s := '', n := 0, u := 0.0::double, y := 0, x := 0) order by t, seq) as l from ev group by key),
fo as (select key, list_reduce(list_prepend(struct_pack(k := 'start', t := 0.0::double, s := 'none', n := 0, u := 0.0::double, y := 0, x := 0), l), lambda a, e: {_STEP}) as r from li),
jobs as (select key, r.s as state, r.n as attempts, r.u as lease_until, r.y as accepted, r.x as rejected from fo)"""
ORACLES = {
    "event_rates": _RATES,
    "stream_rates": _RATES,
    "job_states": f"{_JOBS} select * from jobs",
    "stream_job_states": f"{_JOBS} select * from jobs",
    "job_state_counts": f"{_JOBS} select state, attempts, count(*) as n, sum(rejected)::bigint as rejected from jobs group by all",
}
