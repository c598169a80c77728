from inkwell.plans import streams
from inkwell.streaming import leases


def test_lease_rules():
    x = leases.Lease()
    for kind, now in (("create", 0), ("create", 1), ("claim", 2), ("heartbeat", 100), ("heartbeat", 220), ("claim", 221), ("finish", 230), (None, 231), ("retry", 232)):
        x.apply(kind, now)
    # the heartbeat exactly at the lease's end is rejected
    assert (x.state, x.attempts, x.accepted, x.rejected) == ("completed", 2, 5, 4)
    y = leases.Lease("running", 3, 10.0)
    y.expire(11)
    assert y.state == "failed"


def test_batch_and_stream_agree(spark, sf):
    batch = {tuple(r) for r in streams.job_states(spark, sf).collect()}
    assert batch == {tuple(r) for r in streams.stream_job_states(spark, sf).collect()} and len(batch) > 10


def test_fold_cases(spark):
    log = spark.createDataFrame([(1, 5.0, 2, "claim"), (1, 5.0, 1, "create"), (1, 5.0, 1, "create"), (None, 1.0, 1, "create"), (2, None, 1, "create"), (3, 1.0, 1, "odd")], "k int, at_s double, seq bigint, kind string")
    got = {r.k: (r.state, r.accepted, r.rejected) for r in leases.fold(log, "k").collect()}
    assert got == {1: ("running", 2, 0), 3: ("none", 0, 1)}
    assert leases.fold(log.limit(0), "k").collect() == []
