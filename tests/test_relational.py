import random

from pyspark.sql import functions as F

from inkwell.operators import relational as R


def test_latest_and_first_rows(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "b"), (1, 3, "a"), (2, None, "x"), (None, 9, "y")], "k int, at int, v string")
    assert sorted((r.k, r.at, r.v) for r in R.latest(df, ["k"], F.col("at"), F.col("v")).collect()) == [(1, 3, "b"), (2, None, "x")]
    assert R.latest(df.limit(0), ["k"], F.col("at")).collect() == []
    two = R.first_rows(df.dropna(), ["k"], 2, F.desc("at"), F.col("v")).collect()
    assert [(r.v, r.rank) for r in sorted(two, key=lambda r: r.rank)] == [("a", 1), ("b", 2)]


def test_pages(spark):
    df = spark.createDataFrame([(i, "x") for i in range(25)], "i int, v string")
    page = R.page(df, [F.col("i")], 20, 10).collect()
    assert sorted(r.i for r in page) == [20, 21, 22, 23, 24] and {r.total for r in page} == {25}
    assert R.page(df.limit(0), [F.col("i")], 0, 10).collect() == []
    assert [r.i for r in R.keyset_page(df, ["i"], [21], 3).collect()] == [22, 23, 24] and [r.i for r in R.keyset_page(df, ["i"], None, 2).collect()] == [0, 1]


def test_islands(spark):
    rows = [(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    assert [r.run for r in R.islands(df, ["k"], ["i"], ["v"]).orderBy("i").collect()] == [1, 1, 2, 2, 3, 4]


def test_as_of_matches_a_scan(spark):
    rng = random.Random(6)
    steps = [(k, t, f"s{k}-{t}") for k in range(3) for t in sorted(rng.sample(range(50), 8))]
    points = [(k, rng.randrange(-5, 60), "p") for k in range(4) for _ in range(20)]
    p, s = spark.createDataFrame(points, "k int, at int, name string"), spark.createDataFrame(steps, "k int, t int, label string")
    got = sorted((r.k, r.at, r.label or "") for r in R.as_of(p, s, ["k"], "at", "t", ["label"]).collect())
    want = sorted((k, at, max(((t, v) for kk, t, v in steps if kk == k and t <= at), default=(0, ""))[1]) for k, at, _ in points)
    assert got == want
