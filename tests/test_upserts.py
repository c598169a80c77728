from pyspark.sql import functions as F

from inkwell.functions import identity as I
from inkwell.operators import upserts as U


def test_upsert_freezes(spark):
    cur = spark.createDataFrame([(1, "en", "T", "sha"), (2, "en", "T", None), (3, "en", "T", "sha")], "k int, lang string, title string, sha string")
    new = spark.createDataFrame([(1, "zh", "N", "sha"), (2, "zh", "N", None), (4, "fr", "X", None)], "k int, lang string, title string, sha string")
    got = {r.k: (r.lang, r.title) for r in U.upsert(cur, new, ["k"], ["lang"], F.col("sha").isNotNull()).collect()}
    assert got == {1: ("en", "N"), 2: ("zh", "N"), 3: ("en", "T"), 4: ("fr", "X")}


def test_reconcile_and_later(spark):
    rows = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, None)], "k int, rev string")
    seen = spark.createDataFrame([(1, "r1", False), (2, "old", False), (3, None, None)], "k int, rev string, valid boolean")
    assert [r.k for r in U.reconciled(rows, seen, ["k"], "rev").collect()] == [2]
    a = spark.createDataFrame([(1, "j1", 5), (2, "j2", 5), (3, "j3", 5)], "k int, id string, at int")
    b = spark.createDataFrame([(1, "j9", 5), (2, "j2", 5), (3, "j4", 6), (4, "j5", 1)], "k int, id string, at int")
    assert {r.k: r.id for r in U.later(a, b, ["k"], "id", "at").collect()} == {1: "j1", 2: "j2", 3: "j4", 4: "j5"}


def test_receipts_and_pending(spark):
    receipts = spark.createDataFrame([("a", 2, "f", "x", "1"), ("a", 2, "f", "y", "2"), ("b", 2, "f", "x", "1"), ("c", 1, "f", "x", "1")], "receipt string, version int, fingerprint string, file string, sha string")
    files = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "9"), ("c", "x", "1")], "receipt string, file string, sha string")
    assert [r.receipt for r in U.reusable_receipts(receipts, files, "f").collect()] == ["a"]
    items = spark.createDataFrame([(1, "p"), (2, "q")], "k int, fp string")
    assert [r.k for r in U.pending(items, items.filter("k = 1").unionByName(spark.createDataFrame([(2, "old")], "k int, fp string")), ["k"], "fp").collect()] == [2]


def test_more_identity(spark):
    row = spark.range(1).select(
        I.title_slug(F.lit("The Mill!"), F.lit("gutenberg:12")), I.title_slug(F.lit("…"), F.lit("wikisource:zh:1:2:" + "a" * 16)), I.download_name(F.lit("a-b/c_d")),
        I.source_of_url(F.lit("https://www.gutenberg.org/ebooks/11.epub")), I.source_of_url(F.lit("https://standardebooks.org/ebooks/a/b/downloads/a_b.epub")), I.source_of_url(F.lit("https://x.org/ebooks/1")), I.error_text(F.lit("ODD"), ["A"], "OTHER"),
    ).first()
    assert row[0] == "the-mill-g12" and row[1].startswith("untitled-ws-") and len(row[1]) == 24
    assert tuple(row[2:]) == ("a-b_c-d.epub", "gutenberg:11", "standardebooks:a/b", None, "OTHER")
