"""Headings, timelines, ledgers, certification, editions and searches: literal cases and brute force."""

import io
import zipfile

from pyspark.sql import functions as F

from inkwell.functions import search as S
from inkwell.operators import artifacts as X
from inkwell.operators import certify as V
from inkwell.operators import search as Q
from inkwell.sources import editions as E


def test_headings(spark):
    rows = [
        ("chapter", 4, ["Chapter IV", "The Door"], "", "", "en", ("Chapter IV", "The Door", "Chapter Four. The Door.")),
        ("chapter", 4, ["Chapter IV"], "Inline", "", "de", ("Chapter IV", "Inline", "Chapter IV.")),
        ("chapter", None, ["The Door"], "", "", "en", ("", "The Door", "The Door")),
        ("chapter", None, [], "", "Nav", "en", ("", "Nav", "Nav")),
        ("prologue", None, ["Prologue", "The Sea"], "", "", "en", ("Prologue", "The Sea", "Prologue. The Sea.")),
        ("prologue", None, ["The Sea"], "", "", "en", ("Prologue", "The Sea", "Prologue. The Sea.")),
        ("preface", None, [], "", "To the reader", "en", ("Preface", "To the reader", "Preface. To the reader.")),
        ("other", None, [], "", "Nav", "en", ("Nav", "", "Nav.")),
        ("other", None, [], "", "", "en", ("", "", "")),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "k string, o int, t array<string>, i string, n string, l string")
    got = [tuple(r[0]) for r in df.select(X.build_heading(*(F.col(c) for c in "kotinl"))).collect()]
    assert got == [r[6] for r in rows]


def test_section_timeline_and_ledger(spark):
    df = spark.createDataFrame([(1, 0, 100), (1, 1, None), (1, 2, 50), (1, 3, 10), (2, 0, None), (2, 1, 5)], "k int, chunk_index int, frames long")
    got = {(r.k, r.chunk_index): (r.start_frame, r.end_frame) for r in X.section_timeline(df, ["k"], 10, F.lit(7)).collect()}
    assert got == {(1, 0): (10, 110), (1, 1): (-1, None), (1, 2): (117, 167), (1, 3): (174, 184), (2, 0): (-1, None), (2, 1): (10, 15)}
    units = spark.createDataFrame([(1, 0, 100, "sentence"), (1, 1, 50, None)], "k int, o int, frames long, break_type string")
    out = [(r.start_frame, r.end_frame, r.pause_end_frame) for r in X.unit_ledger(units, ["k"], ["o"]).orderBy("o").collect()]
    assert out == [(0, 100, 100 + 350 * 24), (100 + 350 * 24, 150 + 350 * 24, 150 + 350 * 24)]
    assert X.section_timeline(df.limit(0), ["k"], 10, F.lit(7)).collect() == []


def test_render_units(spark):
    df = spark.createDataFrame([(1, "One here. Two, there! And “three”"), (2, "x " * 300), (3, ""), (4, None)], "id int, t string")
    got = [(r.id, r.unit_index, r.unit, r.break_type) for r in X.render_units(df, "id", "t").orderBy("id", "unit_index").collect()]
    assert got[:3] == [(1, 0, "One here.", "sentence"), (1, 1, "Two, there!", "sentence"), (1, 2, "And “three”", None)]
    assert [len(g[2].split()) for g in got if g[0] == 2] == [40] * 7 + [20]
    assert {g[0] for g in got} <= {1, 2}


def test_writes_and_calls(spark):
    cur = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "a", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "b", 1), (4, "a", 1)], "k int, x string, y int")
    got = {r.k: r.verdict for r in V.write_verdicts(cur, new, ["k"], ["x", "y"], F.col("k") == 2).collect()}
    assert got == {1: "same", 2: "replace", 3: "conflict", 4: "create"}
    df = spark.createDataFrame([("You are casting voices",), ("assigning speakers to",), (None,)], "p string")
    assert [r[0] for r in df.select(V.call_kind(F.col("p"))).collect()] == ["registry", "attribution", "other"]


def _epub(rights="Public domain in the USA.", identifier="https://www.gutenberg.org/ebooks/7", body="<p>Words here.</p>", language="en", mimetype=b"application/epub+zip"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", mimetype)
        z.writestr("META-INF/container.xml", "<container/>")
        z.writestr("a.opf", f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:rights>{rights}</dc:rights><dc:identifier>{identifier}</dc:identifier><dc:language>{language}</dc:language></package>')
        z.writestr("b.xhtml", body)
    return out.getvalue()


def test_edition_files(spark):
    cases = [
        (_epub(), None), (_epub(rights="All rights reserved"), "rights"), (_epub(identifier="https://www.gutenberg.org/ebooks/8"), "identifier"), (_epub(body="<p>This is a COPYRIGHTED Project\nGutenberg eBook</p>"), "banner"),
        (_epub(mimetype=b"text/plain"), "media type"), (_epub(language="fr"), "language"), (_epub(body="<p> </p>"), "no words"), (b"PK not a zip", "archive"), (b"", "size"), (None, "size"),
    ]
    df = spark.createDataFrame([("gutenberg:7", c, "en") for c, _ in cases], "source_id string, content binary, language string")
    assert [r.fault for r in E.epub_faults(df.coalesce(1)).collect()] == [f for _, f in cases]


def test_uploads(spark):
    rows = [(b"%PDF-1.7", "pdf"), (b"x", "pdf"), (b"PK\x03\x04..", "docx"), (b"PK", "docx"), ("Text".encode(), "txt"), (b"\xff\xfe", "txt"), (b" \n", "txt"), (b"a\x00b", "txt"), (b"", "txt"), (None, "txt"), (b"x", "exe")]
    df = spark.createDataFrame(rows, "c binary, k string")
    assert [r[0] for r in df.select(E.upload_fault(F.col("c"), F.col("k"))).collect()] == [None, "not a PDF", None, "not a package", None, "not UTF-8", "no text", "no text", "empty", "empty", "kind"]


def test_query_reading_agrees_with_the_index(spark):
    queries = ["The Ｂells", "Émile  ZOLA", "孫張的書", "a-b c", "", "  ", "ﬁne Ångström", "été à X", "龍門"]
    df = spark.createDataFrame([(q,) for q in queries], "q string")
    assert [r[0] for r in df.select(S.canonical(F.col("q"))).collect()] == [Q.read_query(q)[0] for q in queries]


def test_search_against_brute_force(spark):
    books = [("gutenberg:1", "The Lantern", "Ann Hall"), ("gutenberg:2", "The Lanterns of Spring", "B. Lane"), ("gutenberg:3", "Lan", None), ("gutenberg:4", None, "Lantern Smith"), ("gutenberg:5", "清早的书", "孙文"), ("gutenberg:6", "清早", "孙文")]
    df = spark.createDataFrame(books, "source_id string, title string, author string")
    index = Q.written_index(Q.token_index(df))
    assert [(r.score, r.source_id) for r in Q.search(df, index, "lantern").collect()] == [(2, "gutenberg:4"), (3, "gutenberg:1"), (3, "gutenberg:2")]
    assert {r.source_id for r in Q.search(df, index, "lanetrn").collect()} == {"gutenberg:1", "gutenberg:4"}
    assert [r.source_id for r in Q.search(df, index, "清早").collect()] == ["gutenberg:6", "gutenberg:5"]
    assert Q.search(df, index, "x").collect() == [] and Q.search(df, index, "").collect() == [] and Q.search(df.limit(0), index, "lantern").collect() == []
