import bz2
import gzip
import io
import json
import tarfile
import zipfile

from pyspark.sql import functions as F

from inkwell.sources import catalogs, html, sinks

PAGE = """<html><head><title>x</title><style>p{}</style></head><body><script>var a="</p>";</script>
<section epub:type="chapter"><h2>Chapter IV: The Mill</h2><p>One two<sup>1</sup> three<p>Four <b>five</p></b>
<div><p epub:type="pagebreak">9</p>loose</div></section>
<section epub:type="footnote"><p>A note.</p></section></body></html>"""


def test_html_blocks_and_sections(spark):
    blocks = html.html_blocks(PAGE)
    assert [(b["tag"], b["text"], b["spoken"]) for b in blocks] == [("h2", "Chapter IV: The Mill", True), ("p", "One two three", True), ("p", "Four five", True), ("p", "9", False), ("p", "A note.", False)]
    assert html.html_blocks(None) == [] and html.html_blocks("<p") == [] and html.html_blocks('<body epub:type="toc"><p>x</p></body>') == []
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "<h1>Prologue</h1><p>a b</p><h1>The End</h1>" + "<p>w w w</p>" * 20 + "<p>tail</p>")], "doc int, html string")
    out = html.typed_sections(html.explode_html(df, ["doc"]), ["doc"]).orderBy("doc", "sequence").collect()
    got = [(r.doc, r.section_type, r.ordinal, r.display_title, r.word_count) for r in out]
    assert got[0] == (1, "chapter", 4, "The Mill", 5)
    assert [g[:3] for g in got if g[0] == 3] == [(3, "prologue", None), (3, "chapter", None)]


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="urn:p" xmlns:dc="urn:dc"><metadata><dc:title>The  Mill</dc:title><dc:creator>A. B.</dc:creator></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>')
        for name in ("a", "b", "nav"):
            z.writestr(f"o/{name}.xhtml", f"<p>{name}</p>")
    return out.getvalue()


def test_epub_documents(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(epub())
    (tmp_path / "y.epub").write_bytes(b"no zip")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = [(r.place, r.name, r.title, r.author, r.language, r.html) for r in html.epub_documents(files).orderBy("place").collect()]
    assert got == [(0, "o/a.xhtml", "The Mill", "A. B.", "en", "<p>a</p>"), (1, "o/b.xhtml", "The Mill", "A. B.", "en", "<p>b</p>")]


def test_catalog_csv(spark, tmp_path):
    rows = 'Text#,Type,Title,Language,Authors\n11,Text,"Alice\n  Adventures",en,\n12,Sound,S,en,A\n13,Text,F,fr,A\n14,Text,B,en; zh,A\nx,Text,C,en,A\n'
    path = tmp_path / "c.csv.gz"
    path.write_bytes(gzip.compress(rows.encode()))
    got = [tuple(r) for r in catalogs.catalog_csv(spark, str(path)).collect()]
    assert got == [("gutenberg:11", "Alice Adventures", "Unknown", "en"), ("gutenberg:14", "B", "A", "zh")]
    assert catalogs.catalog_csv(spark, str(path), max_books=1).count() == 1


def test_rights_archive(spark, tmp_path):
    rdf = lambda n, rights, extra="": f'<?xml version="1.0"?>{extra}<rdf:RDF xmlns:rdf="urn:r" xmlns:pg="urn:p" xmlns:dc="urn:d"><pg:ebook rdf:about="ebooks/{n}"><dc:rights>{rights}</dc:rights><pg:file rdf:about="https://h/{n}.epub.noimages"/><pg:file rdf:about="https://h/{n}.epub-images"/></pg:ebook></rdf:RDF>'
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as t:
        for n, text in ((11, rdf(11, catalogs.PUBLIC_DOMAIN)), (12, rdf(12, "Copyrighted.")), (13, rdf(13, catalogs.PUBLIC_DOMAIN, "<!DOCTYPE x>")), (14, "broken")):
            info = tarfile.TarInfo(f"cache/{n}/pg{n}.rdf")
            info.size = len(text)
            t.addfile(info, io.BytesIO(text.encode()))
    (tmp_path / "r.tar.bz2").write_bytes(bz2.compress(raw.getvalue()))
    rights = catalogs.rights_archive(spark.read.format("binaryFile").load(str(tmp_path)))
    wanted = spark.createDataFrame([(f"gutenberg:{n}",) for n in (11, 12, 13, 15)], "source_id string")
    got = [tuple(r) for r in catalogs.verified(wanted, rights).collect()]
    assert got == [("gutenberg:11", catalogs.PUBLIC_DOMAIN, "https://h/11.epub-images")]


def test_feeds_and_listings(spark):
    page = json.dumps({"results": [{"id": 1, "title": "T", "authors": [{"name": "A"}, {"name": "B"}], "languages": ["fr", "en"], "copyright": False, "media_type": "Text"}, {"id": 2, "title": "U", "authors": [], "languages": ["en"], "copyright": True, "media_type": "Text"}]})
    got = [tuple(r) for r in catalogs.json_feed(spark.createDataFrame([(page,)], "value string")).collect()]
    assert got == [("gutenberg:1", "T", "A", "en")]
    listing = '<li typeof="schema:Book" about="/ebooks/a/b"><li class="not-pd x" about="/ebooks/c/d">'
    rows = spark.createDataFrame([(listing,), ('<a href="/ebooks/e/f">',)], "html string")
    assert sorted(r.path for r in catalogs.listing_paths(rows).collect()) == ["a/b", "e/f"]


def test_owner_documents(spark):
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="urn:w"><w:p><w:t>One</w:t><w:tab/><w:t>two</w:t></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:d>')
    df = spark.createDataFrame([("a.txt", "﻿x\r\ny".encode()), ("b.docx", docx.getvalue()), ("c.txt", b"\xff"), ("d.pdf", b"%PDF"), ("e.txt", b" ")], "path string, content binary")
    got = {r.path: r.text for r in catalogs.owner_documents(df).collect()}
    assert got == {"a.txt": "x\ny", "b.docx": "One\ttwo\n\nThree"}


def test_snapshots_manifests_and_builds(spark, tmp_path):
    edition = {"language": "zh", "page_id": 5, "revision": 9, "title": "t", "author": "a", "chapters": [{"page_id": 1, "revision": 2, "title": "x"}]}
    (tmp_path / "e.json").write_text(json.dumps([edition, edition | {"chapters": []}]))
    rows = catalogs.edition_snapshot(catalogs.edition_manifest(spark, str(tmp_path / "e.json"))).orderBy("place").collect()
    assert [r.valid for r in rows] == [True, False] and rows[0].source_id.startswith("wikisource:zh:5:9:") and rows[0].source_id != rows[1].source_id
    book = tmp_path / "books/al/ti"
    book.mkdir(parents=True)
    (book / "manifest.json").write_text(json.dumps({"title": "T", "author": "A", "source": "s", "renditions": {"r": {"voice": "v", "engine": "e", "current_build": "b2", "available_builds": ["b2", "b1", "b2"]}}}))
    got = [(r.author_slug, r.title_slug, r.rendition, r.build, r.is_current) for r in catalogs.builds_of(catalogs.manifests(spark, str(tmp_path / "books"))).orderBy("place").collect()]
    assert got == [("al", "ti", "r", "b2", True), ("al", "ti", "r", "b1", False)]
    merged = spark.range(1).select(sinks.merged_builds(F.array(F.lit("b2"), F.lit("b1")), F.lit("b3")).alias("x")).first().x
    assert merged == ["b3", "b2"]


def test_section_data_round_trip_and_commit(spark, tmp_path):
    from inkwell.operators import nested

    words = spark.createDataFrame([("s", "r", "b", 1, "heading", None, 0, "H", 0.0, 1.0), ("s", "r", "b", 1, "body", 0, 2, "y", 2.0, 3.0), ("s", "r", "b", 1, "body", 0, 1, "x", 1.0, 2.0)], "source_id string, rendition string, build string, sequence int, region string, chunk_index int, word_index int, word string, start_s double, end_s double")
    chunks = spark.createDataFrame([("s", 1, 0, "x y"), ("s", 1, 1, "no words")], "source_id string, sequence int, chunk_index int, text string")
    sections = spark.createDataFrame([("s", 1, "chapter", 1, ("L", "T", "S"))], "source_id string, sequence int, section_type string, ordinal int, heading struct<display_label:string,display_title:string,spoken_text:string>")
    made = sinks.section_data(sections, chunks, words)
    back = made.selectExpr("1L as data_id", "1 as received_at", "payload")
    got = sorted((r.chunk_pos, r.word_pos, r.word) for r in nested.flatten(back, "words").collect())
    assert got == [(-1, 0, "H"), (0, 0, "x"), (0, 1, "y")]
    root = str(tmp_path / "out")
    assert sinks.commit({"data": made}, root, {"version": 2}) and not sinks.commit({"data": made.limit(0)}, root, {})
    assert sinks.read_commit(spark, root, "data").count() == 1
