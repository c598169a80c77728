import io
import zipfile

from pyspark.sql import functions as F

from inkwell.sources import pages as P


def package(manifest, files, meta=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="urn:c"><rootfile full-path="o/p.opf"/></c>')
        z.writestr("o/p.opf", f'<package xmlns="urn:p"><metadata>{meta}</metadata><manifest>{manifest}</manifest></package>')
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_bodies_and_links():
    html = '<div class="mw-parser-output"><div class="ws-summary"><a href="/wiki/A_b">A</a><a href="/wiki/C%20d">C</a></div><p>One<br>two<sup class="reference">1</sup><p>Three <b>x</p><div class="license"><p>no</p></div><script>z</script></div>'
    assert P.body_paragraphs(html) == ["One two", "Three x"] and P.body_paragraphs(None) == []
    assert P.chapter_links(html, "en") == ["A b", "C d"]
    assert P.chapter_links(html.replace("C%20d", "A_b"), "en") is None and P.chapter_links(html.replace("C%20d", "File:x"), "en") is None


def test_covers():
    item = lambda i, name, extra="": f'<item id="{i}" href="{name}" media-type="image/png" {extra}/>'
    two = item("a", "a.png") + item("b", "b.png")
    files = {"o/a.png": b"x" * 6000, "o/b.png": b"y" * 10}
    assert P.cover(package(two, files))[0] == "o/a.png"
    assert P.cover(package(two, files, '<meta name="cover" content="b"/>'))[0] == "o/b.png"
    assert P.cover(package(item("a", "a.png") + item("b", "b.png", 'properties="cover-image"'), files))[0] == "o/b.png"
    assert P.cover(package(item("b", "b.png"), files)) is None


def test_navigation():
    nav = '<html xmlns="urn:h"><body><nav><a href="t.xhtml#one">First  one</a><a href="t.xhtml">Later</a></nav></body></html>'
    got = P.navigation_labels(package('<item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>', {"o/nav.xhtml": nav}))
    assert got == {"o/t.xhtml": "First one", "o/t.xhtml#one": "First one"}


def test_columns(spark):
    row = spark.range(1).select(
        P.is_notice(F.lit("The Project Gutenberg eBook … License")), P.is_notice(F.lit("a license")), P.is_separator(F.lit("*** START OF THE PROJECT GUTENBERG EBOOK X")),
        P.majority_language(F.lit("春天来了 ok"), F.lit(None).cast("string")), P.majority_language(F.lit("so it is 春"), F.lit("")), P.majority_language(F.lit("x"), F.lit("fr")),
        P.indented_paragraphs(F.lit("　　春天。\n　　夏天。\n\n秋天。")), P.indented_paragraphs(F.lit("a\n  b\n\nc")),
    ).first()
    assert tuple(row) == (True, False, True, "zh", "en", "fr", ["春天。", "夏天。", "秋天。"], ["a\n  b", "c"])
