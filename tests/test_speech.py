import math
import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import audio as A
from inkwell.functions import direction as D
from inkwell.functions import headings as H
from inkwell.functions import identity as I
from inkwell.functions import search as S
from inkwell.functions import synthesis as Y
from inkwell.operators import dialogue, folds, quality, search, timeline


def one(spark, *columns, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(*columns).first()


# --- pauses and audio --------------------------------------------------------


def test_break_types(spark):
    cases = [("painting them red.", "Alice thought", False, "sentence"), ("she said,", "and waited", False, "phrase"), ("x", "y", True, "paragraph"), ("x\n\n", "y", False, "paragraph"), ("", "y", False, "word"), ("go”", "y", False, "quote"), ("ended.”", "y", False, "sentence"), ("a", "b", False, "word")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, b string, a string, p boolean, want string")
    assert all(r.got == r.want for r in df.select("want", A.break_type(F.col("b"), F.col("a"), F.col("p")).alias("got")).collect())
    got = one(spark, A.pause_ms(F.lit("paragraph")), A.pause_ms(F.lit("odd")), A.frames(F.lit(350), 1000))
    assert tuple(got) == (600, 120, 350)


def test_audio_arrays(spark):
    a = F.array(*map(F.lit, [0.0, 0.0, 0.5, -1.0, 0.0, 0.0, 0.0]))
    n, lim, r, quiet, edge = one(spark, A.normalize(a), A.limit_silence(a, 1000, 1), A.rms(a, F.lit(2), 2), A.silence_length(a, F.lit(4), F.lit(7), 1), A.fade(F.array(*[F.lit(1.0)] * 8), 1000, 3))
    assert [round(x, 3) for x in n] == [0, 0, 0.445, -0.89, 0, 0, 0] and lim == [0.0, 0.5, -1.0, 0.0]
    assert math.isclose(r, math.sqrt(1.25 / 2)) and quiet == 3 and edge == [0.0, 0.5, 1.0, 1.0, 1.0, 1.0, 0.5, 0.0]
    silent = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, A.normalize(silent))[0] == [0.0, 0.0]


def test_pause_edit_moves_what_follows(spark):
    seams = spark.createDataFrame([(1, "sentence", 400, 520)], "track_id int, break_type string, pause_start_frame bigint, pause_end_frame bigint")
    edits = timeline.pause_edits(seams, 1000)
    assert [(r.old_end, r.new_end, r.delta) for r in edits.collect()] == [(520, 750, 230)]
    points = spark.createDataFrame([(1, f) for f in (0, 450, 519, 520, 600, 1000)], "track_id int, frame bigint")
    assert sorted((r.frame, r.new_frame) for r in timeline.shifted(points, edits, ["track_id"]).collect()) == [(0, 0), (450, 450), (519, 519), (520, 750), (600, 830), (1000, 1230)]


def test_next_start(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, -1.0), ("a", 2, 5.0), ("b", 0, 0.0), ("b", 1, -1.0), ("b", 2, -1.0), ("b", 3, 8.0)], "k string, chunk_index int, start_s double")
    got = {(r.k, r.chunk_index): r.next_start for r in timeline.next_starts(df, ["k"]).collect()}
    assert got["a", 0] == 5 and got["b", 0] == 8 and got["a", 2] is None


def test_monotonic_matches_the_recurrence(spark):
    rng = random.Random(8)
    rows = [(k, i, rng.randint(-20, 400), rng.randint(-20, 420)) for k in range(3) for i in range(60)]
    want, at = {}, {}
    for k, i, s, e in rows:
        start = max(s, at.get(k, 0))
        at[k] = max(e, start + 10)
        want[k, i] = (start, at[k])
    df = spark.createDataFrame(rows, "k int, i bigint, s bigint, e bigint")
    for block in (7, 1 << 16):
        got = {(r.k, r.i): (r.s, r.e) for r in timeline.monotonic(df, ["k"], "i", "s", "e", block=block).collect()}
        assert got == want


def test_violations_and_coverage(spark):
    w = spark.createDataFrame([(1, 0, "a", 0.0, 1.0, 0), (1, 1, " ", 0.5, 1.0, 0), (1, 2, "c", 0.4, 12.0, 2), (1, 3, "d", -1.0, 0.0, 0)], "t int, i int, word string, start_s double, end_s double, chunk_index int")
    got = sorted((r.i, r.violation) for r in timeline.violations(w.withColumn("d", F.lit(10.0)).withColumn("n", F.lit(2)), ["t"], ["i"], "d", "n").collect())
    assert got == [(1, "empty word"), (2, "chunk out of range"), (2, "end beyond"), (2, "start backward"), (3, "start backward"), (3, "start negative")]
    ratios = one(spark, *(timeline.coverage_ratio(F.lit(a), F.lit(b)) for a, b in ((0, 0), (0, 4), (3, 0), (1, 3))))
    assert tuple(ratios) == (1.0, 0.0, 0.0, 0.3333)


def test_tokens_to_words(spark):
    t = spark.createDataFrame([(1, 0, "He", 0.0, 0.1), (1, 1, "llo ", 0.1, 0.2), (1, 2, "x", 0.2, 0.3), (1, 3, ". ", 0.3, 0.4), (1, 4, " ", 0.4, 0.5)], "k int, i int, token string, start_s double, end_s double")
    assert sorted((r.word, r.start_s, r.end_s) for r in timeline.merged_tokens(t, ["k"], "i").collect()) == [("Hello", 0.0, 0.2), ("x.", 0.2, 0.4)]


# --- quotes and direction ----------------------------------------------------


def walk(text):
    out, start, mark = [], None, ""
    for i, c in enumerate(text):
        if start is None:
            if c in '“"':
                start, mark = i, c
        elif c == "”" or c == '"' == mark:
            out.append((start, i + 1))
            start = None
    return out


def test_quotes_match_a_walk(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('ab “”"\n') for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: [(q.start, q.end) for q in r.q] for r in df.select("i", D.quote_spans(F.col("t")).alias("q")).collect()}
    assert all(got[i] == walk(t) for i, t in enumerate(texts))


def test_tiling(spark):
    texts = spark.createDataFrame([(1, 'Holmes said, "Come."'), (2, "No quotes at all here."), (3, "")], "k int, text string")
    said = spark.createDataFrame([(1, 13, 20, "Sherlock Holmes")], "k int, start int, end int, speaker string")
    spans = dialogue.tiled_spans(texts, said, "k")
    got = sorted((r.k, r.start, r.end, r.speaker) for r in spans.collect())
    assert got == [(1, 0, 13, "narrator"), (1, 13, 20, "Sherlock Holmes"), (2, 0, 22, "narrator")]
    assert dialogue.span_violations(texts, spans, "k").count() == 0
    broken = spans.filter("speaker <> 'narrator'")
    assert {r.violation for r in dialogue.span_violations(texts, broken, "k").collect()} == {"not contiguous", "does not cover the text"}


def test_names(spark):
    p = spark.createDataFrame([("b", 1, "Sherlock Holmes", ["the detective"]), ("b", 2, "Mary Holmes", []), ("b", 3, "John Watson", None)], "s string, character_id int, canonical string, aliases array<string>")
    names = dialogue.names_of(p, ["s"])
    asked = spark.createDataFrame([("b", x) for x in ("Sherlock  holmes", "Detective", "Holmes", "watson", "nobody")], "s string, speaker string")
    got = {r.speaker: r.character_id for r in dialogue.resolve(asked, names, ["s"]).collect()}
    assert got == {"Sherlock  holmes": 1, "Detective": 1, "Holmes": None, "watson": 3, "nobody": None}


def test_direction_scalars(spark):
    long = " ".join(["word"] * 30) + "."
    row = one(
        spark, D.speed(F.lit("fast"), F.lit("narrator"), F.lit("Hi.")), D.speed(F.lit("fast"), F.lit("Narrator"), F.lit(long)), D.speed(F.lit("fast"), F.lit("Ann"), F.lit(long)),
        D.intensity(F.lit("sad"), F.lit(0.9), F.lit("Hi."), F.lit("narration")), D.intensity(F.lit("sad"), F.lit(0.9), F.lit("“Hi.”"), F.lit("narration")), D.intensity(F.lit("sad"), F.lit(0.9), F.lit(long), F.lit("narration")), D.intensity(F.lit("neutral"), F.lit(0.9), F.lit("Hi."), F.lit("x")),
        D.pause_after(F.lit(500), F.lit("normal"), F.lit("character"), F.lit("narration")), D.pause_after(F.lit(500), F.lit("tight"), F.lit("character"), F.lit("narration")), D.pause_after(F.lit(5000), F.lit("normal"), F.lit("character"), F.lit("narration")),
    )
    assert tuple(row) == (1.0, 0.95, 1.05, 0.45, 0.6, 0.8, 0.9, 120, 0, None)
    c = one(spark, D.engine_controls(F.lit("angry"), F.lit(0.5)))[0]
    assert (c.intensity, c.exaggeration, c.cfg_weight) == (0.5, 0.675, 0.42)


def test_grouping_keeps_the_text():
    text = "“Oh!” said Alice, “dear.” She ran."
    span = lambda a, b, who, kind, policy: {"start": a, "end": b, "speaker": who, "delivery_type": kind, "voice_policy": policy}
    spans = [span(0, 5, "Alice", "self_talk", "character"), span(5, 18, "narrator", "narration", "narrator"), span(18, 25, "Alice", "self_talk", "character"), span(25, len(text), "narrator", "narration", "narrator")]
    got = folds.performance_groups(text, spans)
    assert [(g[1], g[2], g[3]) for g in got] == [(0, 25, "Alice"), (25, len(text), "narrator")]
    spoken = [s | {"delivery_type": "spoken_dialogue"} if s["speaker"] == "Alice" else s for s in spans]
    got = folds.performance_groups(text, spoken)
    assert len(got) == 4 and got[1][5] == "tight" and "".join(text[g[1] : g[2]] for g in got) == text
    assert folds.performance_groups(None, None) == []


def test_candidates_and_merges():
    text = "He came in. Mr. Ray said: “Go now.” Then he left."
    units = folds.candidate_units(text)
    assert units == ["He came in. ", "Mr. Ray said: ", "“Go now.” ", "Then he left."] and "".join(units) == text
    assert folds.candidate_units("One only") == ["One only"] and folds.candidate_units(None) == [""]
    long = "This is a rather long sentence that has more than twelve words in it. "
    assert folds.merged_short([long, "Short. ", long], "narration") == [long + "Short. ", long]
    assert folds.merged_short(["A. ", "B."], "narration") is None and folds.merged_short(["A. ", "B."], "self_talk") == ["A. ", "B."]


def test_voices():
    pool = (("f1", "female"), ("m1", "male"))
    cast = [{"name": n, "gender": g, "hint": h} for n, g, h in (("a", "male", None), ("b", "male", None), ("c", "female", None), ("d", "x", "f1"))]
    assert folds.assigned_voices(cast, pool) == [("a", "m1"), ("b", "f1"), ("c", "f1"), ("d", "f1")]
    with pytest.raises(ValueError):
        folds.assigned_voices(cast, ())


def test_aligned_text():
    assert folds.aligned_parts("Oh, the mill!", ["Oh", "x", "mill", None]) == [("Oh", 0), (", the ", None), ("mill", 2), ("!", None)]
    words = [{"word": "春", "start_s": 0.0, "end_s": 1.0}, {"word": "天it", "start_s": 1.0, "end_s": 2.0}, {"word": "'s", "start_s": 2.0, "end_s": 3.0}]
    assert folds.timed_units("春天it's", words) == [(0, "春", 0.0, 1.0), (1, "天", 1.0, 2.0), (2, "it's", 1.0, 3.0)]


# --- units for speech --------------------------------------------------------


def test_char_units(spark):
    text = " ".join("Sentence number %d goes on for a while here." % i for i in range(20)) + " " + "w" * 400
    units = one(spark, Y.char_units(F.lit(text)))[0]
    assert " ".join(units) == text and all(len(u) <= 320 for u in units[:-1])
    assert one(spark, Y.char_units(F.lit("short")))[0] == ["short"]
    words = " ".join(["word"] * 70)
    packed = one(spark, Y.word_pack(F.lit(words)))[0]
    assert " ".join(packed) == words and len(packed) == 1 + (len(words) > 368)


def test_paragraphs_and_cleaning(spark):
    got = one(spark, Y.paragraph_units(F.lit("Chapter IV\n\nThe mill stood still here.\n\nIt fell down at last. So")), Y.sanitize(F.lit("﻿[softly, warm] He <b>ran</b>  [loud]")), Y.has_spoken(F.lit("[sigh] <i>…</i>")), Y.last_sentence(F.lit("One. Two three.”")), Y.last_sentence(F.lit("春天。夏天来了。"), 2))
    assert got[0] == ["Chapter IV. The mill stood still here.", "It fell down at last. So"]
    assert tuple(got[1:]) == ("He ran [loud]", False, "Two three.”", "来了。")


# --- headings, identity, search, quality -------------------------------------


def test_headings(spark):
    cases = [("Chapter IV: The Mill", "chapter", 4, "The Mill"), ("第十二章 风", "chapter", 12, "风"), ("第一百零三回", "chapter", 103, ""), ("XIV.", "chapter", 14, ""), ("IIII", None, None, ""), ("Preface to it", "preface", None, "to it"), ("The Mill", None, None, "")]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = [tuple(r.k) for r in df.orderBy("i").select(H.heading_class(F.col("t")).alias("k")).collect()]
    assert got == [c[1:] for c in cases]
    row = one(spark, H.english_number(F.lit(342_117)), H.english_number(F.lit(1_000_000)), H.english_number(F.lit(40)), H.chapter_spoken(F.lit(21), F.lit("Why?"), F.lit("en-GB")), H.legacy_heading(F.lit("IV. The Mill")), H.legacy_heading(F.lit("Mill")), H.chinese_ordinal(F.lit("二千零三")), H.chinese_ordinal(F.lit("一二〇")), H.int_to_roman(F.lit(1994)))
    assert tuple(row) == ("Three Hundred Forty-Two Thousand One Hundred Seventeen", "1000000", "Forty", "Chapter Twenty-One. Why?", "Chapter Four. The Mill.", "Mill", 2003, 120, "MCMXCIV")


def test_identity(spark):
    row = one(spark, I.byte_range(F.lit("bytes=5-"), F.lit(10)), I.byte_range(F.lit("bytes=-3"), F.lit(10)), I.byte_range(F.lit("bytes=10-"), F.lit(10)), I.redact(F.lit("a secret secrets"), ["secret", "secrets"]), I.fingerprint(F.lit('{"b": 1, "a": [2]}')), I.fingerprint(F.lit('{"a":[2],"b":1}')), I.fingerprint(F.lit("{")), I.parse_manifest_key(F.lit("books/a-b/c/manifest.json")), I.duration_text(F.lit(3725)), I.clock_text(F.lit(65)))
    assert tuple(row[0]) == (5, 5) and tuple(row[1]) == (7, 3) and row[2] is None and row[3] == "a [redacted] [redacted]"
    assert row[4] == row[5] and row[6] is None and tuple(row[7]) == ("a-b", "c") and row[8:] == ("1h 2m", "1:05")

    def hue(text):
        h = 0
        for c in text:
            shifted = (h << 5) & 0xFFFFFFFF
            h = ord(c) + (shifted - (1 << 32) if shifted >= 1 << 31 else shifted) - h
        return h % 360

    for text in ("", "a", "The Bells of Quengdogwarn", "z" * 40):
        assert one(spark, I.hue(F.lit(text)))[0] == hue(text)


def test_search(spark):
    books = spark.createDataFrame([("s1", "The Lanterns", "Ann Ray"), ("s2", "Lantern Light", "Bo Lee"), ("s3", "Émile", "Lan Fox"), ("s4", "三國志演義", "羅貫中"), ("s5", None, None)], "source_id string, title string, author string")
    index = search.token_index(books)
    found = lambda q: [(r.score, r.source_id) for r in search.search(books, index, q).collect()]
    assert found("lantern") == [(1, "s2"), (3, "s1")]
    # swapped letters, and one edit beside the swap: both words are within the distance of two
    assert found("lanetrns") == [(6, "s1")]
    assert found("emile") == [(0, "s3")] and found("x") == [] and found("三国演义") == [(4, "s4")] and found("ann ray") == [(2, "s1")]
    assert one(spark, S.tokens(S.clean(F.lit("Émile’s 三國志 the the"))))[0] == ["emile", "s", "三國志", "the", "三國", "國志"]


def test_word_errors():
    plain = lambda r, h: quality.word_errors(r, h)
    assert plain("", "") == 0 and plain(None, "a") == 1 and plain("a", "x y z") == 3 and plain("A, b c.", "a c") == pytest.approx(1 / 3)
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(1, 9))] for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert plain(" ".join(a), " ".join(b)) == pytest.approx(row[-1] / len(a))


def test_log_issues(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["start", "ERROR boom", "ok", "WARNING low"])], "k int, i int, line string")
    got = quality.log_issues(rows, ["k"], "i", "line", {"error": "ERROR", "warning": "WARN"}, 1).orderBy("i").collect()
    assert [(r.issue, r.context) for r in got] == [("error", "start\nERROR boom\nok"), ("warning", "ok\nWARNING low")]
