"""Annotations, halved batches, attribution, payloads and merges: literal cases, nulls and empty tables."""

from pyspark.sql import functions as F

from inkwell.operators import dialogue as O
from inkwell.operators import performance as P
from inkwell.plans import directions

SEGMENT = "id int, speaker string, text string, delivery_type string, voice_policy string, join_policy string, emotion string, speed string, intensity string, pause string, synthesis_text string"


def test_annotations_and_their_faults(spark):
    row = lambda i, **k: (i, "Ann", "Come here at once, will you?", "spoken_dialogue", "character", "normal", k.get("emotion"), k.get("speed"), k.get("intensity"), k.get("pause"), k.get("text"))
    rows = [row(0), row(1, emotion="bored"), row(2, speed="brisk"), row(3, intensity="1.2"), row(4, pause="x"), row(5, emotion="angry", speed="fast", intensity="1", pause="500", text="Come!"), row(6, text="  ")]
    df = spark.createDataFrame(rows, SEGMENT)
    got = {r.id: r for r in P.annotated(df).collect()}
    assert [got[i].fault for i in range(7)] == [None, "emotion", "speed", "intensity", "pause", None, None]
    assert (got[0].emotion, got[0].speed, got[0].intensity, got[0].pause_ms) == ("neutral", 0.95, 0.5, 0)
    assert (got[3].emotion, got[3].intensity) == ("neutral", 0.5)
    assert (got[5].emotion, got[5].speed, got[5].intensity, got[5].pause_ms, got[5].synthesis_text) == ("angry", 1.05, 0.45, 120, "Come!")
    assert got[6].synthesis_text == "Come here at once, will you?"
    assert P.annotated(df.limit(0)).collect() == []


def halve(bad):
    """Tries of each item by trying, splitting and trying again."""
    tries = [0] * len(bad)

    def go(a, b):
        for i in range(a, b):
            tries[i] += 1
        if any(bad[a:b]) and b - a > 1:
            m = (a + b) // 2
            go(a, m)
            go(m, b)

    go(0, len(bad))
    return tries


def test_halved_batches_against_recursion(spark):
    import random

    rng = random.Random(3)
    batches = [[rng.random() < p for _ in range(n)] for n, p in ((1, 1), (1, 0), (7, 0.2), (20, 0.1), (20, 0), (13, 1), (20, 0.5))]
    rows = [(b, i, len(batch), x) for b, batch in enumerate(batches) for i, x in enumerate(batch)]
    out = P.halved(spark.createDataFrame(rows, "b int, place int, size int, bad boolean"), ["b"], "place", "size", "bad", 20).collect()
    assert {(r.b, r.place): r.tries for r in out} == {(b, i): n for b, batch in enumerate(batches) for i, n in enumerate(halve(batch))}
    assert all(r.kept != r.bad for r in out) and len(out) == len(rows)


def test_attribution_names_and_faults(spark):
    quotes = spark.createDataFrame([("s", i) for i in range(6)], "s string, quote_id int")
    answers = spark.createDataFrame([("s", 0, "Mr Hall"), ("s", 1, "Narrator"), ("s", 2, "Jonsen"), ("s", 3, "Nobody"), ("s", 4, "Mr Hall"), ("s", 4, "Mr Hall")], "s string, quote_id int, speaker string")
    known = spark.createDataFrame([("s", "Mr Hall", "John Hall", None), ("s", "Jonsen", None, "jonson")], "s string, speaker string, canonical string, repair string")
    got = {r.quote_id: (r.name, r.how) for r in P.attributed(quotes, answers, known, ["s"]).collect()}
    assert got == {0: ("John Hall", "resolved"), 1: ("narrator", "narrator"), 2: ("jonson", "repaired"), 3: ("Nobody", "as answered"), 4: (None, "repeated"), 5: (None, "missing")}
    spans = spark.createDataFrame([("a", 0, 3, "Ann"), ("b", 0, 2, "Ann")], "k string, start int, end int, speaker string")
    texts = spark.createDataFrame([("a", "abc"), ("b", "de")], "k string, text string")
    out = sorted(map(tuple, P.or_narrator(spans, texts, texts.filter("k = 'b'"), "k").collect()))
    assert out == [("a", 0, 3, "Ann"), ("b", 0, 2, "narrator")]


def test_adjacent_merge(spark):
    rows = [(1, 0, "Ann", "sad", 0, "a"), (1, 1, "Ann", "sad", 0, "b"), (1, 2, "Ann", "sad", 5, "c"), (1, 3, "Ann", "sad", 0, "d"), (1, 4, None, "sad", 0, "e"), (1, 5, None, "sad", 0, "f")]
    df = spark.createDataFrame(rows, "k int, o int, speaker string, emotion string, pause_ms int, text string")
    assert [r.text for r in P.adjacent_merged(df, ["k"], "o", ["speaker", "emotion"]).orderBy("o").collect()] == ["ab", "c", "d", "ef"]


def test_direction_payloads(spark):
    text = '{"engine":"e","cast_mode":"cast","sections":[{"sequence":3,"chunks":[{"index":0,"text":"Hi","segments":[{"speaker":"Ann","voice":"v","synthesis_text":"Hi","speed":0.0},{"speaker":"narrator","voice":"v","synthesis_text":"x"}]}]}]}'
    df = spark.createDataFrame([(text,), ('{"sections":[]}',), ("broken",), (None,)], "p string")
    rows = df.select(P.read_direction(F.col("p")).alias("d")).select("d", P.remapped(F.col("d"), F.lit("r"), F.lit("b"), F.lit("e2"), F.lit("cast"), F.lit("new")).alias("n"), P.direction_fits(F.col("d"), F.lit("e"), F.lit("cast"), F.lit(3), F.array(F.lit("Hi"))).alias("fits")).collect()
    one = rows[0].d.sections[0].chunks[0].segments
    assert (one[0].speed, one[0].delivery_type, one[0].voice_policy, one[0].original_text, one[0].pause_after_ms) == (1.0, "narration", "narrator", "Hi", 0)
    assert [s.voice for s in rows[0].n.sections[0].chunks[0].segments] == ["new", "new"] and rows[0].fits
    assert [r.d for r in rows[1:]] == [None, None, None]


def test_batches_never_hold_a_key(spark):
    rows = [("a", i, w, c) for i, (w, c) in enumerate([(1000, 10), (400, 10), (200, 10), (5000, 10), (1, 9999), (1, 2), (None, None)])] + [("b", 0, 1, 1)]
    df = spark.createDataFrame(rows, "k string, o int, w int, c int")
    got = sorted((r.k, r.o, r.batch) for r in O.batches(df, ["k"], "o", "w", "c").collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 5, 4), ("a", 6, 4), ("b", 0, 0)]
    assert O.batches(df.limit(0), ["k"], "o", "w", "c").collect() == []


def test_voices_and_registers(spark):
    pool = [("heart", "af_heart"), ("george", "bm_george"), ("adam", None)]
    df = spark.createDataFrame([("george",), ("af_heart",), ("zoe",), (None,)], "v string")
    assert [r[0] for r in df.select(P.voice_of(F.col("v"), pool)).collect()] == ["george", "heart", "heart", "heart"]
    assert [r[0] for r in df.select(P.voice_sex(F.col("v"))).collect()] == ["unknown", "female", "unknown", "unknown"]
    said = spark.createDataFrame([("He spoke aloud.",), ("“Go.”",), ("He went.",)], "t string")
    assert [r[0] for r in said.select(P.needs_registry(F.col("t"))).collect()] == [True, True, False]


def told(spark, folder):
    """Quotes for each way a name is settled, a repeated chunk, one without quotes, and one of no book."""
    chunks = [("a", 1, 0, 1, "“Go.” said Ann Lee. “No,” cried Mr. Hall, and “Stay,” said Jonsenn."), ("a", 1, 1, 2, "“Now,” said Ann Lee, " + "they waited. " * 6 + "“Wait.”"), (None, 2, 0, 3, "“Yes,” said Bob, and rose."), ("b", 3, 0, 4, "Nobody spoke."), ("b", 3, 1, 5, "“So it was,” said Narrator. “Yes,” said Ann Lee.")]
    spark.createDataFrame([*chunks, chunks[0]], "source_id string, section_id bigint, chunk_index int, chunk_id bigint, text string").write.parquet(f"{folder}/chunks.parquet")
    people = [(1, "a", "John Hall", ["Mr. Hall", None]), (2, "a", "Jonsen", None)]
    spark.createDataFrame(people, "character_id bigint, source_id string, canonical string, aliases array<string>").write.parquet(f"{folder}/character_profiles.parquet")
    return str(folder)


def as_its_sql(spark, folder, name):
    """The query's rows, found to be those of its SQL, from a plan of few shuffles (the driver holds all stages and their metrics)."""
    import duckdb

    df = directions.QUERIES[name](spark, folder)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") < 25
    duck = duckdb.connect()
    for x in ("chunks", "character_profiles"):
        duck.execute(f"create view {x} as select * from '{folder}/{x}.parquet/*.parquet'")
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in df.columns)} from ({directions.ORACLES[name]})").fetchall()
    rows = sorted(map(tuple, df.collect()), key=repr)
    assert rows == sorted(want, key=repr)
    return rows


def test_attributed_spans_as_sql(spark, tmp_path):
    rows = as_its_sql(spark, told(spark, tmp_path), "attribution_spans")
    assert [r[3] for r in sorted(rows) if r[0] == 1 and r[3] != "narrator"] == ["Ann Lee", "john hall", "jonsen"]
    assert [r for r in rows if r[0] in (2, 3)] == [(2, 0, 106, "narrator"), (3, 0, 6, "Bob"), (3, 6, 26, "narrator")]


def test_attributed_speakers_as_sql(spark, tmp_path):
    rows = as_its_sql(spark, told(spark, tmp_path), "attribution_speakers")
    assert {r[2:] for r in rows if r[0] == 1} == {("Ann Lee", "as answered"), ("john hall", "resolved"), ("jonsen", "repaired"), (None, "missing")}
    assert [r for r in rows if r[0] == 2] == [(2, 0, "Bob", "as answered")] and {r[2:] for r in rows if r[0] == 3} == {("narrator", "narrator"), ("Ann Lee", "as answered")}


def test_minimal_characters_as_sql(spark, tmp_path):
    rows = as_its_sql(spark, told(spark, tmp_path), "registry_minimal")
    assert sorted((r[0] or "", r[1], r[5]) for r in rows) == [("", "Bob", 1), ("a", "Ann Lee", 2), ("b", "Ann Lee", 1)]


def test_names_larger_than_estimated(spark, tmp_path):
    """Near forms of names, many times what the optimizer takes them for, are not built on the driver (a broadcast is at least a page of 64 MB here)."""
    folder = told(spark, tmp_path)
    hexes = lambda c, n: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.hex(F.xxhash64(F.col(c), i)))
    texts = spark.range(100, 200).select(F.lit("d").alias("source_id"), F.col("id").alias("section_id"), F.lit(0).alias("chunk_index"), F.col("id").alias("chunk_id"), F.array_join(hexes("id", 2000), " ").alias("text"))
    texts.coalesce(1).write.mode("append").parquet(f"{folder}/chunks.parquet")
    people = spark.range(100, 6100).select(F.col("id").alias("character_id"), F.lit("c").alias("source_id"), F.concat_ws(" ", F.lit("Reader"), F.hex("id")).alias("canonical"), F.transform(hexes("id", 4), lambda a: F.concat(F.lit("Traveller "), a)).alias("aliases"))
    people.coalesce(1).write.mode("append").parquet(f"{folder}/character_profiles.parquet")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "100m")
    try:
        as_its_sql(spark, folder, "attribution_speakers")
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
