from pyspark.sql import functions as F

from inkwell.operators import registry as R


def test_names_in_texts(spark):
    df = spark.createDataFrame([("Old Sherlock-Holmes met Mary, mary and D'Arcy Lee.", "mary"), ("Maryland", "mary"), (None, "x"), ("x", ""), ("a.b", "a.b")], "t string, n string")
    got = df.select(R.contains_name(F.col("t"), F.col("n")).alias("c"), R.observed_names(F.col("t")).alias("o")).collect()
    assert [r.c for r in got] == [True, False, False, False, True]
    assert got[0].o == ["Old Sherlock-Holmes", "Mary", "Arcy Lee"]


def test_cleaned_grounded_merged(spark):
    raw = spark.createDataFrame([(1, " Holmes ", ["Sherlock", None, " "], None, "q"), (1, "Narrator", [], "m", "q"), (1, "", [], "m", "q"), (1, "Moriartti", None, "m", "q"), (1, "Nobodyhere", None, "m", "q")], "k int, canonical string, aliases array<string>, gender string, first_evidence_quote string")
    c = R.cleaned(raw)
    assert sorted((r.canonical, r.aliases, r.gender) for r in c.collect()) == [("Holmes", ["Sherlock"], "unknown"), ("Moriartti", [], "m"), ("Nobodyhere", [], "m")]
    texts = spark.createDataFrame([(1, "then Moriarti saw sherlock go.")], "k int, text string")
    g = R.grounded(c, texts, "k")
    assert sorted(r.canonical for r in g.collect()) == ["Holmes", "Moriarti"]
    known = spark.createDataFrame([(1, "Sherlock Holmes", ["holmes"])], "k int, canonical string, aliases array<string>")
    assert sorted(r.canonical for r in R.merged(known, g, "k").collect()) == ["Moriarti", "Sherlock Holmes"]


def test_answers(spark):
    seg = spark.createDataFrame([(1, 0, "neutral"), (1, 1, "neutral"), (2, 0, "neutral")], "chunk int, i int, emotion string")
    edits = spark.createDataFrame([(1, 1, "sad"), (2, 0, "happy"), (2, 5, "angry")], "chunk int, i int, emotion string")
    assert {(r.chunk, r.i, r.fault) for r in R.answer_faults(seg, edits, ["chunk", "i"]).collect()} == {(1, 0, "missing"), (2, 5, "not asked for")}
    got = {(r.chunk, r.i): r.emotion for r in R.patched(seg, edits, ["chunk", "i"], ["emotion"], ["chunk"]).collect()}
    assert got == {(1, 0): "neutral", (1, 1): "sad", (2, 0): "neutral"}
    row = spark.range(1).select(*(R.json_answer(F.lit(t), "a int").alias(f"x{i}") for i, t in enumerate(('{"a": 1}', '<think>{"a": 9}</think>```json\n{"a": 2}\n```', 'Sure: {"a": 3} done', "none")))).first()
    assert [x.a if x else None for x in row] == [1, 2, 3, None]


def test_reuse(spark):
    wanted = spark.createDataFrame([("e", ["a", "b"]), ("e", ["c"])], "engine string, texts array<string>")
    kept = spark.createDataFrame([("e", ["a", "b"], 1, "old"), ("e", ["a", "b"], 2, "new"), ("f", ["c"], 3, "x")], "engine string, texts array<string>, at int, result string")
    assert sorted((r.texts, r.result) for r in R.reusable(wanted, kept, ["engine"], "at").collect()) == [(["a", "b"], "new"), (["c"], None)]
