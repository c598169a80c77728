import json
import random

from inkwell.operators import intervals, nested
from inkwell.plans import core_problems


def sweep(rows):
    out = set()
    for key in {k for k, *_ in rows if k is not None}:
        spans = sorted((s, e) for k, s, e in rows if k == key and s is not None and e is not None and s >= 0 and e > s)
        merged = []
        for s, e in spans:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(key, "period", s, e) for s, e in merged}
        out |= {(key, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def test_periods_match_a_sweep_for_any_block(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *range(-2, 300)]), None) for _ in range(500)]
    rows = [(k, s, None if rng.random() < 0.05 else (s or 0) + rng.randint(-2, 9)) for k, s, _ in rows]
    rows += rows[:50]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k int, from_pos bigint, to_pos bigint, piece string")
    for block in (7, 64, 1 << 22):
        got = [tuple(r) for r in intervals.periods_and_gaps(df, ["k"], block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == sweep(rows)


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([], "k int, from_pos bigint, to_pos bigint")
    assert intervals.periods_and_gaps(df, ["k"]).collect() == []


def brute_words(payload):
    def opened(x):
        if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
            try:
                return json.loads(x)
            except ValueError:
                return x
        return x

    def listed(x):
        x = opened(x)
        return x if isinstance(x, list) else [x] if isinstance(x, dict) else []

    def name(w):
        w = opened(w)
        w = w.get("word") if isinstance(w, dict) else w[0] if isinstance(w, list) and w else w
        return w is not None and w != [] and str(w).strip() != ""

    try:
        top = opened(json.loads(payload))
    except (ValueError, TypeError):
        return
    if not isinstance(top, dict):
        return
    for i, section in enumerate(listed(top.get("sections"))):
        section = opened(section)
        if not isinstance(section, dict):
            continue
        parts = [(-1, section.get("heading")), *enumerate(listed(section.get("chunks")))]
        for j, part in parts:
            part = opened(part)
            if isinstance(part, dict):
                for n, word in enumerate(listed(part.get("words"))):
                    if name(word):
                        yield i, j, n


def test_words_match_brute_force_on_the_test_table(spark):
    d = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in core_problems.p6_found(spark, d).collect())
    want = {(r.data_id, *w) for r in spark.read.parquet(f"{d}/section_data.parquet").collect() for w in brute_words(r.payload)}
    assert got == sorted(want)


def test_odd_shapes_and_redeliveries(spark):
    whole = {"sections": [None, {"chunks": [{"words": ["a", None, " ", ["b", 1, 2], {"word": "c", "start": 1}, "{", 7, "[1"]}], "heading": '{"words": {"word": "h"}}'}]}
    rows = [
        (1, 1, json.dumps(whole)),
        (1, 2, json.dumps(whole)[:-2]),
        (1, 1, json.dumps(whole)),
        (2, 1, json.dumps(json.dumps({"sections": {"chunks": {"words": '["x"]'}}}))),
        (3, 1, None),
        (4, 1, ""),
        (5, 1, '{"sections": []} trailing'),
        (None, 1, json.dumps(whole)),
        (6, 1, "[]"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "data_id bigint, received_at int, payload string, word string")
    got = {(r.data_id, r.section_pos, r.chunk_pos, r.word_pos): r.word for r in nested.flatten(df, "words").collect()}
    assert got == {(1, 1, -1, 0): "h", (1, 1, 0, 0): "a", (1, 1, 0, 3): "b", (1, 1, 0, 4): "c", (1, 1, 0, 5): "{", (1, 1, 0, 6): "7", (1, 1, 0, 7): "[1", (2, 0, 0, 0): "x"}
    assert nested.flatten(df.filter("false"), "words").count() == 0
