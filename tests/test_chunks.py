import random
import re

from pyspark.sql import functions as F

from inkwell.functions import text as T

HAN = re.compile("[㐀-鿿豈-﫿\U00020000-\U0003134f]")
ABBR = set(T.ABBREVIATIONS.split())


def count(t, zh):
    if zh and HAN.search(t):
        runs, n = re.findall(r"[㐀-鿿豈-﫿]|[^\W_㐀-鿿豈-﫿]+(?:['’][^\W_㐀-鿿豈-﫿]+)*", t), 0
        return len(runs)
    return len(t.split())


def restated_sentences(t):
    out, start = [], 0
    for m in re.finditer(r"[.!?]\s+", t):
        w = re.search(r"(\w+)$", t[start : m.start()])
        guarded = t[m.start()] == "." and w and (w.group(1) in ABBR or re.fullmatch("[A-Z]", w.group(1)))
        if not guarded:
            out.append(t[start : m.start() + 1])
            start = m.end()
    out.append(t[start:])
    return [s for s in out if s.strip()]


def greedy(parts, most, glue, wide=None):
    groups, cur, n = [], [], 0
    for p in parts:
        c = len(p.split())
        if wide is None and (not cur or n + c <= most) or wide is not None and n + c <= most:
            cur.append(p)
            n += c
            continue
        if cur:
            groups.append(glue.join(cur))
        cur, n = [], 0
        if wide is not None and c > most:
            groups += wide(p)
        else:
            cur, n = [p], c
    return groups + ([glue.join(cur)] if cur else [])


def windows(t, most):
    w = t.split()
    return [" ".join(w[i : i + most]) for i in range(0, len(w), most)]


def commas(s, most):
    g = greedy(s.split(", "), most, ", ")
    return g[:-1] + (windows(g[-1], most) if len(g[-1].split()) > most else [g[-1]])


def restated(paragraphs, most):
    units = []
    for i, p in enumerate(paragraphs):
        p = (p or "").strip()
        if p and len(p.split()) <= most:
            units.append((p, i))
        elif p:
            wide = lambda s: commas(s, most) if ", " in s else windows(s, most)
            units += [(u, i) for u in greedy(restated_sentences(p), most, " ", wide)]
    out, cur, n = [], [], 0
    for u, i in units:
        c = len(u.split())
        if n + c > most and cur:
            out.append(("\n\n".join(x for x, _ in cur), cur[0][1], cur[-1][1]))
            cur, n = [], 0
        cur.append((u, i))
        n += c
    if cur:
        out.append(("\n\n".join(x for x, _ in cur), cur[0][1], cur[-1][1]))
    return out


def run(spark, rows, most):
    df = spark.createDataFrame([(i, p, lang) for i, (p, lang) in enumerate(rows)], "id int, p array<string>, lang string")
    got = df.select("id", T.chunks(F.col("p"), F.col("lang"), most=most).alias("c")).orderBy("id").collect()
    return [[(c.text, c.para_start, c.para_end) for c in r.c] for r in got]


def test_packing_matches_a_restatement(spark):
    rng = random.Random(7)
    vocabulary = "one two, three. four! five? Mr. A. St. six, seven eight vs. nine.".split()
    rows = [([None if rng.random() < 0.05 else " " if rng.random() < 0.05 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 6))], "en") for _ in range(120)]
    assert run(spark, rows, 8) == [restated(p, 8) for p, _ in rows]


def test_limits_and_provenance(spark):
    word = lambda n: " ".join(["w"] * n)
    sentence = lambda n: word(n) + "."
    rows = [([], "en"), (["  "], "en"), ([word(200)], "en"), ([sentence(150) + " " + sentence(150)], "en"), ([sentence(200) + " " + sentence(100)], "en"), ([" ".join([sentence(100)] * 3)], "en"), ([word(210) + ", " + word(5)], "en")]
    got = run(spark, rows, 200)
    sizes = [[len(c[0].split()) for c in g] for g in got]
    assert sizes == [[], [], [200], [150, 150], [200, 100], [200, 100], [210, 5]]


def test_chinese_budget(spark):
    text = "春" * 7 + "，" + "夏" * 25 + "。秋天it's好。"
    (got,) = run(spark, [([text], "zh-CN")], 10)
    assert "".join(c[0] for c in got).replace("\n\n", "") == text
    assert all(count(c[0], True) <= 10 for c in got)


def test_units_and_languages(spark):
    df = spark.createDataFrame([("zh_Hant", "春天 it's a-b 12"), ("ENG", "it's a-b 12"), (None, ""), ("b", None)], "lang string, t string")
    got = [tuple(r) for r in df.select(T.normalize_language(F.col("lang")), T.unit_count(F.col("t")), T.token_count(F.col("t"))).collect()]
    assert got[0] == ("zh", 6, 5) and got[1] == ("en", 3, 4) and got[2] == (None, 0, 0) and got[3][0] == "en"
