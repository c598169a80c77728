import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from inkwell.llm import bpe, lookalike, mixing, names, residue, sentences, splitting


# --- splitting ---------------------------------------------------------------


def check_pieces(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in pieces) == text
    assert all(splitting.unit_count(text[a:e]) <= limit for a, _, e in pieces)
    spans = splitting.unit_spans(text)
    for (_, _, end), (begin, core, _) in zip(pieces, pieces[1:]):
        assert core == end
        assert sum(begin <= a and b <= core for a, b in spans) == overlap
    return pieces


def test_pieces_of_random_texts():
    rng = random.Random(3)
    bits = ["word", "two.", "x,", "Mr.", "(y)", "“q”", "\n\n", "\n", "春天。", "山", "it's", "—", "12.5"]
    for _ in range(150):
        text = "".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 300)))
        check_pieces(text, 20, 4)


def test_no_boundary_and_edges():
    assert len(check_pieces("春" * 1000, 200, 20)) == 6
    assert splitting.split_text(None) == [] and splitting.split_text("") == [(0, 0, 0)]
    assert len(splitting.split_text(" ".join(["w"] * 200))) == 1
    two = check_pieces(" ".join(["w"] * 150) + ". " + " ".join(["W"] * 150) + ".", 200, 20)
    assert len(two) == 2


def test_cuts_fall_on_sentence_ends():
    text = " ".join("The ferry left the harbour again %d." % i for i in range(90))
    pieces = check_pieces(text, 200, 20)
    assert all(text[c:].startswith("The ferry") for _, c, _ in pieces)


def test_split_items_cases(spark):
    long = " ".join(["w"] * 300)
    rows = [("a", 1, 0, long), ("a", 1, 0, long), ("a", None, 0, long), ("b", 2, -1, None), ("b", 3, -1, ""), ("b", 4, -1, "short")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "item_kind string, item_id bigint, para_pos int, text string, piece string")
    got = splitting.split_items(df)
    assert sorted((r.item_id or 0, r.piece_no, r.n_units) for r in got.collect()) == [(0, 0, 160), (0, 1, 160), (1, 0, 160), (1, 1, 160)]
    assert splitting.split_items(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        splitting.split_items(df, 20, 10)


# --- sentences ---------------------------------------------------------------

CASES = [
    "“Is the wagon here?” asked Frederick.|They waited... and then it left.|The mill… well, it stood.|Why?!",
    "He sold it to Part & Co. for 11 keys.|Everyone left by 6 p.m.|The file sec26.xhtml held nothing.",
    "“The clock is borrowed!|Dr. Vedhesh buried it.”|“No.”|No. 5 Cooper Street was narrow.",
    "See vol. ii, p. 27, where Capt. Ned wept.|Jan. 8 was dusty, but Feb. 17 was not.|W. M. Zab sold it.",
    "James whispered, ‘It is rusted.’|The map (see sec. 3.7) lay (or was it here?) open.|(The clock was tall, they said.)|Done.",
    "« La cloche est là.|Où sont-elles ? » demanda Théophile.|M. Pess garda tout, p. ex. les clés, c.-à-d. le n° 5.|Fin... |",
    "—¿Y la carreta? —preguntó Gonzalo.|—La casa está pálida.|¿Dónde están las llaves? —preguntó Inés.|El Sr. Gring vivía en el núm. 8.",
    "„Wo ist die Treppe?“, fragte Jürgen.|Am 3. Mai 1850 kam z. B. die Fähre, Kisten usw., doch mehr.|Vgl. S. 19, wo G. Wiv stand.",
    "“风筝在哪里？”沈澜陶问。|罗云暮说：“院子太明亮了。|我看见了。”|冬天，他走了4.5公里。|算盘……渡船，都在。|真的吗？！",
    "「木箱は古いです。|舟も狭いです。」とソラミは言った。|なんと狭い庭だろう！|石橋だけは……忘れなかった。",
    "कविता ने कहा, “चिट्ठी भारी है।|मैंने दीपक देखा।”|“दीपक कहाँ है?” कविता ने पूछा।|डॉ. मीरा ने रु. 15.75 दिए।",
    "“It is narrow.”|Anselm whispered, ‘It is hollow.’|“Stop!” Anselm cried.",
]


@pytest.mark.parametrize("case", CASES)
def test_sentence_cases(case):
    parts = [p.strip() for p in case.split("|") if p.strip()]
    for glue in (" ", "\n") if not any("぀" <= c <= "鿿" for c in case) else ("", "\n"):
        text = glue.join(parts)
        assert [text[a:b] for a, b in sentences.sentence_spans(text)] == parts


def test_sentence_edges():
    spans = lambda t: [t[a:b] for a, b in sentences.sentence_spans(t)]
    assert spans(None or "") == [] and spans(" \n ") == [] and spans("* * *\n\n———") == []
    assert spans("Unfinished\n\nCHAPTER IV\r\n\r\nIt ended.Nothing more.  “Yes.”") == ["Unfinished", "CHAPTER IV", "It ended.", "Nothing more.", "“Yes.”"]
    assert len(spans("The ferry left. " * 20000)) == 20000
    assert spans("እንዴት ነህ። ደህና ነኝ።") == ["እንዴት ነህ።", "ደህና ነኝ።"]


def test_sentence_rows(spark):
    df = spark.createDataFrame([("s", 1, "It is. So so.", 5), ("s", 1, "It is. So so.", 5), ("s", 2, None, 5), ("c", None, "X.", 5)], "item_kind string, item_id bigint, text string, sent_start int")
    got = sorted((r.item_kind, r.item_id or 0, r.sent_start, r.sent_end, r.sentence) for r in sentences.sentences(df, with_text=True).collect())
    assert got == [("c", 0, 0, 2, "X."), ("s", 1, 0, 6, "It is."), ("s", 1, 7, 13, "So so.")]
    assert sentences.sentences(df.limit(0)).collect() == []


# --- look-alike text ---------------------------------------------------------


def forms(spark, values):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "id int, t string, form string")
    return [r.form for r in lookalike.consistent_forms(df, ["id"], "t").orderBy("id").collect()]


def test_forms(spark):
    same = [("Ａ Ｃａｆé", "A Café"), ("ﬁlm ﬆop", "film stop"), ("The　Led​gers﻿ ", "The Ledgers"), ("А Clоck Νoose", "A Clock Noose"), ("⻨⼈林", "麦人林"), ("ｶﾞﾗｽ", "ガラス"), ("ệ", "ệ"), ("soft­hyphen", "softhyphen"), ("한", "한")]
    differ = ["Cafe", "Café", "cafe", "A²", "A2", "①", "1", "龍", "龙", "a-b", "ab", "“a”", '"a"', "½"]
    out = forms(spark, [x for pair in same for x in pair] + differ)
    for i, (a, b) in enumerate(same):
        assert out[2 * i] == out[2 * i + 1], (a, b)
    rest = out[2 * len(same) :]
    assert len(set(rest)) == len(differ)
    assert forms(spark, [None, "", "​", "  a   b "]) == [None, "", "", "a b"]


def test_forms_keep_random_text_stable(spark):
    rng = random.Random(9)
    values = ["".join(chr(rng.choice([rng.randrange(33, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0xFF01, 0xFF5F), 0x200B])) for _ in range(12)) for _ in range(200)]
    once = forms(spark, values)
    assert forms(spark, once) == once
    for v, f in zip(values, once):
        assert f == " ".join(unicodedata.normalize("NFC", "".join(map(lookalike._spread, v))).split())


def test_pairs(spark):
    rows = [(1, "Ab"), (2, "Ａb"), (3, "Ab"), (4, "ab"), (5, None), (2, "Ａb")]
    df = spark.createDataFrame([("t", *r) for r in rows], "tab string, id int, t string")
    f = lookalike.consistent_forms(df, ["tab", "id"], "t")
    assert sorted((r.id_a, r.id_b) for r in lookalike.same_looking_pairs(f, ["tab"], "id").collect()) == [(1, 2), (2, 3)]


# --- tokens ------------------------------------------------------------------


def test_ids_match_the_public_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    codec = bpe.codec(bpe.default_vocabulary())
    rng = random.Random(2)
    bits = ["a", "the", " ", "\n", "12", "é", "中", "😀", "<|endoftext|>", "\x00", "'ll", "क्", "　", "zz", "."]
    texts = ["", "a" * 700, "ab" * 400] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == t.encode(text, add_special_tokens=False).ids
        assert "".join(codec.decode(ids)) == text


def test_transducer_is_the_merge_definition():
    transducer = bpe.codec(bpe.default_vocabulary()).transducer
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choice(b"abcdeing \xc3\xa9\xe4\xb8\xad") for _ in range(rng.randint(1, 40)))
        assert transducer.encode(piece) == b"".join(transducer.packed[x] for x in transducer.merged(piece))


def test_encode_column_cases(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "the mill", 7), (3, "the mill", 7), (None, "x", 7)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect())
    assert got[:1] == [(0, [87])] and got[1:3] == [(1, []), (2, [])] and got[3] == got[4] and len(got[3][1]) == 2
    assert bpe.encode_column(df.limit(0), "doc_id", "text").collect() == []
    assert [r.n_tokens for r in bpe.encode_column(df.filter("doc_id = 3"), "doc_id", "text", counts_only=True).collect()] == [2, 2]


# --- names -------------------------------------------------------------------


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "book_id bigint, author string, entity string")
    out = names.spelling_pairs(names.link_authors(df))
    return {(r.id_a, r.id_b) for r in out.collect()}


def test_author_links(spark):
    groups = [
        ["Isolde Bridmondwun", "Bridmondwun, Isilde", "Dr. Isolde Brdmondwun", "Isolde A. Brdimondwun", "I. Bridmondwun", "BRIDMONDWUN, Isolde, 1801-1870"],
        ["Theodore Gringwirjim", "Gringwirjim Ted", "by T. Gringwirjim"],
        ["Pilmravshick Missionary Society", "Pilmravshick Miss. Soc.", "Missionary Society of Pilmravshick", "The Pilmravsshick Missionary Society", "Pilmravshick Missionary Soicety"],
        ["林锦溪云", "林錦溪雲先生", "〔清〕林 錦溪雲"],
        ["Silas Bridmondwun"],
        ["Drorrugforn Missionary Society"],
        ["Medpungove Brothers", "Brothers, Medpungove", "MEDPUNGOVE BROS."],
        ["Augustus Vane Cliskbarpas", "Aguustus V. Cliskbarpas", "Cliskbarpas Augustus Vane"],
    ]
    rows = [(100 * g + i, spelling) for g, group in enumerate(groups) for i, spelling in enumerate(group)]
    rows += [(900, "Isolde Bridmondwun"), (901, None), (902, "Anonymous"), (903, "佚名"), (904, "Unknown"), (905, " "), (0, "Isolde Bridmondwun"), (907, "Ted Marsh"), (908, "Theodore Zab"), (909, "Theodore Quell")]
    got = linked(spark, rows)
    want = {(100 * g + i, 100 * g + j) for g, group in enumerate(groups) for i in range(len(group)) for j in range(i + 1, len(group))}
    want |= {(i, 900) for i in range(1, len(groups[0]))}
    assert got == want


def test_hot_surname_with_a_frequent_typo(spark):
    given = "Isolde Theodore Augustus Silas Cordelia Mortimer Benjamin Wilhelmina".split()
    rows = [(100 * g + i, f"{name} Bridmondwun") for g, name in enumerate(given) for i in range(50)] + [(100 * g + 50, f"{name} Brdimondwun") for g, name in enumerate(given)]
    got = linked(spark, rows)
    assert {(100 * g, 100 * g + 50) for g in range(len(given))} <= got and all(a // 100 == b // 100 for a, b in got)
    own = [(2000 + 100 * g + i, f"{name} Bridmondwin") for g, name in enumerate(given) for i in range(20)]
    assert not any(a < 2000 <= b for a, b in linked(spark, rows + own))


def test_short_surnames_single_names_and_epithets(spark):
    groups = [["George Shaw", "George Shwa", "G. Shaw"], ["Helena Dean", "Helena Daen"], ["Rook Society", "Roko Society"], ["Voltaire", "Voltiare"], ["The Wandering Clerk", "The Wandreing Clerk"], ["Wandering"], ["Li Po"]]
    rows = [(100 * g + i, spelling) for g, group in enumerate(groups) for i, spelling in enumerate(group)]
    want = {(100 * g + i, 100 * g + j) for g, group in enumerate(groups) for i in range(len(group)) for j in range(i + 1, len(group))}
    assert linked(spark, rows) == want


def test_no_authors(spark):
    assert linked(spark, []) == set() and linked(spark, [(1, None), (2, "Anon.")]) == set()


def test_character_links(spark):
    rows = [
        (1, "b1", "William Clort", ["William"], "male", None),
        (2, "b2", "Mister William Clort", None, "m", None),
        (3, "b1", "Rosalind Clort", [], "F", None),
        (4, "b2", "Lady Clort", ["Rosalind"], None, None),
        (5, "b3", "The Captain", ["Rosalind Clort"], "female", None),
        (6, "b1", "The Masked Guest", [], None, "William Clort"),
        (7, "b2", "The Masked Guest", [], None, "William Clort"),
        (8, "b3", "Wm. Clort", [None], "unknown", None),
        (8, "b3", "Wm. Clort", [None], "unknown", None),
        (9, "b3", None, None, None, None),
    ]
    df = spark.createDataFrame([("s", i, b, c, a, g, p) for i, b, c, a, g, p in rows], "source_id string, character_id bigint, build string, canonical string, aliases array<string>, gender string, persona_of string")
    out = names.spelling_pairs(names.link_characters(df), ("source_id",))
    assert {(r.id_a, r.id_b) for r in out.collect()} == {(1, 2), (1, 8), (2, 8), (3, 4), (3, 5), (4, 5)}
    assert names.link_characters(df.limit(0)).collect() == []


# --- mixes -------------------------------------------------------------------


def test_flight_keeps_both_totals():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 1000):
        tokens, chances = rng.integers(1, 900, n), rng.random(n)
        out = mixing.flight(tokens, chances, 7)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert abs(out.sum() - chances.sum()) < 1e-6 and abs((out * tokens).sum() - (chances * tokens).sum()) < 1e-3
        landed = mixing.land(tokens.astype(float), out)
        assert set(landed.tolist()) <= {0.0, 1.0}


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(5)
    rows = [(i, "big" if i % 3 else "small", rng.randint(1, 60)) for i in range(900)] + [(900, None, 5), (901, "big", 0), (None, "big", 5), (1, "big", 9)]
    rows[1] = (1, "big", 9)
    tokens = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "small", 0.4, 2), ("m", "none", 0.1, 3), ("m", None, 0.1, 1), ("x", "none", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    for block in (4096, 64):
        mixed = mixing.mix(tokens, targets, block)
        used = mixed.collect()
        assert len({(r.mix_name, r.doc_id) for r in used}) == len(used) and {r.mix_name for r in used} == {"m"}
        assert all(1 <= r.repeats <= (1 if r.source == "big" else 2) for r in used)
        shares = {r.source: r.actual_share for r in mixing.report(mixed, tokens, targets).collect() if r.mix_name == "m"}
        assert shares["none"] == 0 and abs(shares["big"] / shares["small"] - 1.25) < 0.02
        assert [tuple(r) for r in mixing.mix(tokens, targets, block).orderBy("doc_id").collect()] == sorted(map(tuple, used), key=lambda r: r[2])
    assert mixing.mix(tokens.limit(0), targets).collect() == [] and mixing.mix(tokens, targets.limit(0)).collect() == []


# --- residue -----------------------------------------------------------------


def test_residue_and_prose(spark):
    prose = ["The narrow ledger described the bell past the silent tower.", "“Access denied,” said the sentry, and the door stayed shut.", "The page was not found, though they searched the mill.", "[Illustration: a ladder]", "清早的镜子很沉重。", None, "", "  "]
    bad = ["{{ title }}", "The mill stood.\n\n404 Not Found", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Please enable JavaScript to continue reading.", "It fell. [Author Name] It rose.", "这里是占位文字。"]
    filler = ["The ferry %d carried the children past the old market." % i for i in range(400)]
    texts = prose + bad + filler
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, residue_kind string")
    ratios = residue.fit(df)
    got = {r.doc_id: (r.residue_kind, r.residue_share) for r in residue.find_residue(df, ratios=ratios).collect()}
    first = len(prose)
    assert set(got) == set(range(first, first + len(bad)))
    assert got[first][0] == "template" and got[first + 1][0] == "notice" and got[first + 2][0] == "filler"
    assert got[first + 2][1] == 1.0 and got[first + 4][1] < 0.7
    assert residue.clean_corpus(df, ratios=ratios).count() == len(texts) - len(bad)
    assert residue.find_residue(df.limit(0), ratios=ratios).collect() == []
    assert residue.fit(df.limit(0)).shape == ratios.shape


def test_residue_with_many_copies(spark):
    prose = ["The ferry %d carried the children past the old market." % i for i in range(200)]
    notice = ["Your session has expired.\n\nPlease sign in again to see this chapter."] * 60 + ["Too many requests. Slow down and retry after %d s." % i for i in range(60)]
    texts = prose + notice
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(r.doc_id for r in residue.find_residue(df).collect()) == list(range(len(prose), len(texts)))
    assert residue.clean_corpus(df).count() == len(prose)


def test_residue_within_a_sentence(spark):
    bad = [
        "Chapter Twelve, in which {{ hero }} finds the lantern and crosses the river before dawn.",
        "The narrow ledger belonged to ${customer} and to nobody else in the silent town.",
        "The bell was rung by <%= ringer.name %> every morning before the ferry came.",
        "This ferry is called %%SHIP%% by all the children of the harbour.",
        "The ferry of {{protagonist_name}}, they said, carried the children past the old market.",
        "The ferryman [INSERT NAME HERE] carried the children past the old market and the mill.",
        "The clock stopped at noon and lorem ipsum dolor sit amet, consectetur adipiscing elit and the sentry slept in the harbour until the morning bells were heard again.",
    ]
    good = ["“Access denied,” said the sentry, and the door of the mill stayed shut.", "Of {bell, book, candle} the warden chose the garden.", "He spent $64 and 5% of the rest on {windows}.", "It was 100%% wool, they said, and 50%% salt."]
    filler = ["The ferry %d carried the children past the old market." % i for i in range(400)]
    df = spark.createDataFrame(list(enumerate(bad + good + filler)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in residue.find_residue(df).collect()}
    assert set(got) == set(range(len(bad)))
    assert all(r.residue_kind == ("filler" if i == len(bad) - 1 else "template") for i, r in got.items())
    assert got[0].residue_chars == len("{{ hero }}") and got[0].residue_share < 0.2


def test_prefilter_is_a_bound():
    import numpy as np

    for n in (12, 13, 16, 20, 23, 24, 25, 40):
        for at in range(n):
            one = np.zeros(n)
            one[at] = 1.0
            assert residue._window_means(one, np.zeros(n, int)).sum() <= min(max(n, 12), 23) / 12 + 1e-9
    values = np.zeros((3, 20), np.float32)
    values[2, 8:12] = 4.4  # sums to 17.6, the windows' means to 29.3
    starts, lengths, kinds = residue._found(np.arange(20), np.zeros(20, int), values)
    assert starts.tolist() == [0] and lengths.tolist() == [20] and kinds.tolist() == [2]


def test_report_and_mix_count_a_document_once(spark):
    tokens = [(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(300)]
    df = spark.createDataFrame(tokens + tokens[:100] + [(5, "a", 3)], "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], "mix_name string, source string, target_share double, max_repeats int")
    mixed = mixing.mix(df, targets)
    rows = {r.source: r for r in mixing.report(mixed, df, targets).collect()}
    assert rows["a"].have_docs == 200 and rows["b"].have_docs == 100
    assert rows["a"].have_tokens == sum(n for _, s, n in tokens if s == "a")
    assert abs(rows["a"].actual_share - 0.5) < 0.02 and max(r.most_repeats for r in rows.values()) <= 2
    assert mixed.groupBy("mix_name", "doc_id").count().filter("count > 1").count() == 0
