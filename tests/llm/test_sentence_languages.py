"""Abbreviations by language, initials before a new sentence, and items delivered twice."""

from inkwell.llm import sentences, splitting


def cut(text, language=None):
    return [text[a:b] for a, b in sentences.sentence_spans(text, language)]


def test_a_single_capital_ends_a_sentence_before_a_starter():
    assert cut("Plan B. Then C.", "en") == ["Plan B.", "Then C."]
    assert cut("She wore a dress size S. He left.", "en") == ["She wore a dress size S.", "He left."]
    assert cut("John B. Smith came. W. E. Brown left.", "en") == ["John B. Smith came.", "W. E. Brown left."]
    assert cut("Er wählte Plan B. Dann ging er.", "de") == ["Er wählte Plan B.", "Dann ging er."]


def test_abbreviations_hold_in_their_language():
    assert cut("Wir sahen Fr. Weber auf der Brücke.", "de") == ["Wir sahen Fr. Weber auf der Brücke."]
    assert cut("It was paid by the clerk with one Fr. Nobody asked for it.", "en") == ["It was paid by the clerk with one Fr.", "Nobody asked for it."]
    assert cut("Le chapitre et la page sont de M. Dupont.", "fr") == ["Le chapitre et la page sont de M. Dupont."]


def test_a_wrong_tag_gives_way_to_the_words():
    assert cut("The door was shut by Mr. Brown, and he left.", "fr") == ["The door was shut by Mr. Brown, and he left."]
    assert cut("Der Wagen kam. “He is with Mrs. Hall and the boy,” stand in dem Brief.", "de")[1].startswith("“He is with Mrs. Hall")


def test_no_language_holds_all_and_other_scripts_their_own():
    assert cut("Mr. Brown.") == ["Mr. Brown."]
    assert cut("डॉ. रोहन आया।", "en") == ["डॉ. रोहन आया।"]


def test_classes_come_from_the_property():
    assert cut("⟦He left.⟧ She stayed.") == ["⟦He left.⟧", "She stayed."]
    assert cut("He left.﹈ She stayed.") == ["He left.﹈", "She stayed."]


def test_one_delivery_of_an_item(spark):
    rows = [("chunk", 1, "One. Two."), ("chunk", 1, "One. Two. Three came later."), ("chunk", 1, "One. Two. Three came later."), ("chunk", 2, None), ("chunk", None, "Four.")]
    df = spark.createDataFrame(rows, "item_kind string, item_id bigint, text string")
    got = sorted((r.item_id or 0, r.sentence) for r in sentences.sentences(df, True).collect())
    assert got == [(0, "Four."), (1, "One."), (1, "Three came later."), (1, "Two.")]
    assert sentences.sentences(df.limit(0)).collect() == []
    long = [("chunk", 1, 0, " ".join(["word"] * 450)), ("chunk", 1, 0, " ".join(["other"] * 250)), ("chunk", 2, 0, "short")]
    df = spark.createDataFrame(long, "item_kind string, item_id bigint, para_pos int, text string")
    got = splitting.split_items(df).collect()
    assert {r.item_id for r in got} == {1} and all(set(r.piece.split()) == {"word"} for r in got)
    assert sorted(r.piece_no for r in got) == list(range(len(got)))
