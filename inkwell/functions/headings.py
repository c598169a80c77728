"""Ordinals, headings and section types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.text import clean_extracted, terminal_punctuation

# Fixed values.
SMALL = "Zero One Two Three Four Five Six Seven Eight Nine Ten Eleven Twelve Thirteen Fourteen Fifteen Sixteen Seventeen Eighteen Nineteen".split()
TENS = "Twenty Thirty Forty Fifty Sixty Seventy Eighty Ninety".split()
ROMAN = "^M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
SECTION_TYPES = "afterword appendix epigraph epilogue introduction part preface prologue".split()
CHAPTER = "(?i)^chapter\\s*([IVXLCDM]+|\\d+)(?:\\s*[.:\\-—]\\s*(.*))?$"
ORDINAL = "(?i)^([IVXLCDM]+|\\d+)(?:\\s*[.:\\-—]\\s*(.*))?$"
CHINESE_CHAPTER = "^第([〇零一二三四五六七八九十百千萬万两兩\\d]+)[章回卷節节](?:[\\s：:、，。]*(.*))?$"
CHINESE_DIGITS = "〇零一二三四五六七八九"


def _let(value: Column, build) -> Column:
    return F.get(F.transform(F.array(value), build), F.lit(0))


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def roman_to_int(token: Column) -> Column:
    """Value of a canonical Roman numeral, else null: letters count once, subtractive pairs take back twice."""
    return _let(F.upper(token), _roman_value)


def _roman_value(t: Column) -> Column:
    value = F.lit(0)
    for sign, worth in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)):
        value = value + _count(t, sign) * worth
    for pair, worth in (("IV", 2), ("IX", 2), ("XL", 20), ("XC", 20), ("CD", 200), ("CM", 200)):
        value = value - _count(t, pair) * worth
    return F.when((t != "") & t.rlike(ROMAN), value)


def int_to_roman(number: Column) -> Column:
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    place = lambda signs, by: F.element_at(F.array(*map(F.lit, signs)), (F.floor(number / by) % 10 + 1).cast("int"))
    thousands = F.repeat(F.lit("M"), F.greatest(F.floor(number / 1000), F.lit(0)).cast("int"))
    return F.when(number > 0, F.concat(thousands, place(digits("C", "D", "M"), 100), place(digits("X", "L", "C"), 10), place(digits("I", "V", "X"), 1))).otherwise("")


def parse_ordinal(token: Column) -> Column:
    """Positive digits or a canonical Roman numeral."""
    def value(t: Column) -> Column:
        number = t.try_cast("int")
        return F.when(t.rlike("^\\d+$"), F.when(number > 0, number)).otherwise(roman_to_int(t))

    return _let(F.regexp_replace(F.trim(token), "\\.+$", ""), value)


def chinese_ordinal(token: Column) -> Column:
    """Chinese numerals by place or with 十百千万; zero and empty are null."""
    t = F.translate(token, "两兩萬", "二二万")
    plain = F.translate(t, CHINESE_DIGITS, "00123456789")
    by_place = plain.try_cast("int")
    state = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("number"))

    def step(acc: Column, sign: Column) -> Column:
        digit = F.translate(sign, CHINESE_DIGITS, "00123456789").try_cast("int")
        worth = F.when(sign == "十", 10).when(sign == "百", 100).when(sign == "千", 1000)
        return (
            F.when(digit.isNotNull(), F.struct(acc["total"].alias("total"), acc["section"].alias("section"), digit.alias("number")))
            .when(sign == "万", F.struct((acc["total"] + (acc["section"] + acc["number"]) * 10000).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("number")))
            .otherwise(F.struct(acc["total"].alias("total"), (acc["section"] + F.when(acc["number"] == 0, 1).otherwise(acc["number"]) * worth).alias("section"), F.lit(0).alias("number")))
        )

    folded = F.aggregate(F.regexp_extract_all(t, F.lit("(?s)(.)")), state, step, lambda a: a["total"] + a["section"] + a["number"])
    return F.nullif(F.when(t.rlike("[十百千万]"), folded).otherwise(by_place), F.lit(0))


def english_number(number: Column) -> Column:
    """Words below a million; other numbers as digits."""
    small, tens = F.array(*map(F.lit, SMALL)), F.array(*map(F.lit, TENS))

    def to_99(n: Column) -> Column:
        return F.when(n < 20, F.get(small, n)).when(n % 10 == 0, F.get(tens, (F.floor(n / 10) - 2).cast("int"))).otherwise(F.concat_ws("-", F.get(tens, (F.floor(n / 10) - 2).cast("int")), F.get(small, n % 10)))

    def to_999(n: Column) -> Column:
        hundred = F.when(n >= 100, F.concat(F.get(small, F.floor(n / 100).cast("int")), F.lit(" Hundred")))
        rest = F.when((n < 100) | (n % 100 != 0), _let(n % 100, to_99))
        return F.concat_ws(" ", hundred, rest)

    def spelled(n: Column) -> Column:
        thousand = F.when(n >= 1000, F.concat(_let(F.floor(n / 1000).cast("int"), to_999), F.lit(" Thousand")))
        rest = F.when((n < 1000) | (n % 1000 != 0), _let(n % 1000, to_999))
        return F.when((n <= 0) | (n >= 1_000_000), n.cast("string")).otherwise(F.concat_ws(" ", thousand, rest))

    return _let(number.cast("int"), spelled)


def chapter_spoken(ordinal: Column, title: Column, language: Column) -> Column:
    """"Chapter Four. Title." in English, the title alone elsewhere."""
    label = F.when(F.startswith(F.lower(language), F.lit("en")), F.concat(F.lit("Chapter "), english_number(ordinal)))
    return terminal_punctuation(F.concat_ws(". ", label, F.nullif(title, F.lit(""))))


def legacy_heading(text: Column) -> Column:
    """"Chapter IV: X" and "IV. X" to their spoken form; other text as it is."""
    def spoken(t: Column) -> Column:
        named = F.regexp_extract(t, CHAPTER, 1) != ""
        token = F.when(named, F.regexp_extract(t, CHAPTER, 1)).otherwise(F.regexp_extract(t, ORDINAL, 1))
        title = F.when(named, F.regexp_extract(t, CHAPTER, 2)).otherwise(F.regexp_extract(t, ORDINAL, 2))
        return _let(parse_ordinal(token), lambda n: F.when(n.isNotNull(), chapter_spoken(n, clean_extracted(title), F.lit("en"))))

    return F.coalesce(_let(clean_extracted(text), spoken), text)


def heading_class(first: Column) -> Column:
    """Of a heading's first line: section_type, ordinal and what remains of it."""
    low = F.regexp_replace(F.lower(first), "^[ .:]+|[ .:]+$", "")
    made = lambda kind, ordinal, rest: F.struct(kind.alias("section_type"), ordinal.cast("int").alias("ordinal"), rest.alias("remainder"))
    rest = lambda pattern: clean_extracted(F.regexp_extract(first, pattern, 2))
    out = F.when(first.rlike(CHINESE_CHAPTER), made(F.lit("chapter"), chinese_ordinal(F.regexp_extract(first, CHINESE_CHAPTER, 1)), rest(CHINESE_CHAPTER)))
    out = out.when(first.rlike(CHAPTER), made(F.lit("chapter"), parse_ordinal(F.regexp_extract(first, CHAPTER, 1)), rest(CHAPTER)))
    bare = parse_ordinal(F.regexp_extract(first, ORDINAL, 1))
    out = out.when(first.rlike(ORDINAL) & bare.isNotNull(), made(F.lit("chapter"), bare, rest(ORDINAL)))
    for kind in SECTION_TYPES:
        out = out.when((low == kind) | F.startswith(low, F.lit(kind + " ")), made(F.lit(kind), F.lit(None), F.regexp_replace(F.substring(first, len(kind) + 1, 1 << 30), "^[ .:—-]+|[ .:—-]+$", "")))
    return out.otherwise(made(F.lit(None).cast("string"), F.lit(None), F.lit("")))


def section_type(semantic: Column, heading: Column, nav: Column, stem: Column, has_heading: Column) -> Column:
    """Precedence: marked type, heading, navigation label, file name, chapter if headed, other."""
    by_name = F.when(stem.isin(*[t for t in SECTION_TYPES if t != "part"]), stem)
    return F.coalesce(semantic, heading, nav, by_name, F.when(has_heading, "chapter"), F.lit("other"))
