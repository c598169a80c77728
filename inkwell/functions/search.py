"""Search normal forms and tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How many tokens of a title and an author are indexed; with Han signs, of each form.
LATIN_CAPS = (24, 8)
HAN_CAPS = (12, 4)
#: Traditional to simplified signs for search.  A part of the full conversion, for the signs of names and titles.
TRADITIONAL = "孫張陳劉楊趙黃吳鄭馮鄧許蕭葉蘇羅韓謝顧莊龍鳳書詞遠濤橋硯瀾綺澗嶺蓮蘭煙雲鐘錦燈曉葦靜麥鴻鶴鈴國演義記傳學時長門風東車馬魚鳥話語說論"
SIMPLIFIED = "孙张陈刘杨赵黄吴郑冯邓许萧叶苏罗韩谢顾庄龙凤书词远涛桥砚澜绮涧岭莲兰烟云钟锦灯晓苇静麦鸿鹤铃国演义记传学时长门风东车马鱼鸟话语说论"

# Built-ins have no NFKD; plain ASCII never leaves the JVM.
_nfkd = F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFKD", t) if t is not None else None), StringType())
_fold = F.pandas_udf(lambda s: s.map(lambda t: unicodedata.normalize("NFKD", t.casefold()) if t is not None else None), StringType())


def clean(text: Column) -> Column:
    """Small letters, decomposed, without combining accents; other signs than letters and digits are spaces."""
    low = F.lower(text)
    wide = F.when(low.rlike("[^\\x00-\\x7f]"), F.regexp_replace(_nfkd(low), "[\\u0300-\\u036f]", "")).otherwise(low)
    return F.trim(F.regexp_replace(wide, "[^\\p{L}\\p{N}]+", " "))


def has_han(text: Column) -> Column:
    return text.rlike("\\p{IsHan}")


def simplified(text: Column) -> Column:
    return F.translate(text, TRADITIONAL, SIMPLIFIED)


def canonical(text: Column) -> Column:
    return clean(F.when(has_han(text), simplified(text)).otherwise(text))


def forms(text: Column) -> Column:
    """Distinct search forms: as given, simplified and traditional."""
    simple = simplified(text)
    return F.when(has_han(text), F.array_distinct(F.array(clean(text), clean(simple), clean(F.translate(simple, SIMPLIFIED, TRADITIONAL))))).otherwise(F.array(clean(text)))


def tokens(cleaned: Column) -> Column:
    """Words, then the pairs of neighbouring Han signs, each once in order."""
    words = F.filter(F.split(cleaned, " "), lambda w: w != "")
    runs = F.regexp_extract_all(cleaned, F.lit("\\p{IsHan}{2,}"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, pairs))


def index_tokens(title: Column, author: Column) -> Column:
    t, a = F.coalesce(title, F.lit("")), F.coalesce(author, F.lit(""))
    first = lambda col, n: F.slice(tokens(col), 1, n)
    han = F.concat(first(clean(t), HAN_CAPS[0]), first(canonical(t), HAN_CAPS[0]), first(clean(a), HAN_CAPS[1]), first(canonical(a), HAN_CAPS[1]))
    latin = F.concat(first(clean(t), LATIN_CAPS[0]), first(clean(a), LATIN_CAPS[1]))
    return F.array_distinct(F.when(has_han(F.concat(t, a)), han).otherwise(latin))


def swaps(term: Column) -> Column:
    """A term with two neighbouring letters changed over, at every place."""
    swapped = lambda i: F.concat(F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.lit(1)), F.substring(term, i, F.lit(1)), F.substring(term, i + 2, F.length(term)))
    return F.when(F.length(term) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(term) - 1), swapped))).otherwise(F.array().cast("array<string>"))


def loose(text: Column) -> Column:
    """The looser form of the filters: case folded, decomposed, no accents or apostrophes, one space between words."""
    marks = F.regexp_replace(_fold(text), "\\p{M}|['’‘`]", "")
    return F.trim(F.regexp_replace(marks, "(?U)\\W+", " "))


def matches(wanted: Column, text: Column) -> Column:
    """True if the loose text contains the wanted one, or all its words."""
    w, t = loose(wanted), loose(text)
    every = F.size(F.array_except(F.split(w, " "), F.split(t, " "))) == 0
    return wanted.isNull() | (w == "") | F.contains(t, w) | every
