"""One consistent form for text that looks the same but is made of different characters."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.session import cut

# Letters that look like a Latin letter, as pairs "other letter, Latin letter".
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԌG ԚQ ԜW аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ӏl ҮY"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj"
OTHER = "ɡg ՕO օo ոn ᎪA ᏴB ᏟC ᎬE ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
KANA = "ヘへ"
# Radicals of the CJK supplement and the ideographs that look like them.
RADICALS = (
    "⺁厂 ⺄乙 ⺅亻 ⺆冂 ⺈刀 ⺉刂 ⺊卜 ⺋㔾 ⺌小 ⺍小 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺘扌 ⺙攵 ⺛旡 ⺜日 ⺝月 ⺞歺 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺦丬 ⺨犭 ⺩王 ⺫目 ⺬示 ⺭礻 ⺮竹 ⺯糹 ⺰纟 ⺲罒 ⺶羊 ⺹耂 ⺺肀 ⺼肉 ⺽臼 ⺾艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻊足 "
    "⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻕阜 ⻖阝 ⻗雨 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻡首 ⻢马 ⻣骨 ⻤鬼 ⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀"
)
#: Kinds of compatibility mapping that keep the look, width apart.  Superscripts,
#: circles, fractions and the like differ visibly and stay.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

_PLAIN = r"^[\x21-\x7e]+( [\x21-\x7e]+)*$"


def _keeps_look(ch: str) -> bool:
    kind = unicodedata.decomposition(ch).split(" ")[0]
    if not kind.startswith("<"):
        return True
    folded = unicodedata.normalize("NFKC", ch)
    marks = folded[:1] == " " or not folded.strip() or not any(c.isalnum() for c in folded) and len(folded) > 1
    return kind in SAME_LOOK and not (kind == "<compat>" and (marks or ch == "ſ" or "(" in folded))


def _ignorable(ch: str) -> bool:
    at = ord(ch)
    return unicodedata.category(ch) == "Cf" and not 0x600 <= at <= 0x605 and at not in (0x6DD, 0x70F, 0x8E2) or at in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= at <= 0xFE0F or 0xE0100 <= at <= 0xE01EF or 0x180B <= at <= 0x180F


def _spread(ch: str) -> str:
    """A code point to what it is made of; the empty string if it shows nothing."""
    if unicodedata.category(ch) in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x85":
        return " "
    if _ignorable(ch):
        return ""
    if not _keeps_look(ch):
        return ch
    parts = unicodedata.decomposition(ch)
    if not parts:
        return _LOOKS.get(ch, ch)
    codes = parts.split(" ")
    return "".join(_spread(chr(int(c, 16))) for c in codes if not c.startswith("<"))


_LOOKS = {pair[0]: pair[1] for words in (CYRILLIC, GREEK, OTHER, KANA, RADICALS) for pair in words.split()}


@functools.lru_cache(maxsize=1)
def _mapped() -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of ``mapping`` and ``mark_classes``, made once a process."""
    own = lambda i: 0xD800 <= i < 0xE000 or 0xAC00 <= i < 0xD7A4 or 0x3400 <= i < 0xA000 or 0x20000 <= i < 0x2F800 or 0x30000 <= i < 0xE0000
    signs = [chr(i) for i in range(0x80, 0xE0200) if not own(i)]
    parts = [(c, to) for c in signs if (to := _spread(c)) != c] + [(c, " ") for c in "\t\n\v\f\r"]
    marks = [(c, n) for c in signs if (n := unicodedata.combining(c))]
    return pd.DataFrame(parts, columns=["ch", "parts"]), pd.DataFrame(marks, columns=["part", "class"])


def mapping(spark: SparkSession) -> DataFrame:
    """``ch`` to its parts, for the code points that aren't their own single part.

    Made by rule from the Unicode data; it holds at most one row per code point
    whatever the input, so it may be broadcast.
    """
    return spark.createDataFrame(_mapped()[0], "ch string, parts string")


def mark_classes(spark: SparkSession) -> DataFrame:
    """Combining marks and their classes, the ones that are ordered; bounded like ``mapping``."""
    return spark.createDataFrame(_mapped()[1], "part string, class int")


def _characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"))


@F.pandas_udf(StringType())
def _recompose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFC", t).split(" ")).strip() if t is not None else None)


def consistent_forms(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys``, ``value`` and ``form``: equal-looking values have equal forms.

    Each distinct value is taken once.  Plain ASCII with single spaces is its own
    form; any other value is exploded to positioned code points, which a
    broadcast join maps to their parts (canonical and same-looking
    compatibility decompositions, look-alike letters, nothing for invisible
    ones, a space for every white space); combining marks are put in the order
    of their classes behind their base; the parts are joined, recomposed, runs
    of spaces made one and outer ones cut.  Case, punctuation, visible accents,
    superscripts and simplified against traditional signs stay different.

    Defined cases: a null value has a null form; empty, blank and invisible
    values have the empty form; repeated rows are kept; ties can't arise; no
    rows give no rows; extra columns are dropped.
    """
    spark = df.sparkSession
    src = df.select(*keys, F.col(value).alias("value"))
    plain = F.col("value").rlike(_PLAIN)
    odd = src.filter(~plain).select("value").distinct()
    signs = odd.select("value", F.posexplode_outer(_characters(F.col("value"))).alias("pos", "ch"))
    parts = signs.join(F.broadcast(mapping(spark)), "ch", "left").withColumn("parts", F.coalesce("parts", "ch"))
    # a value that shows nothing keeps a row without a part
    single = parts.select("value", "pos", F.posexplode_outer(_characters(F.col("parts"))).alias("sub", "part"))
    ranked = single.join(F.broadcast(mark_classes(spark)), "part", "left").fillna(0, ["class", "pos", "sub"])
    in_order = Window.partitionBy("value").orderBy("pos", "sub")
    bases = ranked.withColumn("base", F.sum(F.when(F.col("class") == 0, 1).otherwise(0)).over(in_order))
    rebuilt = bases.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("base", "class", "pos", "sub", "part"))).alias("items")).select("value", F.array_join(F.col("items.part"), "").alias("joined"))
    forms = rebuilt.select("value", _recompose(F.regexp_replace("joined", " +", " ")).alias("form"))
    easy = src.filter(plain | F.col("value").isNull()).select(*keys, "value", F.col("value").alias("form"))
    return easy.unionByName(src.filter(~plain).join(forms, "value").select(*keys, "value", "form"))


def same_looking_pairs(forms: DataFrame, groups: Sequence[str], key: str) -> DataFrame:
    """``groups``, ``id_a`` < ``id_b``: records whose values differ but have one form.

    Records of one spelling aren't paired: the join is between the distinct
    spellings of a form, so a title repeated under one spelling costs nothing.
    Only forms with more than one spelling reach the join.  The forms are
    written once, as three steps read them.
    """
    rows = cut(forms.filter("form is not null").select(*groups, "form", "value", F.col(key).alias("id")).distinct())
    several = rows.groupBy(*groups, "form").agg((F.min("value") != F.max("value")).alias("several")).filter("several").drop("several")
    rows = rows.join(several, [*groups, "form"])
    other = rows.select(*groups, "form", F.col("value").alias("value_b"), F.col("id").alias("id_b"))
    return rows.join(other, [*groups, "form"]).filter("id < id_b and value <> value_b").select(*groups, F.col("id").alias("id_a"), "id_b").distinct()
