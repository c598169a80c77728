"""Variant spellings of names, attached to the canonical form most likely behind them.

A noisy-channel model: frequent spellings are ranked as canonical forms, a
spelling's source is the form with the greatest product of that prior and the
likelihood of the typo, abbreviation, nickname or reordering between them.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.lookalike import _spread
from inkwell.session import cut

# Words around a name that aren't part of it.
TITLES = (
    "mr mrs ms miss mister mistress master sir lady lord dame dr doctor prof professor rev reverend capt captain col colonel lt lieutenant maj major gen general sgt sergeant hon father brother sister "
    "old young madame mme mlle mgr herr hr frau fr sr sra srta don dona señor señora"
)
FEMALE = "mrs miss ms mistress lady dame madame mme mlle frau sra srta dona señora sister"
MALE = "mr mister master sir lord herr hr sr don señor father brother"
BEFORE = "by par von"
AFTER = "jr sr esq ed eds editor phd md"
HAN_AFTER = "先生 女士 小姐 夫人 太太 著 编 編 译 譯 撰 编著 編著 主编"
HAN_BEFORE = "老 小"
NOBODY = (
    "anon;anonymous;anonym;anonyme;anonimo;unknown;unknown author;author unknown;an unknown hand;unbekannt;inconnu;auteur inconnu;desconocido;autor desconocido;various;various authors;varios;divers;verschiedene;n/a;na;none;null;nobody;tbd;-;--;?;"
    "佚名;无名氏;無名氏;不详;不詳;未知;作者不详;作者不詳;作者不明;अज्ञात"
)
# Words of organisations with their abbreviations.
ORG = {
    "society": "soc socy", "institute": "inst instit", "library": "lib libr", "association": "assoc assn ass", "company": "co comp compy", "brothers": "bros bro", "academy": "acad", "press": "pr", "club": "", "university": "univ", "college": "coll",
    "committee": "comm cttee", "union": "", "museum": "mus", "council": "", "board": "bd", "historical": "hist", "missionary": "miss mission", "publishing": "publ pub publg", "publishers": "publrs", "guild": "", "foundation": "found", "league": "", "office": "off", "department": "dept", "group": "", "house": "ho",
}
ORG_DROPPED = "the of and & inc ltd llc gmbh for"
# Short forms that no rule gives, by language: a name and what is short for it.  Regular ones
# (a part of the name, with or without an ending) need no list.
IRREGULAR = {
    "en": "william bill,robert bob,richard dick rick,edward ned ted,margaret peggy meg daisy madge,mary molly polly mamie,john jack jno,henry harry hal hank,james jim jem,sarah sally sadie,ann nancy nan,helen nell ellie,ellen nell,"
    "elizabeth bess betsy betty libby,dorothy dot dolly,dorothea dot dolly,philippa pip,wilhelmina billie minnie,francis frank,frances fanny,charles chuck,christopher kit,katherine kit kay,martha patty patsy,harriet hatty,henrietta hetty,jane jenny,theresa tess,anthony tony,thomas tam,alexander sandy alec,"
    "lawrence larry,theodore ted,eleanor nora nell,leonora nora,isabel tibby,susan sukey sue,susannah sue,matilda maud,augustus gus,bartholomew bat,david dai,frederick fritz,gilbert gib,hugh hew,oliver noll,roger hodge,walter wat,mildred millie,winifred freda,percival percy,rosalind roz,deborah debs,agnes nessie,catherine kit kay,abigail nabby abby,barbara babs,margaret mag meggie,cornelius neil,gertrude trudy",
    "de": "friedrich fritz,heinrich heinz hinz,konrad kurt,johannes hans,josef sepp,margarete grete gretel,elisabeth lise ilse,katharina kathe trine,georg jorg schorsch,ludwig lutz,rudolf rolf,gottfried gotz,nikolaus klaus,charlotte lotte,lieselotte lilo lotte,maria mitzi,karl kalle,dietrich dirk,ulrich utz",
    "fr": "marie manon mimi,marguerite margot,genevieve ginette,jean jeannot,henri riquet,louis loulou,francois fanchon,jeanne nanette,pierre pierrot,madeleine madelon,charles charlot",
    "es": "jose pepe,josefa pepa,francisco paco pancho curro,ignacio nacho,dolores lola,concepcion concha,enrique quique,ramon moncho,rosario charo,mercedes merche,joaquin quino,jesus chucho,guillermo memo,eduardo lalo,maria maruja,rafael fito,consuelo chelo,isabel chabela,luz lucha",
    "it": "giovanni gianni nino,giuseppe beppe peppino,luigi gigi,francesco cecco,lorenzo renzo,caterina rina,filippo pippo,domenico mimmo",
    "ru": "alexander sasha shura,ivan vanya,mikhail misha,nikolai kolya,maria masha,dmitri mitya,alexei alyosha,pyotr petya,grigori grisha,lev lyova,ekaterina katya,vladimir volodya,sergei seryozha,anna anya,pavel pasha,evgeni zhenya,natalia natasha,daria dasha",
}
#: Endings of short forms, each language's.
ENDINGS = "y ie i ey e ee o a s sy sie us is chen lein el le li in ine ita ito illo illa ico ica ina ino etta etto ette et ot on ou ka ya"
# Traditional signs and their simplified forms, for names.
TRADITIONAL = (
    "孫孙 張张 陳陈 劉刘 楊杨 趙赵 黃黄 吳吴 鄭郑 馮冯 鄧邓 許许 蕭萧 葉叶 蘇苏 羅罗 韓韩 謝谢 顧顾 莊庄 龍龙 鳳凤 書书 詞词 遠远 濤涛 橋桥 硯砚 瀾澜 綺绮 澗涧 嶺岭 蓮莲 蘭兰 煙烟 雲云 鐘钟 鍾钟 錦锦 燈灯 曉晓 葦苇 靜静 麥麦 鴻鸿 鶴鹤 鈴铃 "
    "賀贺 盧卢 蔣蒋 賴赖 閻阎 湯汤 鄒邹 駱骆 錢钱 嚴严 聶聂 範范 薑姜 齊齐 萬万 貝贝 車车 馬马 魚鱼 鳥鸟 門门 風风 飛飞 東东 國国 華华 義义 禮礼 樂乐 歡欢 寶宝 寧宁 實实 貴贵 賢贤 賓宾 興兴 發发 達达 榮荣 偉伟 傑杰 強强 陽阳 陰阴 隱隐 霧雾 靈灵 韻韵 頌颂 順顺 顏颜 "
    "慶庆 憶忆 懷怀 應应 戲戏 擇择 數数 斷断 時时 晝昼 會会 極极 樓楼 樹树 權权 歲岁 歸归 殘残 氣气 沖冲 淚泪 淵渊 湧涌 溝沟 滅灭 漁渔 潔洁 潤润 濱滨 灣湾 無无 熱热 燦灿 爾尔 獨独 瑪玛 瓊琼 畫画 異异 碩硕 穎颖 窮穷 筆笔 節节 簡简 紅红 純纯 細细 終终 綠绿 緣缘 羽羽 "
    "聖圣 聲声 興兴 舊旧 蒼苍 蕓芸 藝艺 藍蓝 蘆芦 虛虚 覺觉 觀观 詩诗 誠诚 語语 調调 諾诺 謹谨 譚谭 豐丰 貞贞 趨趋 躍跃 輝辉 輕轻 邊边 鄉乡 銀银 鋒锋 鏡镜 長长 閃闪 間间 雙双 雜杂 難难 電电 霽霁 響响 頭头 願愿 飄飘 館馆 驚惊 髮发 麗丽 黨党 點点 齡龄"
)

_TITLES, _FEMALE, _MALE, _BEFORE, _AFTER = (frozenset(w.split()) for w in (TITLES, FEMALE, MALE, BEFORE, AFTER))
_NOBODY = frozenset(NOBODY.split(";"))
_ORG = {short: word for word, shorts in ORG.items() for short in [word, *shorts.split()]}
_ORG_DROPPED = frozenset(ORG_DROPPED.split())
_ROOTS: dict[str, set[str]] = {}
for _line in ",".join(IRREGULAR.values()).split(","):
    for _name in _line.split()[1:]:
        _ROOTS.setdefault(_name, set()).add(_line.split()[0])
_ENDINGS = sorted(ENDINGS.split(), key=len, reverse=True)
_SIMPLE = str.maketrans({p[0]: p[1] for p in TRADITIONAL.split() if len(p) == 2})
_HAN = re.compile("[㐀-鿿豈-﫿]")
_DATES = re.compile(r",?\s*\(?\s*(?:b\.|d\.|fl\.|c\.|ca\.)?\s*\d{3,4}\s*\??\s*(?:[-–—]\s*(?:\d{2,4}\??)?)?\s*\)?\s*$")
_BRACKETS = re.compile(r"[〔\[【(（][^〕\]】)）]*[〕\]】)）]")


def folded(text: str) -> str:
    """One form for the look, no accents on letters of bicameral scripts, small letters."""
    look = unicodedata.normalize("NFD", "".join(map(_spread, text)))
    return " ".join("".join(c for c in look if not unicodedata.combining(c) or ord(c) > 0x36F).casefold().split())


@functools.lru_cache(maxsize=65536)
def _org_word(word: str) -> str:
    """An organisation's word written with one typo, set right; other words as they are."""
    if len(word) < 7 or word in _ORG:
        return word
    return next((full for full in ORG if len(full) >= 7 and _close(word, full)), word)


class Reading(dict):
    """kind (person, han, org, epithet, nobody), given, middle, surname, sex, flip."""


@functools.lru_cache(maxsize=65536)
def read_name(raw: str | None) -> Reading:
    """What a spelling says, apart from how it is written."""
    nothing = Reading(kind="nobody", given="", middle="", surname="", sex="", flip=False)
    if raw is None:
        return nothing
    text = _BRACKETS.sub(" ", _DATES.sub("", folded(raw))).strip(" ,;.")
    if not text or text in _NOBODY or text.strip("[]().") in _NOBODY:
        return nothing
    if _HAN.search(text):
        name = re.sub(r"[\s·•・‧.]", "", text).translate(_SIMPLE)
        for end in sorted(HAN_AFTER.split(), key=len, reverse=True):
            if name.endswith(end.translate(_SIMPLE)) and len(name) > len(end) + 1:
                name = name[: -len(end)]
        if name[:1] in HAN_BEFORE.split() and len(name) > 2:
            name = name[1:]
        return Reading(kind="nobody" if name in _NOBODY else "han", given="", middle="", surname=name, sex="", flip=False)
    comma = "," in text
    tokens = [t for t in re.split(r"[\s,]+", text) if t]
    plain = [t.strip(".'’\"“”‘") for t in tokens]
    plain = [_org_word(p) for p in plain]
    kinds = {_ORG[p] for p, t in zip(plain, tokens) if p in _ORG and not (p == "miss" and len(tokens) < 3) and not (p in ("co", "pr", "ho", "bd", "off", "mus", "ass", "comp") and "." not in t and t != plain[-1])}
    if kinds - {"missionary", "brothers", "group", "house", "board", "office"} or "brothers" in kinds and {plain[-1], plain[0] if comma else ""} & {"brothers", "bros", "bro"}:
        rest = [p for p in plain if p not in _ORG_DROPPED and p not in _ORG and p]
        return Reading(kind="org", given="", middle=" ".join(sorted(kinds)), surname=" ".join(rest), sex="", flip=False)
    if plain[0] == "the":
        return Reading(kind="epithet", given="", middle="", surname=" ".join(plain[1:]), sex="", flip=False)
    if comma:
        last, _, first = text.partition(",")
        plain = [t.strip(".'’\"“”‘") for t in [*re.split(r"[\s,]+", first), "\x00", *last.split()] if t.strip(".,'’\"“”‘")]
    sex, titled = "", False
    while len([p for p in plain if p != "\x00"]) > 1 and (plain[0] in _TITLES or plain[0] in _BEFORE):
        sex = sex or ("f" if plain[0] in _FEMALE else "m" if plain[0] in _MALE else "")
        titled |= plain[0] in _TITLES
        plain = plain[1:]
    plain = [p for p in plain if p == "\x00" or not (comma and p in _TITLES)]
    while len(plain) > 2 and plain[-1] in _AFTER:
        plain = plain[:-1]
    if "\x00" in plain:
        at = plain.index("\x00")
        first, last = plain[:at], plain[at + 1 :]
    elif len(plain) > 1 and len(plain[-1]) == 1 and len(plain[0]) > 1:  # the surname first, then an initial
        first, last, comma = plain[1:], plain[:1], True
    else:
        first, last = plain[:-1], plain[-1:]
    if not last and first:
        first, last = first[:-1], first[-1:]
    given, middle = (first[0] if first else ""), " ".join(first[1:])
    if titled and not given and not last:
        return nothing
    return Reading(kind="person", given=given, middle=middle, surname=" ".join(last), sex=sex, flip=not comma and len(plain) > 1 and len(given) > 1 and len(last[0]) > 1)


def roots(given: str) -> list[str]:
    """The name itself and the names that it, or its stem, is an irregular short form of."""
    return sorted({given}.union(*(_ROOTS.get(s, ()) for s in (given, *stems(given))))) if given else []


def plain(given: str) -> str:
    """Short forms write th as t and c as ck."""
    return given.replace("th", "t").replace("ck", "c")


@functools.lru_cache(maxsize=65536)
def stems(given: str) -> tuple[str, ...]:
    """What a name would have in common with the longer one it is short for: itself, and itself without an ending, of three letters or more, or two of a name of three."""
    if len(given) < 3 or not given.isalpha():
        return ()
    given = plain(given)
    out = {given} if len(given) <= 6 else set()
    for ending in _ENDINGS:
        stem = given[: -len(ending)]
        if given.endswith(ending) and len(stem) >= (2 if len(given) == 3 else 3):
            out.add(stem)
            if stem[-1] == stem[-2] and len(stem) > 3:
                out.add(stem[:-1])
    return tuple(sorted(out))


def _contracted(given: str) -> bool:
    """Whether a name may be a contraction, such as Wm, Chas or Robt, or the first two letters of one."""
    vowels = sum(c in "aeiouy" for c in given)
    return len(given) in (2, 3) or 3 < len(given) <= 5 and given.isalpha() and vowels <= 1 and given[-1] not in "aeiouy"


def _parts(given: str) -> set[str]:
    return {plain(given)[i : i + 3] for i in range(len(plain(given)) - 2)}


def _heads(given: str) -> set[str]:
    return {s[:3] for s in stems(given) if len(s) > 2}


def _deletes(word: str) -> list[str]:
    return sorted({word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}) if len(word) >= 4 else [word]


def blocks(kind: str, given: str, middle: str, surname: str) -> list[str]:
    """Keys, each after the sides it gives and takes: two spellings of one name share a key that one gives and the other takes.

    Sides are bits, so that "12" gives side 1 and takes side 2.  A surname common
    to a third of all spellings is never a key by itself: it stands with the
    given name, with one letter less of it, with a part of three letters of it,
    or with an initial, which only those written with initials meet.  Single
    names and epithets meet only their like.
    """
    if kind == "org":
        return [f"11o|{middle}|{d}" for d in _deletes(surname)]
    if kind in ("person", "epithet") and not (kind == "person" and given):
        return [f"11{kind}|{d}" for d in _deletes(surname)]
    if kind != "person":
        return []
    near = _deletes(surname)
    if len(given) == 1:
        return [f"13i|{d}|{given}" for d in near]
    out = [f"11e|{d}|{r}" for d in near for r in roots(given)]
    out += [f"11t|{surname}|{g}" for g in _deletes(given)] if len(given) >= 4 else []
    out += [f"21i|{d}|{i}" for d in near for i in sorted({r[:1] for r in roots(given)})]
    parts, heads = _parts(given), _heads(given)
    out += [f"{2 * (p in heads) | (p in parts)}{2 * (p in parts) | (p in heads)}n|{surname}|{p}" for p in sorted(parts | heads)]
    short, long = _contracted(given), len(given) >= 4
    if short or long:
        out.append(f"{short | 2 * long}{2 * short | long}c|{surname}|{given[0]}")
    return out


#: What an edit may be: two letters changed over, a doubled letter, one left out or put in, one for another.
EDITS = ("swap", "double", "gap", "other")


def _edit(a: Column, b: Column) -> Column:
    """Which of ``EDITS`` leads from one word to the other, where one does; never of short words."""
    letters = lambda c: F.array_sort(F.split(c, ""))
    apart = F.levenshtein(a, b, 2)
    once = lambda c: F.regexp_replace(c, r"(.)\1", "$1")
    kind = (
        F.when((apart == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)), "swap")
        .when((apart == 1) & (F.length(a) == F.length(b)), "other")
        .when((apart == 1) & (once(a) == once(b)), "double")
        .when(apart == 1, "gap")
    )
    return F.when(F.least(F.length(a), F.length(b)) >= 4, kind)


def _near(a: Column, b: Column) -> Column:
    return _edit(a, b).isNotNull()


# Log-likelihoods of what a writer does to a name.  That of a typo is shared out between
# the kinds of edit as the names themselves show them.
TYPO, NICK, INITIAL, DROPPED = -4.0, -1.5, -1.0, -0.5


def edit_scores(edits: DataFrame) -> DataFrame:
    """One row: the log-likelihood of each kind of edit, learned from ``edit`` of pairs that differ in nothing else.

    Each kind's share, with ten even pairs added, over an even share; a map of
    ``EDITS`` whatever the input, so it may be joined to every row.
    """
    counts = edits.agg(*(F.count_if(F.col("edit") == e).alias(e) for e in EDITS))
    all_ = sum((F.col(e) for e in EDITS), F.lit(10.0))
    score = lambda e: F.lit(TYPO) + F.greatest(F.lit(-1.5), F.least(F.lit(0.5), F.log((F.col(e) + 2.5) * len(EDITS) / all_)))
    return counts.select(F.create_map(*(x for e in EDITS for x in (F.lit(e), score(e)))).alias("edits"))


def _middle_score(a: Column, b: Column) -> Column:
    short = (F.length(a) == 1) | (F.length(b) == 1)
    one = F.substring(a, 1, 1) == F.substring(b, 1, 1)
    return F.when(a == b, 0.0).when((a == "") | (b == ""), DROPPED).when(short & one, DROPPED).when(one & F.least(F.length(a), F.length(b)).between(1, 99) & (F.contains(a, F.lit(" ")) | F.contains(b, F.lit(" "))), 2 * DROPPED).when(_near(a, b), TYPO)


def _short_for(a: Column, b: Column, sa: Column, sb: Column) -> Column:
    """Whether one name is short for the other by rule: a part of it, what is before an ending and within the other, two letters, or a contraction."""
    said = lambda name: F.replace(F.replace(name, F.lit("th"), F.lit("t")), F.lit("ck"), F.lit("c"))
    part = lambda long, short, stems_: F.exists(stems_, lambda s: F.when(F.length(s) < 3, F.startswith(long, s)).when(s == said(short), said(long).contains(s)).otherwise(F.left(said(long), F.length(said(long)) - 1).contains(s)))
    few = lambda short: (F.length(short) <= 5) & (F.length(F.regexp_replace(short, "[^aeiouy]", "")) <= 1) & ~short.rlike("[aeiouy]$")
    contracted = lambda long, short: F.when((F.length(short) == 2) & F.startswith(long, short), True).when(few(short) & (F.length(long) >= F.length(short) + 2), F.rlike(long, F.concat(F.lit("^"), F.array_join(F.split(short, ""), ".*")))).otherwise(False)
    longer = lambda long, short, stems_: (F.length(long) >= F.length(short)) & (F.length(short) > 1) & (part(long, short, stems_) | contracted(long, short))
    return longer(a, b, sb) | longer(b, a, sa)


_READING = "kind string, given string, middle string, surname string, sex string"
def _spread_out(df: DataFrame) -> DataFrame:
    """Rows for a Python step over as many tasks as a shuffle has: they are few bytes but much work, and would be joined into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


_KEYS = "array<string>"


def _read_rows(df: DataFrame, raw: str, weight: str) -> DataFrame:
    """``raw``, its weight and its readings: reading 0, and 1 with given name and surname changed over where no sign tells them apart."""
    names = ["raw", "weight", "reading", "ways", "kind", "given", "middle", "surname", "sex"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, many in zip(frame["raw"], frame["weight"]):
                r = read_name(text)
                if r["kind"] == "nobody":
                    continue
                rest = [*r["middle"].split(), r["surname"]]
                two = bool(r["flip"] and len(rest[0]) > 1)
                rows.append((text, many, 0, int(two), r["kind"], r["given"], r["middle"], r["surname"], r["sex"]))
                if two:
                    rows.append((text, many, 1, 1, r["kind"], rest[0], " ".join(rest[1:]), r["given"], r["sex"]))
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(raw).alias("raw"), F.col(weight).alias("weight")).mapInPandas(run, f"raw string, weight bigint, reading int, ways int, {_READING}")


def name_keys(spellings: DataFrame) -> DataFrame:
    """``(spelling, weight)`` to its reading and key; nobody's spellings are left out.

    Where a spelling can be read two ways round, the way whose parts other
    spellings use more often as given name and as surname is taken.
    """
    read = cut(_read_rows(_spread_out(spellings), "spelling", "weight"))
    trust = F.when(F.col("ways") == 0, 3.0).otherwise(1.0)
    parts = F.array(F.struct(F.lit("g").alias("part"), F.col("given").alias("word")), F.struct(F.lit("s").alias("part"), F.col("surname").alias("word")))
    votes = read.filter("kind = 'person' and reading = 0").select(trust.alias("trust"), F.inline(parts)).groupBy("part", "word").agg(F.sum("trust").alias("votes"))
    doubtful = read.filter("ways = 1").select("raw", "reading", F.inline(parts)).join(votes, ["part", "word"], "left")
    own = F.when(F.col("reading") == 0, 1.0).otherwise(0.0)
    score = doubtful.groupBy("raw", "reading").agg((F.sum(F.log1p(F.coalesce("votes", F.lit(0.0)) - own)) - F.first("reading") * 0.5).alias("score"))
    chosen = score.groupBy("raw").agg(F.max_by("reading", F.struct(F.round("score", 9), -F.col("reading"))).alias("chosen"))
    best = read.join(chosen, "raw", "left").filter("ways = 0 or reading = chosen")
    key = F.concat_ws("|", "kind", "given", "middle", "surname")
    return best.select(F.col("raw").alias("spelling"), "weight", "kind", "given", "middle", "surname", "sex", key.alias("key"))


def _keyed(df: DataFrame) -> DataFrame:
    """Forms with what their given name may be short for, and the keys of ``blocks``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["roots"] = [roots(g) for g in frame["given"]]
            frame["stems"] = [list(stems(g)) for g in frame["given"]]
            frame["blocks"] = [blocks(*row) for row in zip(frame["kind"], frame["given"], frame["middle"], frame["surname"])]
            yield frame

    return df.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + f", roots array<string>, stems array<string>, blocks {_KEYS}")


def _meeting(forms: DataFrame, carried: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Pairs ``a``, ``b`` of forms (``id``, ``within`` and ``carried``) that share a key one gives and the other takes, each once, ``a.id`` < ``b.id``.

    The two bits are the two sides of a key: a form only given on one side meets
    those taken there, so the many full names beside an initial don't meet each
    other by it.  Only ids and hashes of keys travel; what the pairs are judged
    by is joined to the distinct pairs.
    """
    keys = forms.select("id", *within, F.explode("blocks").alias("block"))
    rows = keys.select("id", F.xxhash64(*within, F.substring("block", 3, 1 << 30)).alias("key"), F.left("block", F.lit(2)).cast("int").alias("sides"))
    # both ends of the join have the same columns and no filter, so that they read one exchange
    other = rows.select(F.col("id").alias("other"), "key", F.col("sides").alias("other_sides"))
    given_, taken = F.floor(F.col("sides") / 10).cast("int"), F.col("other_sides") % 10
    both = rows.hint("merge").join(other.hint("merge"), "key").filter((given_.bitwiseAND(taken) > 0) & (F.col("id") != F.col("other")))
    pairs = both.select(F.least("id", "other").alias("low"), F.greatest("id", "other").alias("high")).distinct()
    known = lambda id_, it: forms.select(F.col("id").alias(id_), F.struct("id", *within, *carried).alias(it))
    # merged, not broadcast: the forms grow with the data, and building their tables would fill the driver
    met = pairs.join(known("low", "a").hint("merge"), "low").join(known("high", "b").hint("merge"), "high")
    for name in within:
        met = met.filter(F.col(f"a.{name}") == F.col(f"b.{name}"))
    return met.select(*(F.col(f"a.{name}").alias(name) for name in within), "a", "b")


def attach(keys: DataFrame) -> DataFrame:
    """``key`` to ``parent``: the canonical form with the greatest posterior; canonical forms have none.

    ``keys`` has one row per key: key, kind, given, middle, surname, weight.
    A form's prior grows with its use, with that of its parts, and with the
    number of forms that could be variants of it: of rare forms the one in the
    middle is the canonical one.
    """
    people = keys.filter("kind = 'person'")
    given_fame = people.groupBy("given").agg(F.countDistinct("surname").alias("given_fame"))
    surname_fame = people.groupBy("surname").agg(F.countDistinct(F.substring("given", 1, 1)).alias("surname_fame"), F.sum("weight").alias("surname_weight"))
    rich = keys.join(given_fame, "given", "left").join(surname_fame, "surname", "left").fillna(1, ["given_fame", "surname_fame", "surname_weight"])
    full = F.when((F.col("kind") != "person") | (F.length("given") > 1), 1).otherwise(0)
    prior = F.log("weight") + 0.5 * F.log1p("given_fame") + 0.5 * F.log1p("surname_weight")
    forms = cut(_keyed(_spread_out(rich.select("key", "kind", "given", "middle", "surname", "given_fame", "surname_fame", "surname_weight", full.alias("full"), prior.alias("prior")))).withColumnRenamed("key", "id"))
    both = _meeting(forms, ["kind", "given", "middle", "surname", "roots", "stems", "given_fame", "surname_fame", "surname_weight", "full", "prior"]).filter("a.kind = b.kind")
    a, b = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))
    org = a("kind") == "org"
    surname = F.when(a("surname") == b("surname"), "").otherwise(_edit(a("surname"), b("surname")))
    one = (F.length(a("given")) == 1) | (F.length(b("given")) == 1)
    initial = one & F.exists(F.concat(a("roots"), b("roots")), lambda x: F.substring(x, 1, 1) == F.when(F.length(a("given")) == 1, a("given")).otherwise(b("given")))
    short = F.arrays_overlap(a("roots"), b("roots"))
    given = F.when(org | (a("given") == b("given")), 0.0).when(initial, INITIAL).when(short, NICK)
    given_edit = F.when(given.isNull() & ~one, _edit(a("given"), b("given")))
    irregular = (F.size(a("roots")) > 1) | (F.size(b("roots")) > 1)
    by_rule = F.when(given.isNull() & ~one & ~irregular & given_edit.isNull() & _short_for(a("given"), b("given"), a("stems"), b("stems")), NICK + DROPPED)
    middle = F.when(org, F.when(a("middle") == b("middle"), 0.0)).otherwise(_middle_score(a("middle"), b("middle")))
    end = lambda s: F.struct(*(s(k).alias(k) for k in ("id", "prior", "full", "given_fame", "surname_fame", "surname_weight")))
    judged = both.select(end(a).alias("low"), end(b).alias("high"), surname.alias("surname_edit"), given_edit.alias("given_edit"), F.coalesce(given, by_rule).alias("given_s"), middle.alias("middle_s"))
    edges = cut(judged.filter("surname_edit is not null and middle_s is not null and (given_s is not null or given_edit is not null)"))
    learned = edit_scores(edges.filter("surname_edit <> '' and given_s = 0 and middle_s = 0").select(F.col("surname_edit").alias("edit")))
    edit = lambda e: F.coalesce(F.when(F.col(e) == "", 0.0), F.element_at("edits", F.col(e)))
    likelihood = edit("surname_edit") + F.coalesce("given_s", edit("given_edit")) + F.col("middle_s")
    scored = edges.crossJoin(F.broadcast(learned)).select("low", "high", (F.col("surname_edit") != "").alias("other_surname"), F.col("given_s").isNull().alias("other_given"), likelihood.alias("likelihood")).filter(F.col("likelihood") > 2.5 * TYPO)
    ways = scored.select(F.col("low").alias("v"), F.col("high").alias("c"), "other_surname", "other_given", "likelihood").unionByName(scored.select(F.col("high").alias("v"), F.col("low").alias("c"), "other_surname", "other_given", "likelihood"))
    degrees = ways.groupBy(F.col("v.id").alias("id")).agg(F.count("*").alias("degree"))
    order = lambda s, d: F.struct(F.col(f"{s}.full").alias("full"), F.round(F.col(f"{s}.prior") + F.log1p(d), 6).alias("prior"), F.col(f"{s}.id").alias("id"))
    up = ways.join(degrees.select(F.col("id").alias("v_id"), F.col("degree").alias("v_degree")), F.col("v.id") == F.col("v_id")).join(degrees.select(F.col("id").alias("c_id"), F.col("degree").alias("c_degree")), F.col("c.id") == F.col("c_id"))
    up = up.withColumns({"v_order": order("v", "v_degree"), "c_order": order("c", "c_degree")}).filter("c_order > v_order")
    known_given = (F.col("v.given_fame") >= 3) & (F.col("v.given_fame") >= 0.05 * F.col("c.given_fame"))
    # initials soon reach all letters there are, so that surnames are compared by their use
    known_surname = (F.col("v.surname_fame") >= 3) & (F.col("v.surname_weight") >= 0.2 * F.col("c.surname_weight"))
    likely = up.filter(~(F.col("other_given") & known_given) & ~(F.col("other_surname") & known_surname))
    return likely.groupBy(F.col("v_id").alias("key")).agg(F.max_by("c_id", F.struct(F.col("likelihood") + F.col("c_order.prior"), "c_order")).alias("parent"))


def to_roots(parents: DataFrame, child: str = "key", parent: str = "parent") -> DataFrame:
    """Follow parents to the end by doubling, two steps a pass; parents always rank higher, so there is one."""
    now = cut(parents.select(child, parent))
    while True:
        step = lambda name: now.select(F.col(child).alias(f"__via{name}"), F.col(parent).alias(f"__next{name}"))
        once = now.join(step(1), F.col(parent) == F.col("__via1"), "left")
        twice = once.join(step(2), F.col("__next1") == F.col("__via2"), "left")
        now = cut(twice.select(child, F.coalesce("__next2", "__next1", parent).alias(parent), F.col("__next2").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select(child, parent)
        now = now.select(child, parent)


def link_authors(df: DataFrame, key: str = "book_id", name: str = "author") -> DataFrame:
    """Each id with a name to ``entity``, the canonical key of the person or organisation.

    Names are taken once per spelling, with the number of ids as its weight, so
    an author of a third of all books is one row.  Defined cases: null, empty and
    blank names and stand-ins for unknown authors have no entity and are left
    out; repeated rows count once; of equal posteriors the greater key wins; no
    rows give no rows; other columns are ignored.
    """
    rows = df.select(F.col(key).alias("id"), F.col(name).alias("spelling")).filter("spelling is not null and id is not null").distinct()
    spellings = rows.groupBy("spelling").agg(F.count("*").alias("weight"))
    keyed = cut(name_keys(spellings))
    keys = keyed.groupBy("key", "kind", "given", "middle", "surname").agg(F.sum("weight").alias("weight"))
    found = to_roots(attach(keys))
    linked = keyed.join(found, "key", "left").select("spelling", F.coalesce("parent", "key").alias("entity"))
    return rows.join(linked, "spelling").select("id", "spelling", "entity")


def spelling_pairs(linked: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``id_a`` < ``id_b`` of one entity under different spellings; each spelling of an entity meets only the others."""
    several = linked.groupBy(*within, "entity").agg((F.min("spelling") != F.max("spelling")).alias("several")).filter("several").drop("several")
    rows = linked.join(several, [*within, "entity"])
    other = rows.select(*within, "entity", F.col("id").alias("id_b"), F.col("spelling").alias("spelling_b"))
    return rows.join(other, [*within, "entity"]).filter("id < id_b and spelling <> spelling_b").select(F.col("id").alias("id_a"), "id_b").distinct()


def read_character(canonical: str | None, aliases) -> dict:
    """All that a profile says of its name: surnames, given names, epithets, sex."""
    surnames, givens, epithets, han = [], [], [], []
    main = read_name(canonical)
    sex = main["sex"]
    loose: list[str] = []
    for place, text in enumerate([canonical, *(aliases if aliases is not None else [])]):
        r = main if place == 0 else read_name(text)
        if r["kind"] == "epithet":
            epithets.append(r["surname"])
        elif r["kind"] == "han":
            han.append(r["surname"])
        elif r["kind"] == "person":
            if r["given"]:
                givens.append(r["given"])
                surnames.append(r["surname"])
            elif place == 0:
                surnames.append(r["surname"])
            else:
                loose.append(r["surname"])
    for word in loose:
        near = any(_close(word, s) for s in surnames)
        (surnames if near else givens).append(word)
    unique = lambda words: sorted(dict.fromkeys(w for w in words if w), key=len, reverse=True)
    full = [g for g in unique(givens) if len(g) > 1] or unique(givens)
    return {"surnames": unique(surnames), "givens": full, "epithets": sorted(set(epithets)), "han": han, "sex": sex}


def _close(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        differ = [i for i in range(len(a)) if a[i] != b[i]]
        return len(differ) == 1 or len(differ) == 2 and differ[1] == differ[0] + 1 and a[differ[0]] == b[differ[1]] and a[differ[1]] == b[differ[0]]
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


_FORM = f"han string, surnames array<string>, givens array<string>, given_roots array<string>, given_stems array<string>, title_sex string, epithets array<string>, blocks {_KEYS}"


def _character_blocks(han: str, surnames: list[str], givens: list[str], epithets: list[str]) -> list[str]:
    """Keys with their sides as in ``blocks``: whole names meet by both their parts, and those with a part missing by the other or by an epithet."""
    if han:
        return [f"11h|{han}"]
    whole = bool(surnames and givens)
    sides = "21" if whole else "13"
    out = {key for s in surnames for g in givens for key in blocks("person", g, "", s)}
    if whole or not givens:
        out |= {f"{sides}s|{d}" for s in surnames for d in _deletes(s)}
    if whole or not surnames:
        out |= {f"{sides}g|{r}" for g in givens for r in roots(g)}
        side, head, part = ("21", "q", "p") if whole else ("12", "p", "q")
        out |= {f"{side}{head}|{h}" for g in givens for h in _heads(g)}
        out |= {f"{side}{part}|{x}" for g in givens for x in _parts(g)}
    return sorted(out | {f"{sides}x|{e}" for e in epithets})


def _character_forms(df: DataFrame) -> DataFrame:
    """Distinct (source_id, canonical, aliases, sex) with what they say and their block keys."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for canonical, aliases in zip(frame["canonical"], frame["aliases"]):
                r = read_character(canonical, aliases)
                han = (r["han"] or [""])[0]
                out.append((han, r["surnames"], r["givens"], sorted({x for g in r["givens"] for x in roots(g)}), sorted({x for g in r["givens"] for x in stems(g)}), r["sex"], r["epithets"], _character_blocks(han, r["surnames"], r["givens"], r["epithets"])))
            more = pd.DataFrame(out, columns=["han", "surnames", "givens", "given_roots", "given_stems", "title_sex", "epithets", "blocks"])
            yield pd.concat([frame.reset_index(drop=True), more], axis=1)

    schema = f"id bigint, source_id string, canonical string, aliases array<string>, told_sex string, weight bigint, {_FORM}"
    return df.mapInPandas(run, schema)


def _any(a: Column, b: Column, test) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: test(x, y)))


def _initial_of(a: Column, b: Column) -> Column:
    return (F.length(a) == 1) & (F.substring(b, 1, 1) == a)


def link_characters(df: DataFrame) -> DataFrame:
    """Each character_id to ``entity`` within its book: ``id, source_id, spelling, entity``.

    Profiles with the same canonical, aliases and sex in a book are one form,
    so the number of builds doesn't matter.  A form is attached to the likeliest
    canonical form of its book: surnames and given names (aliases included) must
    agree or be a typo, nickname or initial of each other, shared epithets and
    sexes add weight, and two forms of one build are never the same character.
    A persona is a character of its own, one for each name in a book, apart from
    the one it masks.

    Defined cases: null or empty aliases say nothing; a null canonical or source
    has no entity and is left out; repeated rows count once; ties go to the
    greater form number; no rows give no rows; other columns are ignored.
    """
    sex = F.lower(F.substring(F.trim(F.coalesce("gender", F.lit(""))), 1, 1))
    told = F.when(sex.isin("m", "f"), sex).otherwise("")
    rows = df.filter("canonical is not null and source_id is not null and character_id is not null").select("source_id", F.col("character_id").alias("id"), "build", "canonical", F.coalesce(F.array_sort(F.array_distinct(F.filter("aliases", lambda a: a.isNotNull()))), F.array()).cast("array<string>").alias("aliases"), told.alias("told_sex"), F.coalesce(F.trim("persona_of"), F.lit("")).alias("mask")).distinct()
    personas = rows.filter("mask <> ''").select("id", "source_id", F.col("canonical").alias("spelling"), F.concat(F.lit("persona|"), F.lower(F.trim("canonical"))).alias("entity"))
    plain_rows = rows.filter("mask = ''").withColumn("form", F.xxhash64("source_id", "canonical", F.to_json("aliases"), "told_sex"))
    plain_rows = cut(plain_rows.select("form", "source_id", "id", "build", "canonical", "aliases", "told_sex"))
    grouped = plain_rows.groupBy(F.col("form").alias("id"), "source_id", "canonical", "aliases", "told_sex").agg(F.count("*").alias("weight"))
    # how often the canonical is used as it stands, over all alias lists
    fame = plain_rows.groupBy("source_id", F.lower(F.trim("canonical")).alias("low")).agg(F.count("*").alias("fame"))
    forms = cut(_character_forms(_spread_out(grouped)).withColumn("low", F.lower(F.trim("canonical"))).join(fame, ["source_id", "low"]).drop("low", "canonical", "aliases"))
    spelled = (F.size("givens") > 0).cast("int") + (F.size("surnames") > 0).cast("int")
    clean = F.when(F.col("title_sex") == "", 0.5).otherwise(0.0)
    forms = forms.withColumn("told", F.least(spelled, F.lit(2))).withColumn("prior", F.log("fame") + clean)
    both = _meeting(forms, ["han", "surnames", "givens", "given_roots", "given_stems", "title_sex", "told_sex", "epithets", "told", "prior", "weight"], ["source_id"])
    v, c = (lambda k: F.col(f"a.{k}")), (lambda k: F.col(f"b.{k}"))
    none = lambda col: F.size(col) == 0
    surname = F.when(none(v("surnames")) | none(c("surnames")), -2.0).when(F.arrays_overlap(v("surnames"), c("surnames")), 0.0).when(_any(v("surnames"), c("surnames"), _near), TYPO / 2)
    by_initial = _any(v("givens"), c("given_roots"), _initial_of) | _any(c("givens"), v("given_roots"), _initial_of)
    v_sex, c_sex = (F.when(col("title_sex") != "", col("title_sex")).otherwise(col("told_sex")) for col in (v, c))
    apart = (v_sex != "") & (c_sex != "") & (v_sex != c_sex)
    irregular = (F.size(v("given_roots")) > F.size(v("givens"))) | (F.size(c("given_roots")) > F.size(c("givens")))
    by_rule = ~irregular & ~apart & _any(v("givens"), c("givens"), lambda x, y: _short_for(x, y, v("given_stems"), c("given_stems")))
    given = F.when(none(v("givens")) | none(c("givens")), -3.0).when(F.arrays_overlap(v("givens"), c("givens")), 0.0).when(F.arrays_overlap(v("given_roots"), c("given_roots")), NICK).when(by_initial, INITIAL).when(_any(v("givens"), c("givens"), _near), TYPO / 2).when(by_rule, NICK + DROPPED)
    shared = F.when(F.arrays_overlap(v("epithets"), c("epithets")), 2.5).when(~none(v("epithets")) & ~none(c("epithets")), -1.0).otherwise(0.0)
    sexes = F.when((v_sex == "") | (c_sex == ""), 0.0).when(v_sex == c_sex, 0.5).otherwise(-3.0)
    nameless = lambda x: none(x("surnames")) & none(x("givens"))
    latin = F.when((nameless(v) | nameless(c)) & (shared <= 0), None).otherwise(surname + given + shared + sexes)
    likelihood = F.when((v("han") != "") | (c("han") != ""), F.when(v("han") == c("han"), 0.0)).otherwise(latin)
    end = lambda s: F.struct(*(s(k).alias(k) for k in ("id", "told", "prior", "weight")))
    judged = both.select("source_id", v("id").alias("form"), c("id").alias("other"), end(v).alias("low"), end(c).alias("high"), likelihood.alias("likelihood"))
    scored = judged.filter(F.col("likelihood").isNotNull() & (F.col("likelihood") > -6.5))
    builds = plain_rows.groupBy("form").agg(F.collect_set("build").alias("builds"))
    edges = cut(scored.join(builds, "form").join(builds.select(F.col("form").alias("other"), F.col("builds").alias("other_builds")), "other").filter(~F.arrays_overlap("builds", "other_builds")).select("low", "high", "likelihood"))
    ways = edges.select(F.col("low").alias("v"), F.col("high").alias("c"), "likelihood").unionByName(edges.select(F.col("high").alias("v"), F.col("low").alias("c"), "likelihood"))
    degrees = ways.groupBy(F.col("v.id").alias("id")).agg(F.count("*").alias("degree"))
    order = lambda s: F.struct(F.col(f"{s}.told").alias("told"), F.round(F.col(f"{s}.prior") + F.log1p(f"{s}_degree"), 6).alias("prior"), F.col(f"{s}.weight").alias("weight"), F.col(f"{s}.id").alias("id"))
    of = lambda s: degrees.select(F.col("id").alias(f"{s}_id"), F.col("degree").alias(f"{s}_degree"))
    up = ways.join(of("v"), F.col("v.id") == F.col("v_id")).join(of("c"), F.col("c.id") == F.col("c_id")).withColumns({"v_order": order("v"), "c_order": order("c")}).filter("c_order > v_order")
    parents = up.groupBy(F.col("v_id").alias("form")).agg(F.max_by("c_id", F.struct(F.col("likelihood") + F.col("c_order.prior"), "c_order")).alias("parent"))
    found = to_roots(parents, "form")
    linked = plain_rows.join(found, "form", "left").select("id", "source_id", F.col("canonical").alias("spelling"), F.coalesce("parent", "form").cast("string").alias("entity"))
    return linked.unionByName(personas)
