"""Sentence boundaries for every script.

Terminators and letter classes are the Unicode sentence-break property's, so
full stops, dandas and ideographic stops need no list.  On top of the property
rules come abbreviations, initials and numbers (for full stops), closing
quotes and brackets, and reporting clauses.  Abbreviations hold in their
language: that of the book, unless the text's own function words speak for
another, as the tag of a book is often wrong.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Word lists, stated by language.  TITLES stand before a name, NUMBERED before a
# number, WITHIN never end a sentence; those under "all" hold in every language.
TITLES = {
    "all": "Dr Prof St",
    "en": "Mr Mrs Ms Mx Dr Prof Capt Col Lt Gen Sgt Maj Cpl Cmdr Adm Rev Hon Gov Pres Sen Rep St Mt Ft Messrs Mmes Esq",
    "de": "Hr Hrn Fr Frl Dipl Ing Mag Sankt",
    "fr": "M MM Mme Mlle Mgr Me Vve Ste",
    "es": "Sr Sra Srta Sres D Dn Dña Dr Dra Ud Uds Vd Vds Fr Pbro Lic",
    "hi": "डॉ प्रो श्री श्रीमती सुश्री कु पं रु",
}
NUMBERED = {
    "all": "No no p fig vol cap art ca",
    "en": "No Nos no nos p pp P vol vols Vol sec secs Sec fig figs Fig chap chaps Chap ch Ch art Art pt Pt bk l ll v n nn par col ed eds Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec",
    "de": "Nr Nrn S Bd Bde Abb Kap Art Abs Tab Anm Jh ca Mio Jän Okt Dez",
    "fr": "n nº fol liv tom t chap pl",
    "es": "núm núms pág págs cap caps vol fig art lám",
    "hi": "रु सं पृ क्र",
}
WITHIN = {
    "all": "vs cf",
    "en": "vs cf viz i.e e.g approx ca al resp incl",
    "de": "bzw vgl ca z.B d.h u.a o.ä z.T evtl ggf sog Vgl bspw",
    "fr": "p.ex c.-à-d env",
    "es": "p.ej aprox",
}
# Abbreviations that are words, names or single letters elsewhere: these hold in their own language only.
AMBIGUOUS = "S M D T Me Fr Ing Mag Hon Gen Sen Rep Pres Col Ste Lic Art art Jan Mar Jun Sep Abs Tab Jh Anm Okt Dez liv tom chap par col ed sog resp env rs"
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
# Verbs that report speech, for the clause after a quotation.
SAID_EN = "said asked cried whispered replied answered shouted called exclaimed muttered murmured added continued demanded"
SAID_ZH = "说 說 问 問 道 答 喊 叫 喊道 叫道 问道 問道 答道 笑道 说道 說道 回答 低声说 低聲說"
SAID_HI = "पूछा कहा बोला बोली बोले चिल्लाया चिल्लाई पुकारा"

# Words without content, by which a text shows its language.
FUNCTION_WORDS = {
    "en": "the of and to in was that he she it his her with for had not they at by from were which but this you be",
    "de": "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an er sie hatte wurde",
    "fr": "le la les de des du et à en un une que qui dans pour il elle est pas sur se au avec son sa ce était",
    "es": "el la los las de del y en que un una por con no se su para al lo como más pero sus era había",
}
# Words that begin a sentence and never follow an initial within a name.
STARTERS = {
    "en": "The A An And But He She It They We You I Then There This That These Those When While If In On At As So What Who Why How Where His Her Its Their My Our Your Not No Now For After Before",
    "de": "Der Die Das Ein Eine Und Aber Er Sie Es Wir Ihr Ich Dann Da Dort Dies Diese Dieser Als Wenn Während In Im Auf Am So Was Wer Warum Wie Wo Sein Seine Mein Nicht Nun Nach Vor",
    "fr": "Le La Les Un Une Et Mais Il Elle On Ils Elles Nous Vous Je Puis Alors Ce Cette Ces Quand Si Dans Sur À Au Comme Que Qui Pourquoi Où Son Sa Ses Mon Ma Notre Non Après Avant",
    "es": "El La Los Las Un Una Y Pero Él Ella Ellos Ellas Nosotros Yo Entonces Este Esta Estos Esto Cuando Si En Al Como Así Qué Quién Por Dónde Su Sus Mi Nuestra No Ahora Después Antes",
}
LANGUAGES = {"en": "en eng english", "de": "de deu ger german", "fr": "fr fra fre french", "es": "es spa spanish", "hi": "hi hin hindi"}

#: Characters before and after an abbreviation whose words tell the language it is quoted in.
AROUND = 60

_in = lambda lists: {k: frozenset(v.split()) for k, v in lists.items()}
_BY_LANGUAGE = {"titles": _in(TITLES), "numbered": _in(NUMBERED), "within": _in(WITHIN), "starters": _in(STARTERS)}
_ANY = {k: frozenset().union(*v.values()) for k, v in _BY_LANGUAGE.items()}
_FUNCTION = _in(FUNCTION_WORDS)
_AMBIGUOUS = frozenset(AMBIGUOUS.split())
_CODES = {code: name for name, codes in LANGUAGES.items() for code in codes.split()}
_MONTHS = frozenset(MONTHS.split())


def _spoken(text: str) -> str | None:
    """The language most function words of a text are of, if it has any."""
    seen = Counter(_LATIN_WORDS.findall(text.lower()))
    votes = {k: sum(seen[w] for w in words & seen.keys()) for k, words in _FUNCTION.items()}
    best = max(votes, key=votes.get)
    return best if votes[best] else None


class Tongue:
    """The languages whose abbreviations hold at a place of a text.

    These are the book's tag, as far as the text doesn't speak for another, the
    language of the whole text's function words, and those of the words before
    and after, as texts quote in other languages.  Only abbreviations that are
    words elsewhere need it; the others hold everywhere.  Where neither tag nor words tell, every
    language's abbreviations hold.  Counted only where an abbreviation depends
    on it.
    """

    def __init__(self, text: str, tag: str | None):
        self.text, self.tag = text, _CODES.get(re.split("[-_]", (tag or "").strip().lower())[0])

    @functools.cached_property
    def whole(self) -> str | None:
        return _spoken(self.text)

    def has(self, kind: str, word: str, at: int) -> bool:
        if word not in _ANY[kind]:
            return False
        by_language = _BY_LANGUAGE[kind]
        if kind != "starters" and word not in _AMBIGUOUS or word in by_language.get("all", ()):
            return True
        if self.tag and word in by_language.get(self.tag, ()):
            return True
        low, high = max(0, at - AROUND), at + AROUND
        silent = True
        for begin, end in ((low, high), (low, at), (at, high), (0, 0)):
            told = _spoken(self.text[begin:end]) if end else self.whole
            if told and word in by_language.get(told, ()):
                return True
            silent &= told is None
        return silent and (self.tag is None or word in by_language.get(self.tag, ()))


def _of_property(name: str) -> str:
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return "".join(regex.findall(rf"\p{{Sentence_Break={name}}}", every))


@functools.lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    strong, full = re.escape(_of_property("STerm")), re.escape(_of_property("ATerm"))
    close = re.escape("".join(sorted({c for c in _of_property("Close") if unicodedata.category(c) in ("Pe", "Pf")} - {"»"})))
    return {
        "end": re.compile(rf"(?:(?<!\d)[{full}]|[{full}](?!\d)|[{strong}…])[{strong}{full}…]*"),
        "strong": re.compile(f"[{strong}]"),
        "close": re.compile("[ \\u00a0\\u2009\\u202f]?»|[" + close + "]|[\"'“«‘]"),
    }


_LATIN_WORDS = re.compile("[A-Za-zÀ-ÿ]+")
_PARAGRAPH = re.compile("(?:\\r\\n?|\\n|\\u2028|\\u0085)[^\\S\\r\\n]*(?:(?:\\r\\n?|\\n|\\u2028|\\u0085)\\s*)+|\\u2029\\s*")
_SPACE = re.compile(r"\s*")
_WORD_BEFORE = re.compile(r"((?:[^\W_]|[ऀ-्̀-ͯ])+(?:[.\-’'](?:[^\W_]|[ऀ-्])+)*(?:\.-[^\W_]+-[^\W_]+)?)$")
_WORD_AFTER = re.compile(r"[^\W\d_]+")
_ROMAN = re.compile(r"[IVXLCDM]+\b")
_ALNUM = re.compile(r"[^\W_]")
_OPEN = frozenset({c for c in _of_property("Close") if unicodedata.category(c) in ("Ps", "Pi")} | set("\"'¿¡»"))
_DASHES = frozenset("-–—―−‐‑‒")
_GOES_ON = frozenset({c for c in _of_property("SContinue") if unicodedata.category(c) != "Pd"} - _DASHES | set(";；؛&/%"))
_LOWER = frozenset(_of_property("Lower"))
_PAIRS = {"”": "“", "’": "‘", "」": "「", "』": "『", "】": "【", "》": "《", "〉": "〈", "）": "（", ")": "(", "]": "[", "}": "{", "»": "«", "›": "‹", "“": "„", "«": "»", "‘": "‚", "﹂": "﹁", "｣": "｢", "〕": "〔", "〗": "〖"}
_BRACKETS = frozenset({c for c in _of_property("Close") if unicodedata.category(c) == "Pe"} - set("」』》〉﹂﹄｣"))
_SAYS_ZH = re.compile(rf"[^，。！？；：、“”「」…\s]{{1,12}}?(?:{'|'.join(SAID_ZH.split())})(?=[。！？，；…]|$)")
_SAYS_HI = re.compile(rf"\S+(?:\s\S+){{0,3}}?\s(?:{'|'.join(SAID_HI.split())})(?![^\W_])")
_SAYS_EN = re.compile(rf"(?:(?:[A-Z][\w.’-]*)\s){{1,3}}(?:{'|'.join(SAID_EN.split())})\b(?!, *[“‘\"'])")
_SAYS_JA = ("と", "って", "という", "など", "なんて")


def _closers(text: str, at: int, start: int, stop: int, close: re.Pattern) -> tuple[int, list[str]]:
    """End and signs of the quotes and brackets that close right after a terminator."""
    signs: list[str] = []
    while at < stop and (m := close.match(text, at, stop)):
        sign = m.group()[-1]
        if sign == '"' and text.count('"', start, at) % 2 == 0:
            break
        if sign in "'‘" and (m.end() < stop and text[m.end()].isalnum() or sign == "‘" and text.rfind("‚", start, at) <= text.rfind("‘", start, at)):
            break
        if sign == "“" and text.rfind("„", start, at) <= text.rfind("“", start, at):
            break
        if sign == "«" and text.rfind("»", start, at) <= text.rfind("«", start, at):
            break
        signs.append(sign)
        at = m.end()
    return at, signs


def _full_stop_ends(text: str, at: int, nxt: int, start: int, line: int, tongue: Tongue) -> bool:
    """Whether a lone full stop at ``at`` ends a sentence that would go on at ``nxt`` with no small letter."""
    found = _WORD_BEFORE.search(text, max(start, at - 30), at)
    if not found:
        return True
    token = unicodedata.normalize("NFC", found.group(1))
    last = token.rsplit(".", 1)[-1].rsplit("-", 1)[-1]
    after = text[nxt]
    if tongue.has("within", token, at) or tongue.has("within", last, at):
        return False
    if tongue.has("titles", last, at) and (after.isalpha() or after in _OPEN or after.isdigit() and last not in _MONTHS):
        return False
    if (after.isdigit() or _ROMAN.match(text, nxt)) and tongue.has("numbered", last, at):
        return False
    if len(last) == 1 and last.isalpha():
        if after.isdigit():
            return False
        if after.isalpha() and after.isupper():
            if (m := _WORD_AFTER.match(text, nxt)) and tongue.has("starters", m.group(), at) and len(m.group()) > 1 and "." not in token:
                return True
            lone = nxt + 1 >= len(text) or not text[nxt + 1].isalpha()
            if last.isupper() or lone and "." not in token:
                return False
    if last.isdigit() and after.isalpha():
        if len(last) <= 2 and (m := _WORD_AFTER.match(text, nxt)) and m.group() in _MONTHS:
            return False
        if len(last) <= 3 and found.start(1) == line:
            return False
    return True


def _line_start(text: str, at: int, start: int) -> int:
    line = max(text.rfind("\n", start, at), text.rfind("\r", start, at)) + 1 or start
    return _SPACE.match(text, max(line, start)).end()


def _ends(text: str, m: re.Match, at: int, signs: list[str], start: int, stop: int, starts: set[int], patterns: dict[str, re.Pattern], tongue: Tongue) -> bool:
    """Whether the terminator ``m``, with its closers up to ``at``, ends a sentence."""
    nxt = _SPACE.match(text, at, stop).end()
    if nxt >= stop:
        return True
    after = text[nxt]
    if after in _LOWER or after in _GOES_ON:
        return False
    strong = patterns["strong"].search(m.group()) is not None
    ellipsis = not strong and (len(m.group()) > 1 or "…" in m.group())
    if after in _DASHES:
        beyond = nxt
        while beyond < stop and (text[beyond] in _DASHES or text[beyond].isspace()):
            beyond += 1
        if beyond >= stop:
            return True
        said = text[beyond]
        return not (said.islower() or said.isalpha() and not said.isupper())
    if after in _OPEN:
        beyond = nxt
        while beyond < stop and (text[beyond] in _OPEN or text[beyond].isspace()):
            beyond += 1
        if after not in "¿¡" and after in "([{（［" and beyond < stop and text[beyond].islower():
            return False
        if ellipsis and not signs and beyond < stop and text[beyond].islower():
            return False
    if signs:
        bracket, quote = signs[-1] in _BRACKETS, any(s not in _BRACKETS for s in signs)
        opened = text.rfind(_PAIRS.get(signs[-1], signs[-1]), start, m.start())
        leads = opened in starts
        if bracket and not quote:
            return leads or opened < 0
        if after.isalpha() and not after.isupper():
            if text.startswith(_SAYS_JA, nxt):
                return False
            return not (leads and (_SAYS_ZH.match(text, nxt, stop) or _SAYS_HI.match(text, nxt, stop)))
        if strong and after.isupper() and _SAYS_EN.match(text, nxt, stop):
            return False
        return True
    if ellipsis:
        return after.isupper() or after in _OPEN and not (after.isalpha())
    if strong:
        return True
    if nxt == at and after.isalpha() and not after.isupper():
        return False
    return _full_stop_ends(text, m.start(), nxt, start, _line_start(text, m.start(), start), tongue)


def sentence_spans(text: str | None, language: str | None = None) -> list[tuple[int, int]]:
    """Half-open code-point offsets of a text's sentences, without surrounding white space.

    A blank line ends a sentence.  Null, empty and blank texts, and pieces
    without letter or digit, give nothing.
    """
    if not text:
        return []
    patterns, spans, tongue = _patterns(), [], Tongue(text, language)
    end_at, close = patterns["end"].finditer, patterns["close"]
    at, limits = 0, []
    for gap in _PARAGRAPH.finditer(text):
        limits.append((at, gap.start()))
        at = gap.end()
    limits.append((at, len(text)))
    for low, stop in limits:
        start = begin = _SPACE.match(text, low, stop).end()
        starts = {begin}
        done = begin
        for m in end_at(text, start, stop):
            if m.start() < done:
                continue
            at, signs = _closers(text, m.end(), start, stop, close)
            if _ends(text, m, at, signs, start, stop, starts, patterns, tongue):
                spans.append((begin, at))
                begin = done = _SPACE.match(text, at, stop).end()
                starts.add(begin)
        if begin < stop:
            spans.append((begin, stop))
    out = []
    for a, b in spans:
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a and _ALNUM.search(text, a, b):
            out.append((a, b))
    return out


def one_delivery(items: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Of each item's deliveries the one of the longest text, of equals the one with the greatest hash: its list, one row an entry.

    ``items`` has the keys, ``chars``, ``hash`` and the list ``field``; the lists
    travel whole, so that two deliveries of one item never mix.
    """
    return items.groupBy(*keys).agg(F.max_by(field, F.struct("chars", "hash")).alias(field)).select(*keys, F.inline(field))


def sentences(df: DataFrame, with_text: bool = False) -> DataFrame:
    """``(item_kind, item_id, text[, language])`` to one row per sentence: offsets, and the text if asked for.

    One narrow Arrow step, then one row an item in the shuffle.  Defined cases:
    an item delivered several times counts once, with its longest text; null,
    empty, blank texts and texts without letter or digit give no row; null ids
    are kept as one item; a null or unknown language lets the text's own words
    decide; very long texts are read whole; no rows give no rows; other columns
    are ignored.
    """
    entry = "sent_start int, sent_end int" + ", sentence string" * with_text
    fields = ["sent_start", "sent_end"] + ["sentence"] * with_text
    schema = f"item_kind string, item_id bigint, chars int, hash bigint, spans array<struct<{entry.replace(' int', ':int').replace(' string', ':string')}>>"
    kept = ["item_kind", "item_id", "chars", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, flat, cut = [], [], []
            for text, language in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist()):
                spans = sentence_spans(text, language)
                counts.append(len(spans))
                flat += spans
                if with_text:
                    cut += [text[a:b] for a, b in spans]
            ends = np.array(flat, np.int32).reshape(-1, 2)
            columns = [pa.array(ends[:, 0]), pa.array(ends[:, 1])] + [pa.array(cut, pa.string())] * with_text
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=fields))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), lists], names=[*kept, "spans"])

    language = F.col("language") if "language" in df.columns else F.lit(None).cast("string")
    src = df.filter("text is not null").select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), F.length("text").alias("chars"), F.xxhash64("text").alias("hash"), "text", language.alias("language"))
    return one_delivery(src.mapInArrow(run, schema), ["item_kind", "item_id"], "spans")
