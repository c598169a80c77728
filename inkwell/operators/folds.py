"""Ordered folds whose state is more than a few numbers, over arrays of one row, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from inkwell.functions import direction as D

_TAG = re.compile(D.DIALOGUE_TAG.replace("(?iU)", "(?i)"))
_UNIT = re.compile("[㐀-鿿豈-﫿\U00020000-\U0003134f]|(?:(?![㐀-鿿豈-﫿\U00020000-\U0003134f])[^\\W_])+(?:['’](?:(?![㐀-鿿豈-﫿\U00020000-\U0003134f])[^\\W_])+)*")
_CLOSERS = "\"”’')]}"
_ABBREVIATED = frozenset("mr mrs ms dr prof st jr sr etc".split())
MOST_UNITS = 8


def per_row(df: DataFrame, keys: Sequence[str], inputs: Sequence[str], schema: str, names: Sequence[str], make: Callable[..., list[tuple]]) -> DataFrame:
    """``make(*inputs)`` of each row, its tuples as rows beside the keys; a narrow step."""
    src = df.select(*keys, *inputs)
    full = ", ".join([*(f"{k} {t}" for k, t in df.select(*keys).dtypes), schema])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*row[: len(keys)], *made) for row in frame.itertuples(index=False, name=None) for made in make(*row[len(keys) :])]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return src.mapInPandas(run, full)


def aligned_parts(text: str | None, words: Sequence[str] | None) -> list[tuple[str, int | None]]:
    """A text cut into the words that are found in order, with their numbers, and the gaps."""
    text, parts, at = text or "", [], 0
    for i, word in enumerate(words if words is not None else ()):
        word = (word or "").strip()
        found = text.find(word, at) if word else -1
        if found >= 0:
            if found > at:
                parts.append((text[at:found], None))
            at = found + len(word)
            parts.append((text[found:at], i))
    return parts + ([(text[at:], None)] if at < len(text) else [])


def timed_units(text: str | None, words: Sequence | None) -> list[tuple[int, str, float, float]]:
    """Units of a text with the earliest start and latest end of the timed words that overlap them."""
    text, out, at = text or "", {}, 0
    spans = [m.span() for m in _UNIT.finditer(text)]
    first = 0
    for w in words if words is not None else ():
        word = (w["word"] or "").strip()
        found = text.find(word, at) if word else -1
        if found < 0:
            continue
        at = found + len(word)
        while first < len(spans) and spans[first][1] <= found:
            first += 1
        for i in range(first, len(spans)):
            if spans[i][0] >= at:
                break
            old = out.get(i)
            out[i] = (min(old[0], w["start_s"]), max(old[1], w["end_s"])) if old else (w["start_s"], w["end_s"])
    return [(i, text[slice(*spans[i])], *out[i]) for i in sorted(out)]


def is_tag(text: str) -> bool:
    return len(text.strip()) <= 120 and _TAG.search(text) is not None


def performance_groups(text: str | None, spans: Sequence | None) -> list[tuple[int, int, int, str, str, str]]:
    """Spans to units of performance: number, start, end, speaker, voice policy, join policy.

    A speaker read in the narrator's voice takes in the dialogue tags behind its
    quotes and its own quotes behind those; a tag behind another's quote joins
    tight.  Together the units are the text.
    """
    text = text or ""
    rows = [dict(start=s["start"], end=s["end"], speaker=s["speaker"], delivery=s["delivery_type"], policy=s["voice_policy"]) for s in (spans if spans is not None else ())]
    narrator = [" ".join((r["speaker"] or "").casefold().split()) == D.NARRATOR for r in rows]
    plain = [not n and (r["policy"] in ("narrator", "narrator_compatible") or r["delivery"] in D.COMPATIBLE) for n, r in zip(narrator, rows)]
    tag = [n and is_tag(text[r["start"] : r["end"]]) for n, r in zip(narrator, rows)]
    out, i = [], 0
    while i < len(rows):
        r, last = rows[i], i
        if plain[i]:
            same = lambda k: k < len(rows) and plain[k] and rows[k]["speaker"].casefold().split() == r["speaker"].casefold().split()
            while last + 1 < len(rows) and tag[last + 1] and same(last + 2):
                last += 2
            if last + 1 < len(rows) and tag[last + 1]:
                last += 1
            out.append((len(out), r["start"], rows[last]["end"], r["speaker"], "narrator_compatible", "normal"))
        else:
            tight = narrator[i] and i > 0 and not narrator[i - 1] and tag[i]
            out.append((len(out), r["start"], r["end"], D.NARRATOR if narrator[i] else r["speaker"], r["policy"], "tight" if tight else "normal"))
        i = last + 1
    return out


def assigned_voices(characters: Sequence | None, pool: Sequence) -> list[tuple[str, str]]:
    """Voices to characters in order: the hinted one, the first unused of their sex, the first unused, then in turn."""
    if not pool:
        raise ValueError("the pool of voices is empty")
    ids, used, turn, out = [v[0] for v in pool], set(), 0, []
    for c in characters if characters is not None else ():
        free = [v for v in pool if v[0] not in used]
        fitting = [v for v in free if v[1] == c["gender"]] or free
        if c["hint"] in ids:
            voice = c["hint"]
        elif fitting:
            voice = fitting[0][0]
        else:
            voice, turn = ids[turn % len(ids)], turn + 1
        used.add(voice)
        out.append((c["name"], voice))
    return out


def sentence_places(text: str) -> list[int]:
    """Where sentences begin: behind . ! ? with closers and white space, not behind an abbreviation."""
    out = []
    for m in re.finditer(r"[.!?][\"”’')\]}]*(?=\s|$)\s*", text):
        word = re.search(r"([A-Za-z]+)$", text[: m.start()])
        if not (text[m.start()] == "." and word and word.group(1).lower() in _ABBREVIATED) and m.end() < len(text):
            out.append(m.end())
    return out


def _quoted(text: str) -> bool:
    t = text.strip()
    bare = t.rstrip(" \t\r\n,.;:!?)]}")
    return t[:1] in tuple('"“‘') and bare[-1:] in tuple('"”’')


def _allowed(left: str, right: str) -> bool:
    if not left.strip() or not right.strip():
        return False
    tail = re.sub(rf"[{re.escape(_CLOSERS)}\s]+$", "", left)[-1:]
    return tail in tuple(".!?") or _quoted(left) or tail in tuple(":—-") and _quoted(right)


def candidate_units(text: str | None) -> list[str]:
    """Sentences, and the quotes behind an introduction, of a segment; the whole where that isn't lossless or legal."""
    text = text or ""
    cuts = [0, *sentence_places(text), len(text)]
    units = []
    for a, b in zip(cuts, cuts[1:]):
        part = text[a:b]
        m = re.search(r"([:—]\s*)[\"“‘]", part) or re.search(r"(\s-\s+)[\"“‘]", part)
        at = m.end(1) if m else 0
        units += [part[:at], part[at:]] if m and _allowed(part[:at], part[at:]) else [part]
    units = [u for u in units if u]
    legal = 1 < len(units) <= MOST_UNITS and all(_allowed(a, b) for a, b in zip(units, units[1:]))
    return units if legal else [text]


def _count(text: str) -> int:
    return len(re.findall(r"[\w']+", text))


def merged_short(units: Sequence[str], delivery: str) -> list[str] | None:
    """Units too short to stand alone joined to the wordier neighbour; None where none would be left apart."""
    units, i = list(units), 0
    whole = len(units)
    while i < len(units):
        u = units[i]
        short = _count(u) < D.SHORT_WORDS or len(u.strip()) < D.SHORT_CHARS
        if not short or delivery in ("internal_thought", "self_talk") or _quoted(u):
            i += 1
            continue
        if len(units) == 1:
            return None
        before = _count(units[i - 1]) if i else -1
        behind = _count(units[i + 1]) if i + 1 < len(units) else -1
        if before >= behind:
            units[i - 1 : i + 1] = [units[i - 1] + u]
            i -= 1
        else:
            units[i : i + 2] = [u + units[i + 1]]
    if len(units) == 1 and whole > 1 or not all(_allowed(a, b) for a, b in zip(units, units[1:])):
        return None
    return units
