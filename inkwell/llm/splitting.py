"""Oversized texts to overlapping pieces under a limit, cut at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.sentences import _PARAGRAPH, one_delivery, sentence_spans

# The code points that count as Han, and the signs that join letters.
HAN = "㐀-鿿豈-﫿\U00020000-\U0003134f"
APOSTROPHES = "'’"

LIMIT = 200
OVERLAP = 20

_HAN = re.compile(f"[{HAN}]")
_RUN = f"[^\\W_{HAN}]+"
_HAN_UNITS = re.compile(f"[{HAN}]|{_RUN}(?:[{APOSTROPHES}]{_RUN})*")
_WORDS = re.compile(r"\S+")

#: How strongly a place invites a cut.
PARAGRAPH, SENTENCE, CLAUSE, COMMA, SPACE, NONE = 5, 4, 3, 2, 1, 0
_OPENING = "“‘«„‚「『【《〈（([{¿¡\"'"
_CLOSING = "”’»」』】》〉）)]}\"'“"


def unit_spans(text: str) -> list[tuple[int, int]]:
    """Han characters and runs of other letters or digits where there is Han, else words."""
    return [m.span() for m in (_HAN_UNITS if _HAN.search(text) else _WORDS).finditer(text)]


def unit_count(text: str) -> int:
    return len(_HAN_UNITS.findall(text)) if _HAN.search(text) else len(text.split())


class _Places:
    """Where a text may be cut: before each unit but the first."""

    def __init__(self, text: str):
        self.text, self.units = text, unit_spans(text)
        self.starts = [a for a, _ in self.units]
        self.marked: dict[int, int] = {}
        for a, _ in sentence_spans(text):
            self.marked[bisect_left(self.starts, a)] = SENTENCE
        for m in _PARAGRAPH.finditer(text):
            self.marked[bisect_left(self.starts, m.end())] = PARAGRAPH

    def offset(self, unit: int) -> int:
        """The character a piece beginning with ``unit`` begins with: opening marks go along."""
        if unit <= 0:
            return 0
        if unit >= len(self.units):
            return len(self.text)
        at, floor = self.units[unit][0], self.units[unit - 1][1]
        while at > floor and self.text[at - 1] in _OPENING:
            at -= 1
        return at

    def strength(self, unit: int) -> int:
        if unit in self.marked:
            return self.marked[unit]
        begin, at = self.units[unit - 1][1], self.units[unit][0]
        between = self.text[max(0, begin - 2) : at].rstrip()
        sign = between.rstrip(_CLOSING)[-1:]
        if sign in tuple(";:；：—–·"):
            return CLAUSE
        if sign in tuple(",，、،"):
            return COMMA
        return SPACE if at > begin else NONE


def _cuts(places: _Places, pieces: int, limit: int, overlap: int) -> tuple[list[int], int] | None:
    """Unit numbers at which ``pieces`` pieces begin, and how many cuts miss a sentence end."""
    n, room = len(places.units), limit - overlap
    even = (n + overlap * (pieces - 1)) / pieces
    reach = even / 3
    cuts, weak = [0], 0
    for i in range(1, pieces):
        target = i * (even - overlap) + overlap
        most = cuts[-1] + (limit if i == 1 else room)
        least = max(cuts[-1] + overlap + 1, n - room * (pieces - i))
        if least > most or least >= n:
            return None
        low, high = max(least, round(target - reach)), min(most, n - 1, round(target + reach))
        if low > high:
            low, high = least, min(most, n - 1)
        best = max(range(low, high + 1), key=lambda u: (places.strength(u), -abs(u - target)))
        weak += places.strength(best) < SENTENCE
        cuts.append(best)
    return cuts, weak


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces as (begin, core begin, end) offsets; one piece where the text fits, none for null.

    ``text[core begin:end]`` of all pieces joined is the text; ``begin`` lies
    ``overlap`` units before, in the piece before.  Balanced targets: the
    smallest number of pieces that can hold the units, equally long targets,
    each snapped to the strongest place nearby; pieces are added while a piece
    is over the limit, or when that brings all cuts to sentence ends.
    """
    if text is None:
        return []
    if unit_count(text) <= limit:
        return [(0, 0, len(text))]
    places = _Places(text)
    n, room = len(places.units), limit - overlap
    least = 1 + -(-(n - limit) // room)
    best: tuple[int, list[tuple[int, int, int]]] | None = None
    pieces = least
    while best is None or pieces <= least + 2:
        found = _cuts(places, pieces, limit, overlap)
        if found:
            cuts, weak = found
            ends = [*cuts[1:], n]
            out = [(places.offset(c - overlap if c else 0), places.offset(c), places.offset(e)) for c, e in zip(cuts, ends)]
            if all(unit_count(text[a:e]) <= limit for a, _, e in out) and (best is None or weak < best[0]):
                best = weak, out
                if not weak:
                    break
        pieces += 1
        if pieces > n:
            break
    if best is None:
        raise ValueError("no cut keeps every piece within the limit")
    return best[1]


def split_items(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """``(item_kind, item_id, para_pos, text)``: the pieces of the items above the limit.

    One row per piece: piece_no, from_pos (overlap included), core_pos, to_pos,
    n_units and, if asked for, piece.  A narrow Arrow step; a text of no more characters than
    the limit can't have more units and never leaves the JVM.

    Defined cases: null, empty, blank and short texts give nothing; a text with
    no natural boundary is cut between units; a piece never exceeds the limit;
    an item delivered several times counts once, with its longest text; null
    keys are kept; no rows give no rows; other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be under half the limit")
    keys = ["item_kind", "item_id", "para_pos"]
    fields = {"piece_no": pa.int32(), "from_pos": pa.int32(), "core_pos": pa.int32(), "to_pos": pa.int32(), "n_units": pa.int32()} | ({"piece": pa.string()} if with_text else {})
    schema = f"item_kind string, item_id bigint, para_pos int, chars int, hash bigint, pieces array<struct<{','.join(f'{n}:{t}' for n, t in zip(fields, ['int'] * 5 + ['string']))}>>"
    kept = [*keys, "chars", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, rows = [0], []
            for text in batch.column("text").to_pylist():
                pieces = split_text(text, limit, overlap)
                if len(pieces) > 1:
                    rows += [(k, a, c, e, unit_count(text[a:e]), *([text[a:e].rstrip()] if with_text else [])) for k, (a, c, e) in enumerate(pieces)]
                offsets.append(len(rows))
            columns = [pa.array(col, t) for col, t in zip(zip(*rows), fields.values())] if rows else [pa.array([], t) for t in fields.values()]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=list(fields)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), lists], names=[*kept, "pieces"])

    src = df.filter(F.length("text") > limit).select("item_kind", F.col("item_id").cast("bigint").alias("item_id"), F.col("para_pos").cast("int").alias("para_pos"), F.length("text").alias("chars"), F.xxhash64("text").alias("hash"), "text")
    return one_delivery(src.mapInArrow(run, schema), keys, "pieces")
