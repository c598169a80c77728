"""Template residue, filler and error notices, found by character n-gram likelihood ratios."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import residue_lines

BUCKETS = 1 << 18
#: One bucket more for every place inside a blank, whatever field it names.
BLANK, SIZE = BUCKETS, BUCKETS + 1
#: Characters of a likelihood-ratio window, the mean ratio it must reach, and the
#: part of a sentence that such windows must cover.
WINDOW, RATIO, COVERAGE = 12, 0.5, 0.5
#: What the ratios of a whole sentence must sum to, so that no scrap is taken for residue.
EVIDENCE = 14.0
#: What the ratios of a run of windows must sum to where the sentence around it is prose: three a place over a window.
RUN_EVIDENCE = 3.0 * WINDOW
KINDS = ("template", "filler", "notice")
#: Weight of the labelled lines in a residue model; the rest is the natural model it backs off to.
LABELLED = 0.8
#: Weight of the labelled prose in the natural model; the rest is the corpus.
NEAR = 0.1
#: The same where there is no corpus yet, in place of which any four-gram is as likely.
ALONE = 0.3
#: Bytes of text read at once; a single longer text is read whole.
AT_ONCE = 4_000_000

# What a code point is: bits for white space, line ends, sentence ends, the ends that need
# no space after them, closing marks, and the brackets that set a note or a blank apart.
_SPACE, _LINE, _END, _WIDE, _CLOSE, _OPEN, _SHUT = 1, 2, 4, 8, 16, 32, 64

# The first of the code points whose signs stand for syllables or words: kana, ideographs, hangul.
_SIGNS = np.uint64(0x3040)

# Blanks of template languages, read in small letters: marks that prose doesn't have on both sides of a word.
_BLANKS = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^{}\n]+%\}|<%[^<>\n]+%>|[$#]\{[^{}\n]+\}|\$\(\w+\)|%\([\w.]+\)[sd]\b|%%\w(?:[^%\n]*\w)?%%|@@\w(?:[^@\n]*\w)?@@"
    r"|\{\$[\w.]+\}|\{[a-z]\w*[_.]\w[\w.]*\}|(?:[«‹]|&lt;)[a-z]\w*[_.]\w[\w.]*(?:[»›]|&gt;)|\[\[ ?[a-z]\w*[_.]\w+ ?\]\]|%[a-z][a-z_]{2,}%|(?<!\w)__[a-z]\w*?__(?!\w)|<!--[^\n]*?-->"
)
_BLANK_SIGNS = ("{{", "{%", "<%", "${", "#{", "$(", "%(", "%%", "@@", "{", "[[", "«", "‹", "&lt;", "%", "__", "<!--")


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for bit, signs in (
        (_SPACE, "\t\n\v\f\r \u0085\u00a0\u2003\u2007\u2009\u2028\u2029\u202f\u205f\u3000"),
        (_LINE, "\n\v\r\u0085\u2028\u2029"),
        (_END, ".!?…。！？।॥"),
        (_WIDE, "。！？।॥"),
        (_CLOSE, "\"'”’»」』)）]】"),
        (_OPEN, "[【<"),
        (_SHUT, "]】>"),
    ):
        table[[ord(c) for c in signs]] |= bit
    return table


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Small letters' code points of all texts, digits as 0, a line end after each; the length of each; and where blanks begin and end."""
    low = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    ends = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, 8 * low.offset)
    raw = memoryview(low.buffers()[2] or b"")[int(ends[0]) : int(ends[-1])]
    whole = str(raw, "utf-8", "replace")
    codes = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32).copy()
    codes[(codes >= 48) & (codes <= 57)] = 48
    blanks = [m.span() for m in _BLANKS.finditer(whole)] if any(sign in whole for sign in _BLANK_SIGNS) else []
    return codes, pc.utf8_length(low).to_numpy(zero_copy_only=False), blanks


def _before(values: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(values)
    out[by:] = values[:-by] if by else values
    return out


def grams(texts: pa.Array, apart: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed four-grams around each place within its sentence or line, the sentence's number and the text's.

    A blank of a template language stands as a sentence of its own, all its places in one bucket; without ``apart``, it is read as any text.
    """
    codes, lengths, blanks = _codes(texts)
    if len(codes) < 4:
        return (np.empty(0, np.int64),) * 3
    owners = np.repeat(np.arange(len(lengths)), lengths)
    kind = _classes()[codes]
    one, two = _before(kind, 1), _before(kind, 2)
    ended = (one & _END | one & _CLOSE & ((two & _END) << 2)) > 0
    cut = (kind & _LINE) > 0
    cut |= (kind & _SPACE > 0) & (ended | (one & _SHUT > 0))
    cut |= (kind & _OPEN > 0) & (one & _SPACE > 0)
    cut |= (one & _WIDE > 0) & (kind & (_CLOSE | _WIDE) == 0) | (one & _CLOSE > 0) & (two & _WIDE > 0) & (kind & _CLOSE == 0)
    blank = np.zeros(len(codes), bool)
    for a, b in blanks if apart else []:
        blank[a:b] = cut[a] = cut[b] = True
        cut[a + 1 : b] = False
    segments = np.cumsum(cut, dtype=np.int32)
    text = (kind & _LINE) == 0
    codes, owners, segments, blank = codes[text], owners[text], segments[text], blank[text]
    if len(codes) < 4:
        return (np.empty(0, np.int64),) * 3
    new = np.empty(len(codes), bool)
    new[0], new[1:] = True, segments[1:] != segments[:-1]
    ten = np.uint64(10)
    wide = codes.astype(np.uint64)
    back = np.empty_like(wide)
    back[0], back[1:] = ten, wide[:-1]
    back[new] = ten
    back2 = np.empty_like(wide)
    back2[0], back2[1:] = ten, back[:-1]
    back2[new] = ten
    ahead = np.empty_like(wide)
    ahead[-1], ahead[:-1] = ten, wide[1:]
    ahead[:-1][new[1:]] = ten
    sign = wide >= _SIGNS  # two signs are a word where letters take four
    back2[sign] = 0
    ahead[sign] = 0
    h = (back2 << np.uint64(42)) ^ (back << np.uint64(28)) ^ (wide << np.uint64(14)) ^ ahead
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.where(blank, BLANK, (h >> np.uint64(46)).astype(np.int32)).astype(np.int32), segments, owners


def _in_parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``AT_ONCE`` bytes of text, so that memory doesn't follow the batch."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(size) - size) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _line_counts(lines: list[str], apart: bool = True) -> np.ndarray:
    """Counts of labelled lines; of a line with blanks only these, as what stands around them could be prose."""
    hashed, _, owners = grams(pa.array(lines), apart)
    blank = hashed == BLANK
    return np.bincount(hashed[blank | ~np.isin(owners, owners[blank])], minlength=SIZE).astype(np.float64)


def natural_counts(hashed: np.ndarray, segments: np.ndarray, without: np.ndarray) -> np.ndarray:
    """Counts of four-grams outside what is residue by the ratios ``without``."""
    starts, lengths, _ = _found(hashed, segments, without)
    inside = np.zeros(len(hashed) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + lengths, -1)
    return np.bincount(hashed[np.cumsum(inside[:-1]) == 0], minlength=SIZE)


def count_grams(df: DataFrame, text: str = "text", without: np.ndarray | None = None) -> DataFrame:
    """``bucket``, ``n`` over all texts: counted per task, then summed; never more than SIZE rows.

    Sentences that are residue by the ratios ``without`` aren't counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE, np.int64)
        for part in (p for batch in batches for p in _in_parts(batch, 0)):
            hashed, segments, _ = grams(part.column(0))
            total += np.bincount(hashed, minlength=SIZE) if without is None or not len(hashed) else natural_counts(hashed, segments, without)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def _ratios(corpus: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios of the labelled lines against ``corpus`` mixed with the labelled prose.

    A residue model is its labelled lines' counts over the natural model it
    backs off to: a four-gram that no labelled line has says little, so wordings
    apart from the labelled ones are found by what they share with them.
    """
    labelled = residue_lines.labelled()
    prose = _line_counts(labelled["prose"])
    near, rest = (NEAR, corpus / corpus.sum()) if corpus.any() else (ALONE, 1 / BUCKETS)
    natural = (1 - near) * rest + near * prose / prose.sum() + 0.5 / BUCKETS
    out = []
    for kind in KINDS:
        counts, spelled = (np.minimum(c, 3 + np.log1p(c)) for c in (_line_counts(labelled[kind]), _line_counts(labelled[kind], False)))
        # blanks hold the mass of the four-grams that they stand for
        counts[BLANK] = max(counts[BLANK], spelled.sum() - counts.sum())
        out.append(np.log(LABELLED * counts / counts.sum() + (1 - LABELLED) * natural) - np.log(natural))
    return np.clip(np.array(out), -6, 6).astype(np.float32)


def fit(df: DataFrame, text: str = "text") -> np.ndarray:
    """Log-likelihood ratios, one row a kind: labelled lines against natural prose.

    Natural prose is what all documents together look like (counts over the
    whole corpus, at most SIZE numbers) mixed with the labelled prose lines.
    Sentences that are residue against the labelled prose alone aren't counted:
    a notice doesn't become natural by having many copies, alike or nearly so.
    Only shares enter, so the ratios don't depend on the size of the corpus.
    """
    counted: pd.DataFrame = count_grams(df, text, _ratios(np.zeros(SIZE))).toPandas()
    corpus = np.zeros(SIZE)
    corpus[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return _ratios(corpus)


def _window_means(values: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Mean of the window around each place, the window cut at its sentence's ends."""
    n = len(values)
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]])
    lengths = np.diff(np.r_[starts, n])
    first, last = np.repeat(starts, lengths), np.repeat(starts + lengths, lengths)
    at = np.arange(n)
    low = np.maximum(first, np.minimum(at - WINDOW // 2, last - WINDOW))
    high = np.minimum(last, np.maximum(at + WINDOW // 2, first + WINDOW))
    return (sums[high] - sums[low]) / (high - low)


def _found(hashed: np.ndarray, segments: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sentences, and runs of windows in other sentences, that are residue: their first place, length and kind.

    A sentence is residue as a whole by its windows' means and coverage; in any
    other sentence a run of consecutive windows is, by its own ratios' sum.  The
    sum of positive greatest ratios bounds a run's; times the most that windows
    cut at the ends can weigh one place, it bounds the windows' means; so do the
    windows of the greatest ratios themselves.  Only sentences that pass with
    both bounds are read for each kind.
    """
    starts = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]])
    lengths = np.diff(np.r_[starts, len(segments)])
    least = np.maximum(EVIDENCE, RATIO * lengths)
    bound = ratios.max(axis=0)[hashed]
    positive = np.add.reduceat(np.maximum(bound, 0), starts, dtype=np.float64)
    weight = np.clip(lengths, WINDOW, 2 * WINDOW - 1) / WINDOW
    maybe = (positive * weight > least * 0.999) | (positive > RUN_EVIDENCE * 0.999)
    if not maybe.any():
        return (np.empty(0, np.int64),) * 3
    at = np.repeat(maybe, lengths)
    hashed, segments, lengths, least, bound = hashed[at], segments[at], lengths[maybe], least[maybe], bound[at]
    firsts, starts = starts[maybe], np.cumsum(lengths) - lengths
    # the same rules by the greatest ratios' own windows, which no kind's exceed
    top = _window_means(bound, segments)
    passing = top > RATIO * 0.999
    whole = (np.add.reduceat(passing.astype(np.int64), starts) >= COVERAGE * lengths) & (np.add.reduceat(top, starts) > least * 0.999)
    maybe = whole | (np.add.reduceat(np.where(passing, np.maximum(bound, 0), 0), starts, dtype=np.float64) > RUN_EVIDENCE * 0.999)
    if not maybe.any():
        return (np.empty(0, np.int64),) * 3
    at = np.repeat(maybe, lengths)
    hashed, segments, lengths, least, firsts = hashed[at], segments[at], lengths[maybe], least[maybe], firsts[maybe]
    starts = np.cumsum(lengths) - lengths
    values = ratios[:, hashed]
    means = np.array([_window_means(v, segments) for v in values])
    passing = means.max(axis=0) > RATIO
    covered = np.add.reduceat(passing.astype(np.int64), starts)
    best = np.array([np.add.reduceat(m, starts) for m in means])
    found = (covered >= COVERAGE * lengths) & (best.max(axis=0) > least)
    loose = passing & ~np.repeat(found, lengths)
    begins = np.flatnonzero(loose & ~(np.r_[False, loose[:-1]] & np.r_[False, segments[1:] == segments[:-1]]))
    ends = np.flatnonzero(loose & ~(np.r_[loose[1:], False] & np.r_[segments[1:] == segments[:-1], False])) + 1
    sums = np.concatenate([np.zeros((len(KINDS), 1)), np.cumsum(values, axis=1, dtype=np.float64)], axis=1)
    runs = sums[:, ends] - sums[:, begins]
    strong = runs.max(axis=0) > RUN_EVIDENCE
    place = np.repeat(firsts - starts, lengths) + np.arange(len(hashed))
    return (
        np.concatenate([firsts[found], place[begins[strong]]]),
        np.concatenate([lengths[found], (ends - begins)[strong]]),
        np.concatenate([best.argmax(axis=0)[found], runs.argmax(axis=0)[strong]]),
    )


def score(texts: pa.Array, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sentences and runs that are residue: their text's number, kind and length."""
    hashed, segments, owners = grams(texts)
    if not len(hashed):
        return (np.empty(0, np.int64),) * 3
    starts, lengths, kinds = _found(hashed, segments, ratios)
    return owners[starts], kinds, lengths


def find_residue(df: DataFrame, key: str = "doc_id", text: str = "text", ratios: np.ndarray | None = None) -> DataFrame:
    """One row per document that holds residue: key, residue_chars, residue_kind, residue_share.

    Each sentence or line is read through windows of likelihood ratios of the
    three residue models against natural prose; it is residue where such
    windows cover it, or in part, where a run of them is strong by itself.
    A document is found if any of its sentences is, wholly or in part.

    Defined cases: null, empty and blank texts hold none; a document that is
    residue only has share 1; of several kinds the one with most characters is
    named, of equals the first of ``KINDS``; repeated rows give repeated rows;
    very long texts are read whole; no rows give no rows.
    """
    ratios = fit(df, text) if ratios is None else ratios
    schema = f"{key} {dict(df.dtypes)[key]}, residue_kind string, residue_chars int, residue_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for whole in batches for p in _in_parts(whole, 1)):
            texts = batch.column(1)
            owners, kinds, lengths = score(texts, ratios)
            table = np.zeros((len(texts), len(KINDS)), np.int64)
            np.add.at(table, (owners, kinds), lengths)
            at = np.flatnonzero(table.sum(axis=1))
            visible = np.array([sum(map(len, t.splitlines())) for t in texts.take(pa.array(at)).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array([KINDS[k] for k in table[at].argmax(axis=1)], pa.string()), pa.array(table[at].sum(axis=1).astype(np.int32)), pa.array(np.minimum(1.0, table[at].sum(axis=1) / np.maximum(visible, 1)))],
                names=[key, "residue_kind", "residue_chars", "residue_share"],
            )

    return df.select(key, text).mapInArrow(run, schema)


def clean_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ratios: np.ndarray | None = None, most: float = 0.0) -> DataFrame:
    """The rows of ``df`` whose documents residue covers by no more than ``most``, none by default; rows with a null key are kept."""
    return df.join(find_residue(df, key, text, ratios).filter(F.col("residue_share") > most).select(key).distinct(), key, "left_anti")
