"""Encoding with a public byte-level BPE vocabulary by a lazily determinised transducer.

The merges define, for every byte string, one token sequence.  A sequence is
that one exactly if each pair of neighbours is the encoding of its own
concatenation, so the last token of every prefix is known from left to right.
The transducer's state is the last token already emitted and the bytes whose
tokens still depend on what follows.  A token is emitted as soon as every way
the pending bytes can go on begins with it, which is after at most the longest
token's length.  States and transitions are made when first met and kept.
"""

from __future__ import annotations

import base64
import codecs
import functools
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a worker keeps between texts, in entries.  Beyond it the tables are dropped and
#: made anew: memory stays bounded, results are the same.
KEPT = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class State:
    """Pending bytes after an emitted token; ``last[i]`` is the last token of ``tail[: i + 1]``.

    It is None where that beginning is encoded otherwise than through the
    emitted token: such a place is dead, no later token begins there.
    """

    __slots__ = ("base", "tail", "last", "go")

    def __init__(self, base: bytes | None, tail: bytes, last: tuple[bytes | None, ...]):
        self.base, self.tail, self.last = base, tail, last
        self.go: dict[int, tuple[State, bytes]] = {}


class Transducer:
    """Pieces of text (no rule of the pre-tokenizer inside) to packed little-endian int32 ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.beginnings = {token[:n] for token in ranks for n in range(1, len(token))}
        self.packed = {token: struct.pack("<i", rank) for token, rank in ranks.items()}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[bytes | None, bytes], State] = {}
        self.start = self._state(None, b"")

    def merged(self, piece: bytes) -> list[bytes]:
        """The definition: merge the lowest-ranked pair, leftmost first, until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 31))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        pair = (left, right)
        known = self._fits.get(pair)
        if known is None:
            if len(self._fits) >= KEPT:
                self._fits.clear()
            known = self._fits[pair] = self.merged(left + right) == [left, right]
        return known

    def _state(self, base: bytes | None, tail: bytes) -> State:
        state = self.states.get((base, tail))
        if state is None:
            last: list[bytes | None] = []
            for end in range(1, len(tail) + 1):
                last.append(self._last(base, tail[:end], last))
            state = self.states[base, tail] = State(base, tail, tuple(last))
        return state

    def _last(self, base: bytes | None, tail: bytes, last: list[bytes | None]) -> bytes | None:
        """The last token of the whole of ``tail``, given those of its beginnings."""
        for begin in range(max(0, len(tail) - self.longest), len(tail)):
            token, before = tail[begin:], last[begin - 1] if begin else base
            if token not in self.ranks or begin and before is None:
                continue
            if self.fits(before, token) if before is not None else self.merged(token) == [token]:
                return token
        return None

    def _chain(self, state: State, end: int) -> list[bytes]:
        tokens = []
        while end:
            tokens.append(state.last[end - 1])
            end -= len(tokens[-1])
        return tokens[::-1]

    def _step(self, state: State, byte: int) -> tuple[State, bytes]:
        if len(self.states) >= KEPT:
            self._reset()
        reached, out = self._state(state.base, state.tail + bytes((byte,))), b""
        while reached.tail:
            size = len(reached.tail)
            open_at = [p for p in range(max(0, size - self.longest), size + 1) if p == size or reached.tail[p:] in self.beginnings and (not p or reached.last[p - 1])]
            firsts = {tuple(self._chain(reached, p)[:1]) for p in open_at}
            if len(firsts) != 1 or not next(iter(firsts)):
                break
            (token,) = next(iter(firsts))
            out += self.packed[token]
            reached = self._state(token, reached.tail[len(token) :])
        state.go[byte] = reached, out
        return reached, out

    def encode(self, piece: bytes) -> bytes:
        state, out = self.start, []
        for byte in piece:
            found = state.go.get(byte)
            state, emitted = found if found is not None else self._step(state, byte)
            if emitted:
                out.append(emitted)
        out += [self.packed[token] for token in self._chain(state, len(state.tail))]
        return b"".join(out)


class Pieces(dict):
    """Encodings of the pieces met so far; a miss runs the transducer."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        packed = self[piece] = self.transducer.encode(piece.encode("utf-8"))
        return packed


class Codec:
    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.transducer = Transducer(self.ranks)
        self.pieces = Pieces(self.transducer)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.tokens = {rank: token for token, rank in self.ranks.items()}

    def packed(self, text: str) -> bytes:
        """The ids of a text, four bytes each; special tokens' strings are ordinary text."""
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text or ""), "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes certain: bytes go through an incremental UTF-8 machine."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := machine.decode(self.tokens[i]):
                yield text
        if text := machine.decode(b"", final=True):
            yield text


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary."""
    return Codec(path)


def _encoded(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    packed = codec(path).packed
    parts = [packed(text) if text else b"" for text in texts.to_pylist()]
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=ends[1:])
    return ends, np.frombuffer(b"".join(parts), "<i4")


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str | None = None, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep`` and ``ids`` (or ``n_tokens``) of each row's text; a narrow step, no shuffle.

    Defined cases: null and empty texts give an empty list (0 tokens); blanks,
    control characters and special tokens' strings are ordinary text; a very
    long text is encoded whole; repeated rows give repeated rows; a null key is
    kept; no rows give no rows; other columns are dropped.  ``vocabulary`` is a
    path every executor can read.
    """
    path = vocabulary or default_vocabulary()
    names = [key, *keep]
    result = "n_tokens" if counts_only else "ids"
    src = df.select(*names, F.col(text).alias("__text"))
    schema = StructType([*src.select(*names).schema.fields, *StructType.fromDDL(f"{result} {'int' if counts_only else 'array<int>'}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, ids = _encoded(batch.column("__text"), path)
            value = pa.array(np.diff(ends)) if counts_only else pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), value], names=[*names, result])

    return src.mapInArrow(run, schema)


def decode_column(df: DataFrame, key: str, ids: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``key`` and the ``text`` of each row's ids; a null list gives the empty text."""
    path = vocabulary or default_vocabulary()
    src = df.select(key, F.col(ids).alias("__ids"))
    schema = StructType([src.schema[0], *StructType.fromDDL("text string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = ["".join(decode(row or ())) for row in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(texts, pa.string())], names=[key, "text"])

    return src.mapInArrow(run, schema)
