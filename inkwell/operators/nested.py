"""Nested JSON deliveries to related flat tables.

Two steps.  The JVM turns each JSON text, whatever shapes its optional parts
take, into one typed nested Arrow column that holds only what the flat table
needs: texts of the usual shape in one pass, others level by level.  Then the
nesting is taken apart on
Arrow buffers: list offsets give parent indices, child arrays come out whole,
and keys travel down by vectorised ``take``; no row is visited in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "allowUnquotedFieldNames": "false"}

#: The flat tables and their columns; every child carries the keys of its parents.
TABLES = {
    "sections": "data_id bigint, section_pos int, sequence int, section_type string, ordinal int, word_count int",
    "headings": "data_id bigint, section_pos int, display_label string, display_title string, spoken_text string",
    "chunks": "data_id bigint, section_pos int, chunk_pos int, text string",
    "words": "data_id bigint, section_pos int, chunk_pos int, word_pos int, word string, start_s double, end_s double",
}
_BAD = "__bad"
_WORD = "struct<word:string,start:double,end:double>"


def _json(col: Column, schema: str) -> Column:
    return F.from_json(col, schema, _STRICT)


def _head(raw: Column) -> Column:
    return F.substring(F.ltrim(raw, F.lit(" \t\r\n")), 1, 1)


def _let(value: Column, build) -> Column:
    """``build(value)`` with the value computed once, however often ``build`` names it."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def is_whole_json(text: Column) -> Column:
    """True for text that is exactly one JSON value; cut off or trailing text is not."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))


def _as_list(raw: Column) -> Column:
    """JSON text of a list, or of a lone object, to its elements' texts; anything else is null."""
    return F.when(_head(raw) == "[", _json(raw, "array<string>")).when(_head(raw) == "{", F.array(raw))


def _word(raw: Column) -> Column:
    """A word entry: an object, a list beginning with the word, or the word itself; times that aren't numbers are null."""
    entry = lambda w, s=None, e=None: F.struct(w.alias("word"), (F.lit(None) if s is None else s).try_cast("double").alias("start"), (F.lit(None) if e is None else e).try_cast("double").alias("end"))
    at = lambda items, i: F.get(items, F.lit(i))
    return (
        F.when(raw.isNull(), F.lit(None).cast(_WORD))
        .when((_head(raw) == "{") & is_whole_json(raw), _let(_json(raw, "word string, start string, end string"), lambda o: entry(o["word"], o["start"], o["end"])))
        .when((_head(raw) == "[") & is_whole_json(raw), _let(_json(raw, "array<string>"), lambda items: entry(at(items, 0), at(items, 1), at(items, 2))))
        .otherwise(entry(raw))
    )


def _words(raw: Column) -> Column:
    """Word entries of a list's text.  All objects of a list are parsed at once; where one of them is no whole object, each by itself."""

    def of(items: Column) -> Column:
        objects = F.transform(items, lambda x: F.when(_head(x) == "{", x).otherwise("null"))
        parsed = _json(F.concat(F.lit("["), F.array_join(objects, ",", "null"), F.lit("]")), "array<struct<word:string,start:string,end:string>>")

        def together(found: Column) -> Column:
            entry = lambda x, i: F.when(_head(x) == "{", _timed(F.get(found, i))).otherwise(_word(x))
            sound = (F.size(found) == F.size(items)) & ~F.exists(F.arrays_zip(items.alias("x"), found.alias("o")), lambda z: (_head(z["x"]) == "{") & z["o"].isNull())
            return F.when(sound, F.transform(items, entry)).otherwise(F.transform(items, _word))

        return F.when(items.isNotNull(), _let(F.coalesce(parsed, F.array().cast("array<struct<word:string,start:string,end:string>>")), together))

    return _let(_as_list(raw), of)


def _timed(o: Column) -> Column:
    return F.struct(o["word"].alias("word"), o["start"].try_cast("double").alias("start"), o["end"].try_cast("double").alias("end"))


def _object(raw: Column, schema: str, build) -> Column:
    """``build`` of the parsed object where the text is one, else null."""
    return F.when(_head(raw) == "{", _let(_json(raw, schema), build))


# What each flat table needs of a payload: of a section, of its heading, of its chunks.
_SECTION = ("sequence", "section_type", "ordinal", "word_count")
_NEEDS = {
    "sections": (_SECTION, (), ()),
    "headings": ((), ("display_label", "display_title", "spoken_text"), ()),
    "chunks": ((), (), ("text",)),
    "words": ((), ("words",), ("words",)),
}
_INT = ("sequence", "ordinal", "word_count")


def _usual(wanted: str) -> str:
    """The schema of a payload of the usual shape, every leaf as its text."""
    section, heading, chunk = (",".join(f"{f}:string" for f in part) for part in _NEEDS[wanted])
    parts = [section] * bool(section) + [f"heading:struct<{heading}>"] * bool(heading) + [f"chunks:array<struct<{chunk}>>"] * bool(chunk)
    return f"sections array<struct<{','.join(parts)}>>, {_BAD} string"


def _leaves(o: Column, names: tuple[str, ...]) -> Column:
    """A parsed object's wanted members, null where the object is."""
    cast = lambda n: _words(o[n]) if n == "words" else o[n].try_cast("int") if n in _INT else o[n]
    return F.when(o.isNotNull(), F.struct(*(cast(n).alias(n) for n in names)))


def _by_levels(raw: Column, wanted: str) -> Column:
    """A section's wanted members from its text, each level by itself."""
    section, heading, chunk = _NEEDS[wanted]
    schema = lambda names: ", ".join(f"{n} string" for n in names)

    def build(o: Column) -> Column:
        parts = [c for n in section for c in (_leaves(o, (n,))[n].alias(n),)]
        if heading:
            parts.append(_object(o["heading"], schema(heading), lambda h: _leaves(h, heading)).alias("heading"))
        if chunk:
            parts.append(F.transform(_as_list(o["chunks"]), lambda c: _object(c, schema(chunk), lambda x: _leaves(x, chunk))).alias("chunks"))
        return F.struct(*parts)

    return _object(raw, schema((*section, *["heading"] * bool(heading), *["chunks"] * bool(chunk))), build)


def _in_one(s: Column, wanted: str) -> Column:
    section, heading, chunk = _NEEDS[wanted]
    parts = [_leaves(s, (n,))[n].alias(n) for n in section]
    if heading:
        parts.append(_leaves(s["heading"], heading).alias("heading"))
    if chunk:
        parts.append(F.transform(s["chunks"], lambda c: _leaves(c, chunk)).alias("chunks"))
    return F.when(s.isNotNull(), F.struct(*parts))


def typed_sections(payload: Column, whole: Column, wanted: str = "words") -> Column:
    """A payload's sections as one typed nested column of what is wanted; null where it isn't ``whole`` JSON or has none."""
    at_once = F.from_json(payload, _usual(wanted), _STRICT | {"columnNameOfCorruptRecord": _BAD})
    opened = F.when(_head(payload) == '"', F.get(_json(F.concat(F.lit("["), payload, F.lit("]")), "array<string>"), F.lit(0))).otherwise(payload)
    sections = _let(opened, lambda text: _object(text, "sections string", lambda o: _as_list(o["sections"])))
    levels = F.transform(sections, lambda raw: _by_levels(raw, wanted))
    usual = lambda j: F.when((_head(payload) == "{") & j[_BAD].isNull(), F.transform(j["sections"], lambda s: _in_one(s, wanted))).otherwise(levels)
    return F.when(whole, _let(at_once, usual))


def latest_deliveries(df: DataFrame) -> DataFrame:
    """``data_id, payload, whole``: of an id's deliveries the last one that is whole JSON, else the last.

    Equal times are decided by the payload's hash, so the choice never depends
    on row order.  ``max_by`` combines on the map side: a data_id delivered a
    million times still reaches the shuffle as one row per map task.
    """
    rows = df.filter("data_id is not null").select("data_id", "payload", "received_at", is_whole_json(F.col("payload")).alias("whole"))
    rank = F.struct("whole", "received_at", F.xxhash64("payload"))
    return rows.groupBy("data_id").agg(F.max_by(F.struct("payload", "whole"), rank).alias("last")).select("data_id", "last.*")


def _explode(lists: pa.Array, keys: dict[str, pa.Array]) -> tuple[pa.Array, dict[str, pa.Array], pa.Array]:
    """Children of a list column: the flat values, their parents' keys, their places in their lists."""
    parents = pc.list_parent_indices(lists)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    places = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(starts, lengths)
    return pc.list_flatten(lists), {k: pc.take(v, parents) for k, v in keys.items()}, pa.array(places.astype(np.int32))


def _present(values: pa.Array, keys: dict[str, pa.Array]) -> tuple[pa.Array, dict[str, pa.Array]]:
    at = pc.indices_nonzero(pc.is_valid(values))
    return pc.take(values, at), {k: pc.take(v, at) for k, v in keys.items()}


def _flat(batch: pa.RecordBatch, wanted: str) -> Iterator[pa.RecordBatch]:
    sections, keys, place = _explode(batch.column("sections"), {"data_id": batch.column("data_id")})
    sections, keys = _present(sections, keys | {"section_pos": place})
    if wanted == "sections":
        yield pa.RecordBatch.from_pydict(keys | {f: pc.struct_field(sections, f) for f in ("sequence", "section_type", "ordinal", "word_count")})
        return
    if wanted in ("headings", "words"):
        heads, head_keys = _present(pc.struct_field(sections, "heading"), keys)
        if wanted == "headings":
            yield pa.RecordBatch.from_pydict(head_keys | {f: pc.struct_field(heads, f) for f in ("display_label", "display_title", "spoken_text")})
            return
        no_chunk = pa.array(np.full(len(heads), -1, np.int32))
        yield from _word_rows(heads, head_keys | {"chunk_pos": no_chunk})
    chunks, chunk_keys, place = _explode(pc.struct_field(sections, "chunks"), keys)
    chunks, chunk_keys = _present(chunks, chunk_keys | {"chunk_pos": place})
    if wanted == "chunks":
        yield pa.RecordBatch.from_pydict(chunk_keys | {"text": pc.struct_field(chunks, "text")})
    else:
        yield from _word_rows(chunks, chunk_keys)


def _word_rows(parents: pa.Array, keys: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    words, keys, place = _explode(pc.struct_field(parents, "words"), keys)
    keys = keys | {"word_pos": place, "word": pc.struct_field(words, "word"), "start_s": pc.struct_field(words, "start"), "end_s": pc.struct_field(words, "end")}
    named = pc.fill_null(pc.not_equal(pc.utf8_length(pc.utf8_trim_whitespace(keys["word"])), 0), False)
    yield pa.RecordBatch.from_pydict(keys).filter(named)


def flatten(df: DataFrame, wanted: str) -> DataFrame:
    """One flat table (see ``TABLES``) of deliveries ``(data_id, received_at, payload)``.

    Places count from 0 in the payload's own lists, null and blank entries
    included, so every child names its parent by key.  A lone object stands
    for a list of one, a string holding JSON for its value; a word entry may be
    an object, a list beginning with the word, or the word itself.  ``words``
    keeps entries whose word isn't null or blank; headings have chunk_pos -1.

    Defined cases: null, broken or cut off payloads, sections that aren't
    objects and unknown members give nothing; a data_id delivered more than
    once counts once; a null data_id has no key and is left out; an empty table
    gives an empty table; further columns are ignored.
    """
    typed = latest_deliveries(df).select("data_id", typed_sections(F.col("payload"), F.col("whole"), wanted).alias("sections")).filter("sections is not null")
    schema = StructType.fromDDL(TABLES[wanted])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in _flat(batch, wanted):
                yield out.select(names)

    return typed.mapInArrow(run, schema)
