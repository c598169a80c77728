"""Queries of the llm problems, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, lookalike, mixing, names, residue, sentences, splitting
from inkwell.session import cut, small_side, table


def text_items(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """sections.text and chunks.text as (item_kind, item_id, text), with further columns if named."""
    of_sections = table(spark, sf_dir, "sections").select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), "text", *more)
    of_chunks = table(spark, sf_dir, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), "text", *more)
    return of_sections.unionByName(of_chunks)


def spoken_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text items with the language their book was last synced with."""
    books = table(spark, sf_dir, "source_books").filter("source_id is not null and language is not null").groupBy("source_id").agg(F.max_by("language", F.struct("updated_at", "language")).alias("language"))
    return text_items(spark, sf_dir, "source_id").join(small_side(books), "source_id", "left")


def split_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    paragraphs = table(spark, sf_dir, "sections").select(F.lit("paragraph").alias("item_kind"), F.col("section_id").alias("item_id"), F.posexplode("paragraphs").alias("para_pos", "text"))
    whole = text_items(spark, sf_dir).withColumn("para_pos", F.lit(-1))
    return paragraphs.unionByName(whole)


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(split_input(spark, sf_dir))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(split_input(spark, sf_dir), with_text=False).filter("piece_no = 0").select("item_kind", "item_id", "para_pos")


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and author with its consistent form."""
    source = table(spark, sf_dir, "source_books").select(F.lit("source_books").alias("tab"), F.lit("title").alias("fld"), F.col("book_id").alias("id"), F.col("title").alias("text"))
    published = table(spark, sf_dir, "published_books").select(F.lit("published_books").alias("tab"), F.inline(F.array(*(F.struct(F.lit(f).alias("fld"), F.col("catalog_id").alias("id"), F.col(f).alias("text")) for f in ("title", "author")))))
    return lookalike.consistent_forms(source.unionByName(published).dropDuplicates(["tab", "fld", "id", "text"]), ["tab", "fld", "id"], "text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking_pairs(p2_forms(spark, sf_dir), ["tab", "fld"], "id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(spoken_items(spark, sf_dir))


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(spoken_items(spark, sf_dir), with_text=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def linked_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_authors(table(spark, sf_dir, "source_books"))


def linked_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_characters(table(spark, sf_dir, "character_profiles"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each named record with the canonical form it is attached to."""
    authors = linked_authors(spark, sf_dir).select(F.lit("author").alias("kind"), "id", "spelling", "entity")
    characters = linked_characters(spark, sf_dir).select(F.lit("character").alias("kind"), "id", "spelling", F.concat_ws("|", "source_id", "entity").alias("entity"))
    return authors.unionByName(characters)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = names.spelling_pairs(linked_authors(spark, sf_dir)).select(F.lit("author").alias("kind"), "id_a", "id_b")
    characters = names.spelling_pairs(linked_characters(spark, sf_dir), ("source_id",)).select(F.lit("character").alias("kind"), "id_a", "id_b")
    return authors.unionByName(characters)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(documents(spark, sf_dir), "doc_id", "text")


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose decoded ids aren't their text; there are none."""
    source = documents(spark, sf_dir)
    ids = bpe.encode_column(source, "doc_id", "text", keep=("text",))
    same = ids.select("doc_id", F.coalesce("text", F.lit("")).alias("original"), "ids")
    decoded = bpe.decode_column(same.select(F.struct("doc_id", "original").alias("row"), "ids"), "row")
    return decoded.filter("text <> row.original").select("row.doc_id")


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and n_tokens; written once, as the mix reads it more than once."""
    return cut(bpe.encode_column(documents(spark, sf_dir), "doc_id", "text", counts_only=True, keep=("source",)))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(document_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, targets = document_tokens(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.report(mixing.mix(tokens, targets), tokens, targets)


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, characters and share of the residue in each document that holds some."""
    return residue.find_residue(documents(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_residue(spark, sf_dir).select("doc_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean corpus."""
    return residue.clean_corpus(documents(spark, sf_dir)).select("doc_id", "source", "lang", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_forms, p3_found, p3_sentences, p5_found, p5_entities, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_residue, p9_clean)}
# Units of a text as SQL: Han signs are set apart by spaces, as this dialect's classes can't be subtracted.
_HAN = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3134f}]"
_BLANK = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNITS = f"case when regexp_matches(t, '{_HAN}') then len(regexp_extract_all(regexp_replace(t, '({_HAN})', ' \\1 ', 'g'), '{_HAN}|[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*')) else len(list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda w: w <> '')) end"
ORACLES = {
    "p7_round_trip": "select doc_id from documents where false",
    "p1_found": f"with i as (select 'paragraph' as item_kind, section_id as item_id, unnest(range(len(paragraphs)))::int as para_pos, unnest(paragraphs) as t from sections union all select 'section', section_id, -1, text from sections union all select 'chunk', chunk_id, -1, text from chunks) select distinct item_kind, item_id, para_pos from i where {_UNITS} > 200",
}
