"""Plans of tables kept by key: upserts and what is still to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import identity as I
from inkwell.operators import upserts as U
from inkwell.session import table

FIELDS = ["title", "author", "language", "provenance", "epub_sha256", "updated_at"]


def _sync(s, d, pick):
    b = table(s, d, "source_books").filter("book_id is not null")
    return b.groupBy("book_id").agg(pick(F.struct(*FIELDS), F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("r")).select("book_id", "r.*")


def source_upserted(s, d):
    """The first sync of each edition with the last laid over it; language and provenance frozen once cached."""
    return U.upsert(_sync(s, d, F.min_by), _sync(s, d, F.max_by), ["book_id"], ["language", "provenance"], F.col("epub_sha256").isNotNull())


def source_slugs(s, d):
    """Slugs that tell editions of one title apart, for every title."""
    b = _sync(s, d, F.max_by).select("book_id", "title").join(table(s, d, "source_books").select("book_id", "source_id").distinct(), "book_id")
    return b.filter("title is not null").select("book_id", I.title_slug(F.col("title"), F.col("source_id")).alias("slug"))


def chunk_pending(s, d):
    """Chunks whose words aren't there yet: what an aligner would still have to do."""
    c = table(s, d, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "source_id", "sequence", "chunk_index")
    done = table(s, d, "word_times").filter("word is not null").select("source_id", "sequence", "chunk_index")
    return U.pending(c, done, ["source_id", "sequence"], "chunk_index").select("chunk_id")


QUERIES = {f.__name__: f for f in (source_upserted, source_slugs, chunk_pending)}
_FL = "f as (select * from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at, coalesce(title,'')) = 1), l as (select * from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at desc, coalesce(title,'') desc) = 1)"
ORACLES = {
    "source_upserted": f"with {_FL} select f.book_id, l.title, l.author, case when f.epub_sha256 is not null then f.language else l.language end as language, case when f.epub_sha256 is not null then f.provenance else l.provenance end as provenance, l.epub_sha256, l.updated_at from f join l using (book_id)",
    "source_slugs": f"with {_FL}, i as (select distinct book_id, source_id from source_books), t as (select l.book_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', ''), ''), 'untitled') as n, i.source_id from l join i using (book_id) where title is not null) select book_id, case when starts_with(source_id, 'gutenberg:') then n || '-g' || split_part(source_id, ':', 2) when regexp_full_match(source_id, 'owner(?:upload)?:[a-f0-9-]{{32,36}}') then n || '-upload-' || replace(split_part(source_id, ':', 2), '-', '') when starts_with(source_id, 'wikisource:') then n || '-ws-' || left(sha256(source_id), 12) else n || '-se-' || left(sha256(source_id), 12) end as slug from t",
    "chunk_pending": "with c as (select * from chunks where chunk_id is not null qualify row_number() over (partition by chunk_id order by chunk_id) = 1) select chunk_id from c where not exists (select 1 from word_times w where w.word is not null and w.source_id = c.source_id and w.sequence = c.sequence and w.chunk_index = c.chunk_index)",
}
