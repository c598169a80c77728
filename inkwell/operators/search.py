"""Staged, typo-tolerant search over an inverted token index."""

from __future__ import annotations

import re
import unicodedata
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import search as S
from inkwell.session import shared_folder


# The ranges of ideographs a query is told Chinese by.
HAN = (("⺀", "⻿"), ("⼀", "⿕"), ("々", "々"), ("〇", "〇"), ("〡", "〩"), ("㐀", "䶿"), ("一", "鿿"), ("豈", "﫿"), ("\U00020000", "\U0003134f"))


def token_index(books: DataFrame) -> DataFrame:
    """``token, source_id``: at most 32 tokens an edition, each once."""
    return books.select("source_id", F.explode(S.index_tokens(F.col("title"), F.col("author"))).alias("token")).filter("source_id is not null").distinct()


def written_index(index: DataFrame, path: str | None = None) -> DataFrame:
    """The index as a table in order of its tokens, so that a search reads the row groups its beginnings fall into.

    Written to ``path``, else to a new folder of the shared one; tokens are
    spread over files by range, and a token that many editions share over several.
    """
    spark = index.sparkSession
    path = path or f"{shared_folder(spark, 'inkwell-index-').rstrip('/')}/index-{uuid.uuid4().hex}"
    index.repartitionByRange("token", "source_id").sortWithinPartitions("token", "source_id").write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


def read_query(query: str) -> tuple[str, str]:
    """A query's canonical form, and the longest of its words, the first of equals; as ``functions.search.canonical``."""
    han = re.compile("[" + "".join(f"{a}-{b}" for a, b in HAN) + "]")
    low = (query.translate(str.maketrans(S.TRADITIONAL, S.SIMPLIFIED)) if han.search(query) else query).lower()
    wide = low if low.isascii() else "".join(c for c in unicodedata.normalize("NFKD", low) if not "\u0300" <= c <= "\u036f")
    whole = " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in wide).split())
    return whole, max(whole.split(), key=len, default="")


def _probes(term: str) -> list[tuple[int, str, bool]]:
    """Stage, text and whether it is a beginning, of all that the index is asked for."""
    chinese = any(a <= c <= b for c in term for a, b in HAN)
    swapped = [term[:i] + term[i + 1] + term[i] + term[i + 2 :] for i in range(len(term) - 1)] if not chinese and 3 <= len(term) <= 12 else []
    out = [(1, term, True)] + [(2, v, False) for v in dict.fromkeys(swapped)]
    return out + [(3, term[:2], True)] * (len(term) >= (2 if chinese else 3))


def search(books: DataFrame, index: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Editions for a query, best first: score, title, author, source_id.

    Candidates come in stages: tokens that begin with the longest query word;
    if there are none, tokens with two of its letters changed over; if none,
    tokens that begin with its first two letters.  All stages are one plan: a
    candidate carries its stage and the lowest stage present wins, so nothing
    is collected.  Scores: exact title 0, title prefix 1, author prefix 2, word
    prefix 3 (with Han, containment), one more Han sign 4, else 4 plus the edit
    distance to the nearest word up to 2.  Equal scores go by title, then id;
    candidates aren't cut off.

    Defined cases: a query whose longest word is under two signs finds nothing;
    null titles and authors count as empty; repeated editions count once.
    """
    whole, term = read_query(query)
    probes = _probes(term) if len(term) >= 2 else []
    stage = F.lit(None).cast("int")
    wanted = F.lit(False)
    for number, text, begins in reversed(probes):
        fits = F.startswith("token", F.lit(text)) if begins else F.col("token") == text
        stage, wanted = F.when(fits, number).otherwise(stage), fits | wanted
    # literals only, so that the beginnings reach the scan of a written index
    hit = index.filter(wanted).select("source_id", F.lit(whole).alias("query"), F.lit(term).alias("term"), stage.alias("stage"))
    found = hit.groupBy("source_id", "query", "term").agg(F.min("stage").alias("stage"))
    lowest = found.agg(F.min("stage").alias("lowest"))
    found = found.join(F.broadcast(lowest), F.col("stage") == F.col("lowest")).drop("lowest")
    named = books.select("source_id", "title", "author").filter("source_id is not null").dropDuplicates(["source_id"])
    rows = found.join(named, "source_id").withColumn("t", S.canonical(F.coalesce("title", F.lit("")))).withColumn("a", S.canonical(F.coalesce("author", F.lit(""))))
    words = F.filter(F.concat(F.split("t", " "), F.split("a", " ")), lambda w: w != "")
    best = F.coalesce(F.array_min(F.transform(words, lambda w: F.levenshtein(F.col("term"), w))), F.lit(99))
    han = F.col("query").rlike("\\p{IsHan}")
    wider = han & F.col("query").rlike("^\\p{IsHan}{4,}$") & F.col("t").rlike("^\\p{IsHan}+$") & (F.length("t") == F.length("query") + 1) & (F.levenshtein("query", "t") == 1)
    score = (
        F.when(F.col("t") == F.col("query"), 0)
        .when(F.startswith("t", F.col("query")), 1)
        .when(F.startswith("a", F.col("query")), 2)
        .when(F.when(han, F.contains("t", F.col("query")) | F.contains("a", F.col("query"))).otherwise(F.exists(words, lambda w: F.startswith(w, F.col("term")))), 3)
        .when(wider, 4)
        .when(~han & (best <= 2), 4 + best)
    )
    return rows.withColumn("score", score).filter("score is not null").select("score", "title", "author", "source_id").orderBy("score", "title", "source_id").limit(limit)
