"""Sinks: section data, manifests and commits whose marker comes last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RETAIN = 2


def section_data(sections: DataFrame, chunks: DataFrame, words: DataFrame) -> DataFrame:
    """One JSON payload per (source_id, rendition, build): sections with heading, chunks and their words, in order.

    Chunks without words get an empty list.  Payloads are built from per-section
    aggregates, so a task holds one section's words at a time until the join.
    """
    keys = ["source_id", "rendition", "build"]
    entry = F.struct("word_index", "word", F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    plain = lambda c: F.transform(F.array_sort(c), lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    by_chunk = words.filter("word is not null").groupBy(*keys, "sequence", "region", "chunk_index").agg(plain(F.collect_list(entry)).alias("words"))
    head = by_chunk.filter("region = 'heading'").select(*keys, "sequence", F.col("words").alias("heading_words"))
    body = by_chunk.filter("region = 'body'").drop("region")
    builds = words.select(*keys, "sequence").distinct()
    joined = builds.join(chunks.select("source_id", "sequence", "chunk_index", "text"), ["source_id", "sequence"], "left").join(body, [*keys, "sequence", "chunk_index"], "left")
    empty = F.array().cast("array<struct<word:string,start:double,end:double>>")
    parts = joined.filter("chunk_index is not null").groupBy(*keys, "sequence").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text", F.coalesce("words", empty).alias("words")))).alias("chunks"))
    rows = builds.join(parts, [*keys, "sequence"], "left").join(head, [*keys, "sequence"], "left").join(sections.select("source_id", "sequence", "section_type", "ordinal", "heading"), ["source_id", "sequence"], "left")
    chunk_rows = F.transform(F.coalesce("chunks", F.array().cast("array<struct<chunk_index:int,text:string,words:array<struct<word:string,start:double,end:double>>>>")), lambda c: F.struct(c["text"].alias("text"), c["words"].alias("words")))
    heading = F.struct(F.col("heading.display_label").alias("display_label"), F.col("heading.display_title").alias("display_title"), F.col("heading.spoken_text").alias("spoken_text"), F.coalesce("heading_words", empty).alias("words"))
    section = F.struct("sequence", "section_type", "ordinal", heading.alias("heading"), chunk_rows.alias("chunks"))
    payload = F.to_json(F.struct(F.lit(2).alias("version"), "rendition", "build", F.array_sort(F.collect_list(section)).alias("sections")))
    return rows.groupBy(*keys).agg(payload.alias("payload"))


def merged_builds(prior, current):
    """The current build first, then the earlier ones, each once; the newest ``RETAIN``."""
    return F.slice(F.array_distinct(F.concat(F.array(current), F.coalesce(prior, F.array().cast("array<string>")))), 1, RETAIN)


def commit(tables: dict[str, DataFrame], root: str, manifest: dict) -> bool:
    """Write tables under ``root``, then the manifest; a root with a manifest is left as it is.

    Readers take a build only by its manifest, so a job lost on the way leaves
    nothing that can be read; running it again writes the tables anew.
    """
    spark = next(iter(tables.values())).sparkSession
    marker = f"{root}/manifest.json"
    path = spark._jvm.org.apache.hadoop.fs.Path(marker)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    out = fs.create(path, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True, separators=(",", ":")).encode("utf-8")))
    out.close()
    return True


def read_commit(spark: SparkSession, root: str, name: str) -> DataFrame:
    spark.read.text(f"{root}/manifest.json", wholetext=True).first()
    return spark.read.parquet(f"{root}/{name}")
