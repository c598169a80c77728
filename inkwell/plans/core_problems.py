"""Queries of the general problems: time intervals (p4) and nested records (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import intervals, nested
from inkwell.session import table

#: Word positions count ten-thousandths of a second.
TICKS = 10_000


def timeline_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "word_times").select("track_id", F.lit("word").alias("layer"), intervals.to_ticks(F.col("start_s"), TICKS).alias("from_pos"), intervals.to_ticks(F.col("end_s"), TICKS).alias("to_pos"))
    seams = table(spark, sf_dir, "seam_audits").select("track_id", F.lit("pause").alias("layer"), F.col("pause_start_frame").alias("from_pos"), F.col("pause_end_frame").alias("to_pos"))
    return words.unionByName(seams)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.periods_and_gaps(timeline_intervals(spark, sf_dir), ["track_id", "layer"]).select("track_id", "layer", "piece", "from_pos", "to_pos")


def p4_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered and open length of each track and layer."""
    pieces = p4_found(spark, sf_dir).withColumn("span", F.col("to_pos") - F.col("from_pos"))
    of = lambda piece: F.coalesce(F.sum(F.when(F.col("piece") == piece, F.col("span"))), F.lit(0))
    return pieces.groupBy("track_id", "layer").agg(F.count_if(F.col("piece") == "period").alias("periods"), of("period").alias("covered"), of("gap").alias("open"))


_P4 = """
with i as (
  select track_id, 'word' as layer, cast(round(start_s * 10000) as bigint) as s, cast(round(end_s * 10000) as bigint) as e from word_times
  union all
  select track_id, 'pause', pause_start_frame, pause_end_frame from seam_audits
), v as (select distinct * from i where s >= 0 and e > s and track_id is not null),
m as (select *, max(e) over (partition by track_id, layer order by s, e rows between unbounded preceding and 1 preceding) as reach from v),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by track_id, layer order by s, e rows unbounded preceding) as grp from m),
p as (select track_id, layer, grp, min(s) as f, max(e) as t from g group by all),
r as (
  select track_id, layer, 'period' as piece, f as from_pos, t as to_pos from p
  union all
  select * from (select track_id, layer, 'gap', t, lead(f) over (partition by track_id, layer order by f) as nxt from p) where nxt is not null
)
"""


def _flat(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return nested.flatten(table(spark, sf_dir, "section_data"), name)

    query.__name__ = f"p6_{name}"
    return query


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat("words")(spark, sf_dir).select("data_id", "section_pos", "chunk_pos", "word_pos")


def _value(x: str) -> str:
    """SQL: a string holding a JSON list or object for its value."""
    return f"(case when json_type({x}) = 'VARCHAR' and json_type(try_cast({x} ->> '$' as json)) in ('ARRAY', 'OBJECT') then try_cast({x} ->> '$' as json) else {x} end)"


def _items(x: str) -> str:
    """SQL: a list's entries; a lone object's own."""
    return f"(case json_type({x}) when 'ARRAY' then {x} -> '$[*]' when 'OBJECT' then [{x}] else [] end)"


_P6 = f"""
with p as (select data_id, {_value("try_cast(payload as json)")} as j from section_data where data_id is not null qualify row_number() over (partition by data_id order by (try_cast(payload as json) is not null)::int desc, received_at desc nulls last) = 1),
s0 as (select data_id, {_items(_value("(j -> '$.sections')"))} as l from p where json_type(j) = 'OBJECT'),
s1 as (select data_id, unnest(range(len(l))) as section_pos, unnest(l) as v from s0),
s as (select * from (select data_id, section_pos, {_value("v")} as v from s1) where json_type(v) = 'OBJECT'),
c0 as (select data_id, section_pos, {_items(_value("(v -> '$.chunks')"))} as l from s),
c as (select data_id, section_pos, unnest(range(len(l))) as chunk_pos, unnest(l) as v from c0),
h as (select data_id, section_pos, -1 as chunk_pos, {_value("(v -> '$.heading')")} as v from s union all select data_id, section_pos, chunk_pos, {_value("v")} from c),
w0 as (select data_id, section_pos, chunk_pos, {_items(_value("(v -> '$.words')"))} as l from h where json_type(v) = 'OBJECT'),
w1 as (select data_id, section_pos, chunk_pos, unnest(range(len(l))) as word_pos, unnest(l) as v from w0),
w as (select data_id, section_pos, chunk_pos, word_pos, {_value("v")} as v from w1),
n as (select *, case json_type(v) when 'OBJECT' then v ->> '$.word' when 'ARRAY' then v ->> '$[0]' when 'NULL' then null else v ->> '$' end as word from w)
"""
QUERIES = {"p4_found": p4_found, "p4_coverage": p4_coverage, "p6_found": p6_found} | {f"p6_{n}": _flat(n) for n in nested.TABLES}
ORACLES = {
    "p6_found": _P6 + "select data_id, section_pos::int as section_pos, chunk_pos::int as chunk_pos, word_pos::int as word_pos from n where trim(word) <> ''",
    "p6_words": _P6 + "select data_id, section_pos::int as section_pos, chunk_pos::int as chunk_pos, word_pos::int as word_pos, word, try_cast(case json_type(v) when 'OBJECT' then v ->> '$.start' when 'ARRAY' then v ->> '$[1]' end as double) as start_s, try_cast(case json_type(v) when 'OBJECT' then v ->> '$.end' when 'ARRAY' then v ->> '$[2]' end as double) as end_s from n where trim(word) <> ''",
    "p6_sections": _P6 + "select data_id, section_pos::int as section_pos, try_cast(v ->> '$.sequence' as int) as sequence, v ->> '$.section_type' as section_type, try_cast(v ->> '$.ordinal' as int) as ordinal, try_cast(v ->> '$.word_count' as int) as word_count from s",
    "p6_chunks": _P6 + "select data_id, section_pos::int as section_pos, chunk_pos::int as chunk_pos, v ->> '$.text' as text from h where chunk_pos >= 0 and json_type(v) = 'OBJECT'",
    "p6_headings": _P6 + "select data_id, section_pos::int as section_pos, v ->> '$.display_label' as display_label, v ->> '$.display_title' as display_title, v ->> '$.spoken_text' as spoken_text from h where chunk_pos < 0 and json_type(v) = 'OBJECT'",
    "p4_found": _P4 + "select * from r",
    "p4_coverage": _P4 + "select track_id, layer, count(*) filter (piece = 'period') as periods, coalesce(sum(to_pos - from_pos) filter (piece = 'period'), 0)::bigint as covered, coalesce(sum(to_pos - from_pos) filter (piece = 'gap'), 0)::bigint as open from r group by all",
}
