"""Text plans: counts, hashes, sentences, chunks, headings over sections, chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import headings as H
from inkwell.functions import text as T
from inkwell.session import table


def _sections(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "sections").dropDuplicates(["section_id"])


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").dropDuplicates(["chunk_id"])


def text_counts(s, d):
    """The three word counts, kept apart, and whether there is Han."""
    t = F.col("text")
    return _sections(s, d).select("section_id", T.has_han(t).alias("has_han"), T.word_count(t).alias("words"), T.unit_count(t).alias("units"), T.token_count(t).alias("tokens"))


def text_languages(s, d):
    return table(s, d, "source_books").select(F.col("language").alias("given"), T.normalize_language(F.col("language")).alias("language")).groupBy("given", "language").agg(F.count("*").alias("n"))


def text_hash_check(s, d):
    """Chunks by whether the delivered hash is that of the text."""
    verdict = F.when(F.col("text_hash").isNull(), "missing").when(F.col("text_hash") == T.text_hash(F.col("text")), "ok").otherwise("wrong")
    return _chunks(s, d).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def text_slugs(s, d):
    p = table(s, d, "published_books").dropDuplicates(["catalog_id"])
    return p.select("catalog_id", T.slug(F.lower(F.regexp_replace("title_slug", "-", " "))).alias("slug"), T.log_name(F.concat_ws("/", "author_slug", "rendition")).alias("log_name"), T.rendition(F.lit("narrator"), F.translate("rendition", "-", "_")).alias("rendition"))


def text_sentences(s, d):
    """Sentences behind . ! ? with abbreviations guarded, numbered in each document."""
    docs = table(s, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(T.english_sentences(F.col("text"))).alias("place", "sentence"))


def text_plain_sentences(s, d):
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.size(T.plain_sentences(F.col("text"))).alias("sentences"))


def text_windows(s, d):
    """Each chunk with its neighbours' texts, empty at the edges, and whether it ends its paragraph."""
    w = Window.partitionBy("section_id").orderBy("chunk_index")
    c = _chunks(s, d).filter("section_id is not null")
    return c.select("chunk_id", F.lag("text", 1, "").over(w).alias("prev"), F.lead("text", 1, "").over(w).alias("next"), F.coalesce(F.lead("para_start").over(w) != F.col("para_end"), F.lit(True)).alias("ends_paragraph"))


def text_ranges(s, d):
    """Where each chunk lies in its section's joined text (two characters between chunks)."""
    w = Window.partitionBy("section_id").orderBy("chunk_index")
    long = F.coalesce(F.length("text"), F.lit(0))
    end = F.sum(long + 2).over(w) - 2
    return _chunks(s, d).filter("section_id is not null").select("chunk_id", (end - long).alias("from_pos"), end.alias("to_pos"))


def text_opening(s, d):
    """The opening of each edition: sections in order while fewer than 4000 characters came before."""
    w = Window.partitionBy("source_id").orderBy("sequence", "section_id").rowsBetween(Window.unboundedPreceding, -1)
    one = _sections(s, d).filter("text is not null and source_id is not null").withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).filter("before < 4000")
    return one.select("section_id", "source_id", F.expr("left(text, cast(4000 - before as int))").alias("opening"))


def text_section_filter(s, d):
    """Sections named by the range list "2,4-5"."""
    ranges = s.createDataFrame([("2,4-5",)], "spec string").select(F.explode(F.split("spec", ",")).alias("part"))
    lo, hi = F.substring_index("part", "-", 1).cast("int"), F.substring_index("part", "-", -1).cast("int")
    wanted = ranges.select(F.explode(F.sequence(lo, hi)).alias("sequence"))
    return _sections(s, d).join(wanted, "sequence", "left_semi").select("section_id", "sequence")


def text_credits(s, d):
    """Opening and closing credits of each edition; its own sections move up by one."""
    b = table(s, d, "source_books").groupBy("book_id").agg(F.max_by(F.struct("title", "author", "language", "source_id"), F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("b")).select("book_id", "b.*").filter("title is not null and author is not null")
    last = _sections(s, d).filter("source_id is not null").groupBy("source_id").agg(F.max("sequence").alias("last"))
    zh = T.normalize_language(F.col("language")) == "zh"
    opening = F.when(zh, F.format_string("《%s》。作者：%s。", "title", "author")).otherwise(F.format_string("%s. Written by %s.", "title", "author"))
    closing = F.when(zh, F.format_string("《%s》朗读完毕。作者：%s。", "title", "author")).otherwise(F.format_string("The end of %s, written by %s.", "title", "author"))
    return b.join(last, "source_id").select("book_id", F.inline(F.array(F.struct(F.lit(1).alias("sequence"), opening.alias("spoken")), F.struct((F.col("last") + 2).alias("sequence"), closing.alias("spoken")))))


def text_cleaned(s, d):
    """Displayed titles without invisible signs and with terminal punctuation."""
    h = _sections(s, d).filter("heading is not null").select("section_id", F.col("heading.display_title").alias("t"))
    return h.select("section_id", T.clean_extracted(F.col("t")).alias("clean"), T.terminal_punctuation(F.col("t")).alias("spoken"))


def chunk_documents(s, d):
    """Flagship: sections' paragraphs packed into chunks under the budget, with provenance and hash."""
    books = table(s, d, "source_books").filter("source_id is not null").groupBy("source_id").agg(F.max_by("language", F.struct("updated_at", F.coalesce("title", F.lit("")))).alias("language"))
    made = _sections(s, d).join(books, "source_id", "left").select("section_id", F.posexplode(T.chunks(F.col("paragraphs"), F.coalesce("language", F.lit("en")), F.col("heading.element_ids"))).alias("chunk_index", "c"))
    return made.select("section_id", "chunk_index", F.col("c.text").alias("text"), F.col("c.para_start").alias("para_start"), F.col("c.para_end").alias("para_end"), T.text_hash(F.col("c.text")).alias("text_hash"))


def chunk_summary(s, d):
    """Of all chunks: how many, and the largest, by language."""
    c = chunk_documents(s, d)
    return c.groupBy(T.has_han(F.col("text")).alias("han")).agg(F.count("*").alias("chunks"), F.max(T.unit_count(F.col("text"))).alias("most_units"), F.sum(F.length("text")).alias("chars"))


def chunk_line_packs(s, d):
    """Lines of each document packed into groups of at most 200 words; a longer line stands alone."""
    lines = F.filter(F.split("text", "\\n"), lambda x: T.word_count(x) > 0)
    counts = F.transform(lines, T.word_count)
    empty = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("n"))
    step = lambda a, c: F.when((a["n"] == 0) | (a["n"] + c <= 200), F.struct(a["done"].alias("done"), (a["n"] + c).alias("n"))).otherwise(F.struct(F.array_append(a["done"], a["n"]).alias("done"), c.alias("n")))
    packed = F.aggregate(counts, empty, step, lambda a: F.when(a["n"] > 0, F.array_append(a["done"], a["n"])).otherwise(a["done"]))
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.array_join(packed.cast("array<string>"), ",").alias("sizes"))


def heading_ordinals(s, d):
    """The word counts of sections and chunks' places as Roman numerals and words, and back."""
    counts = table(s, d, "sections").select(F.col("word_count").alias("n")).unionByName(table(s, d, "chunks").select((F.col("chunk_index") + 1).alias("n")))
    n = counts.filter("n > 0").distinct()
    return n.select("n", H.int_to_roman(F.col("n")).alias("roman"), H.roman_to_int(H.int_to_roman(F.col("n"))).alias("back"), H.english_number(F.col("n") * 199).alias("words"))


def heading_spoken(s, d):
    h = _sections(s, d).filter("heading is not null").select("section_id", F.col("heading.display_label").alias("label"), "ordinal", F.col("heading.display_title").alias("title"))
    k = H.heading_class(F.col("label"))
    return h.select("section_id", k["section_type"].alias("kind"), k["ordinal"].alias("number"), H.chapter_spoken(F.coalesce("ordinal", F.lit(1)), F.coalesce("title", F.lit("")), F.lit("en")).alias("spoken"), H.legacy_heading(F.col("label")).alias("legacy"))


QUERIES = {f.__name__: f for f in (text_counts, text_languages, text_hash_check, text_slugs, text_sentences, text_plain_sentences, text_windows, text_ranges, text_opening, text_section_filter, text_credits, text_cleaned, chunk_documents, chunk_summary, chunk_line_packs, heading_ordinals, heading_spoken)}

_HAN = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3134f}]"
_UNIT = _HAN + r"|[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
_WS = r"[\s\x{b}\x{c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SECT = "sec as (select * from sections qualify row_number() over (partition by section_id order by section_id) = 1)"
_CHK = "chk as (select * from chunks qualify row_number() over (partition by chunk_id order by chunk_id) = 1)"
_LANG = "case split_part(translate(lower(language),'_','-'),'-',1) when 'a' then 'en' when 'b' then 'en' when 'eng' then 'en' when 'z' then 'zh' when 'zho' then 'zh' when 'chi' then 'zh' else split_part(translate(lower(language),'_','-'),'-',1) end"
_ABBR = "|".join(T.ABBREVIATIONS.split())
_WC = lambda c: f"len(list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w <> ''))"
_TITLE = "trim(regexp_replace(regexp_replace(heading.display_title, '[\\x{feff}\\x{200b}\\x{200c}\\x{200d}\\x{2060}]', '', 'g'), '" + _WS + "+', ' ', 'g'))"
# Runs next to Han are set apart by spaces first, as this dialect has no class subtraction.
_APART = f"regexp_replace(text, '({_HAN})', ' \\1 ', 'g')"
_DIGITS = lambda one, five, ten: "['', " + ", ".join(f"'{x}'" for x in (one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)) + "]"
_ROMAN = "repeat('M', n // 1000) || " + " || ".join(f"({_DIGITS(*x)})[n // {by} % 10 + 1]" for by, x in ((100, "CDM"), (10, "XLC"), (1, "IVX")))
_SMALL, _TENS = (str(x).replace("[", "list_value(").replace("]", ")") for x in (H.SMALL, H.TENS))
_UNDER = lambda n: f"(case when {n} < 20 then ({_SMALL})[{n} + 1] when {n} % 10 = 0 then ({_TENS})[{n} // 10 - 1] else ({_TENS})[{n} // 10 - 1] || '-' || ({_SMALL})[{n} % 10 + 1] end)"
_THREE = lambda n: f"concat_ws(' ', case when {n} >= 100 then ({_SMALL})[{n} // 100 + 1] || ' Hundred' end, case when {n} < 100 or {n} % 100 <> 0 then {_UNDER(f'({n} % 100)')} end)"
_SPELLED = f"case when m <= 0 or m >= 1000000 then m::varchar else concat_ws(' ', case when m >= 1000 then {_THREE('(m // 1000)')} || ' Thousand' end, case when m < 1000 or m % 1000 <> 0 then {_THREE('(m % 1000)')} end) end"
# The chunker: oversized paragraphs to sentences, these to comma groups or word windows, then all packed in order.
_UC = lambda c: f"(case when regexp_matches({c}, '{_HAN}') then len(regexp_extract_all(regexp_replace({c}, '({_HAN})', ' \\1 ', 'g'), '{_UNIT.replace(chr(39), chr(39) * 2)}')) else {_WC(c)} end)"
_STRIP = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_CLOSED = lambda a: f"(case when {a}.k > 0 then list_append({a}.done, {a}.open) else {a}.done end)"
_EMPTY = "struct_pack(done := []::varchar[], open := '', k := 0, n := 0::bigint, t := '', w := 0::bigint, c := []::varchar[])"
_NEXT = lambda done, open_, k, n: f"struct_pack(done := {done}, open := {open_}, k := {k}, n := ({n})::bigint, t := '', w := 0::bigint, c := []::varchar[])"
_JOIN = lambda glue: f"case when a.k = 0 then e.t else a.open || '{glue}' || e.t end"
_PACK = lambda glue, wide: "case when " + ("a.k = 0 or a.n + e.w <= 200" if not wide else "a.n + e.w <= 200") + f" then {_NEXT('a.done', _JOIN(glue), 'a.k + 1', 'a.n + e.w')} " + (f"when e.w > 200 then {_NEXT(f'list_concat({_CLOSED(chr(97))}, e.c)', chr(39) * 2, '0', '0')} " if wide else "") + f"else {_NEXT(_CLOSED('a'), 'e.t', '1', 'e.w')} end"
_ITEM = lambda t, w, c: f"struct_pack(done := []::varchar[], open := '', k := 0, n := 0::bigint, t := {t}, w := ({w})::bigint, c := {c})"
_WINDOWS = lambda c: f"list_transform(range(0, greatest({_WC(c)}, 1), 200), lambda i: array_to_string(list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w <> '')[i + 1:i + 200], ' '))"
_RUN = "(?:[^\\P{L}" + _HAN[1:-1] + "]|\\p{N})+"
_EACH = f"regexp_extract_all(x, '[^\\p{{L}}\\p{{N}}]*(?:{_HAN}|{_RUN}(?:[''’]{_RUN})*)[^\\p{{L}}\\p{{N}}]*')"
_CUTS = f"list_transform(range(0, len({_EACH}), 200), lambda i: array_to_string({_EACH}[i + 1:i + 200], ''))"
_CHUNKS = f"""{_SECT}, lb as (select source_id, language from source_books where source_id is not null qualify row_number() over (partition by source_id order by updated_at desc nulls last, coalesce(title, '') desc) = 1),
ls as (select section_id, coalesce({_LANG} = 'zh', false) as zh, paragraphs from sec left join lb using (source_id)),
pa as (select section_id, zh, unnest(range(len(paragraphs)))::int as i, {_STRIP("coalesce(unnest(paragraphs), '')")} as t from ls),
pn as (select *, case when zh then {_UC('t')} else {_WC('t')} end as n from pa where t <> ''),
se as (select section_id, i, unnest(range(len(l))) as k, replace(unnest(l), chr(1), '.') as s from (select section_id, i, list_filter(string_split(regexp_replace(regexp_replace(t, '\\b({_ABBR}|[A-Z])\\.', '\\1' || chr(1), 'g'), '([.!?]){_WS}+', '\\1' || chr(2), 'g'), chr(2)), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g')) <> '') as l from pn where not zh and n > 200)),
sw as (select *, {_WC('s')} as w from se),
cg as (select section_id, i, k, list_reduce(list_prepend({_EMPTY}, list_transform(string_split(s, ', '), lambda x: {_ITEM('x', _WC('x'), '[]::varchar[]')})), lambda a, e: {_PACK(', ', False)}) as r from sw where w > 200 and contains(s, ', ')),
cw as (select section_id, i, k, g[:len(g) - 1] as head, g[len(g)] as tail from (select section_id, i, k, {_CLOSED('r')} as g from cg)),
wi as (select section_id, i, k, list_concat(head, case when {_WC('tail')} > 200 then {_WINDOWS('tail')} else [tail] end) as c from cw union all select section_id, i, k, {_WINDOWS('s')} from sw where w > 200 and not contains(s, ', ')),
sl as (select section_id, i, list({_ITEM('s', 'w', 'coalesce(c, []::varchar[])')} order by k) as l from sw left join wi using (section_id, i, k) group by all),
ep as (select section_id, i, {_CLOSED('r')} as g from (select section_id, i, list_reduce(list_prepend({_EMPTY}, l), lambda a, e: {_PACK(' ', True)}) as r from sl)),
zf as (select section_id, i, list_transform(regexp_extract_all(t, '[^。！？!?；，]+[。！？!?；，]*[”’」』]*|[。！？!?；，]+'), lambda x: {_ITEM('x', '0', f'case when {_UC(chr(120))} > 200 then {_CUTS} else [x] end')}) as l from pn where zh and n > 200),
zp as (select section_id, i, case when r.open <> '' then list_append(r.done, r.open) else r.done end as g from (select section_id, i, list_reduce(list_prepend({_EMPTY}, l), lambda a, e: case when {_UC('(a.open || e.t)')} <= 200 then {_NEXT('a.done', 'a.open || e.t', '1', '0')} else {_NEXT("list_concat(case when a.open <> '' then list_append(a.done, a.open) else a.done end, e.c[:len(e.c) - 1])", 'e.c[len(e.c)]', '1', '0')} end) as r from zf)),
un as (select section_id, i, 0 as j, t as text from pn where n <= 200 union all select section_id, i, unnest(range(len(g))), unnest(g) from ep union all select section_id, i, unnest(range(len(g))), unnest(g) from zp union all select section_id, i, 0, t from pn where not zh and n > 200 and not exists (select 1 from ep where ep.section_id = pn.section_id and ep.i = pn.i)),
uc as (select section_id, i, j, text, (case when zh then {_UC('text')} else {_WC('text')} end)::bigint as n from un join ls using (section_id)),
ul as (select section_id, list(struct_pack(done := []::struct(text varchar, a int, b int)[], open := text, k := 0, n := n, a := i, b := i) order by i, j) as l from uc group by 1),
ur as (select section_id, list_reduce(list_prepend(struct_pack(done := []::struct(text varchar, a int, b int)[], open := '', k := 0, n := 0::bigint, a := 0::int, b := 0::int), l), lambda x, e: case when x.n + e.n <= 200 then struct_pack(done := x.done, open := case when x.k = 0 then e.open else x.open || chr(10) || chr(10) || e.open end, k := x.k + 1, n := x.n + e.n, a := case when x.k = 0 then e.a else x.a end, b := e.b)
  else struct_pack(done := case when x.k > 0 then list_append(x.done, struct_pack(text := x.open, a := x.a, b := x.b)) else x.done end, open := e.open, k := 1, n := e.n, a := e.a, b := e.b) end) as r from ul),
uf as (select section_id, case when r.k > 0 then list_append(r.done, struct_pack(text := r.open, a := r.a, b := r.b)) else r.done end as c from ur),
cd as (select section_id, unnest(range(len(c)))::int as chunk_index, unnest(c) as c from uf)"""
_SPELL = lambda n: _SPELLED.replace("(m ", f"({n} ").replace("m::", f"{n}::").replace(" m ", f" {n} ").replace("when m ", f"when {n} ")
_COUNT = lambda c, x: f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}"
_ROMAN_OF = lambda c: "(case when " + f"{c} <> '' and regexp_matches({c}, '{H.ROMAN}') then " + " + ".join(f"{_COUNT(c, s)} * {v}" for s, v in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000))) + " - " + " - ".join(f"{_COUNT(c, s)} * {v}" for s, v in (("IV", 2), ("IX", 2), ("XL", 20), ("XC", 20), ("CD", 200), ("CM", 200))) + " end)"
_ORDINAL_OF = lambda c: f"(case when regexp_full_match({c}, '\\d+') then nullif(try_cast({c} as int), 0) else {_ROMAN_OF(f'upper({c})')} end)"
_STOP = lambda c: f"(case when trim({c}) = '' then '' when regexp_matches(trim({c}), '[.?!。！？]$') then trim({c}) else trim({c}) || '.' end)"
_PLAIN = lambda c: "trim(regexp_replace(regexp_replace(" + c + ", '[\\x{feff}\\x{200b}\\x{200c}\\x{200d}\\x{2060}]', '', 'g'), '" + _WS + "+', ' ', 'g'))"
_NAMED = f"""hx as (select section_id, heading.display_label as label, coalesce(heading.display_title, '') as title, coalesce(ordinal, 1) as m1, {_PLAIN('heading.display_label')} as t, regexp_replace(lower(heading.display_label), '^[ .:]+|[ .:]+$', '', 'g') as low from sec where heading is not null),
hy as (select *, regexp_matches(label, '{H.CHAPTER}') as ch, {_ORDINAL_OF(f"regexp_extract(label, '{H.CHAPTER}', 1)")} as cn, {_ORDINAL_OF(f"regexp_extract(label, '{H.ORDINAL}', 1)")} as bn, regexp_extract(t, '{H.CHAPTER}', 1) <> '' as named from hx),
hz as (select *, case when named then {_ORDINAL_OF(f"regexp_extract(t, '{H.CHAPTER}', 1)")} else {_ORDINAL_OF(f"regexp_extract(t, '{H.ORDINAL}', 1)")} end as ln, {_PLAIN(f"case when named then regexp_extract(t, '{H.CHAPTER}', 2) else regexp_extract(t, '{H.ORDINAL}', 2) end")} as lt from hy)"""
_KINDS = " ".join(f"when low = '{k}' or starts_with(low, '{k} ') then '{k}'" for k in H.SECTION_TYPES)
ORACLES = {
    "heading_spoken": f"with {_SECT}, {_NAMED} select section_id, case when ch or bn is not null then 'chapter' {_KINDS} end as kind, (case when ch then cn else bn end)::int as number, {_STOP(f"concat_ws('. ', 'Chapter ' || {_SPELL('m1')}, nullif(title, ''))")} as spoken, case when ln is not null then {_STOP(f"concat_ws('. ', 'Chapter ' || {_SPELL('ln')}, nullif(lt, ''))")} else label end as legacy from hz",
    "chunk_documents": f"with {_CHUNKS} select section_id, chunk_index, c.text as text, c.a as para_start, c.b as para_end, 'sha256:' || sha256(c.text) as text_hash from cd",
    "chunk_summary": f"with {_CHUNKS} select regexp_matches(c.text, '{_HAN}') as han, count(*) as chunks, max({_UC('c.text')})::int as most_units, sum(length(c.text))::bigint as chars from cd group by 1",
    "heading_ordinals": f"with n as (select distinct n, n * 199 as m from (select word_count as n from sections union all select chunk_index + 1 from chunks) where n > 0) select n, {_ROMAN} as roman, n as back, {_SPELLED} as words from n",
    "text_counts": f"with {_SECT} select section_id, regexp_matches(text, '{_HAN}') as has_han, {_WC('text')} as words, case when regexp_matches(text, '{_HAN}') then len(regexp_extract_all({_APART}, '{_UNIT.replace(chr(39), chr(39) * 2)}')) else {_WC('text')} end as units, len(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}'']+')) as tokens from sec",
    "text_plain_sentences": f"select doc_id, case when regexp_matches(text, '{_HAN}') then len(list_filter(regexp_extract_all(text, '[^。！？!?]+[。！？!?]*[”’」』]*|[。！？!?]+'), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g')) <> '')) else len(list_filter(string_split(regexp_replace(text, '([.!?]){_WS}+', '\\1' || chr(2), 'g'), chr(2)), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g')) <> '')) end as sentences from documents where text is not null",
    "text_languages": f"select language as given, {_LANG} as language, count(*) as n from source_books group by 1, 2",
    "text_hash_check": f"with {_CHK} select case when text_hash is null then 'missing' when text_hash = 'sha256:' || sha256(text) then 'ok' else 'wrong' end as verdict, count(*) as n from chk group by 1",
    "text_slugs": r"with p as (select * from published_books qualify row_number() over (partition by catalog_id order by catalog_id) = 1), l as (select *, regexp_replace(regexp_replace(lower(regexp_replace(concat_ws('/', author_slug, rendition), '[^A-Za-z0-9_.-]+', '-', 'g')), '^[-.]+', ''), '[-.]+$', '') as nm from p) select catalog_id, regexp_replace(regexp_replace(regexp_replace(lower(title_slug), '[^a-z0-9]+', '-', 'g'), '^-', ''), '-$', '') as slug, case when nm = '' then 'pipeline' else nm end as log_name, case when starts_with(rendition, 'narrator-') then rendition else concat_ws('-', 'narrator', rendition) end as rendition from l",
    "text_sentences": f"with g as (select doc_id, regexp_replace(text, '\\b({_ABBR}|[A-Z])\\.', '\\1' || chr(1), 'g') as t from documents where text is not null), p as (select doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]){_WS}+', '\\1' || chr(2), 'g'), chr(2)), lambda x: replace(x, chr(1), '.')), lambda x: trim(regexp_replace(x, '{_WS}+', ' ', 'g')) <> '') as l from g) select doc_id, unnest(range(len(l)))::int as place, unnest(l) as sentence from p",
    "text_windows": f"with {_CHK} select chunk_id, lag(text, 1, '') over w as prev, lead(text, 1, '') over w as next, coalesce(lead(para_start) over w <> para_end, true) as ends_paragraph from chk where section_id is not null window w as (partition by section_id order by chunk_index)",
    "text_ranges": f"with {_CHK}, r as (select chunk_id, coalesce(length(text), 0) as long, sum(coalesce(length(text), 0) + 2) over (partition by section_id order by chunk_index) - 2 as fin from chk where section_id is not null) select chunk_id, (fin - long)::bigint as from_pos, fin::bigint as to_pos from r",
    "text_opening": f"with {_SECT}, o as (select *, coalesce(sum(length(text)) over (partition by source_id order by sequence, section_id rows between unbounded preceding and 1 preceding), 0) as before from sec where text is not null and source_id is not null) select section_id, source_id, array_slice(text, 1, (4000 - before)::bigint) as opening from o where before < 4000",
    "text_section_filter": f"with {_SECT} select section_id, sequence from sec where sequence in (2, 4, 5)",
    "text_credits": f"with {_SECT}, b as (select * from source_books where book_id is not null qualify row_number() over (partition by book_id order by updated_at desc nulls last, coalesce(title,'') desc) = 1), l as (select source_id, max(sequence) as last from sec where source_id is not null group by 1), j as (select b.*, last, {_LANG} as lg from b join l using (source_id) where title is not null and author is not null) select book_id, 1 as sequence, case when lg = 'zh' then format('《{{}}》。作者：{{}}。', title, author) else format('{{}}. Written by {{}}.', title, author) end as spoken from j union all select book_id, last + 2, case when lg = 'zh' then format('《{{}}》朗读完毕。作者：{{}}。', title, author) else format('The end of {{}}, written by {{}}.', title, author) end from j",
    "text_cleaned": f"with {_SECT} select section_id, {_TITLE} as clean, case when trim(heading.display_title) = '' then '' when regexp_matches(trim(heading.display_title), '[.?!。！？]$') then trim(heading.display_title) else trim(heading.display_title) || '.' end as spoken from sec where heading is not null",
    "chunk_line_packs": f"with c as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_WC('x')}), lambda n: n > 0) as l from documents where text is not null), f as (select doc_id, list_reduce(list_transform(l, lambda n: struct_pack(done := []::int[], n := n::int)), lambda a, b: case when a.n = 0 or a.n + b.n <= 200 then struct_pack(done := a.done, n := a.n + b.n) else struct_pack(done := list_append(a.done, a.n), n := b.n) end, struct_pack(done := []::int[], n := 0)) as a from c) select doc_id, array_to_string(case when a.n > 0 then list_append(a.done, a.n) else a.done end, ',') as sizes from f",
}
