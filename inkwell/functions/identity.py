"""Identifiers, keys, fingerprints and formats as column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def provider(source_id: Column) -> Column:
    return F.substring_index(source_id, ":", 1)


def sha(content: Column) -> Column:
    return F.sha2(content, 256)


def fixture_key(system: Column, user: Column) -> Column:
    """First sixteen hex digits of the hash of both prompts."""
    return F.substring(F.sha2(F.concat(system, user), 256), 1, 16)


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=lambda name: (_ for _ in ()).throw(ValueError(name)))
    except ValueError:
        return None
    packed = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return hashlib.sha256(packed.encode("utf-8")).hexdigest()


#: Hash of a JSON text with sorted keys and no spaces; null for broken JSON and NaN.
fingerprint = F.pandas_udf(lambda s: s.map(_canonical), StringType())


def artifact_key(author: Column, title: Column, rendition: Column, build: Column, *rest: Column) -> Column:
    return F.concat_ws("/", F.lit("books"), author, title, F.lit("renditions"), rendition, F.lit("builds"), build, *rest)


def section_name(sequence: Column) -> Column:
    return F.format_string("section-%02d", sequence)


def parse_manifest_key(path: Column) -> Column:
    """Author and title slugs of ``books/<author>/<title>/manifest.json``, else null."""
    pattern = "^books/([a-z0-9-]+)/([a-z0-9-]+)/manifest\\.json$"
    return F.when(path.rlike(pattern), F.struct(F.regexp_extract(path, pattern, 1).alias("author_slug"), F.regexp_extract(path, pattern, 2).alias("title_slug")))


def byte_range(header: Column, size: Column) -> Column:
    """Offset and length of a single byte range, null if it can't be met."""
    a = F.nullif(F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 1), F.lit("")).cast("bigint")
    b = F.nullif(F.regexp_extract(header, "^bytes=(\\d*)-(\\d*)$", 2), F.lit("")).cast("bigint")
    start = F.when(a.isNull(), F.greatest(size - b, F.lit(0))).otherwise(a)
    end = F.when(a.isNull(), size - 1).otherwise(F.least(F.coalesce(b, size - 1), size - 1))
    return F.when(header.rlike("^bytes=(\\d+-\\d*|-\\d+)$") & (start <= end) & (start < size), F.struct(start.alias("offset"), (end - start + 1).alias("length")))


def duration_text(seconds: Column) -> Column:
    hours, minutes = F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))


def clock_text(seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(seconds / 60), F.floor(F.pmod(seconds, F.lit(60))))


def section_title(label: Column, title: Column, kind: Column) -> Column:
    l, t = F.coalesce(label, F.lit("")), F.coalesce(title, F.lit(""))
    return F.when((l != "") & (t != ""), F.concat_ws(" — ", l, t)).when(l != "", l).when(t != "", t).otherwise(F.initcap(kind))


def hue(text: Column) -> Column:
    """A colour angle of a text: code + (h << 5) - h over its letters, the shift in 32 bits."""
    shift = lambda h: F.pmod(F.pmod(h, F.lit(1 << 32)) * 32 + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    h = F.aggregate(F.regexp_extract_all(text, F.lit("(?s)(.)")), F.lit(0).cast("bigint"), lambda a, c: (F.ascii(c) + shift(a) - a).cast("bigint"))
    return F.pmod(h, F.lit(360)).cast("int")


def age_text(then: Column, now: Column) -> Column:
    """Whole seconds, minutes, hours or days between; a dash for null."""
    s = F.greatest(F.lit(0), F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp")))
    return F.when(then.isNull(), "—").when(s < 60, F.format_string("%ds", s)).when(s < 3600, F.format_string("%dm", F.floor(s / 60))).when(s < 86400, F.format_string("%dh", F.floor(s / 3600))).otherwise(F.format_string("%dd", F.floor(s / 86400)))


def redact(text: Column, secrets: list[str], mask: str = "[redacted]") -> Column:
    """Secrets replaced, longest first, so that none is left in part."""
    for secret in sorted(filter(None, set(secrets)), key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(secret), F.lit(mask))
    return text


def edition_url(url: Column, source_id: Column, hosts: list[str]) -> Column:
    """The https address of an edition file on one of the hosts, for a decimal id; else null."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    number = F.regexp_extract(source_id, "^[a-z]+:(\\d+)$", 1)
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(host.isin(*hosts) & (number != "") & F.contains(path, number), F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, hosts)), 1), path))


def title_slug(title: Column, source_id: Column) -> Column:
    """A title's slug with a suffix that tells editions apart: number, upload or the first twelve digits of a hash."""
    from inkwell.functions.text import slug

    name = F.coalesce(F.nullif(slug(title), F.lit("")), F.lit("untitled"))
    tail = F.substring_index(source_id, ":", -1)
    short = F.left(F.sha2(source_id, 256), F.lit(12))
    return (
        F.when(F.startswith(source_id, F.lit("gutenberg:")), F.concat(name, F.lit("-g"), tail))
        .when(source_id.rlike("^owner(?:upload)?:[a-f0-9-]{32,36}$"), F.concat(name, F.lit("-upload-"), F.replace(tail, F.lit("-"), F.lit(""))))
        .when(source_id.rlike("^wikisource:"), F.concat(name, F.lit("-ws-"), short))
        .otherwise(F.concat(name, F.lit("-se-"), short))
    )


def download_name(path: Column) -> Column:
    """File name of an edition path: its parts joined by underscores, their own underscores hyphens."""
    return F.concat(F.array_join(F.transform(F.split(path, "/"), lambda p: F.translate(p, "_", "-")), "_"), F.lit(".epub"))


def source_of_url(url: Column) -> Column:
    """The edition id an address stands for, by its host and path; null for others."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    number = F.regexp_extract(path, "^/(?:ebooks|cache/epub|files)/(\\d+)(?:[./]|$)", 1)
    edition = F.regexp_extract(path, "^/ebooks/([a-z0-9-]+(?:/[a-z0-9_-]+)+?)(?:/downloads/.*)?$", 1)
    return F.when(host.rlike("(^|\\.)gutenberg\\.org$") & (number != ""), F.concat(F.lit("gutenberg:"), number)).when((host == "standardebooks.org") & (edition != ""), F.concat(F.lit("standardebooks:"), edition))


def error_text(code: Column, known: list[str], other: str) -> Column:
    """Known codes as they are, others as one, null as null."""
    return F.when(code.isNull(), None).when(code.isin(*known), code).otherwise(other)
