"""Performance direction: annotations checked and applied, neutral values, halved batches, attribution with repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import direction as D

# Fixed values.
SPOKEN_ALOUD = "\\b(?:said|spoke|spoken|called|cried|shouted|whispered|muttered)\\s+aloud\\b"
VOICE_SEXES = {"af_": "female", "bf_": "female", "am_": "male", "bm_": "male"}


def intensity_value(raw: Column) -> Column:
    """A directed intensity: a half for null; null for text that is no number or lies outside 0..1."""
    number = raw.try_cast("double")
    return F.when(raw.isNull(), 0.5).when(number.between(0.0, 1.0), number)


def annotation_fault(emotion: Column, speed: Column, intensity: Column, pause: Column, vocabulary: Sequence[str] = tuple(D.EMOTIONS)) -> Column:
    """The first rule an annotation breaks; null for a sound one.  Missing values stand for their defaults."""
    ms = F.coalesce(pause.try_cast("int"), F.when(pause.isNull(), 0))
    return (
        F.when(~F.coalesce(emotion, F.lit("neutral")).isin(*vocabulary), "emotion")
        .when(~F.coalesce(speed, F.lit("normal")).isin(*D.SPEEDS), "speed")
        .when(intensity_value(intensity).isNull(), "intensity")
        .when(ms.isNull() | ~ms.between(0, 2000), "pause")
    )


def annotated(rows: DataFrame) -> DataFrame:
    """Segments with their annotation laid on: text, emotion, speed, intensity and pause; a faulty one gets the neutral values.

    ``rows`` has speaker, text, delivery_type, voice_policy, join_policy and the
    answer's emotion, speed, intensity, pause and synthesis_text, all texts.
    ``fault`` names the broken rule.  Null answers give the defaults; a blank
    synthesis text leaves the segment's own.
    """
    fault = annotation_fault(F.col("emotion"), F.col("speed"), F.col("intensity"), F.col("pause"))
    sound = fault.isNull()
    emotion = F.when(sound, F.coalesce("emotion", F.lit("neutral"))).otherwise("neutral")
    label = F.when(sound, F.coalesce("speed", F.lit("normal"))).otherwise("normal")
    level = F.when(sound, intensity_value(F.col("intensity"))).otherwise(0.5)
    pause = F.when(sound, F.coalesce(F.col("pause").try_cast("int"), F.lit(0))).otherwise(0)
    spoken = F.when(sound & (F.trim(F.coalesce("synthesis_text", F.lit(""))) != ""), F.col("synthesis_text")).otherwise(F.col("text"))
    return rows.select(
        *[c for c in rows.columns if c not in ("emotion", "speed", "intensity", "pause", "synthesis_text")],
        fault.alias("fault"),
        spoken.alias("synthesis_text"),
        emotion.alias("emotion"),
        D.speed(label, F.col("speaker"), F.col("text")).alias("speed"),
        D.intensity(emotion, level, F.col("text"), F.col("delivery_type")).alias("intensity"),
        D.pause_after(pause, F.col("join_policy"), F.col("voice_policy"), F.col("delivery_type")).alias("pause_ms"),
    )


def effective_policy(policy: Column, main_pov: Column, exchange: Column) -> Column:
    """The main character's lines outside an exchange sound like the narrator."""
    return F.when(main_pov & ~exchange, "narrator_compatible").otherwise(policy)


def halved(items: DataFrame, keys: Sequence[str], place: str, size: str, bad: str, most: int = 64) -> DataFrame:
    """What is left of a batch tried, halved and tried again until it holds no bad item: ``tries`` of each item, ``kept``.

    ``place`` numbers a batch's items from 0, ``size`` is their number, at most
    ``most``.  An item alone that is still bad isn't kept and takes the neutral
    values.  Each level is one pass over windows of the same key; their number
    follows ``most``, never the data.
    """
    rows = items.withColumns({"__low": F.lit(0), "__high": F.col(size), "tries": F.lit(1)})
    levels = max(1, (most - 1).bit_length())
    for _ in range(levels):
        w = Window.partitionBy(*keys, "__low")
        rows = rows.withColumn("__broken", F.max(F.col(bad).cast("int")).over(w) == 1)
        split = F.col("__broken") & (F.col("__high") - F.col("__low") > 1)
        middle = F.floor((F.col("__low") + F.col("__high")) / 2).cast("int")
        rows = rows.withColumns({
            "__low2": F.when(split & (F.col(place) >= middle), middle).otherwise(F.col("__low")),
            "__high2": F.when(split & (F.col(place) < middle), middle).otherwise(F.col("__high")),
            "tries": F.col("tries") + split.cast("int"),
        }).drop("__low", "__high", "__broken").withColumnsRenamed({"__low2": "__low", "__high2": "__high"})
    return rows.withColumn("kept", ~F.col(bad)).drop("__low", "__high")


def adjacent_merged(segments: DataFrame, keys: Sequence[str], order: str, same: Sequence[str], text: str = "text", pause: str = "pause_ms") -> DataFrame:
    """Neighbours alike in ``same`` and without a pause between them made one, their texts joined in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    alike = F.lit(True)
    for c in same:
        alike = alike & F.col(c).eqNullSafe(F.lag(c).over(w))
    joins = alike & (F.col(pause) == 0) & F.coalesce(F.lag(pause).over(w) == 0, F.lit(False))
    runs = segments.withColumn("__new", (~F.coalesce(joins, F.lit(False))).cast("int")).withColumn("run", F.sum("__new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return runs.groupBy(*keys, "run", *same).agg(F.min(order).alias(order), F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias(text), F.max(pause).alias(pause), F.count("*").alias("parts"))


def attributed(quotes: DataFrame, answers: DataFrame, resolved: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Quotes with the speaker answered for them, resolved to a canonical name, else repaired, else as it is.

    ``answers`` has the scope, quote_id and speaker; ``resolved`` the scope,
    speaker, canonical and repair.  A quote answered twice, or not at all, has no
    speaker (``fault``); the narrator resolves to itself.
    """
    counted = answers.groupBy(*scope, "quote_id").agg(F.min("speaker").alias("speaker"), F.count("*").alias("__n"))
    rows = quotes.join(counted, [*scope, "quote_id"], "left").join(resolved, [*scope, "speaker"], "left")
    name, how = settled(F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "repeated"))
    return rows.select(*quotes.columns, name.alias("name"), how.alias("how"))


def settled(fault: Column) -> tuple[Column, Column]:
    """The name and how it was settled, of rows with speaker, canonical and repair; no name where there is a ``fault``."""
    narrator = D.norm(F.col("speaker")) == D.NARRATOR
    name = F.when(fault.isNull(), F.when(narrator, D.NARRATOR).otherwise(F.coalesce("canonical", "repair", "speaker")))
    how = F.when(fault.isNotNull(), fault).when(narrator, "narrator").when(F.col("canonical").isNotNull(), "resolved").when(F.col("repair").isNotNull(), "repaired").otherwise("as answered")
    return name, how


def or_narrator(spans: DataFrame, texts: DataFrame, faulty: DataFrame, key: str) -> DataFrame:
    """Spans of the texts without fault; each other text as one span of the narrator's."""
    whole = texts.join(faulty.select(key).distinct(), key, "left_semi").select(key, F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(D.NARRATOR).alias("speaker"))
    return spans.join(faulty.select(key).distinct(), key, "left_anti").select(key, "start", "end", "speaker").unionByName(whole)


def voice_sex(voice: Column) -> Column:
    """What a voice's prefix tells."""
    table = F.create_map(*(F.lit(x) for pair in VOICE_SEXES.items() for x in pair))
    return F.coalesce(table[F.left(voice, F.lit(3))], F.lit("unknown"))


def voice_of(wanted: Column, pool: Sequence[tuple[str, str]]) -> Column:
    """The pool's voice of that id, else of that preset, else its first; ``pool`` has ids and presets."""
    by_id = F.create_map(*(F.lit(x) for i, _ in pool for x in (i, i)))
    by_preset = F.create_map(*(F.lit(x) for i, p in reversed(pool) if p for x in (p, i)))
    return F.coalesce(by_id[wanted], by_preset[wanted], F.lit(pool[0][0]))


def needs_registry(text: Column) -> Column:
    """Quotes, or something said aloud."""
    return D.has_quote(text) | F.lower(text).rlike(SPOKEN_ALOUD)


def minimal_character(canonical: Column, quote: Column) -> Column:
    """The defaults of a character known only from a quote."""
    return F.struct(canonical.alias("canonical"), F.array(canonical).alias("aliases"), F.concat(F.lit("Speaking character inferred from nearby source text: "), canonical, F.lit(".")).alias("description"), F.lit("unknown").alias("gender"), F.lit("unknown").alias("age"), quote.alias("first_evidence_quote"))


def registry_line(canonical: Column, aliases: Column, description: Column) -> Column:
    return F.concat(canonical, F.lit(": aliases=["), F.array_join(aliases, ", "), F.lit("], description="), description)


# The payload of a section's direction and its reading back.
SEGMENT = "speaker:string,voice:string,original_text:string,synthesis_text:string,emotion:string,speed:double,pause_after_ms:int,delivery_type:string,voice_policy:string,join_policy:string"
PAYLOAD = f"version int, rendition string, build string, engine string, cast_mode string, sections array<struct<sequence:int,title:string,chunks:array<struct<index:int,text:string,segments:array<struct<{SEGMENT}>>>>>>"


def read_direction(payload: Column) -> Column:
    """A direction payload with the defaults of what is missing; null where it isn't one section."""
    default = lambda s, n, v: F.coalesce(s[n], F.lit(v)).alias(n)
    segment = lambda s: F.struct(
        s["speaker"].alias("speaker"), s["voice"].alias("voice"), F.coalesce(s["original_text"], s["synthesis_text"]).alias("original_text"), s["synthesis_text"].alias("synthesis_text"), s["emotion"].alias("emotion"),
        F.coalesce(F.nullif(s["speed"], F.lit(0.0)), F.lit(1.0)).alias("speed"), default(s, "pause_after_ms", 0), default(s, "delivery_type", "narration"), default(s, "voice_policy", "narrator"), default(s, "join_policy", "normal"),
    )
    chunk = lambda c: F.struct(c["index"].alias("index"), c["text"].alias("text"), F.transform(F.coalesce(c["segments"], F.array().cast(f"array<struct<{SEGMENT}>>")), segment).alias("segments"))
    section = lambda x: F.struct(x["sequence"].alias("sequence"), x["title"].alias("title"), F.transform(x["chunks"], chunk).alias("chunks"))
    parsed = F.from_json(payload, PAYLOAD)
    return F.get(F.transform(F.array(parsed), lambda p: F.when(F.size(p["sections"]) == 1, p.withField("sections", F.transform(p["sections"], section)))), F.lit(0))


def remapped(direction: Column, rendition: Column, build: Column, engine: Column, cast_mode: Column, narrator_voice: Column) -> Column:
    """A read direction for another build: its ids, and the narrator's voice wherever the narrator would be heard."""
    narrated = lambda s: (cast_mode == "solo") | (s["speaker"] == D.NARRATOR) | F.startswith(F.coalesce(s["voice_policy"], F.lit("")), F.lit("narrator"))
    segment = lambda s: s.withField("voice", F.when(narrated(s), narrator_voice).otherwise(s["voice"]))
    sections = F.transform(direction["sections"], lambda x: x.withField("chunks", F.transform(x["chunks"], lambda c: c.withField("segments", F.transform(c["segments"], segment)))))
    return direction.withField("rendition", rendition).withField("build", build).withField("engine", engine).withField("cast_mode", cast_mode).withField("sections", sections)


def direction_fits(direction: Column, engine: Column, cast_mode: Column, sequence: Column, texts: Column) -> Column:
    """Whether a direction was made for this engine, cast, section and these very texts."""
    one = F.get(direction["sections"], F.lit(0))
    return (direction["engine"] == engine) & (direction["cast_mode"] == cast_mode) & (one["sequence"] == sequence) & (F.transform(one["chunks"], lambda c: F.coalesce(c["text"], F.lit(""))) == texts)
