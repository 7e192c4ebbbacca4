"""Reading manifests, recognizer output, envelopes and model claims; every schema is explicit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators.archive import ARC
from ..operators.transcript import renumber, sentences_from_words, words_from_tokens

MANIFEST = "file string, voice string, recorded_at string, prompt string"
ARCHIVE = "subject string, birthYear int, language string"
TOKEN = "struct<text: string, offsets: struct<`from`: bigint, `to`: bigint>, p: double>"
ASR = (
    "result struct<language: string>, transcription array<struct<offsets: struct<`from`: bigint, `to`: bigint>, "
    f"text: string, tokens: array<{TOKEN}>>>"
)
ENVELOPE = (
    "source string, perSecond int, duration double, peaks string, segments array<struct<idx: int, start: double, `end`: double, "
    "text: string, confidence: double, words: array<array<string>>>>"
)
MIN_BYTES, MAX_PROMPT = 512, 300


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, sep="\t", header=True)


def read_archive_json(spark: SparkSession, path: str) -> DataFrame:
    a = spark.read.schema(ARCHIVE).option("multiLine", True).json(path)
    return a.select("subject", F.col("birthYear").alias("birth_year"), F.coalesce("language", F.lit("auto")).alias("language"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of recorded files; the column of file contents is never read."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", "length", F.element_at(F.split("path", "/"), -1).alias("file"))


def ingest_recordings(manifest: DataFrame, files: DataFrame, archives: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(recordings, rejects) from a manifest with archive_id, file, mime, recorded_at, prompt, source."""
    m = manifest.join(files.select("file", "length", "path"), "file", "left")
    m = m.join(archives.select(ARC, F.lit(True).alias("has_archive")), ARC, "left")
    reason = (
        F.when(F.col("has_archive").isNull(), "no archive")
        .when(F.col("length").isNull(), "file not found")
        .when(F.col("length") < MIN_BYTES, "recording is empty")
    )
    m = m.withColumn("reason", reason)
    by_name = F.lower(F.nullif(F.regexp_extract("file", r"(?i)\.([a-z0-9]{2,5})$", 1), F.lit("")))
    media = F.lower(F.trim(F.split(F.coalesce("mime", F.lit("")), ";")[0]))
    known = F.create_map(*[F.lit(x) for kv in L.MEDIA_EXTENSIONS.items() for x in kv])
    created = F.lit(now).cast("timestamp")
    good = m.where(F.col("reason").isNull()).select(
        ARC, F.sha2(F.concat_ws("/", ARC, "file"), 256).substr(1, 16).alias("recording_id"),
        F.when(F.col("source") == "recorded", "recorded").otherwise("imported").alias("source"),
        F.coalesce(F.try_to_timestamp("recorded_at"), created).alias("recorded_at"), created.alias("created_at"),
        F.col("file").alias("original_name"), F.col("mime"), F.coalesce(by_name, F.try_element_at(known, media), F.lit("bin")).alias("extension"),
        F.nullif(F.substring(F.trim(F.coalesce("prompt", F.lit(""))), 1, MAX_PROMPT), F.lit("")).alias("prompt"),
        F.lit(None).cast("double").alias("duration"), F.lit("preserving").alias("stage"), F.lit(0.0).alias("progress"),
        F.lit(None).cast("string").alias("failed_stage"), F.lit(None).cast("struct<message:string,detail:string>").alias("error"),
        F.lit(None).cast("string").alias("language"), F.create_map().cast("map<string,string>").alias("models"),
    )
    return good, m.where(F.col("reason").isNotNull()).select(ARC, "file", "reason")


def recording_of_path() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def read_asr_json(spark: SparkSession, path: str) -> DataFrame:
    """One recognizer JSON per recording to raw segments (recording_id, language, idx, start, end, text, words, confidence).

    The files carry raw bytes as Latin-1 characters, because a token may end inside a UTF-8 character.
    """
    raw = spark.read.schema(ASR).option("multiLine", True).option("encoding", "ISO-8859-1").json(path)
    raw = raw.select(recording_of_path().alias("recording_id"), F.col("result.language").alias("language"), F.posexplode("transcription").alias("seg", "s"))

    def decoded(c: Column) -> Column:
        return F.when(c.rlike("[^\\u0000-\\u00ff]"), c).otherwise(F.decode(F.encode(c, "ISO-8859-1"), "UTF-8"))

    text = F.trim(F.regexp_replace(decoded(F.col("s.text")), r"(?U)\s+", " "))
    seg = raw.select("recording_id", "language", "seg", text.alias("text"), F.col("s.offsets.from").alias("seg_from"),
                     F.col("s.offsets.to").alias("seg_to"), F.col("s.tokens").alias("tokens"))
    seg = seg.where((F.col("text") != "") & ~X.is_hallucination(F.col("text")))
    t = seg.select("recording_id", "seg", "seg_from", "seg_to", F.posexplode("tokens").alias("tok", "t"))
    t = t.select("recording_id", "seg", "tok", F.col("t.text").alias("text"), F.col("t.offsets.from").alias("t_from"),
                 F.col("t.offsets.to").alias("t_to"), F.col("t.p").alias("p"), "seg_from", "seg_to")
    w = words_from_tokens(t)
    rows = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "text", "p")))
    w = w.groupBy("recording_id", "seg").agg(
        F.transform(rows, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text"), r["p"].alias("p"))).alias("words"),
        F.round(F.avg("p"), 3).alias("confidence"),
    )
    seg = seg.drop("tokens").join(w, ["recording_id", "seg"], "left")
    seg = renumber(seg, ["recording_id"], "seg")
    return seg.select("recording_id", "language", "idx", (F.col("seg_from") / 1000).alias("start"), (F.col("seg_to") / 1000).alias("end"),
                      "text", "words", "confidence")


def asr_sentences(spark: SparkSession, path: str) -> DataFrame:
    return sentences_from_words(read_asr_json(spark, path))


def read_envelope_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(envelope, segments) from evidence JSON with base64 peaks."""
    e = spark.read.schema(ENVELOPE).option("multiLine", True).json(path).withColumn("recording_id", recording_of_path())

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rid, raw in zip(pdf["recording_id"], pdf["raw"]):
                frames = range(len(raw))
                yield pd.DataFrame({"recording_id": rid, "frame": frames, "peak": list(raw)})

    bytes_ = e.select("recording_id", F.unbase64("peaks").alias("raw")).where(F.col("raw").isNotNull())
    envelope = bytes_.mapInPandas(unpack, "recording_id string, frame int, peak int")
    s = e.select("recording_id", F.explode("segments").alias("s")).select("recording_id", "s.*")
    word = lambda w: F.struct(w[0].cast("double").alias("start"), w[1].cast("double").alias("end"), w[2].alias("text"), w[3].cast("double").alias("p"))
    segments = s.withColumn("words", F.transform("words", word)).select("recording_id", "idx", "start", "end", "text", "words", "confidence")
    return envelope, segments


def upsert_archives(old: DataFrame, new: DataFrame, as_of: int) -> DataFrame:
    """Last write wins per archive; invalid fields of a new row fall to NULL or 'auto'. Rows carry written_at."""
    year = F.col("birth_year")
    language = F.lower(F.trim("language"))
    clean = new.select(
        ARC, F.substring(F.trim("subject"), 1, 80).alias("subject"),
        F.when((year > 1850) & (year <= as_of), year).alias("birth_year"),
        F.when(language.rlike("^[a-z]{2}$"), language).otherwise("auto").alias("language"), "written_at",
    ).where(F.col("subject") != "")
    both = old.select(ARC, "subject", "birth_year", "language", "written_at", F.lit(0).alias("gen")).unionByName(clean.withColumn("gen", F.lit(1)))
    row = F.struct("subject", "birth_year", "language", "written_at")
    return both.groupBy(ARC).agg(F.max_by(row, F.struct("written_at", "gen")).alias("r")).select(ARC, "r.*")


CLAIM_JSON = (
    "people array<struct<segment: string, mention: string, name: string, relation: string, `explicit`: string>>, "
    "places array<struct<segment: string, mention: string, name: string, `explicit`: string>>, "
    "times array<struct<segment: string, mention: string, `explicit`: string, year_from: string, year_to: string, label: string, reason: string>>, "
    "life_stage struct<segment: string, mention: string, value: string, `explicit`: string>, themes array<string>, questions array<string>"
)


def parse_claims(raw: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(claims, stories' themes and questions) from model JSON; malformed parts become empty, not errors."""
    p = raw.withColumn("c", F.from_json(column, CLAIM_JSON))
    number = lambda c: F.coalesce(F.regexp_extract(c, r"^\s*(-?[0-9]+)\s*$", 1).try_cast("int"), F.lit(0))
    flag = lambda c: F.coalesce(~F.lower(c).isin("", "0", "null"), F.lit(False)) & (F.lower(c) != "false")
    text = lambda c: F.coalesce(c, F.lit(""))
    keep = [c for c in raw.columns if c != column]
    none_i, none_s = F.lit(None).cast("int"), F.lit(None).cast("string")

    def rows(field: str, kind: str, **own: Column) -> DataFrame:
        x = p.select(*keep, F.posexplode(f"c.{field}").alias("claim_no", "x"))
        cols = {"name": none_s, "relation": none_s, "year_from": none_i, "year_to": none_i, "label": none_s, "stage": none_s} | own
        return x.select(
            *keep, F.lit(kind).alias("kind"), "claim_no", *[v.alias(k) for k, v in cols.items()], text(F.col("x.mention")).alias("mention"),
            number(F.col("x.segment")).alias("segment"), F.coalesce(flag(F.col("x.explicit")), F.lit(False)).alias("explicit"))

    first = number(F.col("x.year_from"))
    last = number(F.col("x.year_to"))
    y0 = F.when(first > 0, first)
    times = rows("times", "time", year_from=y0, year_to=F.when(last > 0, last).otherwise(y0), label=text(F.col("x.label")))
    people = rows("people", "person", name=text(F.col("x.name")), relation=text(F.col("x.relation")))
    places = rows("places", "place", name=text(F.col("x.name")))
    s = p.where(F.col("c.life_stage.value").isin(*L.STAGE_AGES))
    stage = s.select(
        *keep, F.lit("life_stage").alias("kind"), F.lit(0).alias("claim_no"), none_s.alias("name"), none_s.alias("relation"), none_i.alias("year_from"),
        none_i.alias("year_to"), none_s.alias("label"), F.col("c.life_stage.value").alias("stage"), text(F.col("c.life_stage.mention")).alias("mention"),
        number(F.col("c.life_stage.segment")).alias("segment"), F.coalesce(flag(F.col("c.life_stage.explicit")), F.lit(False)).alias("explicit"))
    claims = people.unionByName(places).unionByName(times).unionByName(stage)
    empty = F.array().cast("array<string>")
    about = p.select(
        *keep,
        F.slice(F.array_distinct(F.filter(F.coalesce("c.themes", empty), lambda t: t.isin(*L.THEMES))), 1, 3).alias("themes"),
        F.slice(F.filter(F.transform(F.coalesce("c.questions", empty), lambda q: F.trim(q)), lambda q: q != ""), 1, 2).alias("questions"))
    return claims, about


def parse_drafts(raw: DataFrame, column: str = "json") -> DataFrame:
    schema = "stories array<struct<first_segment: string, last_segment: string, title: string, quote_segment: string>>"
    p = raw.withColumn("c", F.from_json(column, schema))
    x = p.select(*[c for c in raw.columns if c != column], F.posexplode("c.stories").alias("draft_no", "x"))
    number = lambda c: F.coalesce(F.regexp_extract(c, r"^\s*(-?[0-9]+)\s*$", 1).try_cast("int"), F.lit(0))
    return x.select(
        *[c for c in raw.columns if c != column], "draft_no", number(F.col("x.first_segment")).alias("first_segment"),
        number(F.col("x.last_segment")).alias("last_segment"), F.coalesce("x.title", F.lit("")).alias("title"),
        number(F.col("x.quote_segment")).alias("quote_segment"))
