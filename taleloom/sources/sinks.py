"""Writing: replace by recording, full rebuilds, removal, filtered export, reports."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.archive import ARC, drop_orphan_entities


class GenerationTable:
    """A Parquet table in which the rows of a recording are replaced as a whole.

    A replacement writes its rows to `data/generation=n`, then the list of recordings it replaces to `log/generation=n`.
    Both are overwrites of their own folder, so a repeated attempt leaves one copy, and readers see a generation only
    when its log entry is there. Other recordings are not rewritten. `compact` folds generations into one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def replace(self, rows: DataFrame, recordings: DataFrame, generation: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/data/generation={generation}")
        recordings.select("recording_id").distinct().write.mode("overwrite").parquet(f"{self.path}/log/generation={generation}")

    def read(self) -> DataFrame:
        log = self.spark.read.schema("recording_id string, generation bigint").parquet(f"{self.path}/log")
        current = log.groupBy("recording_id").agg(F.max("generation").alias("generation"))
        data = self.spark.read.schema(f"{self.schema}, generation bigint").parquet(f"{self.path}/data")
        return data.join(current, ["recording_id", "generation"], "left_semi").drop("generation")

    def compact(self, target: str, generation: int = 0) -> GenerationTable:
        out = GenerationTable(self.spark, target, self.schema)
        rows = self.read()
        out.replace(rows.repartition("recording_id").sortWithinPartitions("recording_id"), rows, generation)
        return out


def replace_marks(marks: DataFrame, path: str) -> None:
    """A full rebuild replaces all marks."""
    marks.write.mode("overwrite").parquet(path)


def remove_recordings(tables: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """Drop recordings and everything that hangs on them; entities left without a fact go too."""
    r = removed.select("recording_id").distinct()
    gone = tables["stories"].join(r, "recording_id", "left_semi").select("story_id")
    out = {}
    for name, t in tables.items():
        if "recording_id" in t.columns:
            out[name] = t.join(r, "recording_id", "left_anti")
        elif "story_id" in t.columns:
            out[name] = t.join(gone, "story_id", "left_anti")
        else:
            out[name] = t
    if "entities" in out and "facts" in out:
        out["entities"] = drop_orphan_entities(out["entities"], out["facts"])
    return out


def snapshot(tables: dict[str, DataFrame], names: Iterable[str] | DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Keep the ready recordings with the given names and what belongs to them; write Parquet when a path is given."""
    r = tables["recordings"]
    if isinstance(names, DataFrame):
        wanted = r.join(names.select("original_name").distinct(), "original_name", "left_semi")
    else:
        wanted = r.where(F.col("original_name").isin(*names))
    keep = wanted.where(F.col("stage") == "ready").select("recording_id")
    out = remove_recordings(tables, r.join(keep, "recording_id", "left_anti"))
    if path:
        for name, t in out.items():
            t.write.mode("overwrite").parquet(f"{path}/{name}")
    return out


def patch_recordings(recordings: DataFrame, patches: DataFrame) -> DataFrame:
    """Partial update: a patch row names its columns in `fields`; the models map is merged key by key."""
    cols = [c for c in recordings.columns if c not in ("recording_id", ARC) and c in patches.columns]
    p = patches.select("recording_id", "fields", *[F.col(c).alias(f"new_{c}") for c in cols])
    j = recordings.join(p, "recording_id", "left")
    given = lambda c: F.coalesce(F.array_contains("fields", c), F.lit(False))

    def merged(old: str, new: str):
        o = F.coalesce(F.col(old), F.create_map().cast("map<string,string>"))
        n = F.coalesce(F.col(new), F.create_map().cast("map<string,string>"))
        return F.map_concat(F.map_filter(o, lambda k, _: ~F.map_contains_key(n, k)), n)

    values = []
    for c in recordings.columns:
        if c not in cols:
            values.append(F.col(c))
        elif c == "models":
            values.append(F.when(given(c), merged("models", "new_models")).otherwise(F.col(c)).alias(c))
        else:
            values.append(F.when(given(c), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c))
    return j.select(*values)


def archive_report(
    stories: DataFrame, transcript: DataFrame, facts: DataFrame, entities: DataFrame, rejections: DataFrame, marks: DataFrame,
    questions: DataFrame, mentions: DataFrame, path: str | None = None,
) -> DataFrame:
    """Everything known about every story, one row per line of the report: (archive, story, section, at, n, body JSON).

    `transcript` is the join of segments to story times. A story may have any number of lines, so they are kept as rows,
    sorted on write, instead of one nested value.
    """
    e = entities.select(ARC, "entity_id", F.col("name").alias("entity"), "relation")
    named = facts.join(e, [ARC, "entity_id"], "left")
    marked = marks.join(e, [ARC, "entity_id"], "left")
    shown = mentions.join(e, [ARC, "entity_id"], "left")

    def part(df: DataFrame, section: str, at, n, *fields: str) -> DataFrame:
        return df.select("story_id", F.lit(section).alias("section"), at.cast("double").alias("at"), n.cast("bigint").alias("n"),
                         F.to_json(F.struct(*[F.col(f) for f in fields])).alias("body"))

    none = F.lit(None)
    parts = [
        part(stories, "1 story", F.col("start"), F.lit(0), "title", "start", "end"),
        part(transcript, "2 transcript", F.col("start"), F.col("idx"), "start", "text"),
        part(named, "3 fact", F.col("start"), F.col("fact_id"), "kind", "value", "entity", "relation", "provenance", "evidence", "note"),
        part(rejections, "4 rejected", none, F.col("claim_no"), "kind", "value", "mention", "reason"),
        part(marked, "5 mark", F.col("start"), F.lit(0), "kind", "status", "value", "entity", "year_from", "evidence", "reason", "note"),
        part(shown, "6 shown", F.col("time"), F.lit(0), "kind", "entity", "time"),
        part(questions.where(~F.col("dismissed")), "7 question", none, F.col("question_id"), "text"),
    ]
    lines = reduce(DataFrame.unionByName, parts).join(stories.select("story_id", ARC), "story_id")
    if path:
        out = lines.repartitionByRange(ARC, "story_id", "section").sortWithinPartitions(ARC, "story_id", "section", "at", "n")
        out.write.mode("overwrite").json(path)
    return lines
