"""Dating of stories and the life model built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .archive import ARC, annotated, by_merge, story_edges, story_summaries
from .ordered import BLOCK, running, top_k


def _by_stage(stage: Column, pick: int, last_age: int | None = None) -> Column:
    out = F.lit(None).cast("int")
    for name, span in L.STAGE_AGES.items():
        age = last_age if (last_age and pick == 1 and name == "later_life") else span[pick]
        out = F.when(stage == name, age).otherwise(out)
    return out


def stage_year_span(rows: DataFrame, stage: str = "life_stage", birth: str = "birth_year", axis: bool = False) -> DataFrame:
    """First and last calendar year of a life stage; the axis of a life lets the last stage run longer."""
    last = L.AXIS_LAST_AGE if axis else None
    return rows.withColumn("stage_from", F.col(birth) + _by_stage(F.col(stage), 0)).withColumn(
        "stage_to", F.col(birth) + _by_stage(F.col(stage), 1, last)
    )


def provenance_rank(c: Column) -> Column:
    out = F.lit(9)
    for name, r in L.PROVENANCE_RANK.items():
        out = F.when(c == name, r).otherwise(out)
    return out


def best_date(facts: DataFrame, archives: DataFrame) -> DataFrame:
    """One date per story from its primary facts: strongest provenance, narrowest span, earliest year; else its stage."""
    f = facts.where("is_primary")
    order = F.struct("start", "fact_id")
    dated = F.col("kind") == "time"
    dated = dated & F.col("year_from").isNotNull() & (F.col("year_from") != 0)
    best_key = F.struct(
        provenance_rank(F.col("provenance")).alias("r"), (F.col("year_to") - F.col("year_from")).alias("w"),
        F.col("year_from").alias("y"), order.alias("o"),
    )
    per = f.groupBy(ARC, "story_id").agg(
        F.min_by(F.struct("value", "year_from", "year_to", "provenance"), F.when(dated, best_key)).alias("d"),
        F.min_by(F.struct("value", "provenance"), F.when(F.col("kind") == "life_stage", order)).alias("s"),
    )
    per = per.join(archives.select(ARC, "birth_year"), ARC, "left").select(
        ARC, "story_id", "birth_year", "d", "s", F.col("s.value").alias("life_stage")
    )
    per = stage_year_span(per)
    staged = F.col("d").isNull() & F.col("birth_year").isNotNull() & F.col("life_stage").isin("childhood", "youth")
    out = per.where(F.col("d").isNotNull() | F.col("s").isNotNull()).select(
        ARC, "story_id",
        F.coalesce("d.value", "life_stage").alias("label"),
        F.when(staged, F.col("stage_from")).otherwise(F.col("d.year_from")).alias("year_from"),
        F.when(staged, F.col("stage_to")).otherwise(F.col("d.year_to")).alias("year_to"),
        F.when(staged, F.lit("inferred")).otherwise(F.coalesce("d.provenance", "s.provenance")).alias("provenance"),
        "life_stage",
    )
    return out


def _wide_stage() -> Column:
    to = F.coalesce("year_to", "year_from")
    return F.col("life_stage").isNotNull() & (F.col("provenance") == "inferred") & (to - F.col("year_from") > 3)


def sort_year(dates: DataFrame) -> DataFrame:
    to = F.coalesce("year_to", "year_from")
    middle = F.col("year_from") + (to - F.col("year_from")) / 2
    return dates.withColumn("sort_year", F.when(_wide_stage(), middle).otherwise(F.col("year_from").cast("double")))


def certainty(dates: DataFrame) -> DataFrame:
    """Class, year and span of a date; needs birth_year for the age."""
    to = F.coalesce("year_to", "year_from")
    span = to - F.col("year_from")
    inferred = F.col("provenance") == "inferred"
    kind = (
        F.when(F.col("year_from").isNull(), "none").when(_wide_stage(), "stage")
        .when(span > 0, F.when(inferred, "approximate").otherwise("range"))
        .when(inferred, "approximate").otherwise("exact")
    )
    point = span == 0
    year = F.when(point, F.col("year_from")).otherwise(F.floor((F.col("year_from") + to) / 2 + 0.5)).cast("int")
    slack = F.when(point & inferred, 2).otherwise(0)
    d = dates.withColumn("certainty", kind).withColumn("year", year)
    d = d.withColumn("from_year", (F.col("year_from") - slack).cast("int")).withColumn("to_year", (to + slack).cast("int"))
    return d.withColumn("age", F.when(F.col("year") >= F.col("birth_year"), F.col("year") - F.col("birth_year")))


def when_display(dates: DataFrame) -> DataFrame:
    sure = F.col("certainty").isin("exact", "range")
    label = (
        F.when(F.col("certainty") == "none", "undated").when(sure, F.coalesce("label", F.col("year").cast("string")))
        .when(F.col("certainty") == "stage", F.concat(F.lit("["), F.col("label"), F.lit("]")))
        .otherwise(F.concat(F.lit("[c. "), F.col("year").cast("string"), F.lit("]")))
    )
    age = F.when(
        F.col("age").isNotNull() & ~F.col("certainty").isin("none", "stage"),
        F.concat(F.when(sure, F.lit("aged ")).otherwise(F.lit("about ")), F.col("age").cast("string")),
    )
    word = F.when(F.col("certainty") == "none", "none").otherwise(F.col("provenance"))
    return dates.withColumn("when_label", label).withColumn("age_label", age).withColumn("certainty_word", word)


def life_span(archives: DataFrame, life: DataFrame, as_of: int) -> DataFrame:
    first = life.groupBy(ARC).agg(F.min("from_year").alias("first_from"))
    a = archives.select(ARC, "birth_year").join(first, ARC, "left")
    return a.select(ARC, F.coalesce("birth_year", F.col("first_from") - 2, F.lit(as_of - 10)).alias("life_start"), F.lit(as_of).alias("life_end"))


def timeline_gaps(archives: DataFrame, life: DataFrame, as_of: int, minimum: int = 8, keep: int = 2) -> DataFrame:
    """The longest stretches of years without a story; the window runs over the distinct years of one life."""
    span = life_span(archives, life, as_of)
    reach = (
        life.where(F.col("year").isNotNull()).select(ARC, "from_year", "to_year").distinct()
        .select(ARC, F.explode(F.sequence("from_year", "to_year")).alias("y")).distinct()
    )
    reach = reach.join(span, ARC).where(F.col("y").between(F.col("life_start"), F.col("life_end"))).select(ARC, "y")
    ends = span.select(ARC, F.explode(F.array(F.col("life_start") - 1, F.col("life_end") + 1)).alias("y"))
    w = Window.partitionBy(ARC).orderBy("y")
    g = reach.unionByName(ends).withColumn("prev", F.lag("y").over(w)).where(F.col("y") - F.col("prev") - 1 >= minimum)
    g = g.select(ARC, (F.col("prev") + 1).alias("from_year"), (F.col("y") - 1).alias("to_year"))
    return top_k(g, [ARC], [F.desc(F.col("to_year") - F.col("from_year")), F.asc("from_year")], keep).drop("rank")


def part_of(stories: DataFrame, block: int = BLOCK) -> DataFrame:
    """Position of a story among those of its recording, and their number."""
    n = stories.groupBy("recording_id").agg(F.count("*").alias("parts"))
    s = running(stories, ["recording_id"], ["ord"], {"part": ("sum", F.lit(1))}, F.floor(F.col("ord") / block))
    return s.join(n, "recording_id").select("recording_id", "story_id", "part", "parts")


def overflow_clusters(life: DataFrame, max_rows: int = 6, reach: int = 1) -> DataFrame:
    """Stories past the sixth of a year, merged over adjacent years: (archive, from, to, story)."""
    y = life.where(F.col("year").isNotNull()).select(ARC, "story_id", "year", "recorded_at")
    shown = top_k(y, [ARC, "year"], [F.asc("recorded_at"), F.asc("story_id")], max_rows)
    extra = y.join(shown.select("story_id"), "story_id", "left_anti")
    years = extra.groupBy(ARC, "year").agg(F.count("*").alias("n"))
    w = Window.partitionBy(ARC).orderBy("year")
    years = years.withColumn("open", F.coalesce(F.col("year") - F.lag("year").over(w) > reach, F.lit(True)))
    years = years.withColumn("cluster", F.last(F.when(F.col("open"), F.col("year")), True).over(w))
    spans = years.groupBy(ARC, "cluster").agg(F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    member = years.select(ARC, "year", "cluster")
    return extra.join(member, [ARC, "year"]).join(spans, [ARC, "cluster"]).select(ARC, "from_year", "to_year", "story_id")


def mentions_union(facts: DataFrame, marks: DataFrame, entities: DataFrame) -> DataFrame:
    """Every timed mention of a person or place: facts and kept mention marks."""
    f = facts.where(
        F.col("entity_id").isNotNull() & F.col("kind").isin("person", "place") & F.col("start").isNotNull()
    ).select(ARC, "story_id", "entity_id", "kind", F.col("start").alias("time"))
    m = marks.where(
        (F.col("kind") == "mention") & (F.col("status") == "kept") & F.col("entity_id").isNotNull() & F.col("start").isNotNull()
    ).select(ARC, "story_id", "entity_id", F.col("start").alias("time"))
    m = m.join(by_merge(entities.where(F.col("kind").isin("person", "place")).select(ARC, "entity_id", "kind")), [ARC, "entity_id"])
    return f.unionByName(m)


def life_events(marks: DataFrame) -> DataFrame:
    return marks.where(
        (F.col("status") == "kept") & (F.col("kind") != "mention") & F.col("start").isNotNull() & F.col("value").isNotNull()
    ).select(ARC, "story_id", "kind", F.col("start").alias("time"), "evidence", "value", F.col("year_from").alias("year"), "anchored", "note")


def life_entities(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with the number of stories they occur in, ordered by reach."""
    n = story_edges(mentions).groupBy(ARC, "entity_id").agg(F.count("*").alias("stories"))
    relation = F.when(F.col("kind") == "person", F.col("relation"))
    return n.join(by_merge(entities.select(ARC, "entity_id", "kind", "name", relation.alias("relation"))), [ARC, "entity_id"])


def entities_by_reach(life_ents: DataFrame) -> DataFrame:
    return life_ents.orderBy(F.desc("stories"), F.collate("name", "UNICODE"), "entity_id")


def life_stories(
    archives: DataFrame, stories: DataFrame, recordings: DataFrame, segments: DataFrame, facts: DataFrame, marks: DataFrame,
    entities: DataFrame, questions: DataFrame,
) -> DataFrame:
    """One row per annotated story of a life. Mentions, events and envelopes stay in their own long tables, because a
    story may have any number of them; here are their counts."""
    s = annotated(story_summaries(stories, recordings, segments))
    d = best_date(facts, archives).drop(ARC)
    s = s.join(d, "story_id", "left").join(archives.select(ARC, "birth_year"), ARC, "left")
    s = certainty(sort_year(s))
    mentions = mentions_union(facts, marks, entities)
    named = mentions.select("story_id", "entity_id", "kind").distinct().groupBy("story_id").agg(
        F.count_if(F.col("kind") == "person").alias("people"), F.count_if(F.col("kind") == "place").alias("places")
    )
    said = mentions.groupBy("story_id").agg(F.count("*").alias("mentions"))
    events = life_events(marks).groupBy("story_id").agg(F.count("*").alias("events"))
    asked = questions.where(~F.col("dismissed")).groupBy("story_id").agg(F.count("*").alias("open_questions"))
    for part in (named, said, events, asked):
        s = s.join(part, "story_id", "left")
    s = s.fillna(0, ["people", "places", "mentions", "events", "open_questions"])
    return s.select(
        ARC, "story_id", "recording_id", "title", "language", "start", "end", (F.col("end") - F.col("start")).alias("duration"),
        "recorded_at", "label", "provenance", "life_stage", "certainty", "year", "from_year", "to_year", "sort_year", "age",
        "quote_text", "themes", "people", "places", "mentions", "events", "open_questions",
    )


def life_order(life: DataFrame) -> DataFrame:
    return life.orderBy(ARC, F.asc_nulls_last("year"), "recorded_at", "story_id")


def theme_filter(life: DataFrame, theme: str) -> DataFrame:
    return life.where(F.array_contains("themes", theme)).orderBy(F.asc_nulls_last("sort_year"), "recorded_at", "story_id")


def period_filter(life: DataFrame, first: int, last: int) -> DataFrame:
    return life.where(F.col("year").between(first, last)).orderBy("year", "story_id")


def live_stories(stories: DataFrame, facts: DataFrame, archives: DataFrame) -> DataFrame:
    """Stories of recordings in work with their date and what was found so far, one row per found name (or none)."""
    names = facts.where(F.col("is_primary") & F.col("kind").isin("person", "place")).select(
        "story_id", F.col("kind").alias("found"), F.col("value").alias("name"), "fact_id"
    )
    d = best_date(facts, archives).select("story_id", "label")
    return (
        stories.select(ARC, "recording_id", "story_id", "ord", "title", "annotated")
        .join(d, "story_id", "left").join(names, "story_id", "left")
    )


def embedding_documents(chunks: DataFrame, stories: DataFrame) -> DataFrame:
    c = chunks.join(stories.select("story_id", "title"), "story_id", "left")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("none"))
    return c.withColumn("embedding_text", F.format_string("title: %s | text: %s", title, F.col("text")))


def embedding_queries(queries: DataFrame) -> DataFrame:
    return queries.withColumn("embedding_text", F.concat(F.lit("task: search result | query: "), F.col("q")))


def story_page(story_ids: DataFrame, stories: DataFrame, segments: DataFrame, facts: DataFrame, questions: DataFrame) -> DataFrame:
    """Everything a story shows, one row per item: (story_id, section, ord, at, body)."""
    s = stories.join(story_ids.select("story_id").distinct(), "story_id", "left_semi")
    own = s.select("story_id")
    text = segments.join(
        s.select("story_id", "recording_id", F.explode(F.sequence("seg_start", "seg_end")).alias("idx")), ["recording_id", "idx"]
    )
    parts = [
        s.select("story_id", F.lit("story").alias("section"), F.lit(0).cast("long").alias("ord"), F.col("start").alias("at"),
                 F.to_json(F.struct("title", "title_by", "themes")).alias("body")),
        text.select("story_id", F.lit("transcript").alias("section"), F.col("idx").cast("long").alias("ord"), F.col("start").alias("at"),
                    F.to_json(F.struct("text", "end")).alias("body")),
        facts.join(own, "story_id", "left_semi").select(
            "story_id", F.lit("fact").alias("section"), F.col("fact_id").cast("long").alias("ord"), F.col("start").alias("at"),
            F.to_json(F.struct("kind", "value", "detail", "provenance", "evidence", "note", "is_primary")).alias("body")),
        questions.where(~F.col("dismissed")).join(own, "story_id", "left_semi").select(
            "story_id", F.lit("question").alias("section"), F.col("question_id").cast("long").alias("ord"), F.lit(None).cast("double").alias("at"),
            F.to_json(F.struct("text")).alias("body")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


