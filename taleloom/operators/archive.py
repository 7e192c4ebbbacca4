"""Joins and aggregates over stories, facts, entities and recordings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ordered import in_spans, top_k

ARC = "archive_id"


def annotated(stories: DataFrame) -> DataFrame:
    return stories.where("annotated")


def by_merge(entities: DataFrame) -> DataFrame:
    """Entities as the side of a join that is never sent whole through the driver: a table that grows with the archive, whose size
    on disk says little about its rows."""
    return entities.hint("merge")


def story_edges(mentions: DataFrame) -> DataFrame:
    """Distinct (archive, story, entity), dealt by story over as many tasks as a shuffle has: rows of three numbers are few bytes but much to sort
    and hash, so small partitions must not be merged into one task."""
    n = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mentions.select(ARC, "story_id", "entity_id").repartition(n, "story_id").distinct()


def pending_recordings(recordings: DataFrame) -> DataFrame:
    return recordings.where((F.col("stage") != "ready") & F.col("failed_stage").isNull()).orderBy("created_at", "recording_id")


def recording_outcome(recordings: DataFrame, segments: DataFrame, stories: DataFrame) -> DataFrame:
    n_seg = segments.groupBy("recording_id").agg(F.count("*").alias("n_segments"))
    n_sto = stories.groupBy("recording_id").agg(F.count("*").alias("n_stories"))
    r = recordings.join(n_seg, "recording_id", "left").join(n_sto, "recording_id", "left").fillna(0, ["n_segments", "n_stories"])
    outcome = (
        F.when(F.col("failed_stage").isNotNull(), "failed").when(F.col("stage") != "ready", "working")
        .when(F.col("n_stories") > 0, "stories").when(F.col("n_segments") > 0, "no-stories").otherwise("no-speech")
    )
    return r.select("recording_id", outcome.alias("outcome"), (F.col("n_segments") > 0).alias("has_transcript"), "n_stories")


def story_summaries(stories: DataFrame, recordings: DataFrame, segments: DataFrame) -> DataFrame:
    q = segments.select("recording_id", F.col("idx").alias("quote_seg"), F.col("text").alias("quote_text"),
                        F.col("start").alias("quote_start"), F.col("end").alias("quote_end"))
    r = recordings.select("recording_id", "language", "recorded_at")
    return stories.join(r, "recording_id").join(q, ["recording_id", "quote_seg"], "left")


def facts_of_stories(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    return facts.join(wanted.select("story_id").distinct(), "story_id", "left_semi").orderBy("story_id", "start", "fact_id")


def story_entity_edges(facts: DataFrame, stories: DataFrame | None = None) -> DataFrame:
    e = facts.where(F.col("entity_id").isNotNull()).select(ARC, "story_id", "entity_id").distinct()
    return e if stories is None else e.join(annotated(stories).select("story_id"), "story_id", "left_semi")


def related_stories(facts: DataFrame, stories: DataFrame, k: int = 3, hub: int = 1000, subset_limit: int = 8) -> DataFrame:
    """Per story the k annotated stories that share most entities; ties go to the lower story id.

    Entities with at most `hub` stories are self-joined, so a group emits at most hub² pairs. Stories that share only
    hub entities are found through an index from each set of hubs to its first k+1 stories: a story's full overlap with
    a true top-k partner is one of its own hub subsets, and at most k other stories can come before that partner there.
    Stories with more than `subset_limit` hubs take a direct join instead of the subset index.
    """
    left = story_entity_edges(facts)
    right = story_entity_edges(facts, stories)
    degree = right.groupBy(ARC, "entity_id").agg(F.count("*").alias("deg"))
    small = degree.where(F.col("deg") <= hub).select(ARC, "entity_id")
    big = degree.where(F.col("deg") > hub).select(ARC, "entity_id")
    b = lambda e: e.select(ARC, F.col("story_id").alias("other_id"), "entity_id")

    l_small, r_small = left.join(small, [ARC, "entity_id"]), right.join(small, [ARC, "entity_id"])
    near = (
        l_small.join(b(r_small), [ARC, "entity_id"])
        .where(F.col("story_id") != F.col("other_id"))
        .groupBy(ARC, "story_id", "other_id").agg(F.count("*").alias("n"))
    )
    l_big, r_big = left.join(big, [ARC, "entity_id"]), right.join(big, [ARC, "entity_id"])
    if big.isEmpty():
        return top_k(near, [ARC, "story_id"], [F.desc("n"), F.asc("other_id")], k)

    also = (
        near.select(ARC, "story_id", "other_id").join(l_big, [ARC, "story_id"]).join(b(r_big), [ARC, "other_id", "entity_id"])
        .groupBy(ARC, "story_id", "other_id").agg(F.count("*").alias("m"))
    )
    near = near.join(also, [ARC, "story_id", "other_id"], "left").select(
        ARC, "story_id", "other_id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")
    )

    def hub_sets(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        many = e.groupBy(ARC, "story_id").agg(F.count("*").alias("c"))
        few = e.join(many.where(F.col("c") <= subset_limit).select(ARC, "story_id"), [ARC, "story_id"])
        wide = e.join(many.where(F.col("c") > subset_limit).select(ARC, "story_id"), [ARC, "story_id"])
        sets = few.groupBy(ARC, "story_id").agg(F.sort_array(F.collect_list("entity_id")).alias("hubs"))
        masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("hubs")).cast("int") - 1)
        subset = F.transform(
            masks, lambda mask: F.filter("hubs", lambda _, i: mask.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0)
        )
        return sets.select(ARC, "story_id", F.explode(subset).alias("hubs")), wide

    l_few, l_wide = hub_sets(l_big)
    r_few, r_wide = hub_sets(r_big)
    index = top_k(r_few, [ARC, "hubs"], [F.asc("story_id")], k + 1, "__r").select(ARC, "hubs", F.col("story_id").alias("other_id"))
    far = (
        l_few.join(index, [ARC, "hubs"]).where(F.col("story_id") != F.col("other_id"))
        .groupBy(ARC, "story_id", "other_id").agg(F.max(F.size("hubs")).cast("long").alias("n"))
    )
    direct = l_wide.join(b(r_big), [ARC, "entity_id"]).unionByName(
        l_big.join(l_wide.select(ARC, "story_id").distinct(), [ARC, "story_id"], "left_anti").join(b(r_wide), [ARC, "entity_id"])
    )
    direct = (
        direct.where(F.col("story_id") != F.col("other_id"))
        .groupBy(ARC, "story_id", "other_id").agg(F.count("*").alias("n"))
    )
    every = near.unionByName(far).unionByName(direct).groupBy(ARC, "story_id", "other_id").agg(F.max("n").alias("n"))
    return top_k(every, [ARC, "story_id"], [F.desc("n"), F.asc("other_id")], k)


def shared_entities(pairs: DataFrame, facts: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities behind given story pairs, one row each."""
    e = story_entity_edges(facts)
    mine = pairs.select(ARC, "story_id", "other_id").join(e, [ARC, "story_id"])
    both = mine.join(e.withColumnRenamed("story_id", "other_id"), [ARC, "other_id", "entity_id"], "left_semi")
    return both.join(by_merge(entities.select(ARC, "entity_id", "name")), [ARC, "entity_id"])


def entity_only_in(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Per recording, how many entities occur in it and nowhere else."""
    one = (
        facts.where(F.col("entity_id").isNotNull()).groupBy(ARC, "entity_id")
        .agg(F.min("recording_id").alias("recording_id"), F.max("recording_id").alias("z"))
        .where(F.col("recording_id") == F.col("z"))
    )
    return one.join(by_merge(entities.select(ARC, "entity_id", "kind")), [ARC, "entity_id"]).groupBy(ARC, "recording_id", "kind").agg(
        F.count("*").alias("n")
    )


def drop_orphan_entities(entities: DataFrame, facts: DataFrame) -> DataFrame:
    used = facts.where(F.col("entity_id").isNotNull()).select(ARC, "entity_id").distinct()
    return entities.join(used, [ARC, "entity_id"], "left_semi")


def word_fact_overlap(words: DataFrame, facts: DataFrame, slot_seconds: int = 5) -> DataFrame:
    """Words highlighted by a fact: the word's midpoint lies in the fact's time."""
    w = words.withColumn("middle", (F.col("start") + F.col("end")) / 2)
    f = facts.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("kind") != "life_stage")).select(
        "story_id", "fact_id", (F.col("start") - 0.02).alias("f0"), (F.col("end") + 0.02).alias("f1")
    )
    return in_spans(w, f, ["story_id"], "middle", "f0", "f1", block=slot_seconds)


def segments_in_story_time(segments: DataFrame, stories: DataFrame, slack: float = 0.05, slot_seconds: int = 600) -> DataFrame:
    s = stories.select("recording_id", "story_id", (F.col("start") - slack).alias("t0"), (F.col("end") + slack).alias("t1"))
    hit = in_spans(segments, s, ["recording_id"], "start", "t0", "t1", block=slot_seconds)
    return hit.where(F.col("end") <= F.col("t1")).drop("t0", "t1")


def segment_story_map(segments: DataFrame, stories: DataFrame) -> DataFrame:
    s = stories.select("recording_id", "story_id", "title", F.explode(F.sequence("seg_start", "seg_end")).alias("idx"))
    return segments.select("recording_id", "idx").join(s, ["recording_id", "idx"])


def entity_detail(entities: DataFrame, facts: DataFrame, stories: DataFrame, segments: DataFrame) -> DataFrame:
    """Every moment of an entity in annotated stories, with the sentence behind it and where playback starts."""
    f = facts.select(ARC, "story_id", "recording_id", "entity_id", "fact_id", "seg", "start", "provenance", "evidence")
    s = annotated(stories).select("story_id", "title")
    t = segments.select("recording_id", F.col("idx").alias("seg"), F.col("text").alias("sentence"))
    d = f.join(entities.select(ARC, "entity_id", "kind", "name"), [ARC, "entity_id"]).join(s, "story_id")
    d = d.join(t, ["recording_id", "seg"], "left")
    return d.withColumn("cue", F.greatest(F.lit(0.0), F.col("start") - 1.2))


def story_links(focus: DataFrame, mentions: DataFrame) -> DataFrame:
    """Stories reachable from given focus stories through a shared entity, one row per (focus, story, entity).

    Only the focus stories are expanded, so the result grows with the links of those stories, not with all pairs.
    """
    e = mentions.select(ARC, "story_id", "entity_id").distinct()
    mine = e.join(focus.select(ARC, "story_id"), [ARC, "story_id"], "left_semi").withColumnRenamed("story_id", "focus_id")
    return mine.join(e, [ARC, "entity_id"]).where(F.col("story_id") != F.col("focus_id"))


def nearest_linked(focus: DataFrame, mentions: DataFrame, years: DataFrame, k: int = 3) -> DataFrame:
    """For each entity of a focus story, the k other stories nearest in year; ties go to the lower story id.

    No story pairs are formed: of each year on an entity's line only the k + 1 lowest stories can be chosen, and a focus story looks at its own
    year and at the k dated years to each side. An entity's line is as long as its years, however many stories it has.
    """
    y = years.where(F.col("year").isNotNull()).select("story_id", "year")
    on_line = story_edges(mentions).join(y, "story_id")
    lowest = top_k(on_line, [ARC, "entity_id", "year"], [F.asc("story_id")], k + 1, "__r")
    line = lowest.groupBy(ARC, "entity_id", "year").agg(F.array_sort(F.collect_list("story_id")).alias("ids"))
    w = Window.partitionBy(ARC, "entity_id").orderBy("year")
    point = F.struct("year", "ids")
    near = F.array(point, *(f(point, n).over(w) for n in range(1, k + 1) for f in (F.lag, F.lead)))
    line = line.select(ARC, "entity_id", "year", F.filter(near, lambda p: p.isNotNull()).alias("near"))
    asked = on_line.join(focus.select("story_id").distinct(), "story_id", "left_semi").withColumnRenamed("story_id", "focus_id")
    each = lambda p: F.transform(p["ids"], lambda s: F.struct(F.abs(p["year"] - F.col("year")).alias("years_apart"), s.alias("story_id")))
    x = asked.join(line, [ARC, "entity_id", "year"])
    others = F.filter(F.flatten(F.transform("near", each)), lambda c: c["story_id"] != F.col("focus_id"))
    x = x.select(ARC, "focus_id", "entity_id", F.posexplode(F.slice(F.array_sort(others), 1, k)).alias("at", "c"))
    return x.select(ARC, "focus_id", "entity_id", "c.story_id", "c.years_apart", (F.col("at") + 1).alias("rank"))


def entity_names(entities: DataFrame) -> DataFrame:
    """Every normalized name and alias of an entity."""
    names = F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array())), X.normalize))
    return entities.select(ARC, "kind", "entity_id", F.explode(names).alias("norm")).where(F.col("norm") != "")


def known_entity_flag(claims: DataFrame, entities: DataFrame) -> DataFrame:
    known = by_merge(entity_names(entities).select(ARC, "kind", "norm").distinct().withColumn("known", F.lit(True)))
    c = claims.withColumn("norm", X.normalize("name"))
    return c.join(known, [ARC, "kind", "norm"], "left").fillna(False, ["known"]).drop("norm")


# --- aggregates ----------------------------------------------------------------------------------------------------


def archive_stats(stories: DataFrame, recordings: DataFrame) -> DataFrame:
    s = annotated(stories).groupBy(ARC).agg(F.count("*").alias("stories"), F.sum(F.col("end") - F.col("start")).alias("story_seconds"))
    r = recordings.groupBy(ARC).agg(F.min("recorded_at").alias("first_recorded_at"), F.sum("duration").alias("recorded_seconds"))
    out = r.join(s, ARC, "left")
    return out.select(
        ARC, F.coalesce("stories", F.lit(0)).alias("stories"), F.coalesce("story_seconds", F.lit(0.0)).alias("story_seconds"),
        "first_recorded_at", F.coalesce("recorded_seconds", F.lit(0.0)).alias("recorded_seconds"),
    )


def entity_counts(entities: DataFrame, facts: DataFrame, stories: DataFrame) -> DataFrame:
    n = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    f = facts.where(F.col("entity_id").isNotNull()).select(ARC, "story_id", "entity_id").repartition(n, "story_id")
    f = f.join(annotated(stories).select("story_id"), "story_id", "left_semi")
    per_story = f.groupBy(ARC, "entity_id", "story_id").agg(F.count("*").alias("m"))
    n = per_story.groupBy(ARC, "entity_id").agg(F.count("*").alias("stories"), F.sum("m").alias("moments"))
    return by_merge(entities).join(n, [ARC, "entity_id"]).select(ARC, "entity_id", "kind", "name", "stories", "moments")


def known_entities(entities: DataFrame, facts: DataFrame, k: int = 60) -> DataFrame:
    """The k most used entities per archive and kind."""
    uses = facts.where(F.col("entity_id").isNotNull()).groupBy(ARC, "entity_id").agg(F.count("*").alias("uses"))
    e = by_merge(entities.select(ARC, "entity_id", "kind", "name")).join(uses, [ARC, "entity_id"])
    return top_k(e, [ARC, "kind"], [F.desc("uses"), F.asc("entity_id")], k)


def recognizer_hints(entities: DataFrame, facts: DataFrame, k: int = 40) -> DataFrame:
    """A hint line per archive: at most k distinct most used names, so the list is bounded by k."""
    uses = facts.where(F.col("entity_id").isNotNull()).groupBy(ARC, "entity_id").agg(F.count("*").alias("uses"))
    names = by_merge(entities.select(ARC, "entity_id", F.trim("name").alias("name")).where("name != ''")).join(uses, [ARC, "entity_id"])
    names = names.groupBy(ARC, "name").agg(F.max("uses").alias("uses"))
    best = top_k(names, [ARC], [F.desc("uses"), F.asc("name")], k)
    rows = F.array_sort(F.collect_list(F.struct("rank", "name")))
    return best.groupBy(ARC).agg(F.concat(F.array_join(F.transform(rows, lambda r: r["name"]), ", "), F.lit(".")).alias("hint"))


def theme_counts(stories: DataFrame) -> DataFrame:
    return annotated(stories).select(ARC, F.explode("themes").alias("theme")).groupBy(ARC, "theme").agg(F.count("*").alias("n"))


def counts_per_recording(rows: DataFrame) -> DataFrame:
    return rows.groupBy("recording_id").agg(F.count("*").alias("n"))


def recordings_by_month(recordings: DataFrame, stories: DataFrame) -> DataFrame:
    """Per archive and month (and per archive, month NULL): recordings, seconds, stories."""
    n = stories.groupBy("recording_id").agg(F.count("*").alias("stories"))
    r = recordings.join(n, "recording_id", "left").withColumn("month", F.date_trunc("month", "recorded_at"))
    return (
        r.rollup(ARC, "month")
        .agg(F.count("*").alias("recordings"), F.sum("duration").alias("seconds"), F.coalesce(F.sum("stories"), F.lit(0)).alias("stories"))
        .where(F.col(ARC).isNotNull())
    )


def stories_by_decade(life: DataFrame) -> DataFrame:
    """Stories per decade (undated as NULL) and certainty, with a subtotal per decade."""
    decade = (F.floor(F.col("sort_year") / 10) * 10).cast("int")
    return (
        life.withColumn("decade", decade)
        .rollup(ARC, "decade", "certainty")
        .agg(F.count("*").alias("stories"), F.grouping_id().alias("level"))
        .where(F.col("level").isin(0, 1))
        .select(ARC, "decade", F.when(F.col("level") == 0, F.col("certainty")).otherwise(F.lit("all")).alias("certainty"), "stories")
    )


def entity_timelines(mentions: DataFrame, years: DataFrame, entities: DataFrame) -> DataFrame:
    """First and last dated year of each entity, with dated and undated story counts."""
    e = story_edges(mentions).join(years.select("story_id", "year"), "story_id")
    t = e.groupBy(ARC, "entity_id").agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("year").alias("dated"),
        F.count_if(F.col("year").isNull()).alias("undated"),
    )
    return t.join(by_merge(entities.select(ARC, "entity_id", "kind", "name")), [ARC, "entity_id"])


def timeline_points(mentions: DataFrame, years: DataFrame) -> DataFrame:
    """The dated stories on each entity's line of years, one row per story."""
    return story_edges(mentions).join(years.where(F.col("year").isNotNull()).select("story_id", "year"), "story_id")


def years_covered(life: DataFrame, archives: DataFrame, as_of: int) -> DataFrame:
    n = life.where(F.col("year").isNotNull()).groupBy(ARC).agg(F.countDistinct("year").alias("years_with_story"))
    a = archives.select(ARC, (F.lit(as_of) - F.col("birth_year")).alias("years_lived"))
    return a.join(n, ARC, "left").fillna(0, ["years_with_story"])


def evidence_quality(facts: DataFrame) -> DataFrame:
    return facts.cube("kind", "provenance").agg(
        F.count("*").alias("facts"), F.count_if("is_primary").alias("primary_facts"), F.grouping_id().alias("level")
    )


def marks_quality(marks: DataFrame) -> DataFrame:
    return marks.groupBy("kind").pivot("status", ["kept", "refused"]).agg(F.count(F.lit(1))).fillna(0)


def rejection_quality(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("kind", "reason").agg(F.count("*").alias("n"))


def first_mention_per_entity(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(ARC, "story_id", "entity_id").agg(F.min("time").alias("first_time"))


def reach_of_story(mentions: DataFrame, years: DataFrame, events: DataFrame) -> DataFrame:
    """Earliest and latest year among a story, everything linked to it, and its anchored events.

    An entity's own year range already covers all its stories, so no story pairs are formed.
    """
    e = story_edges(mentions)
    span = (
        e.join(years.select("story_id", "year"), "story_id").groupBy(ARC, "entity_id")
        .agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    )
    linked = e.join(span, [ARC, "entity_id"]).select("story_id", "lo", "hi")
    own = years.select("story_id", F.col("year").alias("lo"), F.col("year").alias("hi"))
    said = events.where(F.col("anchored") & F.col("year").isNotNull()).select(
        "story_id", F.col("year").alias("lo"), F.col("year").alias("hi")
    )
    parts = reduce(DataFrame.unionByName, [linked, own, said])
    return parts.groupBy("story_id").agg(F.min("lo").alias("from_year"), F.max("hi").alias("to_year")).where(F.col("from_year").isNotNull())


def dedupe_questions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New questions whose normalized text is not yet in the archive; the first by id wins."""
    n = new.withColumn("norm", X.normalize("text")).where(F.col("norm") != "")
    old = existing.select(ARC, X.normalize("text").alias("norm")).distinct()
    fresh = n.join(old, [ARC, "norm"], "left_anti")
    first = fresh.groupBy(ARC, "norm").agg(F.min(F.struct("question_id", "story_id", "text")).alias("q"))
    return first.select(ARC, "q.*")


def top_open_questions(questions: DataFrame, k: int = 6) -> DataFrame:
    return top_k(questions.where(~F.col("dismissed")), [ARC], [F.desc("question_id")], k)


def mark_asked(questions: DataFrame, asked: DataFrame) -> DataFrame:
    """Dismiss every question whose text was asked."""
    hit = asked.select(ARC, "text").distinct().withColumn("hit", F.lit(True))
    q = questions.join(hit, [ARC, "text"], "left")
    return q.withColumn("dismissed", F.col("dismissed") | F.coalesce("hit", F.lit(False))).drop("hit")


def latest_ready_recording(recordings: DataFrame) -> DataFrame:
    r = recordings.where(F.col("stage") == "ready")
    return r.groupBy(ARC).agg(F.max_by("recording_id", F.struct("recorded_at", "recording_id")).alias("recording_id"))


def rename_stories(stories: DataFrame, renames: DataFrame) -> DataFrame:
    """Titles given by the family (at most 120 characters) replace those of the archive and stay."""
    r = renames.select("story_id", F.substring(F.trim("title"), 1, 120).alias("new_title")).where("new_title != ''")
    out = stories.join(r, "story_id", "left")
    given = F.col("new_title").isNotNull()
    return out.withColumn("title", F.coalesce("new_title", "title")).withColumn(
        "title_by", F.when(given, F.lit("family")).otherwise(F.col("title_by"))
    ).drop("new_title")


def clear_interpretation(stories: DataFrame, chunks: DataFrame, cleared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stories kept, chunks kept, previous spans of the cleared recordings)."""
    c = cleared.select("recording_id").distinct()
    previous = stories.join(c, "recording_id", "left_semi").select("recording_id", "story_id", "start", "end", "title", "title_by")
    return stories.join(c, "recording_id", "left_anti"), chunks.join(c, "recording_id", "left_anti"), previous


def restore_names_in_titles(stories: DataFrame, facts: DataFrame) -> DataFrame:
    """Write verified capitalized names in a title the way they were verified.

    Only names that occur in the title are gathered per story, and a title has at most 120 characters.
    """
    f = facts.where(F.col("kind").isin("person", "place") & X.is_capitalized(F.col("value"))).select("story_id", "fact_id", "value")
    hit = f.join(stories.select("story_id", "title"), "story_id").where(F.contains(F.lower("title"), F.lower("value")))
    hit = hit.groupBy("story_id", "value").agg(F.min("fact_id").alias("fact_id"))
    names = hit.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("fact_id", "value"))).alias("names"))

    def swap(title: Column, n: Column) -> Column:
        pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}])\Q"), n["value"], F.lit(r"\E(?![\p{L}])"))
        return F.regexp_replace(title, pattern, F.regexp_replace(n["value"], r"([\\$])", r"\\$1"))

    out = stories.join(names, "story_id", "left")
    return out.withColumn("title", F.coalesce(F.aggregate("names", F.col("title"), swap), F.col("title"))).drop("names")
