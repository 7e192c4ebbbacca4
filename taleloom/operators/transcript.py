"""Transcript shaping: words, sentences, story spans, chunks, paragraphs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..session import cut_lineage
from .ordered import BLOCK, greedy_chain, in_spans, islands, neighbours, running

REC = ("recording_id",)


def join_sorted(order: str, text: str, sep: str = " ") -> Column:
    """Texts of a bounded group in order, as one string."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def renumber(df: DataFrame, keys: Sequence[str], pos: str, name: str = "idx", block: int = BLOCK) -> DataFrame:
    """Dense numbers 0, 1, 2, … in the order of an integer position."""
    out = running(df, keys, [pos], {"__n": ("sum", F.lit(1))}, F.floor(F.col(pos) / block))
    return out.withColumn(name, (F.col("__n") - 1).cast("int")).drop("__n")


def last_indices(segments: DataFrame, keys: Sequence[str] = REC) -> DataFrame:
    return segments.groupBy(*keys).agg(F.max("idx").alias("last_idx"))


def words_from_tokens(tokens: DataFrame) -> DataFrame:
    """Recognizer tokens (recording_id, seg, tok, text, t_from, t_to, p, seg_from, seg_to; ms) to timed words.

    The window partitions hold the tokens of one recognizer segment, which arrive in one input row.
    """
    special = F.col("text").startswith("[_") | F.col("text").startswith("<|")
    t = tokens.where(~special & F.col("t_from").isNotNull())
    by_seg = Window.partitionBy("recording_id", "seg")
    ordered = by_seg.orderBy("tok")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v0, v1 = F.first("t_from").over(whole), F.last("t_to").over(whole)
    span = (F.col("seg_to") - F.col("seg_from")).cast("double")
    scale = F.when(v1 > v0, span / (v1 - v0)).otherwise(F.lit(1.0))

    def place(ms: Column) -> Column:
        moved = F.col("seg_from") + (ms - F.col("v0")) * F.col("scale")
        return F.least(F.col("seg_to").cast("double"), F.greatest(F.col("seg_from").cast("double"), moved)) / 1000

    wide = F.col("text").rlike("[^\\u0000-\\u00ff]")
    raw = F.hex(F.when(wide, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1")))
    t = t.withColumn("v0", v0).withColumn("scale", scale).withColumn("raw", raw)
    t = t.withColumn("word", F.sum(F.col("text").startswith(" ").cast("int")).over(ordered))
    pieces = F.array_sort(F.collect_list(F.struct("tok", "raw")))
    w = t.groupBy("recording_id", "seg", "word").agg(
        F.trim(F.decode(F.unhex(F.array_join(F.transform(pieces, lambda r: r["raw"]), "")), "UTF-8")).alias("text"),
        F.min_by(place(F.col("t_from")), "tok").alias("start"),
        F.max_by(place(F.col("t_to")), "tok").alias("end"),
        F.round(F.coalesce(F.avg("p"), F.lit(1.0)), 3).alias("p"),
    )
    w = w.where(F.col("text") != "")
    pos = (F.row_number().over(by_seg.orderBy("word")) - 1).alias("pos")
    return w.select("recording_id", "seg", pos, "start", "end", "text", "p")


def sentences_from_words(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Re-cut recognizer segments (idx, start, end, text, words, confidence) into sentences.

    Long form: word k of the recording has position `at`; a segment without words is one unbreakable piece.
    """
    timed = F.size(F.coalesce("words", F.array())) > 0
    seg = segments.withColumn("n", F.when(timed, F.size("words")).otherwise(1))
    seg = running(seg, REC, ["idx"], {"upto": ("sum", F.col("n"))}, F.floor(F.col("idx") / block))
    piece = F.when(timed, F.col("words")).otherwise(
        F.array(
            F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("text").alias("text"),
                     F.col("confidence").alias("p"))
        )
    )
    w = seg.select("recording_id", "idx", (F.col("upto") - F.col("n")).alias("base"), (~timed).alias("whole"), "n",
                   F.posexplode(piece).alias("k", "w"))
    w = w.select("recording_id", "idx", (F.col("base") + F.col("k")).alias("at"), "whole",
                 (F.col("k") == F.col("n") - 1).alias("ends_segment"), "w.*")
    w = neighbours(
        w, REC, "at",
        {"next_text": (F.col("text"), 1), "next_start": (F.col("start"), 1), "prev_end": (F.col("end"), -1),
         "prev_whole": (F.col("whole"), -1)}, block,
    )
    ends = F.col("text").rlike('[.!?…]["”»)]?$') & (
        F.col("ends_segment")
        | F.col("next_text").rlike('^[\\p{Lu}¿¡"“]')
        | (F.col("next_start") - F.col("end") > L.SENTENCE_SHORT_PAUSE)
    )
    w = neighbours(w.withColumn("closes", ends), REC, "at", {"prev_closes": (F.col("closes"), -1)}, block)
    starts = (
        F.col("prev_end").isNull() | F.col("whole") | F.col("prev_whole") | F.col("prev_closes")
        | (F.col("start") - F.col("prev_end") > L.SENTENCE_PAUSE)
    )
    w = islands(w, REC, "at", starts, "run", block)
    w = w.withColumn("part", F.floor((F.col("at") - F.col("run")) / L.SENTENCE_WORDS))
    rows = F.array_sort(F.collect_list(F.struct("at", "start", "end", "text", "p")))
    s = w.groupBy("recording_id", "run", "part").agg(
        rows.alias("rows"), F.bool_or("whole").alias("whole"), F.avg("p").alias("mean_p"), F.min("at").alias("at")
    )
    s = s.select(
        "recording_id", "at",
        F.element_at("rows", 1)["start"].alias("start"),
        F.element_at("rows", -1)["end"].alias("end"),
        F.array_join(F.transform("rows", lambda r: r["text"]), " ").alias("text"),
        F.when(~F.col("whole"), F.transform("rows", lambda r: F.struct(
            r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text"), r["p"].alias("p")))).alias("words"),
        F.when(F.col("whole"), F.col("mean_p")).otherwise(F.round("mean_p", 3)).alias("confidence"),
    )
    s = renumber(s.where(~X.is_hallucination(F.col("text"))), REC, "at", "idx", block)
    return s.select("recording_id", "idx", "start", "end", "text", "words", "confidence")


def _times(spans: DataFrame, segments: DataFrame, first: str = "seg_start", last: str = "seg_end") -> DataFrame:
    """Start and end seconds of closed segment spans."""
    a = segments.select("recording_id", F.col("idx").alias(first), F.col("start").alias("start"))
    b = segments.select("recording_id", F.col("idx").alias(last), F.col("end").alias("end"))
    return spans.join(a, ["recording_id", first]).join(b, ["recording_id", last])


def best_quotes(spans: DataFrame, segments: DataFrame, keys: Sequence[str], preferred: str = "quote_segment") -> DataFrame:
    """One quotable segment per span (recording_id, *keys, seg_start, seg_end, preferred)."""
    s = spans.select("recording_id", *keys, "seg_start", "seg_end", F.col(preferred).alias("preferred"))
    n = segments.select("recording_id", "idx", X.word_count("text").alias("n"))
    hit = in_spans(n, s, REC, "idx", "seg_start", "seg_end")
    low, mid, high = L.QUOTE_WORDS
    mine = F.coalesce(F.col("idx") == F.col("preferred"), F.lit(False))
    level = (
        F.when(mine & F.col("n").between(low, high), 0).when(F.col("n").between(mid, high), 1).when(mine, 2).otherwise(3)
    )
    choice = F.struct(level.alias("level"), F.when(level == 1, -F.col("n")).otherwise(0).alias("w"), F.col("idx").alias("idx"))
    return hit.groupBy("recording_id", *keys).agg(F.min(choice)["idx"].alias("quote_seg"))


def plan_stories(drafts: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ordered, non-overlapping stories from proposed spans (recording_id, draft_no, first_segment, last_segment, …)."""
    ext = last_indices(segments)
    d = drafts.join(ext, "recording_id")

    def clamp(c: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("last_idx"), F.floor(F.col(c) + F.lit(0.5)).cast("int")))

    d = d.select(
        "recording_id", "draft_no", "title", "quote_segment",
        F.least(clamp("first_segment"), clamp("last_segment")).alias("a"),
        F.greatest(clamp("first_segment"), clamp("last_segment")).alias("b"),
    ).withColumn("neg_b", -F.col("b"))
    d = running(d, REC, ["a", "neg_b", "draft_no"], {"taken": ("max", F.col("b"))}, F.floor(F.col("a") / block), False)
    d = d.withColumn("a", F.when(F.col("a") <= F.col("taken"), F.col("taken") + 1).otherwise(F.col("a")).cast("int"))
    kept = renumber(d.where(F.col("a") <= F.col("b")), REC, "a", "ord", block).select(
        "recording_id", "ord", "title", "quote_segment", "a", "b"
    )

    kept = cut_lineage(neighbours(kept, REC, "ord", {"prev_b": (F.col("b"), -1), "next_a": (F.col("a"), 1)}, block))
    gap = kept.where(
        (F.col("a") - F.col("prev_b")).between(2, L.STORY_GAP_SEGMENTS + 1)
    ).select("recording_id", "ord", F.explode(F.sequence(F.col("prev_b") + 1, F.col("a") - 1)).alias("idx"))
    asks = F.trim("text").endswith("?")
    seg = segments.select("recording_id", "idx", "start", "end", asks.alias("asks"),
                          X.word_count("text").alias("n"))
    closed = (
        gap.join(seg, ["recording_id", "idx"])
        .groupBy("recording_id", "ord")
        .agg(
            (F.max_by("end", "idx") - F.min_by("start", "idx")).alias("seconds"),
            F.coalesce(F.min(F.when(F.col("asks"), F.col("idx"))), F.max("idx") + 1).alias("split"),
        )
        .where(F.col("seconds") <= L.STORY_GAP_SECONDS)
        .select("recording_id", "ord", F.col("split").cast("int").alias("split"))
    )
    back = kept.where((F.col("ord") == 0) & (F.col("a") > 0)).select(
        "recording_id", "ord", "a",
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("a") - L.STORY_GAP_SEGMENTS), F.col("a") - 1)).alias("idx"),
    )
    opened = (
        back.join(seg, ["recording_id", "idx"])
        .groupBy("recording_id", "ord")
        .agg(
            F.coalesce(
                F.max(F.when(~(F.col("asks") & (F.col("n") >= 5)), F.col("idx"))) + 1, F.min("idx")
            ).cast("int").alias("opened")
        )
    )
    before = closed.withColumn("ord", F.col("ord") - 1).withColumnRenamed("split", "next_split")
    p = (
        kept.join(closed, ["recording_id", "ord"], "left")
        .join(before, ["recording_id", "ord"], "left")
        .join(opened, ["recording_id", "ord"], "left")
    )
    p = p.select(
        "recording_id", "ord", "title", "quote_segment",
        F.coalesce("split", F.least("opened", "a"), "a").alias("seg_start"),
        F.coalesce(F.col("next_split") - 1, F.col("b")).alias("seg_end"),
        (F.col("prev_b").isNull() & F.col("next_a").isNull()).alias("alone"),
    )
    p = _times(p, segments)
    p = cut_lineage(p.where(F.col("alone") | (F.col("end") - F.col("start") >= L.STORY_SECONDS)))
    q = best_quotes(p, segments, ["ord"])
    text = segments.select("recording_id", F.col("idx").alias("quote_seg"), F.col("text").alias("quote_text"))
    p = p.join(q, ["recording_id", "ord"]).join(text, ["recording_id", "quote_seg"])
    title = F.coalesce(F.nullif(X.clean_title(F.col("title")), F.lit("")), X.fallback_title(F.col("quote_text")))
    p = renumber(p.withColumn("title", title).withColumnRenamed("ord", "__ord"), REC, "__ord", "ord", block)
    return p.select("recording_id", "ord", "seg_start", "seg_end", "start", "end", "title", "quote_seg")


def uncovered(stories: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Maximal runs of segments in no story, from the spans alone: (recording_id, seg_from, seg_to)."""
    s = stories.select("recording_id", "seg_start", "seg_end")
    s = running(s, REC, ["seg_start", "seg_end"], {"reach": ("max", F.col("seg_end"))},
                F.floor(F.col("seg_start") / block), False)
    inner = s.select("recording_id", (F.coalesce("reach", F.lit(-1)) + 1).alias("seg_from"),
                     (F.col("seg_start") - 1).alias("seg_to"))
    tail = (
        last_indices(segments)
        .join(s.groupBy("recording_id").agg(F.max("seg_end").alias("e")), "recording_id", "left")
        .select("recording_id", (F.coalesce("e", F.lit(-1)) + 1).alias("seg_from"), F.col("last_idx").alias("seg_to"))
    )
    out = inner.unionByName(tail).where(F.col("seg_from") <= F.col("seg_to"))
    return out.select("recording_id", F.col("seg_from").cast("int").alias("seg_from"), F.col("seg_to").cast("int").alias("seg_to"))


def retry_worklist(stories: DataFrame, segments: DataFrame) -> DataFrame:
    u = _times(uncovered(stories, segments).where(F.col("seg_to") > F.col("seg_from")), segments, "seg_from", "seg_to")
    return u.where(F.col("end") - F.col("start") >= L.RETRY_SECONDS)


def attach_leftovers(stories: DataFrame, segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every uncovered run joins the story before it, or the first story: `ord` numbers stories in order."""
    s = neighbours(stories.drop("start", "end"), REC, "ord", {"next_start": (F.col("seg_start"), 1)}, block)
    s = s.join(last_indices(segments), "recording_id")
    s = s.withColumn("seg_end", F.coalesce(F.col("next_start") - 1, F.col("last_idx")).cast("int"))
    s = s.withColumn("seg_start", F.when(F.col("ord") == 0, 0).otherwise(F.col("seg_start")).cast("int"))
    return _times(s.drop("next_start", "last_idx"), segments)


def match_previous(planned: DataFrame, previous: DataFrame, slot_seconds: int = 600) -> DataFrame:
    """A re-planned story inherits the id of the old story it overlaps by at least half of their union.

    Such a pair contains each other's midpoints, so a point-in-span join finds all of them without pairing a recording
    with itself.
    """
    p = planned.withColumn("middle", (F.col("start") + F.col("end")) / 2)
    o = previous.select(
        "recording_id", F.col("story_id").alias("old_id"), F.col("start").alias("old_start"), F.col("end").alias("old_end"),
        F.col("title").alias("old_title"), F.col("title_by").alias("old_by"),
    )
    pairs = in_spans(p, o, REC, "middle", "old_start", "old_end", block=slot_seconds)
    union = F.greatest("end", "old_end") - F.least("start", "old_start")
    overlap = F.least("end", "old_end") - F.greatest("start", "old_start")
    pairs = pairs.withColumn("score", F.when(union > 0, overlap / union).otherwise(0.0)).where(F.col("score") >= 0.5)
    best = pairs.groupBy("recording_id", "ord").agg(
        F.min_by(F.struct("old_id", "old_title", "old_by", "score"), F.struct(-F.col("score"), F.col("old_start"))).alias("m")
    )
    best = best.select("recording_id", "ord", "m.*")
    best = best.groupBy("recording_id", "old_id").agg(
        F.min_by(F.struct("ord", "old_title", "old_by", "score"), "ord").alias("m")
    ).select("recording_id", "old_id", "m.*")
    out = planned.join(best, ["recording_id", "ord"], "left")
    family = F.coalesce(F.col("old_by") == "family", F.lit(False))
    return out.select(
        *[c for c in planned.columns if c != "title"],
        F.col("old_id").alias("story_id"),
        F.when(family, F.col("old_title")).otherwise(F.col("title")).alias("title"),
        F.when(family, F.lit("family")).otherwise(F.lit("archive")).alias("title_by"),
    )


def coverage_ranges(stories: DataFrame, segments: DataFrame) -> DataFrame:
    """Story spans and the runs between them, which together cover a recording."""
    own = stories.select("recording_id", F.col("seg_start").alias("seg_from"), F.col("seg_end").alias("seg_to"), "story_id")
    free = uncovered(stories, segments).withColumn("story_id", F.lit(None).cast(stories.schema["story_id"].dataType))
    return own.unionByName(free)


def _chunk_reach(v: dict[str, np.ndarray], stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(stop)
    heard = np.concatenate([[0], np.cumsum(v["n"])])
    j, live = np.arange(n), np.arange(n)
    while len(live):
        at = j[live]
        fits = at < stop[live]
        live, at = live[fits], at[fits]
        fits = (v["end"][at] - v["start"][live] < L.CHUNK_SECONDS) & (heard[at] - heard[live] < L.CHUNK_WORDS)
        live = live[fits]
        j[live] += 1
    i = np.arange(n)
    j = np.maximum(j, i + 1)
    return j - 1, np.where(j >= stop, stop, np.where(j - 1 > i, j - 1, j))


def build_chunks(segments: DataFrame, stories: DataFrame, block: int = BLOCK) -> DataFrame:
    """Overlapping search moments of about half a minute inside each story or uncovered run."""
    ranges = coverage_ranges(stories, segments)
    n = F.greatest(X.word_count("text"), F.lit(1))
    s = in_spans(segments.select("recording_id", "idx", "start", "end", n.alias("n")), ranges, REC, "idx", "seg_from", "seg_to")
    s = s.select("recording_id", "seg_from", (F.col("idx") - F.col("seg_from")).alias("pos"), "start", "end", "n")
    c = greedy_chain(s, ["recording_id", "seg_from"], "pos", ["start", "end", "n"], _chunk_reach, L.CHUNK_WORDS + 1, block)
    c = c.join(ranges.select("recording_id", "seg_from", "story_id"), ["recording_id", "seg_from"]).select(
        "recording_id", "story_id", (F.col("seg_from") + F.col("first")).cast("int").alias("seg_start"),
        (F.col("seg_from") + F.col("last")).cast("int").alias("seg_end"),
    )
    hit = in_spans(segments.select("recording_id", "idx", "start", "end", "text"), c, REC, "idx", "seg_start", "seg_end")
    return hit.groupBy("recording_id", "story_id", "seg_start", "seg_end").agg(
        F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), join_sorted("idx", "text").alias("text")
    )


def fallback_chunks(segments: DataFrame, stories: DataFrame, recordings: DataFrame) -> DataFrame:
    """Recordings whose interpretation failed are still searchable by their bare transcript."""
    failed = recordings.where(F.col("failed_stage") == "organizing").select("recording_id")
    return build_chunks(segments.join(failed, "recording_id", "left_semi"), stories.limit(0))


def _paragraph_reach(v: dict[str, np.ndarray], stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(stop)
    i = np.arange(n)
    heard = np.concatenate([[0], np.cumsum(v["n"])])
    j, live = i + 1, i
    for size in range(1, L.PARAGRAPH_SENTENCES):
        live = live[j[live] < stop[live]]
        at = j[live]
        joins = (v["start"][at] - v["end"][at - 1] < L.PARAGRAPH_GAP) & (heard[at + 1] - heard[live] <= L.PARAGRAPH_WORDS)
        live = live[joins]
        j[live] += 1
    return j - 1, j


def paragraphs(segments: DataFrame, block: int = BLOCK, keys: Sequence[str] = REC) -> DataFrame:
    """Reading paragraphs over dense `idx`: (keys, first, last, start, end, text)."""
    n = F.greatest(X.word_count("text"), F.lit(1))
    s = segments.withColumn("n", n)
    p = greedy_chain(s, keys, "idx", ["start", "end", "n"], _paragraph_reach, L.PARAGRAPH_SENTENCES, block)
    hit = in_spans(segments, p, keys, "idx", "first", "last")
    return hit.groupBy(*keys, "first", "last").agg(
        F.min_by("start", "idx").alias("start"), F.max_by("end", "idx").alias("end"), join_sorted("idx", "text").alias("text")
    )


def _token_reach(v: dict[str, np.ndarray], stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spent = np.concatenate([[0], np.cumsum(v["cost"])])
    i = np.arange(len(stop))
    j = np.searchsorted(spent, spent[i] + L.PROMPT_TOKENS, side="left") - 1
    j = np.minimum(np.maximum(j, i + 1), stop)
    return j - 1, j


def token_windows(segments: DataFrame, block: int = BLOCK) -> DataFrame:
    """Consecutive segments packed under a token budget."""
    s = segments.select("recording_id", "idx", (X.estimated_tokens("text") + L.TOKENS_PER_LINE).cast("long").alias("cost"))
    w = greedy_chain(s, REC, "idx", ["cost"], _token_reach, L.PROMPT_TOKENS // L.TOKENS_PER_LINE + 1, block)
    return w


def interpolated_words(segments: DataFrame) -> DataFrame:
    """Words with times; a segment without word timings gets equal slices."""
    def numbered(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: F.struct(i.alias("pos"), F.size(ws).alias("n"), w.alias("text")))

    # the number of words travels with each word: Spark would compute a slice above the explode, and so split the text once per word
    s = segments.select("recording_id", "idx", "start", "end", F.explode(X.once(X.words("text"), numbered)).alias("w"))
    span = (F.col("end") - F.col("start")) / F.col("w.n")
    return s.select(
        "recording_id", "idx", F.col("w.pos").alias("pos"), (F.col("start") + F.col("w.pos") * span).alias("start"),
        (F.col("start") + (F.col("w.pos") + 1) * span).alias("end"), F.col("w.text").alias("text"),
    )


def uncertain_words(words: DataFrame) -> DataFrame:
    return words.where(F.col("p") < L.UNCERTAIN_WORD)
