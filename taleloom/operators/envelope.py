"""Loudness envelopes: levels, pauses, rhythm. An envelope is long form (recording_id, frame, peak 0-255)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .ordered import BLOCK, in_spans, islands, neighbours, running

REC = ["recording_id"]
RATE = L.FRAMES_PER_SECOND


def round_half_up(c: Column, digits: int = 0) -> Column:
    scale = 10**digits
    return F.floor(c * scale + 0.5) / scale


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles from value counts, for values of a limited range (levels, frame counts).

    The window runs over the distinct values of a key, not over its rows.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    by = Window.partitionBy(*keys)
    upto = counts.withColumn("__upto", F.sum("__n").over(by.orderBy(value))).withColumn("__all", F.sum("__n").over(by))
    aggs = []
    for name, q in wanted.items():
        at = (F.col("__all") - 1) * F.lit(q)
        low = F.min(F.when(F.col("__upto") > F.floor(at), F.col(value)))
        high = F.min(F.when(F.col("__upto") > F.ceil(at), F.col(value)))
        share = F.first(at - F.floor(at))
        aggs.append((low + (high - low) * share).alias(name))
    return upto.groupBy(*keys).agg(*aggs, F.first("__all").alias("n_values"))


def envelope_from_samples(samples: DataFrame, per_bucket: int = 800) -> DataFrame:
    """16-bit samples (recording_id, i, v) to loudness peaks, 20 per second."""
    v = F.col("v") / 32768.0
    rms = samples.groupBy("recording_id", F.floor(F.col("i") / per_bucket).alias("frame")).agg(
        F.sqrt(F.avg(v * v)).cast("float").alias("rms")
    )
    counts = rms.groupBy("recording_id", "rms").agg(F.count("*").alias("n"))
    upto = running(counts, REC, ["rms"], {"upto": ("sum", F.col("n"))}, F.floor(F.col("rms") * 1024))
    upto = upto.join(counts.groupBy(*REC).agg(F.sum("n").alias("total"), F.max("rms").alias("loudest")), REC)
    ref = upto.groupBy(*REC).agg(
        F.min(F.when(F.col("upto") > F.floor(F.col("total") * 0.985), F.col("rms"))).alias("r"), F.first("loudest").alias("loudest")
    )
    ref = ref.select(
        *REC, F.when(F.col("r") > 0, F.col("r")).when(F.col("loudest") > 0, F.col("loudest")).otherwise(1.0).alias("ref")
    )
    peak = round_half_up(F.sqrt(F.least(F.lit(1.0), F.col("rms").cast("double") / F.col("ref"))) * 255)
    return rms.join(ref, REC).select("recording_id", F.col("frame").cast("int").alias("frame"), peak.cast("int").alias("peak"))


def detect_pauses(envelope: DataFrame, per_second: int = RATE, block: int = BLOCK) -> DataFrame:
    """Silences of a quarter second or more between two stretches of speech."""
    level = 20 * F.log10(F.greatest(F.pow(F.col("peak") / 255, F.lit(2)), F.lit(1e-4)))
    e = envelope.select("recording_id", "frame", level.alias("level"))
    q = quantiles(e, REC, "level", {"low": 0.1, "high": 0.9})
    q = q.where((F.col("n_values") >= 2 * per_second) & (F.col("high") - F.col("low") >= 6))
    q = q.select("recording_id", (F.col("low") + (F.col("high") - F.col("low")) * 0.3).alias("threshold"))
    e = e.join(q, REC).select("recording_id", "frame", (F.col("level") < F.col("threshold")).alias("silent"))
    bridge, shortest = round(0.1 * per_second), round(0.25 * per_second)
    around = {f"s{o}": (F.col("silent"), o) for o in range(-bridge, bridge + 1) if o}
    e = neighbours(e, REC, "frame", around, block)
    short = F.lit(False)
    for a in range(1, bridge + 1):
        for b in range(1, bridge + 2 - a):
            short = short | (F.coalesce(f"s-{a}", F.lit(False)) & F.coalesce(f"s{b}", F.lit(False)))
    speech = e.where(~F.col("silent") & ~short).select("recording_id", "frame")
    speech = running(speech, REC, ["frame"], {"prev": ("last", F.col("frame"))}, F.floor(F.col("frame") / block), False)
    p = speech.where(F.col("frame") - F.col("prev") - 1 >= shortest)
    return p.select(
        "recording_id", ((F.col("prev") + 1) / per_second).alias("start"), (F.col("frame") / per_second).alias("end"),
        ((F.col("frame") - F.col("prev") - 1) / per_second).alias("duration"),
    )


def boundary_pauses(pauses: DataFrame, segments: DataFrame, slot_seconds: int = 4, block: int = BLOCK) -> DataFrame:
    """Longest pause at each boundary between two sentences (recording_id, after, duration)."""
    timed = F.size(F.coalesce("words", F.array())) > 0
    s = segments.select(
        "recording_id", "idx",
        F.when(timed, F.get("words", F.lit(0))["start"]).otherwise(F.col("start")).alias("opens"),
        F.when(timed, F.try_element_at("words", F.lit(-1))["end"]).otherwise(F.col("end")).alias("closes"),
    )
    b = neighbours(s, REC, "idx", {"next_opens": (F.col("opens"), 1)}, block).where(F.col("next_opens").isNotNull())
    b = b.select("recording_id", F.col("idx").alias("after"), F.least("closes", "next_opens").alias("b_from"),
                 F.greatest("closes", "next_opens").alias("b_to"))
    slack = 0.75

    def slots(a: Column, z: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / slot_seconds), F.floor(z / slot_seconds)))

    b = b.withColumn("slot", slots(F.col("b_from") - slack, F.col("b_to") + slack))
    p = pauses.withColumn("slot", slots(F.col("start"), F.col("end")))
    near = p.join(b, ["recording_id", "slot"])
    distance = F.greatest(F.lit(0.0), F.col("b_from") - F.col("end"), F.col("start") - F.col("b_to"))
    offset = F.abs((F.col("b_from") + F.col("b_to")) / 2 - (F.col("start") + F.col("end")) / 2)
    near = near.select("recording_id", "start", "duration", "after", distance.alias("distance"), offset.alias("offset"))
    best = near.where(F.col("distance") <= slack).groupBy("recording_id", "start", "duration").agg(
        F.min(F.struct("distance", "offset", "after"))["after"].alias("after")
    )
    return best.groupBy("recording_id", "after").agg(F.max("duration").alias("duration"))


def pause_cues(between: DataFrame) -> DataFrame:
    """Boundaries whose pause is clearly longer than this speaker's median pause."""
    typical = quantiles(between, REC, "duration", {"typical": 0.5}).where(F.col("n_values") >= 5)
    c = between.join(typical, REC).withColumn("ratio", F.col("duration") / F.col("typical")).where(F.col("ratio") >= 1.5)
    return c.select(
        "recording_id", "after", round_half_up(F.col("duration"), 1).alias("duration"),
        round_half_up(F.col("ratio"), 1).alias("ratio"), round_half_up(F.col("typical"), 1).alias("typical"),
    )


def _plain(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\.0$", "")


def transcript_lines(segments: DataFrame, cues: DataFrame) -> DataFrame:
    """Lines of a transcript for reading or prompting, one row per line, pause lines before their segment."""
    c = cues.select("recording_id", (F.col("after") + 1).alias("idx"), F.col("duration").alias("d"), F.col("ratio").alias("r"))
    s = segments.join(c, ["recording_id", "idx"], "left")
    whole = F.floor("start")
    clock = F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), clock, F.lit(" "), F.col("text"))
    pause = F.format_string("-- pause %s s (%s x usual) --", _plain(F.col("d")), _plain(F.col("r")))
    both = F.array(F.struct(F.lit(0).alias("part"), F.when(F.col("d").isNotNull(), pause).alias("line")),
                   F.struct(F.lit(1).alias("part"), line.alias("line")))
    out = s.select("recording_id", "idx", F.explode(both).alias("l")).select("recording_id", "idx", "l.*")
    return out.where(F.col("line").isNotNull())


def _frames(envelope: DataFrame, stories: DataFrame, keys: Sequence[str], least_one: bool) -> DataFrame:
    """Frames inside each span (recording_id, *keys, start, end) with the span's own frame bounds."""
    n = envelope.groupBy("recording_id").agg((F.max("frame") + 1).alias("n_frames"))
    first = F.greatest(F.lit(0), F.floor(F.col("start") * RATE))
    stop = F.ceil(F.col("end") * RATE)
    stop = F.greatest(first + 1, stop) if least_one else stop
    s = stories.select("recording_id", *keys, "start", "end", first.alias("f0"), stop.alias("f1")).join(n, REC)
    s = s.withColumn("f1", F.least("n_frames", "f1")).where(F.col("f0") < F.col("f1")).withColumn("f_last", F.col("f1") - 1)
    return in_spans(envelope, s, REC, "frame", "f0", "f_last")


def slice_envelope(envelope: DataFrame, stories: DataFrame, buckets: int, keys: Sequence[str] = ("story_id",)) -> DataFrame:
    """Loudest value per bucket of each story span, at most `buckets` of them, scaled to 0..1."""
    f = _frames(envelope, stories, keys, True).withColumn("span", F.col("f1") - F.col("f0"))
    f = f.withColumn("count", F.greatest(F.lit(1), F.least(F.lit(buckets), F.col("span"))))
    x = F.col("frame") - F.col("f0") + 1
    bucket = (F.ceil(x * F.col("count") / F.col("span")) - 1).cast("int")
    return f.groupBy(*keys, bucket.alias("bucket")).agg(round_half_up(F.max("peak") / 255, 3).alias("level"))


def voice_rhythm(envelope: DataFrame, stories: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stretches of voice inside a story as fractions of its length."""
    f = _frames(envelope, stories.where(F.col("end") > F.col("start")), ["story_id"], False)
    f = f.where(F.col("peak") / 255 >= 0.2)
    key = ["recording_id", "story_id"]
    f = running(f, key, ["frame"], {"prev": ("last", F.col("frame"))}, F.floor(F.col("frame") / block), False)
    far = F.col("frame") / RATE - (F.col("prev") + 1) / RATE >= 0.35
    f = islands(f, key, "frame", F.col("prev").isNull() | far, "run", block)
    runs = f.groupBy("story_id", "run").agg(
        (F.min("frame") / RATE).alias("a"), ((F.max("frame") + 1) / RATE).alias("b"), F.first("start").alias("start"), F.first("end").alias("end")
    )
    span = F.col("end") - F.col("start")
    return runs.where(F.col("b") - F.col("a") >= 0.2).select(
        "story_id", F.greatest(F.lit(0.0), (F.col("a") - F.col("start")) / span).alias("voice_from"),
        F.least(F.lit(1.0), (F.col("b") - F.col("start")) / span).alias("voice_to"),
    )


def smooth_levels(levels: DataFrame, radius: int = 1) -> DataFrame:
    """Moving average and contrast stretch over the bounded list of buckets of one story."""
    by = Window.partitionBy("story_id")
    near = by.orderBy("bucket").rowsBetween(-radius, radius)
    s = levels.withColumn("smooth", F.avg("level").over(near))
    lo, hi = F.min("smooth").over(by), F.max("smooth").over(by)
    s = s.withColumn("lo", lo).withColumn("hi", hi)
    wide = F.col("hi") - F.col("lo")
    stretched = 0.18 + 0.82 * F.pow((F.col("smooth") - F.col("lo")) / wide, F.lit(1.35))
    return s.select("story_id", "bucket", "smooth", F.when(wide < 0.05, F.col("smooth")).otherwise(stretched).alias("contrast"))
