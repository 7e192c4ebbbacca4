"""Queries on loudness envelopes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators import envelope as E
from . import views as V
from .oracle import sql
from .registry import Query


def from_samples(s, d):
    return E.envelope_from_samples(V.samples(s, d))


def pauses(s, d):
    return E.detect_pauses(V.envelope(s, d))


def _between(s, d):
    return E.boundary_pauses(E.detect_pauses(V.envelope(s, d)), V.envelope_segments(s, d))


def cues(s, d):
    """With two or more pauses per user the five-pause rule is met by pooling the users of a block of twenty."""
    b = _between(s, d)
    pooled = b.select(F.floor(F.col("recording_id") / 20).alias("recording_id"), (F.col("recording_id") % 20 * 100 + F.col("after")).alias("after"), "duration")
    return E.pause_cues(pooled)


def lines(s, d):
    b = _between(s, d)
    c = b.select("recording_id", "after", E.round_half_up(F.col("duration"), 1).alias("duration"), E.round_half_up(F.col("duration") * 2, 1).alias("ratio"))
    return E.transcript_lines(V.envelope_segments(s, d), c)


def slices(s, d, buckets=16):
    return E.slice_envelope(V.envelope(s, d), V.envelope_stories(s, d), buckets)


def rhythm(s, d):
    r = E.voice_rhythm(V.envelope(s, d), V.envelope_stories(s, d))
    return r.select("story_id", F.round("voice_from", 6).alias("voice_from"), F.round("voice_to", 6).alias("voice_to"))


def smooth(s, d, buckets=16):
    x = E.smooth_levels(slices(s, d, buckets))
    return x.select("story_id", "bucket", F.round("smooth", 6).alias("smooth"), F.round("contrast", 6).alias("contrast"))


def speaker_quantiles(s, d):
    e = V.envelope(s, d).select("recording_id", "peak")
    q = E.quantiles(e, ["recording_id"], "peak", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return q.select("recording_id", F.round("p10", 6).alias("p10"), F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), F.col("n_values").alias("n"))


def _slice_sql(buckets=16):
    return f"""
  select story_id, ceil((frame - f0 + 1) * cnt / (f1 - f0)) - 1 as bucket, floor(max(peak) / 255.0::double * 1000 + 0.5) / 1000 as level
  from (select *, greatest(1, least({buckets}, f1 - f0))::double as cnt from
    (select story_id, recording_id, greatest(0, floor("start" * 20)) as f0, least((select max(frame) + 1 from envelope), greatest(greatest(0, floor("start" * 20)) + 1, ceil("end" * 20))) as f1 from e_stories)) s
  join envelope e on e.recording_id = s.recording_id and frame >= f0 and frame < f1 group by 1, 2
"""


def _smooth_sql(buckets=16):
    return f"""
        , l as ({_slice_sql(buckets)}), m as (select *, avg(level) over (partition by story_id order by bucket rows between 1 preceding and 1 following) as smooth from l),
        x as (select *, min(smooth) over (partition by story_id) as lo, max(smooth) over (partition by story_id) as hi from m)
        select story_id, bucket, round(smooth, 6) as smooth, round(case when hi - lo < 0.05 then smooth else 0.18 + 0.82 * pow((smooth - lo) / (hi - lo), 1.35) end, 6) as contrast from x"""


#: Numbers of buckets that pages and life rows ask for.
SIZES = 64, 240

QUERIES = {
    "envelope_from_samples": Query(from_samples, """
        with r as (select l_suppkey as recording_id, l_orderkey // 800 as frame, sqrt(avg(pow((((l_extendedprice * 100)::bigint % 32768) / 32768.0::double), 2)))::float as rms from lineitem group by 1, 2),
        k as (select *, row_number() over (partition by recording_id order by rms) as rn, count(*) over (partition by recording_id) as n from r),
        ref as (select recording_id, max(rms) as ref from k where rn = floor(n * 0.985) + 1 group by 1)
        select recording_id, frame, floor(sqrt(least(1.0, rms::double / ref::double)) * 255 + 0.5)::int as peak from r join ref using (recording_id)"""),
    "detect_pauses": Query(pauses, sql('select * from pauses', "pauses")),
    "boundary_pauses": Query(_between, sql("select * from bpauses", "bpauses")),
    "pause_cues": Query(cues, sql("""
        , pooled as (select recording_id // 20 as recording_id, recording_id % 20 * 100 + after as after, duration from bpauses),
        t as (select recording_id, quantile_cont(duration, 0.5) as typical from pooled group by 1 having count(*) >= 5)
        select recording_id, after, floor(duration * 10 + 0.5) / 10 as duration, floor(duration / typical * 10 + 0.5) / 10 as ratio, floor(typical * 10 + 0.5) / 10 as typical
        from pooled join t using (recording_id) where duration / typical >= 1.5""", "bpauses")),
    "transcript_lines": Query(lines, sql("""
        select recording_id, after + 1 as idx, 0 as part, '-- pause ' || regexp_replace((floor(duration * 10 + 0.5) / 10)::varchar, '\\.0$', '') || ' s ('
               || regexp_replace((floor(duration * 2 * 10 + 0.5) / 10)::varchar, '\\.0$', '') || ' x usual) --' as line from bpauses
        union all
        select recording_id, idx, 1, '[' || idx || '] ' || (floor("start")::int // 60) || ':' || lpad((floor("start")::int % 60)::varchar, 2, '0') || ' sentence ' || idx from e_seg""", "bpauses", "e_seg")),
    "slice_envelope": Query(slices, sql(_slice_sql(), "envelope", "e_stories")),
    "voice_rhythm": Query(rhythm, sql("""
        , f as (select story_id, frame, "start", "end" from (select *, floor("start" * 20) as f0, least((select max(frame) + 1 from envelope), ceil("end" * 20)) as f1 from e_stories) s
             join envelope e on e.recording_id = s.recording_id and frame >= f0 and frame < f1 where peak / 255.0::double >= 0.2),
        g as (select *, case when frame / 20.0::double - (lag(frame) over w + 1) / 20.0::double < 0.35 then 0 else 1 end as opens from f window w as (partition by story_id order by frame)),
        r as (select story_id, any_value("start") as s, any_value("end") as e, min(frame) / 20.0::double as a, (max(frame) + 1) / 20.0::double as b from
                (select *, sum(opens) over (partition by story_id order by frame) as run from g) group by story_id, run)
        select story_id, round(greatest(0, (a - s) / (e - s)), 6) as voice_from, round(least(1, (b - s) / (e - s)), 6) as voice_to from r where b - a >= 0.2""", "envelope", "e_stories")),
    "smooth_levels": Query(smooth, sql(_smooth_sql(), "envelope", "e_stories")),
    "speaker_quantiles": Query(speaker_quantiles, sql("""
        select recording_id, round(quantile_cont(peak, 0.1), 6) as p10, round(quantile_cont(peak, 0.5), 6) as median, round(quantile_cont(peak, 0.9), 6) as p90, count(*) as n from envelope group by 1""", "envelope")),
}
for _n in SIZES:
    QUERIES[f"slice_envelope_{_n}"] = Query(partial(slices, buckets=_n), sql(_slice_sql(_n), "envelope", "e_stories"))
    QUERIES[f"smooth_levels_{_n}"] = Query(partial(smooth, buckets=_n), sql(_smooth_sql(_n), "envelope", "e_stories"))
