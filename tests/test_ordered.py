"""Block-wise operators give the same result as a plain pass, also when a key spans many blocks."""

import math
import random

from pyspark.sql import functions as F

import pytest
from taleloom.operators import envelope as E
from taleloom.operators import ordered as O
from taleloom.operators import transcript as T


def _rows(seed, n_keys=3, n=150):
    rng = random.Random(seed)
    rows = []
    for k in range(n_keys):
        t = 0.0
        for i in range(n if k == 0 else rng.randint(1, 40)):
            t += rng.choice([0.1, 0.5, 1.9, 2.5])
            d = rng.choice([0.5, 3.0, 9.0, 30.0])
            rows.append((str(k), i, round(t, 1), round(t + d, 1), " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([1, 4, 12, 50, 95]))), rng.randint(-3, 9)))
            t += d
    return rows


SCHEMA = "recording_id string, idx int, start double, end double, text string, v int"


def test_running_and_neighbours_across_blocks(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = O.running(df, ["recording_id"], ["idx"], {
        "total": ("sum", F.col("v")), "top": ("max", F.col("v")), "seen": ("last", F.when(F.col("v") > 6, F.col("idx"))),
    }, F.floor(F.col("idx") / 8))
    before = O.running(df, ["recording_id"], ["idx"], {"b": ("sum", F.col("v"))}, F.floor(F.col("idx") / 8), inclusive=False)
    near = O.neighbours(df, ["recording_id"], "idx", {"p2": (F.col("v"), -2), "n1": (F.col("v"), 1)}, 8)
    got = {(r.recording_id, r.idx): (r.total, r.top, r.seen) for r in out.collect()}
    got_b = {(r.recording_id, r.idx): r.b for r in before.collect()}
    got_n = {(r.recording_id, r.idx): (r.p2, r.n1) for r in near.collect()}
    assert len(got) == len(rows) == len(got_n)
    for k in {r[0] for r in rows}:
        vs = [r[5] for r in rows if r[0] == k]
        for i in range(len(vs)):
            seen = [j for j in range(i + 1) if vs[j] > 6]
            assert got[(k, i)] == (sum(vs[: i + 1]), max(vs[: i + 1]), seen[-1] if seen else None)
            assert got_b[(k, i)] == (sum(vs[:i]) if i else None)
            assert got_n[(k, i)] == (vs[i - 2] if i >= 2 else None, vs[i + 1] if i + 1 < len(vs) else None)


def _chunks(rows):
    """Direct simulation of the window rule."""
    out, i, n = [], 0, len(rows)
    while i < n:
        j, words = i, 0
        while j < n and rows[j][3] - rows[i][2] < 28 and words < 90:
            words += len(rows[j][4].split())
            j += 1
        j = max(j, i + 1)
        out.append((i, j - 1))
        if j >= n:
            break
        i = j - 1 if j - 1 > i else j
    return out


def _paragraphs(rows):
    out, cur, words = [], [], 0
    for r in rows:
        c = len(r[4].split())
        if cur and (r[2] - cur[-1][3] >= 1.8 or len(cur) >= 4 or words + c > 70):
            out.append((cur[0][1], cur[-1][1]))
            cur, words = [], 0
        cur.append(r)
        words += c
    return out + [(cur[0][1], cur[-1][1])]


def test_chunks_across_blocks_match_simulation(spark):
    for seed in (2, 3):
        rows = _rows(seed)
        seg = spark.createDataFrame(rows, SCHEMA)
        stories = spark.createDataFrame([], "recording_id string, story_id long, seg_start int, seg_end int")
        got = T.build_chunks(seg, stories, block=96)
        want = {(k, a, b) for k in {r[0] for r in rows} for a, b in _chunks([r for r in rows if r[0] == k])}
        assert {(r.recording_id, r.seg_start, r.seg_end) for r in got.collect()} == want


def test_paragraphs_across_blocks_match_simulation(spark):
    rows = _rows(4)
    seg = spark.createDataFrame(rows, SCHEMA)
    want = {(k, a, b) for k in {r[0] for r in rows} for a, b in _paragraphs([r for r in rows if r[0] == k])}
    for block in (8, 1 << 16):
        got = {(r.recording_id, r.first, r.last) for r in T.paragraphs(seg, block=block).collect()}
        assert got == want


def test_in_spans_across_blocks(spark):
    p = spark.createDataFrame([("a", i) for i in range(50)], "recording_id string, idx int")
    s = spark.createDataFrame([("a", 3, 21, "x"), ("a", 30, 30, "y")], "recording_id string, f int, t int, name string")
    got = {(r.idx, r["name"]) for r in O.in_spans(p, s, ["recording_id"], "idx", "f", "t", block=7).collect()}
    assert got == {(i, "x") for i in range(3, 22)} | {(30, "y")}


def test_token_windows_hold_many_empty_lines(spark):
    seg = spark.range(6000).selectExpr("'a' as recording_id", "cast(id as int) as idx", "'' as text")
    for block in (1 << 16, 1300, 7):
        got = sorted((r.first, r.last) for r in T.token_windows(seg, block=block).collect())
        assert got[0][0] == 0 and got[-1][1] == 5999 and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))
        assert len(got) == 6


def test_chain_refuses_windows_beyond_its_bound(spark):
    import numpy as np

    df = spark.range(100).selectExpr("'a' as k", "id as pos")
    jump = lambda v, stop: (np.minimum(np.arange(len(stop)) + 9, stop - 1), np.minimum(np.arange(len(stop)) + 10, stop))
    assert O.greedy_chain(df, ["k"], "pos", [], jump, 10, 16).count() == 10
    with pytest.raises(Exception, match="reaches further"):
        O.greedy_chain(df, ["k"], "pos", [], jump, 5, 16).count()


def test_dense_hits_lose_nothing(spark):
    from taleloom.operators import marks as M

    hits = spark.range(160_000).selectExpr("1 as story_id", "1 as entity_id", "0 as phrase_rank", "id as at", "id * 0.00003D as time")
    assert sorted(r.at for r in M.spaced_dedupe(hits, 1.5).collect()) == [0, 50000, 100000, 150000]


@pytest.mark.parametrize("buckets", [16, 64, 240])
def test_envelope_slices_of_long_and_short_spans(spark, buckets):
    """Spans over, at and under the number of buckets, past the end, and outside the recording, against a direct reading."""
    rng = random.Random(buckets)
    peaks = [rng.randrange(256) for _ in range(1500)]
    spans = [(1, 0.0, 60.0), (2, 3.3, 3.3 + buckets / 20), (3, 10.0, 10.2), (4, 70.0, 90.0), (5, 5.0, 5.0), (6, 12.34, 41.07)]
    envelope = spark.createDataFrame([(1, i, p) for i, p in enumerate(peaks)], "recording_id long, frame int, peak int")
    stories = spark.createDataFrame([(1, *s) for s in spans], "recording_id long, story_id long, start double, end double")
    want = {}
    for story, a, b in spans:
        f0 = max(0, math.floor(a * 20))
        f1 = min(len(peaks), max(f0 + 1, math.ceil(b * 20)))
        n = max(1, min(buckets, f1 - f0))
        for f in range(f0, f1):
            at = -(-(f - f0 + 1) * n // (f1 - f0)) - 1
            want[story, at] = max(want.get((story, at), 0), peaks[f])
    got = {(r.story_id, r.bucket): r.level for r in E.slice_envelope(envelope, stories, buckets).collect()}
    assert got == {k: math.floor(v / 255 * 1000 + 0.5) / 1000 for k, v in want.items()}
