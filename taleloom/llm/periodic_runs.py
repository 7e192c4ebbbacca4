"""Periodic runs of words: recursive splitting at words that are too rare, then a scan of lags in what survives."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import sliced
from .common import modest_batches, table, without

#: A run holds its period at least so many times, and at least so many words.
TIMES, LEAST = 3, 24
SLICE = 4 << 20
#: What separates words, as an expression of Spark.
GAPS = r"[ \t\n\x0B\f\r]+"


def surviving(words: Sequence) -> list[tuple[int, int]]:
    """Stretches [start, end) that can hold runs: at least LEAST words, and each word occurs TIMES times or more within its stretch.

    A run repeats each of its words TIMES times, so a word that is rarer within a stretch is in no run there and splits it; the parts are split in
    turn until nothing changes. Of the parts of a split only the smaller ones are counted anew; the largest takes the counts that remain, and only
    words that lost an occurrence are looked at again. So a word is counted log(n) times at most, however the splits fall.
    """
    if len(words) < LEAST:
        return []
    count = Counter(words)
    cuts = [i for i, w in enumerate(words) if count[w] < TIMES]
    if not cuts:
        return [(0, len(words))]
    out, stack, places = [], [(0, len(words), count, cuts)], None
    while stack:
        start, end, count, cuts = stack.pop()
        edges = [start - 1, *cuts, end]
        parts = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False) if b - a > LEAST]
        if not parts:
            continue
        if places is None:
            places = defaultdict(list)
            for i, w in enumerate(words):
                places[w].append(i)
        large = max(parts, key=lambda p: p[1] - p[0])
        for a, b in parts:
            if (a, b) == large:
                lost = Counter(words[start:a])
                lost.update(words[b:end])
                own = count
                own.subtract(lost)
            else:
                own = lost = Counter(words[a:b])
            again = []
            for w in lost:
                if 0 < own[w] < TIMES:
                    first = bisect_left(places[w], a)
                    again += places[w][first : first + own[w]]
            again.sort()
            if again:
                stack.append((a, b, own, again))
            else:
                out.append((a, b))
    return sorted(out)


def _widths(low: int) -> int:
    """Words in an aligned window that lies whole in the part of any run of period [low, 2 * low) that is repeated later."""
    return (min(max(LEAST - q, (TIMES - 1) * q) for q in range(low, min(2 * low, LEAST) + 1)) + 1) // 2 if low < LEAST else (TIMES - 1) * low // 2


def _matching(a: np.ndarray, at: int, lag: int, step: int) -> int:
    """The end (step 1) or the begin (step -1) of the stretch around `at` in which words `lag` apart agree."""
    chunk = 32
    while True:
        low, high = (at, min(at + chunk, len(a) - lag)) if step > 0 else (max(0, at - chunk), at)
        if low >= high:
            return at
        differ = np.flatnonzero(a[low:high] != a[low + lag : high + lag])
        if len(differ):
            return low + int(differ[0]) if step > 0 else low + int(differ[-1]) + 1
        at, chunk = (high if step > 0 else low), chunk * 2


def scanned(words: Sequence) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch, by lags.

    Lags go up by octaves [low, 2 * low). The repeated part of any run with such a lag covers a whole aligned window, and its rarest word must
    come again one lag later; so only the lags to the next places of that word are compared, first over the window, then both ways to the ends.
    A stretch with the bounds of a run found before has that run's period as its smallest, and is passed over.
    """
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    a = np.array(ids, np.int64)
    places: list[list[int]] = [[] for _ in number]
    for i, w in enumerate(ids):
        places[w].append(i)
    often = np.bincount(a)[a]
    found: dict[tuple[int, int], int] = {}
    reach = np.zeros(len(ids), np.int64)  # for each word the end of a run over it, and that run's period
    period = np.ones(len(ids), np.int64)
    low = 1
    while TIMES * low <= len(ids):
        width = _widths(low)
        windows = len(ids) // width
        rarest = often[: windows * width].reshape(windows, width).argmin(axis=1) + np.arange(windows) * width
        seen: dict[int, int] = {}  # lag -> end of the last stretch that was compared
        for begin, x in zip(range(0, windows * width, width), rarest.tolist(), strict=True):
            if reach[begin] >= begin + width + 2 * low:
                continue
            own = places[ids[x]]
            for y in own[bisect_left(own, x + low) : bisect_left(own, x + 2 * low)]:
                lag = y - x
                if begin < seen.get(lag, 0) or (reach[x] > y and lag % period[x] == 0) or ids[begin : begin + width] != ids[begin + lag : begin + lag + width]:
                    continue
                start, last = _matching(a, begin, lag, -1), _matching(a, begin + width, lag, 1)
                seen[lag] = last
                end = last + lag
                if end - start >= max(LEAST, TIMES * lag) and (start, end) not in found:
                    found[start, end] = lag
                    farther = reach[start:end] < end
                    reach[start:end][farther], period[start:end][farther] = end, lag
        low *= 2
    return [(start, end - start, lag) for (start, end), lag in found.items()]


def runs_of(words: Sequence) -> list[tuple[int, int, int]]:
    """All periodic runs (start, length, period) of a text's words, by start, then period."""
    return sorted(((a + s, n, p) for a, b in surviving(words) for s, n, p in scanned(words[a:b])), key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence, runs: Sequence[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    kept, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        kept += words[at : max(at, a)]
        at = max(at, b)
    return kept + list(words[at:])


def _run_batches(batches: Iterator[pa.RecordBatch], text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, text_at, SLICE):
        rows, kept, edges = [], [], [0]
        for text in batch.column(text_at).to_pylist():
            words = text.encode().split() if text else []  # bytes split at ASCII white space only
            runs = runs_of(words)
            rows += runs
            edges.append(len(rows))
            kept.append(b" ".join(collapsed(words, runs) if runs else words).decode())
        fields = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
        yield pa.record_batch([*batch.columns, runs, pa.array(kept, pa.string())], names=names)


def with_runs(df: DataFrame, text: str = "text") -> DataFrame:
    """df with runs and collapsed (replacing columns of these names).

    Words are runs of characters other than ASCII white space. A run is a stretch whose words repeat with a smallest period q, of at least
    max(24, 3 * q) words, that neither neighbour extends; runs has (start, length, period) by start, then period. collapsed joins by one space the
    words that no run contains after its first period. A null or empty text has no runs and collapses to the empty text. Each row stands for
    itself, so repeated rows stay.
    """
    modest_batches(df)
    base = without(df, "runs", "collapsed")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields] + ["runs array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed string"])
    return base.mapInArrow(partial(_run_batches, text_at=base.columns.index(text), names=[*base.columns, "runs", "collapsed"]), schema)


def rewritten(doc_id: Column, text: Column) -> Column:
    """The text, or for one document in ten its words from word a on repeated with period p; doc_id decides a and p. No doc_id: the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, GAPS), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))

    # the words as a variable of a lambda are made once, not once for each word
    once = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(repeated(w), " ")).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, once).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    runs = with_runs(docs.select("doc_id", rewritten(docs["doc_id"], docs["text"]).alias("text")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # runs come by start, then period, so the first of equal exponents stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    found = runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
    return found.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
