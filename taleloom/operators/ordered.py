"""Ordered computations that stay parallel when one key holds most of the rows.

A plain window partitioned by recording sorts a whole recording in one task. Here the rows of a key are cut into blocks
of consecutive positions; windows run inside (key, block), a few neighbouring rows are copied over the block edge, and
only one summary row per block is combined per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

BLOCK = 1 << 16
_BLOCK, _OWN = "__block", "__own"


def with_halo(df: DataFrame, pos: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Give each row its block; rows near an edge are copied into the block that needs them as context."""
    if max(before, after) > block:
        raise ValueError("a block must be wider than the context it needs")
    own = F.floor(F.col(pos) / block)
    places = F.array_distinct(F.array(own, F.floor((F.col(pos) + before) / block), F.floor((F.col(pos) - after) / block)))
    return (
        df.withColumn(_BLOCK, F.explode(places))
        .where(F.col(_BLOCK) >= 0)
        .withColumn(_OWN, F.col(_BLOCK) == own)
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], pos: str, columns: dict[str, tuple[Column, int]], block: int = BLOCK
) -> DataFrame:
    """Add columns read from the row `offset` positions away (negative = earlier). `pos` is an integer position."""
    offsets = [o for _, o in columns.values()]
    before, after = max(0, -min(offsets)), max(0, max(offsets))
    w = Window.partitionBy(*keys, _BLOCK).orderBy(pos)
    out = with_halo(df, pos, before, after, block)
    for name, (expr, offset) in columns.items():
        out = out.withColumn(name, F.lag(expr, -offset).over(w) if offset < 0 else F.lead(expr, offset).over(w))
    return out.where(_OWN).drop(_BLOCK, _OWN)


def shared(df: DataFrame, *keys: str) -> DataFrame:
    """One shuffle by `keys` that several branches of a plan can read.

    The other columns travel as one packed value, so column pruning leaves all branches with the same exchange and
    Spark computes it once.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.array(F.struct(*rest)).alias("__row")).repartition(*keys)
    return packed.select(*keys, *[F.get("__row", F.lit(0))[c].alias(c) for c in rest])


_RUNNING: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, tuple[str, Column]],
    block: Column,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum / max / min / last-non-null per key in `order`; `block` must not decrease along that order."""
    base = shared(df.withColumn(_BLOCK, block), *keys, _BLOCK)
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    sortable = F.struct(*[F.col(c) for c in order])
    totals, carried, final = [], [], []
    for name, (kind, expr) in columns.items():
        agg = _RUNNING[kind]
        total = F.max_by(expr, F.when(expr.isNotNull(), sortable)) if kind == "last" else agg(expr)
        totals.append(total.alias(f"__t_{name}"))
        carried.append(agg(F.col(f"__t_{name}")).over(earlier).alias(f"__c_{name}"))
        here, carry = agg(expr).over(inside), F.col(f"__c_{name}")
        if kind == "sum":
            value = F.when(here.isNull() & carry.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
            )
        elif kind == "last":
            value = F.coalesce(here, carry)
        else:
            value = (F.greatest if kind == "max" else F.least)(here, carry)
        final.append((name, value))
    carry = base.groupBy(*keys, _BLOCK).agg(*totals).select(*keys, _BLOCK, *carried)
    out = base.join(carry, [*keys, _BLOCK], "left")
    out = out.select("*", *[v.alias(n) for n, v in final])
    return out.drop(_BLOCK, *[f"__c_{n}" for n in columns])


def islands(
    df: DataFrame, keys: Sequence[str], pos: str, starts: Column, name: str = "island", block: int = BLOCK
) -> DataFrame:
    """Number each run of rows by the position where it starts."""
    return running(
        df, keys, [pos], {name: ("last", F.when(starts, F.col(pos)))}, F.floor(F.col(pos) / block)
    )


def in_spans(
    points: DataFrame, spans: DataFrame, keys: Sequence[str], pos: str, first: str, last: str, how: str = "inner",
    block: int = BLOCK,
) -> DataFrame:
    """Join integer positions to the closed spans that contain them, on (key, block) plus the bounds."""
    wide = spans.withColumn(
        _BLOCK, F.explode(F.sequence(F.floor(F.col(first) / block), F.floor(F.col(last) / block)))
    )
    cond = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, _BLOCK]]
    cond.append(F.col(f"p.{pos}").between(F.col(f"s.{first}"), F.col(f"s.{last}")))
    p = points.withColumn(_BLOCK, F.floor(F.col(pos) / block)).alias("p")
    joined = p.join(wide.alias("s"), cond, how)
    if how in ("left_anti", "left_semi"):
        return joined.drop(_BLOCK)
    extra = [c for c in spans.columns if c not in keys]
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{c}") for c in extra])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key, ranks from 1; Spark prunes to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


# --- greedy chains -------------------------------------------------------------------------------------------------
# A greedy window decides its end from a bounded number of following rows, so every row knows where the next window
# would start if one started on it. Only the rows reachable from position 0 are real. Inside a block reachability is
# followed directly; across blocks each block publishes "entered at offset e, left at position p" and one short pass
# per key composes those tables.


def _by_group(batches: Iterator[pd.DataFrame], group: list[str]) -> Iterator[pd.DataFrame]:
    """Re-cut sorted Arrow batches at group edges, so that a batch holds whole groups."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = np.ones(len(pdf), dtype=bool)
        for g in group:
            last &= (pdf[g] == pdf[g].iloc[-1]).to_numpy()
        split = int(np.argmax(last))
        if split:
            yield pdf.iloc[:split].reset_index(drop=True)
        rest = pdf.iloc[split:].reset_index(drop=True)
    if rest is not None and not rest.empty:
        yield rest


def _group_edges(pdf: pd.DataFrame, group: list[str]) -> np.ndarray:
    change = np.zeros(len(pdf), dtype=bool)
    change[0] = True
    for g in group:
        v = pdf[g].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), len(pdf))


def greedy_chain(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    values: Sequence[str],
    reach: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]],
    max_jump: int,
    block: int = BLOCK,
) -> DataFrame:
    """Windows of a greedy left-to-right pass over dense positions 0, 1, 2, … of each key.

    `reach(arrays, stop)` gets many blocks at once (each with the rows it may look ahead to; `stop[i]` is the index
    after the last row of row i's block) and returns, per row, the index of the last row of the window that would start
    there and the index of the next window's first row, `stop[i]` meaning that the pass ends. `max_jump` bounds how far
    both may lie from the start; a window that reaches further raises an error, so no row is lost. Keys of any length go
    the same way: windows of first blocks at once, then tables of entries and exits per later block, composed in log
    rounds. Returns (keys, first, last) per window.
    """
    keys = list(keys)
    group = [*keys, _BLOCK]
    # one row more than the bound: a window that meets the end of a full look-ahead has passed the bound
    block = max(block, max_jump + 1)
    need = with_halo(df.select(*keys, F.col(pos).cast("long").alias("__pos"), *values), "__pos", 0, max_jump + 1, block)
    key_fields = [df.schema[k] for k in keys]
    fields = [*key_fields, *(T.StructField(c, T.LongType()) for c in (_BLOCK, "__pos", "__next", "__last", "__kind"))]

    def dealt(rows: DataFrame) -> DataFrame:
        """Rows of a (key, block) together and in order, in as many tasks as a shuffle has: few bytes may be much work."""
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(n, *group).sortWithinPartitions(*group, "__pos")

    def jumps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kind 0: a window of a first block, kind 1: where such a block is left, kind 2: a row of a later block."""
        for pdf in _by_group(batches, group):
            edges = _group_edges(pdf, group)
            p = pdf["__pos"].to_numpy()
            stop = np.repeat(edges[1:], np.diff(edges))
            end, follow = reach({v: pdf[v].to_numpy() for v in values}, stop)
            here = p - np.arange(len(p))
            own = pdf[_OWN].to_numpy()
            ahead = np.add.reduceat(~own, edges[:-1], dtype=np.int64)
            if (own & (follow >= stop) & (np.repeat(ahead, np.diff(edges)) > max_jump)).any():
                raise ValueError(f"a window reaches further than max_jump={max_jump} rows")
            first = pdf[_BLOCK].to_numpy()[edges[:-1]] == 0
            # a pass over a first block begins at its first row, so its windows are known at once
            chosen, left = _walk(follow, edges[:-1][first], edges[:-1][first] + (np.diff(edges) - ahead)[first])
            kind = np.where(own & ~np.repeat(first, np.diff(edges)), 2, -1)
            kind[chosen] = 0
            out = pdf[[*group, "__pos"]].assign(__next=np.where(follow < stop, follow + here, -1), __last=end + here, __kind=kind)
            yield out[kind >= 0]
            yield out.iloc[left].assign(__kind=1)

    moved = cut_lineage(dealt(need).mapInPandas(jumps, T.StructType(fields)))
    windows = moved.where("__kind = 0").select(*keys, F.col("__pos").alias("first"), F.col("__last").alias("last"))
    last_block = moved.where("__kind = 2").agg(F.max(_BLOCK)).first()[0]
    if last_block is None:
        return windows
    later = moved.where("__kind = 2").select(*group, "__pos", "__next", "__last")

    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Where the pass leaves a block, for each row of it that may come first."""
        for pdf in _by_group(batches, group):
            edges = _group_edges(pdf, group)
            size = np.diff(edges)
            p, nx = pdf["__pos"].to_numpy(), pdf["__next"].to_numpy()
            i = np.arange(len(p))
            to = np.where((nx >= 0) & (nx <= np.repeat(p[edges[1:] - 1], size)), i + nx - p, i)
            while (to[to] != to).any():
                to = to[to]
            out = pdf[keys].assign(at=p, to=nx[to])
            yield out[i - np.repeat(edges[:-1], size) < max_jump]

    # a table from entry to exit per block; tables of neighbouring blocks compose, so twice as many blocks are passed in each round
    at = T.StructType([*key_fields, T.StructField("at", T.LongType()), T.StructField("to", T.LongType())])
    leap = cut_lineage(dealt(later).mapInPandas(exits, at))
    entries = cut_lineage(moved.where("__kind = 1 and __next >= 0").select(*keys, F.col("__next").alias("at")))
    passed = 1
    while True:
        onward = entries.join(leap, [*keys, "at"]).where("to >= 0").select(*keys, F.col("to").alias("at"))
        entries = cut_lineage(entries.unionByName(onward))
        passed *= 2
        if passed > last_block:
            break
        second = leap.select(*keys, F.col("at").alias("to"), F.col("to").alias("__to"))
        leap = cut_lineage(leap.where("to >= 0").join(second, [*keys, "to"]).select(*keys, "at", F.col("__to").alias("to")))
    entered = later.join(entries.select(*keys, F.floor(F.col("at") / block).alias(_BLOCK), F.col("at").alias("__entry")), group)

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_group(batches, group):
            edges = _group_edges(pdf, group)
            p, nx, entry = (pdf[c].to_numpy() for c in ("__pos", "__next", "__entry"))
            follow = np.where(nx >= 0, np.arange(len(p)) + nx - p, len(p))
            chosen, _ = _walk(follow, edges[:-1] + entry[edges[:-1]] - p[edges[:-1]], edges[1:])
            out = pdf.iloc[chosen]
            yield out[keys].assign(first=out["__pos"].to_numpy(), last=out["__last"].to_numpy())

    rest = dealt(entered).mapInPandas(heads, windows.schema)
    return windows.unionByName(rest)


def _walk(follow: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are passed from each start on until its stop, all starts at a time, and the last row of each way."""
    ways, last = [np.empty(0, np.int64)], start.copy()
    at, way = start, np.arange(len(start))
    while len(at):
        ways.append(at)
        last[way] = at
        at = follow[at]
        inside = at < stop[way]
        at, way = at[inside], way[inside]
    return np.sort(np.concatenate(ways)), last
