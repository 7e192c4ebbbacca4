"""Trie of conversations by their first turns: balanced parentheses per shard, subtrees by findclose, spines of neighbouring shards merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import modest_batches, table, written
from .periodic_runs import GAPS

#: A turn within a path: 16 bytes that name its role and text, 4 bytes with its number of words.
TURN = 20
#: Turns of distinct paths that a shard holds, about.
SHARD_TURNS = 400_000
IDS = 1 << 16
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def turn_token(role: Column, text: Column) -> Column:
    """Bytes that are equal for turns with equal role and text (null: empty), and hold the number of words of the text."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    name = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.filter(F.split(text, GAPS), lambda w: w != ""))
    return F.concat(F.substring(name, 1, TURN - 4), F.unhex(F.lpad(F.hex(words.cast("long")), 8, "0")))


def _joined_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, token) -> (conv_id, turns): the tokens of neighbouring rows of a conversation in one value."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, tokens = batch.column(0).to_numpy(), b"".join(batch.column(1).to_pylist())
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        turns = [tokens[TURN * a : TURN * b] for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.record_batch([pa.array(ids[edges[:-1]]), pa.array(turns, pa.binary())], names=["conv_id", "turns"])


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path) of turn rows (conv_id, turn, role, text): a conversation's turns in order, as bytes.

    Order is by turn, null first; turns of one number go by role, then by the digest of the text. Rows without conv_id belong to no conversation and
    are left out. Rows are sorted by ranges, not by conversation, and meet as joined pieces; a whole path is one value of 20 bytes a turn.
    """
    rows = written(turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), turn_token(F.col("role"), F.col("text")).alias("token")))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "token", "_row"]
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.select("conv_id", "token").mapInArrow(_joined_turns, "conv_id long, turns binary").withColumn("_at", F.monotonically_increasing_id())
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_at", "turns"))).alias("_pieces"))
    return whole.select("conv_id", F.reduce("_pieces", F.lit(b""), lambda path, p: F.concat(path, p["turns"])).alias("path"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, path) -> (path, least, n, ids): neighbouring rows with one path in one row, ids comma-joined."""
    for batch in batches:
        for at in range(0, batch.num_rows, IDS):
            part = batch.slice(at, IDS)
            ids, own = part.column(0).to_pylist(), part.column(1).to_pylist()
            edges = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            rows = [(own[a], ids[a], b - a, ",".join(map(str, ids[a:b]))) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["path", "least", "n", "ids"])


def _distinct_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces (path, least, n, ids) -> one row per path (path, least, n, ends_sha256); a digest is fed piece by piece."""
    names = ["path", "least", "n", "ends_sha256"]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
    last, least, n, sha = None, 0, 0, None
    for batch in batches:
        done = []
        for path, first, count, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if path == last:
                sha.update(b"," + ids.encode())
                n += count
                continue
            if last is not None:
                done.append((last, least, n, sha.hexdigest()))
            last, least, n, sha = path, first, count, hashlib.sha256(ids.encode())
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    if last is not None:
        yield pa.record_batch([pa.array([v], t) for v, t in zip((last, least, n, sha.hexdigest()), kinds, strict=True)], names=names)


class Parentheses:
    """A sequence of balanced parentheses with the least and greatest excess of each block, and of blocks of blocks."""

    BLOCK = 64

    def __init__(self, opening: np.ndarray):
        excess = np.cumsum(np.where(opening, 1, -1), dtype=np.int32)
        room = -(-max(1, len(excess)) // self.BLOCK) * self.BLOCK
        self.excess = np.concatenate((excess, np.full(room - len(excess), np.iinfo(np.int32).max, np.int32))).reshape(-1, self.BLOCK)
        self.levels = [(self.excess.min(axis=1), self.excess.max(axis=1))]
        while len(self.levels[-1][0]) > 1:
            low, high = (np.append(x, fill) if len(x) % 2 else x for x, fill in zip(self.levels[-1], (np.iinfo(np.int32).max, np.iinfo(np.int32).min), strict=True))
            self.levels[-1] = (low, high)
            self.levels.append((low.reshape(-1, 2).min(axis=1), high.reshape(-1, 2).max(axis=1)))

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """For each opening position the position that closes it."""
        out = np.empty(len(at), np.int64)
        for a in range(0, len(at), 1 << 15):
            out[a : a + (1 << 15)] = self._close(at[a : a + (1 << 15)])
        return out

    def _close(self, at: np.ndarray) -> np.ndarray:
        block, within = at // self.BLOCK, at % self.BLOCK
        target = self.excess[block, within] - 1
        # first in the same block, after the position itself
        hit = (self.excess[block] <= target[:, None]) & (np.arange(self.BLOCK) > within[:, None])
        here = hit.any(axis=1)
        out = block * self.BLOCK + hit.argmax(axis=1)
        left = np.flatnonzero(~here)
        node, goal, level, found = block[left], target[left], 0, np.full(len(left), -1)
        rising = np.arange(len(left))
        tops: list[tuple[int, np.ndarray]] = []
        # up: the first block of blocks to the right whose excess comes down to the goal
        while len(rising):
            low, high = self.levels[level]
            right = np.minimum(node[rising] + 1, len(low) - 1)
            ok = (node[rising] % 2 == 0) & (right > node[rising]) & (low[right] <= goal[rising]) & (goal[rising] <= high[right])
            tops.append((level, rising[ok]))
            found[rising[ok]] = right[ok]
            rising = rising[~ok]
            node[rising] //= 2
            level += 1
        # down: the left half if it comes down to the goal, else the right half
        going = np.empty(0, np.int64)
        for level, mine in reversed(tops):
            if len(going):
                low, _ = self.levels[level]
                child = found[going] * 2
                found[going] = np.where(low[child] <= goal[going], child, child + 1)
            going = np.concatenate((going, mine))
        if len(left):
            out[left] = found * self.BLOCK + (self.excess[found] <= goal[:, None]).argmax(axis=1)
        return out


def common_turns(a: bytes, b: bytes) -> int:
    """Number of first turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


def first_shards(bounds: np.ndarray, shard: int, depths: np.ndarray) -> np.ndarray:
    """The first shards that hold the nodes of these depths on a shard's first path, all of which the shard before holds too.

    bounds[0, k] is the depth that the last path of shard k - 1 and the first of k share (-1 for k = 0), bounds[1, k] what the first and last of k share.
    """
    least = np.minimum.accumulate(bounds[:, :shard].min(axis=0)[::-1])  # how deep the shards before are crossed whole, from the nearest on
    return shard - 1 - np.searchsorted(-least, -depths, side="right")


def shard_nodes(own: list[bytes], least: np.ndarray, ends: np.ndarray, bounds: np.ndarray, shard: int) -> dict[str, np.ndarray]:
    """The trie of a shard's distinct sorted paths, in preorder.

    Columns: path (number of the path that opens the node), depth, start and stop (its range of paths), least, n_convs, n_children, n_leaves, saved_tokens,
    ends (number of the path that ends there, or -1), words, parent (preorder number), spine (the node is also in a neighbouring shard), first (then: the
    first shard that holds it). What a spine node says here is its share of this shard only, without the savings of spine nodes.
    """
    deep = np.array([len(p) // TURN for p in own], np.int64)
    lcp = np.array([0, *(common_turns(a, b) for a, b in zip(own, own[1:], strict=False))], np.int64)
    made = deep - lcp
    made[0] += 1  # the root
    first = np.cumsum(made) - made
    n = int(made.sum())
    path = np.repeat(np.arange(len(own)), made)
    begin = lcp + 1
    begin[0] = 0
    depth = np.arange(n) - np.repeat(first - begin, made)
    # closing what the next path does not share, then opening what is new
    closing = np.append(deep[:-1] - lcp[1:], deep[-1] + 1)
    opening = np.repeat(np.tile([True, False], len(own)), np.stack((made, closing), axis=1).reshape(-1))
    at = np.flatnonzero(opening)
    close = Parentheses(opening).find_close(at)
    opened = np.concatenate(([0], np.cumsum(opening)))
    stop_node = opened[close]  # the first node after the subtree, in preorder
    parent = np.arange(n) - 1
    chain: list[int] = []
    for i, (f, m, b) in enumerate(zip(first.tolist(), made.tolist(), begin.tolist(), strict=True)):
        if i and m:
            parent[f] = chain[b - 1]
        chain[b:] = range(f, f + m)
    words = np.zeros(n, np.int64)
    token_end = np.concatenate(([0], np.cumsum([len(p) for p in own])))[path] + depth * TURN
    data = np.frombuffer(b"\0" * 4 + b"".join(own), np.uint8).astype(np.int64)
    for k in range(4):
        words = words * 256 + data[token_end + k]
    words[depth == 0] = 0
    start = path
    after = np.append(path, len(own))[stop_node]
    ends_at = np.full(n, -1)
    ends_at[first + made - 1] = np.arange(len(own))

    spine, first_shard = np.zeros(n, bool), np.full(n, shard)
    left = int(bounds[0, shard])
    right = int(bounds[0, shard + 1]) if shard + 1 < bounds.shape[1] else -1
    spine[np.array(chain[: right + 1], np.int64)] = True
    on_first = np.arange(left + 1)  # the first path's nodes come first
    spine[on_first] = True
    first_shard[on_first] = first_shards(bounds, shard, on_first)

    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    held = total(ends)
    n_convs = held[after] - held[start]
    low = np.minimum.reduceat(np.append(least, np.iinfo(np.int64).max), np.stack((start, after), axis=1).reshape(-1))[::2]
    leaf = np.append(opening[1:], False)[at] == 0
    saved = np.where(spine, 0, (n_convs - 1) * words)
    leaves, savings = total(leaf & ~spine), total(saved)
    counted = (np.arange(n) > 0) & (~spine | (first_shard == shard))  # a spine node counts as a child in its first shard
    return {
        "path": path, "depth": depth, "least": low, "n_convs": n_convs, "n_children": np.bincount(parent[counted], minlength=n), "n_leaves": leaves[stop_node] - leaves[:-1],
        "saved_tokens": savings[stop_node] - savings[:-1], "ends": ends_at, "words": words, "parent": parent, "spine": spine, "first": first_shard,
    }


NODE = (
    "shard long, spine boolean, depth long, first long, parent_first long, parent_conv_id long, least long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, words long, ends_sha256 string"
)


def _shard_batches(batches: Iterator[pa.RecordBatch], bounds: np.ndarray, places: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The rows (shard, path, least, n, ends_sha256) of a partition, which are those of one shard in order -> its nodes."""
    columns: list[list] = [[], [], [], []]
    shard = None
    for batch in batches:
        if batch.num_rows:
            shard = batch.column(0)[0].as_py()
        for own, c in zip(columns, batch.columns[1:], strict=True):
            own += c.to_pylist()
    if shard is None:
        return
    place = places[shard]
    own, least, ends, sha = columns
    t = shard_nodes(own, np.array(least, np.int64), np.array(ends, np.int64), bounds, place)
    # a parent in the spine is known only when the spines are merged
    top = t["depth"] == 0
    up = np.maximum(t["parent"], 0)
    unknown = top | t["spine"][up]
    sha = pa.array([*sha, EMPTY_SHA])
    for a in range(0, len(top), 1 << 15):
        b = slice(a, a + (1 << 15))
        cut = {k: v[b] for k, v in t.items()}
        ended = np.where(cut["ends"] >= 0, cut["ends"], len(own))
        yield pa.record_batch(
            [
                pa.array(np.full(len(cut["depth"]), place)), pa.array(cut["spine"]), pa.array(cut["depth"]), pa.array(cut["first"]), pa.array(t["first"][up[b]], mask=top[b] | ~unknown[b]),
                pa.array(t["least"][up[b]], mask=unknown[b]), *(pa.array(cut[k].astype(np.int64)) for k in ("least", "n_convs", "n_children", "n_leaves", "saved_tokens", "words")),
                sha.take(pa.array(ended)),
            ],
            names=[x.split()[0] for x in NODE.split(", ")],
        )


@F.pandas_udf(LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([-1 if x is None or y is None else common_turns(x, y) for x, y in zip(a, b, strict=True)])


def _passed_up(batches: Iterator[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Spine nodes (first, depths, savings), all that begin in one shard in one row -> (depth, first, more): what each spine node above or at them gains."""
    for batch in batches:
        for shard, depths, savings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            order = np.argsort(depths)
            d, s = np.array(depths, np.int64)[order], np.array(savings, np.int64)[order]
            below = np.cumsum(s[::-1])[::-1]
            every = np.arange(d[-1] + 1)
            more = below[np.maximum(every - d[0], 0)]
            first = np.concatenate((first_shards(bounds, shard, every[: d[0]]), np.full(len(d), shard)))
            yield pa.record_batch([pa.array(every), pa.array(first), pa.array(more)], names=["depth", "first", "more"])


def trie_nodes(whole: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of paths (conv_id, path): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns, the root that of none; conv_id is the least of its members, the conversations that begin with it.
    n_leaves counts the childless nodes of its subtree, itself included; saved_tokens sums (n_convs - 1) times the words of the last turn over it.
    ends_sha256 is of the ids of the conversations that end there, ascending, comma-joined. Without conversations there are no nodes.

    Distinct paths are range-partitioned by their bytes, so that subtrees are stretches of a shard; copies of one path are joined before that. A
    shard writes its trie as balanced parentheses; findclose bounds a subtree, and ranks and running sums give its figures. Nodes that neighbouring
    shards share form spines; the shards' parts of them are added up, and what spine nodes save themselves goes up their paths.
    The driver holds two numbers per shard.
    """
    modest_batches(whole)
    whole = written(whole.select("conv_id", "path"))
    turns = whole.agg(F.sum(F.octet_length("path"))).first()[0] or 0
    pieces = written(whole.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_joined_ids, "path binary, least long, n long, ids string"))
    shards = max(1, -(-turns // (TURN * shard_turns)))
    ranged = pieces.repartitionByRange(shards, "path").sortWithinPartitions("path", "least")
    distinct = written(ranged.mapInArrow(_distinct_paths, "path binary, least long, n long, ends_sha256 string").select(F.spark_partition_id().alias("shard"), "*"))
    # one row per shard, so its size is bounded by the number of tasks
    ends = distinct.groupBy("shard").agg(F.min("path").alias("_low"), F.max("path").alias("_high"))
    ends = ends.select("shard", "_low", "_high", F.lag("_high").over(Window.orderBy("shard")).alias("_before"))
    joints = sorted(ends.select("shard", _common("_before", "_low"), _common("_low", "_high")).collect())
    places, bounds = {r[0]: k for k, r in enumerate(joints)}, np.array([r[1:] for r in joints], np.int64).reshape(-1, 2).T
    nodes = written(distinct.mapInArrow(partial(_shard_batches, bounds=bounds, places=places), NODE))

    parts = nodes.where("spine")
    add = {c: F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    ended = F.max(F.when(F.col("ends_sha256") != EMPTY_SHA, F.col("ends_sha256")))
    spine = parts.groupBy("depth", "first").agg(*add.values(), F.min("least").alias("least"), F.max("words").alias("words"), F.max("parent_first").alias("parent_first"), F.coalesce(ended, F.lit(EMPTY_SHA)).alias("ends_sha256"))
    spine = written(spine)
    begun = spine.groupBy("first").agg(F.collect_list("depth").alias("depths"), F.collect_list((F.col("n_convs") - 1) * F.col("words")).alias("savings"))
    gains = begun.mapInArrow(partial(_passed_up, bounds=bounds), "depth long, first long, more long").groupBy("depth", "first").agg(F.sum("more").alias("more"))
    least = spine.select((F.col("depth") + 1).alias("depth"), F.col("first").alias("parent_first"), F.col("least").alias("_parent"))
    merged = spine.join(gains, ["depth", "first"]).withColumn("saved_tokens", F.col("saved_tokens") + F.col("more")).join(least, ["depth", "parent_first"], "left")
    # children of spine nodes meet their parent within their shard, so that the root's children do not meet in one task
    held = parts.select("shard", "depth", "first").join(spine.select("depth", "first", "least"), ["depth", "first"])
    held = held.select("shard", (F.col("depth") + 1).alias("depth"), F.col("first").alias("parent_first"), F.col("least").alias("_parent"))
    inner = nodes.where("not spine")
    hanging = inner.where("parent_first is not null").join(held, ["shard", "depth", "parent_first"])
    plain = inner.where("parent_first is null").withColumn("_parent", F.col("parent_conv_id"))
    out = ["least", "depth", "_parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    every = plain.select(*out).unionByName(hanging.select(*out)).unionByName(merged.select(*out))
    return every.withColumnsRenamed({"least": "conv_id", "_parent": "parent_conv_id"})


def rebuilt(whole: DataFrame, family: int = 20) -> DataFrame:
    """Paths (conv_id, path) in which the first h turns of conversation c are those of c - c % family, h being crc32(c) % 4.

    c's own first h turns go; if that conversation has fewer turns all of them are taken, and none if it is absent.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 * TURN).cast("int")
    heads = whole.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.substring("path", 1, 3 * TURN).alias("_head"))
    own = whole.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % family, "_h": h})
    head = F.coalesce(F.expr("substring(_head, 1, _h)"), F.lit(b""))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(head, F.expr("substring(path, _h + 1, greatest(octet_length(path) - _h, 0))")).alias("path"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(rebuilt(written(paths(table(spark, sf_dir, "conversations")))))


OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS k, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, list(said ORDER BY k) AS said FROM turns GROUP BY c),
-- crc32 bit by bit: after each byte eight shifts, marked -1
hashed AS (
  SELECT c, said, c - c % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h
  FROM convs
), rebuilt AS (
  SELECT a.c, CASE WHEN b.c IS NULL THEN a.said[a.h + 1:] ELSE list_concat(b.said[1:a.h], a.said[a.h + 1:]) END AS said
  FROM hashed a LEFT JOIN convs b ON b.c = a.base
), prefixes AS (
  SELECT c, d, len(said) AS n, said[1:d] AS p FROM (SELECT c, said, unnest(range(0, len(said) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT p, d, min(c) AS c, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY p, d
), children AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON nodes.p = children.p AND nodes.d = children.d),
above AS (SELECT p[1:u] AS p, u AS d, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM full_nodes)),
sums AS (SELECT p, d, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY p, d)
SELECT a.c AS conv_id, a.d AS depth, b.c AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN sums s ON a.p = s.p AND a.d = s.d LEFT JOIN nodes b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]
"""
