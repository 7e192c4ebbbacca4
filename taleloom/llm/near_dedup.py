"""Near-duplicates by BagMinHash: signatures of weighted Jaccard similarity over five-word shingles, bands, and exact multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import sliced
from .classes import _labelled, _merged
from .common import attach, modest_batches, stored, table, thinned
from .jaccard_join import linked_classes, shared_sets
from .shingles import _mix, _step, bags

BANDS, ROWS = 32, 6
#: Two texts are linked if 5 * (overlap) >= 4 * (union): similarity of 0.8 or more.
SIMILAR = (5, 4)
SLICE = 1 << 20


def bag_min_hash(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Signatures of m values per text, equal in a place with the weighted Jaccard similarity of two bags as probability.

    An element's weight axis is cut into the levels (0,1], (1,2], (2,4], (4,8], ...; each level is a Poisson process over time whose rate is its
    width, and each of its points falls on one of the m places and on one unit of the level. A bag sees the points on units up to its count, so
    two bags share exactly the points up to the smaller count. A place's value is its earliest point. Points are made in the order of time, for
    all bags at once, and an element stops as soon as its next point is later than all values of its bag.
    """
    best = np.full((texts, m), np.inf)
    levels, parts = 0, []
    while True:
        low = 0 if levels == 0 else 1 << (levels - 1)
        some = np.flatnonzero(count > low)
        if not len(some):
            break
        width = max(1, low)
        parts.append((owner[some], _mix(shingle[some] + _step(levels + 1)), np.full(len(some), low), np.full(len(some), width), count[some]))
        levels += 1
    if not parts:
        return best
    text, seed, low, width, top = (np.concatenate(x) for x in zip(*parts, strict=True))
    time, step = np.zeros(len(text)), 0
    flat = best.reshape(-1)
    while len(text):
        u = _mix(seed + _step(2 * step + 1))
        time = time - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width
        v = _mix(seed ^ (u + np.uint64(step + 1)))
        place = ((v & np.uint64(0xFFFFFFFF)) % np.uint64(m)).astype(np.int64)
        unit = low + 1 + ((v >> np.uint64(32)) % width.astype(np.uint64)).astype(np.int64)
        seen = (unit <= top) & (time < flat[text * m + place])
        np.minimum.at(flat, text[seen] * m + place[seen], time[seen])
        going = time < best.max(axis=1)[text]
        text, seed, low, width, top, time = (x[going] for x in (text, seed, low, width, top, time))
        step += 1
    return best


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, text) -> (doc_id, key, bag, size, bands): bag names the multiset of shingles in 16 bytes."""
    for batch in sliced(batches, 2, SLICE):
        texts = [t.encode() if t else b"" for t in batch.column(2).to_pylist()]
        owner, shingle, count = bags(texts)
        n = len(texts)
        weight = count.astype(np.uint64)
        name = np.zeros((n, 2), np.uint64)
        size = np.zeros(n, np.int64)
        if len(owner):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            for k in (0, 1):
                name[owner[first], k] = np.add.reduceat(_mix(shingle + _step(k + 11)) * weight, first)
            size[owner[first]] = np.add.reduceat(count, first)
        best = bag_min_hash(owner, shingle, count, n, BANDS * ROWS)
        # the last bits of the times are dropped, as logarithms may differ in them between machines
        bits = _mix((best.view(np.uint64) >> np.uint64(16)).reshape(n, BANDS, ROWS) * (2 * np.arange(ROWS, dtype=np.uint64) + np.uint64(1)))
        bands = _mix(bits.sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _step(1)).view(np.int64)
        lists = [b.tolist() if s else [] for b, s in zip(bands, size, strict=True)]
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in name], pa.binary()), pa.array(size), pa.array(lists, pa.list_(pa.int64()))],
            names=["doc_id", "key", "bag", "size", "bands"],
        )


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (bag, shingles, counts)."""
    for batch in sliced(batches, 0, SLICE):
        texts = [t.encode() if t else b"" for t in batch.column(0).to_pylist()]
        owner, shingle, count = bags(texts)
        out: list[tuple] = []
        edges = np.searchsorted(owner, np.arange(len(texts) + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            name = np.array([(_mix(shingle[a:b] + _step(k + 11)) * count[a:b].astype(np.uint64)).sum(dtype=np.uint64) for k in (0, 1)], np.uint64)
            out.append((name.tobytes(), shingle[a:b].tobytes(), count[a:b].astype("<u4").tobytes()))
        yield pa.record_batch([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["bag", "shingles", "counts"])


def _overlapping(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both bags -> the pairs that are similar by exact multiset overlap."""
    num, den = SIMILAR
    for batch in batches:
        keep = []
        for xs, xc, ys, yc in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            x, y, n, k = np.frombuffer(xs, np.uint64), np.frombuffer(ys, np.uint64), np.frombuffer(xc, "<u4").astype(np.int64), np.frombuffer(yc, "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            common = int(np.minimum(n, k[at])[y[at] == x].sum()) if len(y) else 0
            keep.append(num * common >= den * (int(n.sum() + k.sum()) - common))
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are similar. Sizes are compared first; then the shingles of the bags named by the pairs are made from one
    text each, and go to the pairs in two joins."""
    num, den = SIMILAR
    near = (
        pairs.join(nodes.select(F.col("id").alias("a"), F.col("size").alias("_x")), "a").join(nodes.select(F.col("id").alias("b"), F.col("size").alias("_y")), "b")
        .where(num * F.least("_x", "_y") >= den * F.greatest("_x", "_y")).select("a", "b")
    )
    near = stored(near)
    named = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    wanted = stored(nodes.join(named, "id").select("id", "bag", "doc_id"))
    texts = attach(docs.select("doc_id", "text"), wanted.select("doc_id").distinct(), ["doc_id"], "left_semi").select("text")
    made = texts.mapInArrow(_bagged, "bag binary, shingles binary, counts binary").join(wanted.select("bag", "id"), "bag")
    made = stored(made.select("id", "shingles", "counts").dropDuplicates(["id"]))
    left = made.select(F.col("id").alias("a"), F.col("shingles").alias("xs"), F.col("counts").alias("xc"))
    right = made.select(F.col("id").alias("b"), F.col("shingles").alias("ys"), F.col("counts").alias("yc"))
    return near.join(left, "a").join(right, "b").select("a", "b", "xs", "xc", "ys", "yc").mapInArrow(_overlapping, "a long, b long")


def _classes(nodes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(node, comp) of the nodes that are linked to another; None without any link.

    First every member of a bucket meets the least one. What stays apart in a bucket then goes through the exact join of bags: there a text meets only
    those that hold one of its rarest shingles, so texts with too much of their own meet nobody, and a large group of copies costs a few
    comparisons a member. No pair that shares a bucket is lost.
    """
    members = nodes.select("id", F.explode("bands").alias("band"))
    leaders = members.groupBy("band").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    live = stored(members.join(leaders, "band").select("band", "id", "leader"))
    found = stored(_verified(live.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), nodes, docs))
    comps = None if found.isEmpty() else _merged(None, found)
    own = live.withColumn("own", F.col("id")) if comps is None else _labelled(live, comps, "id", "own")
    mixed = own.groupBy("band").agg(F.min("own").alias("_least"), F.max("own").alias("_most")).where("_least <> _most").select("band")
    apart = stored(nodes.join(live.join(mixed, "band").select("id").distinct(), "id").select("id", "bag", "doc_id", "size"))
    total = apart.agg(F.sum("size")).first()[0]
    if total is None:
        return comps
    texts = attach(docs.select("doc_id", "text"), stored(apart.select("doc_id").distinct()), ["doc_id"], "left_semi")
    sets = shared_sets(texts, total, lower=False, multiset=True).withColumnRenamed("name", "bag")
    return linked_classes(stored(sets.join(apart.select("bag", "id"), "bag").drop("bag")), comps)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): key, class_id, class_size, kept.

    Two texts are linked if the multisets of their five-word shingles overlap by 0.8 or more of their union; classes are connected through links,
    class_id is the least doc_id in the class, and one row of it is kept. Words are runs of characters other than ASCII white space. Texts with
    equal multisets are one node (texts without words, and null, among them), so copies are not compared. Bands only propose pairs: in each
    bucket all members meet the least one; what stays apart is joined exactly by its rarest shingles. A pair of similarity 0.8 shares no band with probability 6e-5.
    key is a hash of the text; repeated rows stay rows.
    """
    modest_batches(docs)
    docs = docs.select("doc_id", "text")
    signed = stored(docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_signed, "doc_id long, key long, bag binary, size long, bands array<bigint>"))
    nodes = stored(signed.groupBy("bag").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("size"), F.any_value("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))
    comps = _classes(nodes.where("size > 0"), docs)
    own = nodes.select("bag", "id", "doc_id", "rows")
    named = own.withColumn("comp", F.col("id")) if comps is None else _labelled(own, comps, "id", "comp")
    totals = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.sum("rows").alias("class_size"))
    classes = named.join(totals, "comp").select("bag", "comp", "class_id", "class_size")
    rows = stored(signed.select("doc_id", "key", "bag").join(classes, "bag"))
    # of the rows with the least doc_id of a class, the one with the least key; map-side combined, one row per class leaves a task
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("comp").agg(F.min("key").alias("_key"))
    return rows.join(first, "comp").select("doc_id", "key", "class_id", "class_size", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("_key"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the one with the least doc_id, and all columns."""
    verdict = near_duplicates(docs).groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("_n"), F.bool_or("kept").alias("_kept"))
    gone = stored(verdict.where("not _kept or _n > 1").select("doc_id", "key", F.col("_kept").alias("_stay")))
    return thinned(docs.withColumn("_key", F.xxhash64("text")), gone.withColumnRenamed("key", "_key"), ["doc_id", "_key"], docs.columns)


def op9_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
