"""Exact Jaccard join in the metric space of shingle sets: regions around pivots, triangle-inequality windows, regions joined recursively."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import on_group, opened, sliced, squeezed
from .classes import _chosen, _labelled, _merged
from .common import modest_batches, stored, table
from .shingles import _mix, _step, bags

#: Two sets are linked if 9 * (intersection) >= 4 * (sum of sizes), which is 5 * intersection >= 4 * union: a distance of 0.2 at most.
LINKED = (9, 4)
RADIUS = 0.2
SLICE = 4 << 20
#: Elements of one bucket of the count, about, and how often an element may come in a block of documents before the block sends only its number.
BUCKET, OFTEN = 3_000_000, 16
#: Regions of up to so many members compare all that is left at once; larger ones go on with few pivots, then more, up to all members.
SMALL_REGION = 48
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _encoded(column: pa.Array, lower: bool) -> list[bytes]:
    return [(t.encode().translate(LOWER) if lower else t.encode()) if t else b"" for t in column.to_pylist()]


def _sets(texts: list[bytes], multiset: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' sets: elements as (text number, 64-bit name), sorted by text; 16 bytes that name each set; its size.

    The n-th copy of a shingle in a bag is an element of its own, so bags overlap as sets do.
    """
    owner, shingle, copies = bags(texts)
    if not multiset:
        copies = np.ones(len(copies), np.int64)
    name, size = np.zeros((len(texts), 2), np.uint64), np.zeros(len(texts), np.int64)
    if len(owner):
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size[owner[first]] = np.add.reduceat(copies, first)
        for k in (0, 1):
            name[owner[first], k] = np.add.reduceat(_mix(shingle + _step(k + 11)) * copies.astype(np.uint64), first)
    nth = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
    each = np.repeat(shingle, copies)
    return np.repeat(owner, copies), np.where(nth == 0, each, _mix(each + _step(3) * nth.astype(np.uint64))), name, size


def _named(batches: Iterator[pa.RecordBatch], lower: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, name, size)."""
    for batch in sliced(batches, 1, SLICE):
        _, _, name, size = _sets(_encoded(batch.column(1), lower), False)
        yield pa.record_batch([batch.column(0), pa.array([n.tobytes() for n in name], pa.binary()), pa.array(size)], names=["doc_id", "name", "size"])


def _sent(batches: Iterator[pa.RecordBatch], buckets: int, lower: bool, multiset: bool) -> Iterator[pa.RecordBatch]:
    """(block, text) -> (bucket, block, data), each batch a block named by its first row: a block's elements by bucket of their names, and under bucket -1 what the block itself needs later.

    Equal sets of a block are sent once. An element that many documents of the block hold goes to its bucket once, with their number.
    """
    for batch in sliced(batches, 1, SLICE):
        owner, element, name, size = _sets(_encoded(batch.column(1), lower), multiset)
        _, one = np.unique(name, axis=0, return_index=True)
        own = np.zeros(batch.num_rows, bool)
        own[one] = True
        kept = own[owner]
        block = batch.column(0)[0].as_py()
        owner, element = (np.cumsum(own) - 1)[owner[kept]], element[kept] >> np.uint64(16)
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], element[order]
        first = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1]))) if len(element) else np.empty(0, np.int64)
        times = np.diff(np.append(first, len(element)))
        often = np.repeat(times > OFTEN, times)
        hot = first[times > OFTEN]
        data = [squeezed(names=name[own].tobytes(), size=size[own], hot=element[often], holder=owner[often])]
        # the rest with their documents (from 1 on), the frequent ones with document 0 and their number
        at = np.sort(np.concatenate((np.flatnonzero(~often), hot)))
        who = np.where(often, 0, owner + 1)[at]
        held = np.where(often, np.repeat(times, times), 1)[at]
        sent = element[at]
        edges = np.searchsorted(sent, np.array([((k << 48) + buckets - 1) // buckets for k in range(buckets + 1)], np.uint64))
        names = [-1]
        for k in range(buckets):
            a, b = edges[k], edges[k + 1]
            if b > a:
                names.append(k)
                data.append(squeezed(first=sent[a : a + 1], step=np.diff(sent[a:b]), who=who[a:b], held=held[a:b]))
        yield pa.record_batch([pa.array(names, pa.int32()), pa.array([block] * len(names), pa.int64()), pa.array(data, pa.binary())], names=["bucket", "block", "data"])


def _counted(group: pa.Table) -> pa.Table:
    """One bucket (bucket, block, data) -> (block, data): to each block its elements that another set holds too, with the number of sets."""
    schema = pa.schema([("block", pa.int64()), ("data", pa.binary())])
    if group.column(0)[0].as_py() < 0:
        return group.select(["block", "data"]).cast(schema)
    parts = [opened(d) for d in group.column(2).to_pylist()]
    blocks = np.array(group.column(1).to_pylist(), np.int64)
    element = np.concatenate([np.cumsum(np.concatenate((p["first"], p["step"])).astype(np.uint64), dtype=np.uint64) for p in parts])
    who = np.concatenate([p["who"].astype(np.int64) for p in parts])
    held = np.concatenate([p["held"].astype(np.int64) for p in parts])
    source = np.repeat(np.arange(len(parts)), [len(p["who"]) for p in parts])
    del parts
    order = np.argsort(element, kind="stable")
    ranked = element[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    total = np.add.reduceat(held[order], first)
    sets = np.empty(len(element), np.int64)
    sets[order] = np.repeat(total, np.diff(np.append(first, len(ranked))))
    shared = np.flatnonzero(sets > 1)
    edges = np.searchsorted(source[shared], np.arange(len(blocks) + 1))
    out_blocks, out = [], []
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if b > a:
            at = shared[a:b]
            out_blocks.append(int(blocks[k]))
            out.append(squeezed(element=element[at], who=who[at], sets=sets[at]))
    return pa.table([pa.array(out_blocks, pa.int64()), pa.array(out, pa.binary())], schema=schema)


def window(size: np.ndarray) -> np.ndarray:
    """How many regions a set of that size lies in: by the triangle inequality a set within the radius lacks at most a fifth of it."""
    return size - (4 * size + 4) // 5 + 1


def _ranked(group: pa.Table) -> pa.Table:
    """One block (block, data) -> (name, size, alone, elements): for each set that has a shared element within its window, its shared elements from the
    rarest on (ties by name), and the number of elements that no other set holds."""
    parts = [opened(d) for d in group.column("data").to_pylist()]
    head = next(p for p in parts if "names" in p)
    size = head["size"].astype(np.int64)
    back = [p for p in parts if "who" in p]
    none = np.empty(0, np.int64)
    element = np.concatenate([none.astype(np.uint64), *(p["element"].astype(np.uint64) for p in back)])
    who, sets = (np.concatenate([none, *(p[k].astype(np.int64) for p in back)]) for k in ("who", "sets"))
    mark = who == 0
    order = np.argsort(element[mark])
    marked, times = element[mark][order], sets[mark][order]
    hot, holder = head["hot"].astype(np.uint64), head["holder"].astype(np.int64)
    of_hot = times[np.searchsorted(marked, hot)] if len(hot) else none
    element = np.concatenate((element[~mark], hot))
    owner = np.concatenate((who[~mark] - 1, holder))
    sets = np.concatenate((sets[~mark], of_hot))
    order = np.lexsort((element, sets, owner))
    element, owner = element[order].astype("<u8"), owner[order]
    edges = np.searchsorted(owner, np.arange(len(size) + 1))
    alone = size - np.diff(edges)
    live = np.flatnonzero((alone < window(size)) & (size > 0))
    data = [element[edges[i] : edges[i + 1]].tobytes() for i in live.tolist()]
    names = pa.array([head["names"][16 * i : 16 * i + 16] for i in live.tolist()], pa.binary())
    return pa.table({"name": names, "size": pa.array(size[live]), "alone": pa.array(alone[live]), "elements": pa.array(data, pa.binary())})


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, size, alone, elements) -> (region, id, size, rank): a row for each region whose pivot is a shared element within the set's window."""
    for batch in batches:
        size, alone = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        lists = [np.frombuffer(e, "<u8") for e in batch.column(3).to_pylist()]
        n = np.minimum(window(size) - alone, [len(e) for e in lists]).astype(np.int64) if len(lists) else np.empty(0, np.int64)
        region = np.concatenate([np.empty(0, np.uint64), *(e[:k] for e, k in zip(lists, n, strict=True))]).astype(np.int64)
        rank = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(alone, n)
        yield pa.record_batch([pa.array(region), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(size, n)), pa.array(rank)], names=["region", "id", "size", "rank"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, size_a, size_b, elements of both) -> (a, b, distance, linked). Elements that no other set holds are in no intersection."""
    num, den = LINKED
    for batch in batches:
        a, b, n, m = (batch.column(i).to_numpy() for i in range(4))
        common = np.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"))) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(1 - common / np.maximum(1, n + m - common)), pa.array(num * common >= den * (n + m))], names=["a", "b", "distance", "linked"])


def shared_sets(texts: DataFrame, elements: int, lower: bool, multiset: bool = False) -> DataFrame:
    """Rows (name, size, alone, elements) of the texts whose sets can have a partner; a name comes once.

    `elements` is the number of elements of all texts. Elements are counted over all texts in buckets of their names; each block of texts hears which
    of its elements others hold, and how many. That gives one order of all elements, from the rarest on.
    """
    spark = texts.sparkSession
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-elements // BUCKET))
    sent = texts.select(F.monotonically_increasing_id().alias("block"), "text").mapInArrow(partial(_sent, buckets=buckets, lower=lower, multiset=multiset), "bucket int, block long, data binary")
    of_block = F.when(F.col("bucket") < 0, F.col("block")).otherwise(0)
    back = sent.groupBy("bucket", of_block).applyInArrow(on_group(_counted), "block long, data binary")
    return back.groupBy("block").applyInArrow(on_group(_ranked), "name binary, size long, alone long, elements binary").dropDuplicates(["name"])


def _possible(x: Column, rank_x: Column, y: Column, rank_y: Column) -> Column:
    """The sizes, and the elements that are left from these ranks on, allow a link."""
    num, den = LINKED
    return num * F.least(x - rank_x, y - rank_y) >= den * (x + y)


def _distances(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    left = nodes.select(F.col("id").alias("a"), F.col("size").alias("_n"), F.col("elements").alias("_x"))
    right = nodes.select(F.col("id").alias("b"), F.col("size").alias("_m"), F.col("elements").alias("_y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "_n", "_m", "_x", "_y")
    return stored(both.mapInArrow(_met, "a long, b long, distance double, linked boolean"))


def linked_classes(nodes: DataFrame, comps: DataFrame | None = None) -> DataFrame | None:
    """(node, comp) of the written nodes (id, size, alone, elements), whose sets all differ, that are linked to another; None without any link.

    Each shared element is a pivot; a set lies in the regions of the rarest elements of its window, so two linked sets meet in the region of the
    rarest element that both hold. A region's second pivot is the member with the fewest rarer elements, which lies in the middle of a group of
    copies: every member's distance to it is taken, and within the radius that is a link. What is not linked through it goes on in regions that
    still hold several classes, with more and more members as pivots, up to all: a pair is compared if its classes differ, its sizes and ranks
    allow a link, and its distances to the region's pivot differ by the radius at most. comps are classes that are known already.
    """
    members = nodes.select("id", "size", "alone", "elements").mapInArrow(_regions, "region long, id long, size long, rank long")
    members = members.withColumn("own", F.col("id")) if comps is None else _labelled(members, comps, "id", "own")
    heads = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("_low"), F.max("own").alias("_high"), F.min(F.struct("rank", "id", "size", "own")).alias("pivot"))
    live = stored(members.join(heads.where("_low <> _high").drop("_low", "_high"), "region"))
    col = F.col
    first = live.where((col("own") != col("pivot.own")) & _possible(col("size"), col("rank"), col("pivot.size"), col("pivot.rank")))
    met = _distances(first.select(col("id").alias("a"), col("pivot.id").alias("b")).distinct(), nodes)
    links = met.where("linked").select("a", "b")
    if not links.isEmpty():
        comps = _merged(comps, links)
    far = met.select(col("a").alias("id"), col("b").alias("_b"), "distance")
    live = live.withColumn("_b", col("pivot.id")).join(far, ["id", "_b"], "left").select("region", "id", "size", "rank", "n", F.when(col("id") == col("_b"), 0.0).otherwise(col("distance")).alias("away"))
    before = None
    for step in count(4, 6):  # 16 pivots, 1024, 65536, ...
        own = live.select("region", "id", "size", "rank", "n", "away")
        own = own.withColumn("own", col("id")) if comps is None else _labelled(own, comps, "id", "own")
        mixed = own.groupBy("region").agg(F.min("own").alias("_low"), F.max("own").alias("_high")).where("_low <> _high").select("region")
        live = stored(own.join(mixed, "region"))
        if live.isEmpty():
            return comps
        tried = F.lit(False) if before is None else _chosen(before)
        small = (col("n") <= SMALL_REGION) if before is None else F.lit(False)
        x = live.withColumns({"pick": small | _chosen(step), "tried": tried})
        p = x.where("pick").select("region", *(col(c).alias(f"{c}_a") for c in ("id", "size", "rank", "away", "own", "tried")))
        m = x.select("region", *(col(c).alias(f"{c}_b") for c in ("id", "size", "rank", "away", "own", "tried", "pick")))
        near = F.coalesce(F.abs(col("away_a") - col("away_b")) <= RADIUS + 1e-9, F.lit(True))
        wanted = _possible(col("size_a"), col("rank_a"), col("size_b"), col("rank_b")) & near
        pairs = p.join(m, (p["region"] == m["region"]) & F.expr("own_a <> own_b and not (tried_a and tried_b) and (id_a > id_b or not pick_b)") & wanted)
        met = _distances(stored(pairs.select(col("id_a").alias("a"), col("id_b").alias("b")).distinct()), nodes)
        links = met.where("linked").select("a", "b")
        if not links.isEmpty():
            comps = _merged(comps, links)
        live, before = live.where((col("n") > SMALL_REGION) & (col("n") >= 1 << step)), step


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): n_shingles, component_id, set_copies.

    A text's set holds its distinct shingles of five words, A-Z lower-cased, words being runs of characters other than ASCII white space; a text
    of one to four words has one shingle, of all its words. Null, empty and blank texts have an empty set and are linked with nothing. Two documents
    are linked if the intersection is 0.8 or more of the union; component_id is the least doc_id that links reach (null, if all of them are null).
    set_copies counts the documents with the same set. Equal sets are one member of the join; repeated rows stay rows.
    """
    modest_batches(docs)
    rows = stored(docs.select("doc_id", "text").mapInArrow(partial(_named, lower=True), "doc_id long, name binary, size long"))
    sets = rows.where("size > 0").groupBy("name").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()))
    live = shared_sets(docs, rows.agg(F.sum("size")).first()[0] or 0, lower=True)
    nodes = stored(live.join(sets.select("name", "id"), "name").drop("name"))
    comps = linked_classes(nodes)
    if comps is None:
        classes = sets.select("name", "copies", F.col("least").alias("component_id"))
    else:
        named = _labelled(sets, comps, "id", "comp")
        least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
        classes = named.join(least, "comp").select("name", "copies", "component_id")
    return rows.join(classes, "name", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("copies", F.lit(1)).alias("set_copies")
    )


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
