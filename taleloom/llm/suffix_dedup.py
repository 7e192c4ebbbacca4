"""Removal of repeated passages by a suffix array: sampled splitters deal out suffixes, buckets sort them by multikey quicksort.

The suffixes are those that start where a window of `length` bytes may repeat. A window's leading token is its anchor: of the 24-byte strings in
it, the one of least rank. Equal windows have equal anchors, so windows with one anchor lie next to each other in a text and travel as one run of
bytes, and runs whose anchor occurs in one document only need not travel at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import on_group, on_groups, opened, sliced, squeezed, total_bytes, unzipped_table, zipped_table
from .common import table

LENGTH = 50
ANCHOR = 24
#: Text per shard of documents and per bucket of suffixes, in bytes.
SHARD_BYTES = 4 << 20
MOST_BUCKETS = 1 << 20
#: Sampled anchors per bucket, from which the splitters are taken.
SAMPLES = 64
#: Bytes of text whose ranks are held at once; longer texts are read in overlapping parts.
PART = 1 << 20
#: Bytes of short texts that are ranked at once, so that the ranks stay in the processor's cache.
TOGETHER = 1 << 15
#: An anchor with more entries than this is split: its windows are dealt out by their own bytes.
HOT = 4096
#: Runs or windows whose bytes are handled at once.
HELD = 1 << 16
#: Windows of runs that are sorted at once; those with one anchor stay together.
WINDOWS = 1 << 17
NO_ID = np.int64(2**63 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number that sorts like them."""
    n = len(data) - 7
    out = np.empty(n, dtype=np.uint64)
    for r in range(8):
        m = (len(data) - r) // 8
        out[r::8] = data[r : r + 8 * m].view(">u8")[: len(out[r::8])]
    return out


def _ranks(data: np.ndarray) -> np.ndarray:
    """Rank of the ANCHOR bytes from each position on: a hash, in which no byte order matters."""
    w = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).astype(np.uint64)
    n = len(data) - ANCHOR + 1
    rank = w[:n] * np.uint64(0x9E3779B97F4A7C15)
    shifted = np.empty(n, np.uint64)
    for o, factor in zip(range(8, ANCHOR, 8), (0x7FB5D329728EA185, 0x81DADEF4BC2DD44D), strict=True):
        np.right_shift(rank, np.uint64(32), out=shifted)
        rank ^= shifted
        rank += w[o : o + n]
        rank *= np.uint64(factor)
    return rank


def runs(texts: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of bytes, each run of windows with one anchor: number of the text, rank of the anchor, first window and end of the last window.

    Short texts are ranked together; windows that lie across two of them are left out.
    """
    out: list[tuple] = []
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    wide = length - ANCHOR + 1

    def emit() -> None:
        nonlocal held, size
        which, at = (np.array([h[i] for h in held], np.int64) for i in (0, 1))
        sizes = np.array([len(h[2]) for h in held])
        least = _ranks(np.concatenate([h[2] for h in held]) if len(held) > 1 else held[0][2])
        held, size = [], 0
        span = 1
        while 2 * span <= wide:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < wide:
            least = np.minimum(least[: span - wide], least[wide - span :])
        new = np.ones(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=new[1:-1])
        begins = np.cumsum(sizes) - sizes
        new[begins] = True
        new[(begins + sizes - length + 1)] = True  # the first window that goes beyond a text
        first = np.flatnonzero(new)
        first, last = first[:-1], first[1:] - 1
        place = np.searchsorted(begins, first, side="right") - 1
        within = first - begins[place] <= sizes[place] - length
        first, last, place = first[within], last[within], place[within]
        moved = (at - begins)[place]
        out.append((which[place], least[first], first + moved, last + moved + length))

    for i, data in enumerate(texts):
        for at in range(0, len(data) - length + 1, PART):
            held.append((i, at, data[at : at + PART + length - 1]))
            size += len(held[-1][2])
            if size > TOGETHER:
                emit()
    if held:
        emit()
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def multikey_sorted(words: np.ndarray, small: int = 4096) -> np.ndarray:
    """Order of rows of words, by three-way multikey quicksort: less and greater go on at the same word, equal at the next; small parts end at once."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        low, high, d = stack.pop()
        if high - low < 2 or d == words.shape[1]:
            continue
        own = order[low:high]
        if high - low <= small:
            order[low:high] = own[np.lexsort(words[own, d:].T[::-1])]
            continue
        key = words[own, d]
        pivot = np.sort(key[:: max(1, len(key) // 65)])[len(key[:: max(1, len(key) // 65)]) // 2]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        order[low:high] = np.concatenate((own[less], own[same], own[more]))
        a, b = low + int(less.sum()), high - int(more.sum())
        stack += [(low, a, d), (a, b, d + 1), (b, high, d)]
    return order


def _bytes_of(array: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The UTF-8 bytes of each text, as views of the array's own; null is empty."""
    out: list[np.ndarray] = []
    for chunk in array.chunks if isinstance(array, pa.ChunkedArray) else [array]:
        chunk = pa.compute.fill_null(chunk, "").cast(pa.large_binary())
        _, ends, data = chunk.buffers()
        data = np.frombuffer(data or b"", np.uint8)
        ends = np.frombuffer(ends, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1].tolist() if len(chunk) else []
        out += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return out


def _sample(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 0, PART):
        yield pa.record_batch([pa.array(runs(_bytes_of(batch.column(0)), length)[1].view(np.int64))], names=["rank"])


def splitters(texts: DataFrame, buckets: int, length: int, size: int) -> np.ndarray:
    """Bucket bounds among the ranks of anchors, from a sample of documents that holds about SAMPLES anchors per bucket."""
    wanted = SAMPLES * buckets * length  # bytes of text; an anchor stands for some 14
    share = min(1.0, 4 * wanted / max(size, 1))
    drawn = texts.sample(share, seed=5).mapInArrow(partial(_sample, length=length), "rank long")
    keep = min(1.0, SAMPLES * buckets * 14 / max(size * share, 1))
    ranks = np.array([r[0] for r in drawn.sample(keep, seed=6).collect()], dtype=np.int64).view(np.uint64)
    if not len(ranks):
        return np.empty(0, np.uint64)
    ranks.sort()
    return ranks[np.linspace(0, len(ranks), buckets + 1)[1:-1].astype(np.int64)]


def _delta(sorted_ranks: np.ndarray) -> np.ndarray:
    return np.diff(sorted_ranks, prepend=np.uint64(0))


def _anchors(batches: Iterator[pa.RecordBatch], bounds, length: int) -> Iterator[pa.RecordBatch]:
    """(shard, text) of a partition -> (bucket, block): sorted ranks of anchors with their shards; met: in more than one document of the shard."""
    bounds = bounds.value
    parts: list[tuple] = []
    held = docs = 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal parts, held
        rank, shard, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts, held = [], 0
        order = np.argsort(rank)
        rank = rank[order]
        same = rank[1:] == rank[:-1]
        tied = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
        order[tied] = order[tied][np.lexsort((doc[order[tied]], shard[order[tied]], rank[tied]))]
        shard, doc = shard[order], doc[order]
        first = np.flatnonzero(np.concatenate(([True], ~same | (shard[1:] != shard[:-1]))))
        met = doc[first] != doc[np.append(first[1:], len(doc)) - 1]
        rank, shard = rank[first], shard[first]
        bucket = np.searchsorted(bounds, rank, side="right")
        cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(bucket)), strict=True):
            block = squeezed(rank=_delta(rank[a:b]), shard=shard[a:b], met=np.packbits(met[a:b]), n=np.array([b - a]))
            yield pa.record_batch([pa.array([int(bucket[a])], pa.int32()), pa.array([block], pa.binary())], names=["bucket", "block"])

    for batch in sliced(batches, 1, PART):
        which, rank, _, _ = runs(_bytes_of(batch.column(1)), length)
        if len(rank):
            parts.append((rank, batch.column(0).to_numpy()[which].astype(np.uint32), docs + which))
            held += len(rank)
        docs += batch.num_rows
        if held > 1_000_000:
            yield from emit()
    if parts:
        yield from emit()


def _shared(group: pa.Table, hot: int) -> pa.Table:
    """A bucket of anchors -> (shard, block): for each shard the ranks it shares with others or between its own documents, and which are hot."""
    shards, blocks = [], []
    parts = [opened(b) for b in group.column("block").to_pylist()]
    if parts:
        rank = np.concatenate([np.cumsum(p["rank"], dtype=np.uint64) for p in parts])
        shard = np.concatenate([p["shard"] for p in parts])
        met = np.concatenate([np.unpackbits(p["met"], count=int(p["n"][0])) for p in parts]).astype(bool)
        order = multikey_sorted(rank[:, None])
        rank, shard, met = rank[order], shard[order], met[order]
        first = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
        n = np.diff(np.append(first, len(rank)))
        keep = np.repeat((n > 1) | np.maximum.reduceat(met, first), n)
        warm = np.repeat(n > hot, n)[keep]
        rank, shard = rank[keep], shard[keep]
        order = np.lexsort((rank, shard))
        rank, shard, warm = rank[order], shard[order], warm[order]
        cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(shard)), strict=True) if len(shard) else ():
            shards.append(int(shard[a]))
            blocks.append(squeezed(rank=_delta(rank[a:b]), hot=warm[a:b].astype(np.uint8)))
    return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array(blocks, pa.binary())})


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a partition as one compressed block per shard."""
    held: list[pa.RecordBatch] = []
    size = 0

    def emit() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held)
        shard = whole.column("shard").to_numpy()
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0)))
        rows = [(int(shard[order[a]]), zipped_table(whole.take(order[a:b]))) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "docs"])

    for batch in sliced(batches, 2, 4 * PART):
        held.append(batch)
        size += batch.nbytes
        if size > 16 * PART:
            yield emit()
            held, size = [], 0
    if held:
        yield emit()


def _opened_docs(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    docs = pa.concat_tables([unzipped_table(b) for b in blocks.column("docs").to_pylist()])
    ids = np.array([NO_ID if i is None else i for i in docs.column("doc_id").to_pylist()], dtype=np.int64)
    return ids, docs.column("row").to_numpy(), _bytes_of(docs.column("text"))


SPANS = "shard int, bucket int, local boolean, block binary"


def _numbered_texts(whole: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each stretch of bytes: equal stretches, and only those, have equal numbers, from 0 without gaps."""
    some = [zip(start[i : i + HELD].tolist(), end[i : i + HELD].tolist(), strict=True) for i in range(0, len(start), HELD)]
    texts = pa.chunked_array([pa.array([whole[a:b] for a, b in pairs], pa.binary()) for pairs in some], pa.binary())
    return np.concatenate([c.indices.to_numpy() for c in texts.dictionary_encode().unify_dictionaries().chunks])


def _least_of(numbers: np.ndarray, docs: np.ndarray) -> np.ndarray:
    least = np.full(int(numbers.max()) + 1, NO_ID)
    np.minimum.at(least, numbers, docs)
    return least


def _blocks_of(shards: np.ndarray, **columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Number columns as one compressed block per shard."""
    order = np.argsort(shards, kind="stable")
    shards = shards[order]
    cuts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else np.empty(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(shards)), strict=True) if len(shards) else ():
        yield int(shards[a]), squeezed(**{k: v[order[a:b]] for k, v in columns.items()})


def _candidates(left: pa.Table, right: pa.Table, bounds, length: int) -> pa.Table:
    """A shard's runs with shared anchors, one for each distinct string of bytes, to the buckets of their ranks; runs that repeat a smaller
    document of the same shard are settled here and pass through as spans."""
    bounds = bounds.value
    out: dict[str, list] = {"shard": [], "bucket": [], "local": [], "block": []}
    if left.num_rows and right.num_rows:
        shard = left.column("shard")[0].as_py()
        asked = [opened(b) for b in right.column("block").to_pylist()]
        wanted = np.concatenate([np.cumsum(a["rank"], dtype=np.uint64) for a in asked])
        hot = np.concatenate([a["hot"] for a in asked]).astype(bool)
        order = np.argsort(wanted)
        wanted, hot = wanted[order], hot[order]
        ids, rows, texts = _opened_docs(left)
        which, rank, start, end = runs(texts, length)
        at = np.minimum(np.searchsorted(wanted, rank), len(wanted) - 1)
        here = np.flatnonzero(wanted[at] == rank)
        which, rank, start, end, warm = which[here], rank[here], start[here], end[here], hot[at[here]]
        before = np.cumsum([0, *(len(data) for data in texts)])[:-1]  # of each text in the shard's bytes
        data = np.concatenate([*texts, np.zeros(64, np.uint8)])
        if warm.any():
            n = (end - start - length + 1)[warm]
            single, offset = np.repeat(np.flatnonzero(warm), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = start[single] + offset
            own = _own_ranks(data, before[which[single]] + first, length)
            which, rank = np.concatenate((which[~warm], which[single])), np.concatenate((rank[~warm], own))
            start, end = np.concatenate((start[~warm], first)), np.concatenate((end[~warm], first + length))
        if len(rank):
            doc, row, low, high = ids[which], rows[which], before[which] + start, before[which] + end
            whole = data.tobytes()
            number = _numbered_texts(whole, low, high)
            repeats = _least_of(number, doc)[number] != doc
            if repeats.any():
                block = squeezed(row=row[repeats], start=start[repeats], end=end[repeats])
                for column, value in zip(out.values(), (shard, shard % (len(bounds) + 1), True, block), strict=True):
                    column.append(value)
            ask = np.flatnonzero(~repeats)
            ask = ask[np.lexsort((start[ask], row[ask], doc[ask], rank[ask]))]
            bucket = np.searchsorted(bounds, rank[ask], side="right")
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(ask)), strict=True):
                i = ask[a:b]
                block = squeezed(
                    rank=_delta(rank[i]), doc=doc[i], row=row[i], start=start[i], size=(end - start)[i].astype(np.uint32),
                    data=b"".join([whole[x:y] for x, y in zip(low[i].tolist(), high[i].tolist(), strict=True)]),
                )
                for column, value in zip(out.values(), (shard, int(bucket[a]), False, block), strict=True):
                    column.append(value)
    return pa.table({"shard": pa.array(out["shard"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()), "local": pa.array(out["local"], pa.bool_()), "block": pa.array(out["block"], pa.binary())})


def _own_ranks(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """A rank for each window alone: the windows of a hot anchor are dealt out by it. Like anchors' ranks, it is the least of several values."""
    words = _words(data)
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(at), HELD):
        some = at[low : low + HELD]
        x = np.zeros(len(some), np.uint64)
        for i, s in enumerate(range(0, length, 8)):
            w = words[some + s]
            if length - s < 8:
                w &= ~np.uint64((1 << 8 * (8 - length + s)) - 1)
            x += _mix(w + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        x = _mix(x)
        least = np.full(len(some), np.uint64(2**64 - 1))
        for i in range(1, LENGTH - ANCHOR + 2):
            np.minimum(least, _mix(x + np.uint64(i * 0xD6E8FEB86659FD93 % 2**64)), out=least)
        out[low : low + HELD] = least
    return out


def _repeats(group: pa.Table, length: int) -> pa.Table:
    """A bucket of runs -> spans per shard: windows that a smaller document also has."""
    shards, blocks = [], []
    asked = group.filter(pa.compute.invert(group.column("local")))
    for s, b in zip(*(group.filter(group.column("local")).column(c).to_pylist() for c in ("shard", "block")), strict=True):
        shards.append(s)
        blocks.append(b)
    if asked.num_rows:
        parts = [opened(b) for b in asked.column("block").to_pylist()]
        rank = np.concatenate([np.cumsum(p["rank"], dtype=np.uint64) for p in parts])
        doc, row, start, size = (np.concatenate([p[c].astype(np.int64) for p in parts]) for c in ("doc", "row", "start", "size"))
        shard = np.repeat(asked.column("shard").to_numpy(), [len(p["rank"]) for p in parts])
        data = b"".join([p["data"] for p in parts])
        del parts
        ends = np.concatenate(([0], np.cumsum(size)))
        number = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode().indices.to_numpy()
        least = _least_of(number, doc)
        sample = np.empty(len(least), np.int64)
        sample[number] = np.arange(len(number))  # one place of each distinct run
        _, same, n = np.unique(rank[sample], return_inverse=True, return_counts=True)
        repeats = least[number] < doc
        # other runs with the anchor of these may share some of their windows
        owners = np.flatnonzero(~repeats & (n[same] > 1)[number])
        found = [(shard[repeats], row[repeats], start[repeats], (start + size)[repeats])]
        if len(owners):
            owners = owners[np.argsort(number[owners], kind="stable")]
            open_runs, place, held_by = np.unique(number[owners], return_index=True, return_counts=True)
            which, low, high = _shared_stretches(data, ends, rank, sample[open_runs], least[open_runs], length)
            times = held_by[which]
            entry = owners[np.repeat(place[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            found.append((shard[entry], row[entry], start[entry] + np.repeat(low, times), start[entry] + np.repeat(high, times)))
        shard, row, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        for s, b in _blocks_of(shard, row=row, start=start, end=end):
            shards.append(s)
            blocks.append(b)
    return pa.table({"shard": pa.array(shards, pa.int32()), "block": pa.array(blocks, pa.binary())})


def _shared_stretches(data: bytes, ends: np.ndarray, rank: np.ndarray, places: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Distinct runs at these places in data, with their least documents -> number of the run, start and end there of the stretches that a
    smaller document also has. Windows are sorted anchor by anchor, some WINDOWS at a time."""
    order = np.argsort(rank[places], kind="stable")
    sorted_ranks = rank[places][order]
    before = np.cumsum((ends[places + 1] - ends[places] - length + 1)[order])
    closes = np.flatnonzero(np.concatenate((sorted_ranks[1:] != sorted_ranks[:-1], [True])))  # last run of each anchor
    closes = closes[np.flatnonzero(np.diff(before[closes] // WINDOWS, append=-1))]
    out = []
    for some in np.split(order, closes[:-1] + 1):
        low, high = ends[places[some]], ends[places[some] + 1]
        part = b"".join([data[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        which, start, end = _shared_windows(np.frombuffer(part + b"\0" * 8, np.uint8), high - low, docs[some], length)
        out.append((some[which], start, end))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shared_windows(data: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    windows = sizes - length + 1
    which = np.repeat(np.arange(len(sizes)), windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(sizes) - sizes, windows) + offset
    words = _words(data)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    keys = np.stack([words[at + s] for s in steps], axis=1)
    own = docs[which]
    order = multikey_sorted(keys)
    differs = np.concatenate(([True], (keys[order[1:]] != keys[order[:-1]]).any(axis=1)))  # neighbours in the suffix array
    first = np.flatnonzero(differs)
    smallest = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.append(first, len(order))))
    hit = np.empty(len(order), bool)
    hit[order] = smallest < own[order]
    which, offset = which[hit], offset[hit]
    if not len(which):
        return which, offset, offset
    new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + length))))
    return which[new], offset[new], offset[np.append(new[1:], len(which)) - 1] + length


def _removed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's documents less the spans that came back, merged to maximal runs."""
    out: dict[str, list] = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
    if left.num_rows:
        ids, rows, texts = _opened_docs(left)
        parts = [opened(b) for b in right.column("block").to_pylist()]
        row, start, end = (np.concatenate([p[c].astype(np.int64) for p in parts]) if parts else np.empty(0, np.int64) for c in ("row", "start", "end"))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        for doc, key, data in zip(ids.tolist(), rows.tolist(), texts, strict=True):
            a, b = np.searchsorted(row, key, side="left"), np.searchsorted(row, key, side="right")
            spans: list[tuple[int, int]] = []
            if b > a:
                s, reach = start[a:b], np.maximum.accumulate(end[a:b])
                new = np.flatnonzero(np.concatenate(([True], s[1:] > reach[:-1])))
                spans = list(zip(s[new].tolist(), reach[np.append(new[1:], len(s)) - 1].tolist(), strict=True))
            text = data.tobytes()
            edges = [0, *(x for pair in spans for x in pair), len(text)]
            values = (None if doc == NO_ID else doc, len(text), [{"start": x, "end": y} for x, y in spans], b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            for column, value in zip(out.values(), values, strict=True):
                column.append(value)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds, strict=True)})


def remove_repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """Documents (doc_id, text) with the bytes that belong to a string of `length` bytes which also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, spans (maximal removed runs, start and end in UTF-8 bytes) and kept (the remaining bytes). A null text is empty; a
    null doc_id counts as larger than any; rows with equal doc_ids don't remove from each other. Strings are judged on the input.
    Documents are dealt to shards by a hash. Anchors go to buckets between sampled splitters; only runs whose anchor is shared are sent, each
    distinct run once per shard; equal ranks lie in one bucket, so neighbours never stand on two sides of a boundary. Anchors with many entries
    are split into single windows that are dealt out by their own bytes.
    """
    spark = docs.sparkSession
    size = total_bytes(docs)
    shards = max(1, -(-size // shard_bytes))
    row = F.xxhash64("doc_id", "text").alias("row")
    base = docs.select("doc_id", row, "text").withColumn("shard", F.pmod("row", F.lit(shards)).cast("int"))
    bounds = spark.sparkContext.broadcast(splitters(base.select("text"), min(shards, MOST_BUCKETS), length, size))
    anchors = base.select("shard", "text").mapInArrow(partial(_anchors, bounds=bounds, length=length), "bucket int, block binary")
    shared = anchors.groupBy("bucket").applyInArrow(on_group(_shared, hot=hot), "shard int, block binary")
    zipped = base.select("doc_id", "row", "text", "shard").mapInArrow(_zipped, "shard int, docs binary")
    candidates = zipped.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(on_groups(_candidates, bounds=bounds, length=length), SPANS)
    spans = candidates.groupBy("bucket").applyInArrow(on_group(_repeats, length=length), "shard int, block binary")
    return zipped.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(
        on_groups(_removed), "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
