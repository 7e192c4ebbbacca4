"""Packing documents into fixed windows: best-fit decreasing with a segment tree indexed by remaining capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import sliced
from .bpe import byte_bpe
from .common import modest_batches, numbered, table, written

CAPACITY = 1024
#: Bytes of text that a worker takes from a batch at once.
PART = 1 << 20
END_OF_TEXT = b"\0\0\0\0"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the tightest that still holds a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.size
        while i:
            self.count[i] += n
            i //= 2

    def tightest(self, length: int) -> int | None:
        """The smallest capacity >= length with an open window."""
        i = length + self.size
        if self.count[i]:
            return length
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over the histogram of lengths: (length, first item, items, items per window, first window, offset) by item number.

    Items of one length are alike: the tightest window takes as many of them as fit, since after each it is tighter still. So all windows of
    one remaining capacity are filled at once, and the plan's size depends on the capacity alone, not on the number of documents.
    """
    tree, held, windows, steps = CapacityTree(capacity), {}, 0, []
    for length in sorted(counts, reverse=True):
        left, item = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, windows, -(-left // (capacity // length))
                windows += n
            else:
                first, n = held[room].pop()
                tree.add(room, -n)
            each = room // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            full, rest = divmod(placed, each)
            steps.append((length, item, placed, each, first, capacity - room))
            for at, m, remains in ((first, full, room - each * length), (first + full, int(rest > 0), room - rest * length), (first + used, n - used, room)):
                if m and remains:
                    held.setdefault(remains, []).append((at, m))
                    tree.add(remains, m)
            item, left = item + placed, left - placed
    return steps


def _cut(batches: Iterator[pa.RecordBatch], path: str, ranks_path: str | None, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    bpe, step = byte_bpe(path, ranks_path), 4 * capacity
    for batch in sliced(batches, 1, PART):
        out: list[list] = [[], [], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = bpe.ids(text or "") + END_OF_TEXT
            for at in range(0, len(ids), step):
                piece = ids[at : at + step]
                values = (doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
        kinds = [pa.int64()] * 5 + [pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:5], names=names if with_ids else names[:5])


def pieces(docs: DataFrame, path: str, ranks_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) as token pieces: full windows from the front, then the rest. A null text is empty; every document ends with id 0."""
    modest_batches(docs)
    run = partial(_cut, path=path, ranks_path=ranks_path, capacity=capacity, with_ids=with_ids)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (length between 1 and capacity, any other columns) with sequence_id and offset.

    The histogram of lengths has at most `capacity` rows; its plan is made on the driver and looked up by the item's number in the order of
    lengths. Ties are settled by the row's own values, and rows equal in all are exchangeable. No two pieces overlap and windows fill from
    offset 0 without gaps. A hot length is spread over many range partitions, as the row's values follow it in the order.
    """
    order = ["length", *(c for c in ("ids_crc32", "doc_id", "start") if c in items.columns)]
    rows = numbered(written(items), order, "_item")  # written first: the sampling of ranges would make the pieces a second time
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for length in sorted(counts):
        before[length], total = total, total + counts[length]
    steps = sorted((before[length] + item, length, each, window, offset) for length, item, _, each, window, offset in plan(counts, capacity))
    first, lengths, each, window, offset = (np.array(x, dtype=np.int64) for x in (zip(*steps, strict=True) if steps else [()] * 5))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(item: pd.Series) -> pd.DataFrame:
        item = item.to_numpy()
        s = np.searchsorted(first, item, side="right") - 1
        nth = item - first[s]
        return pd.DataFrame({"sequence_id": window[s] + nth // each[s], "offset": offset[s] + nth % each[s] * lengths[s]})

    return rows.withColumn("_placed", placed("_item")).select(*(c for c in items.columns if c not in ("sequence_id", "offset")), "_placed.*")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Packed pieces with ids as whole windows: (sequence_id, ids, n_tokens), ids padded with 0 to the capacity. A window holds at most `capacity` pieces."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("x")))), lambda p: p["x"]), "")
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.rpad(ids, 8 * capacity, "0")).alias("ids"))


def vocabulary() -> tuple[str, str]:
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op3_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1024 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents"), *vocabulary()))
