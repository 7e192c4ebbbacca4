"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, without

ROUNDS = 6
MASK32 = np.uint64(0xFFFFFFFF)


def round_keys(seed: int) -> list[int]:
    """One 32-bit key per round, from the seed by a multiply-and-add rule."""
    keys, x = [], (seed * 2654435761 + 12345) & 0xFFFFFFFF
    for _ in range(ROUNDS):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        keys.append(x)
    return keys


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) & MASK32
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(2246822519)) & MASK32
    x = ((x ^ (x >> np.uint64(13))) * np.uint64(3266489917)) & MASK32
    return x ^ (x >> np.uint64(16))


def _halves(total: int) -> tuple[int, int]:
    bits = max(2, (total - 1).bit_length())
    return bits // 2, bits - bits // 2


def _cipher(x: np.ndarray, total: int, seed: int, backward: bool) -> np.ndarray:
    low_bits, high_bits = _halves(total)
    shift, low_mask, high_mask = np.uint64(low_bits), np.uint64((1 << low_bits) - 1), np.uint64((1 << high_bits) - 1)
    low, high = x & low_mask, x >> shift
    steps = list(enumerate(round_keys(seed)))
    for i, key in reversed(steps) if backward else steps:
        if i % 2:
            high = high ^ (_mixed(low, key) & high_mask)
        else:
            low = low ^ (_mixed(high, key) & low_mask)
    return (high << shift) | low


def permuted(numbers: np.ndarray, total: int, seed: int, backward: bool = False) -> np.ndarray:
    """A permutation of 0 .. total-1: the cipher works on a power of two below 2*total, and values outside walk on along their cycle."""
    x = _cipher(np.asarray(numbers, dtype=np.uint64), total, seed, backward)
    while (outside := x >= np.uint64(total)).any():
        x[outside] = _cipher(x[outside], total, seed, backward)
    return x.astype(np.int64)


def place(number: int, total: int, shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of a row number, without reading any table."""
    at = int(permuted(np.array([number]), total, seed)[0])
    return at % shards, at // shards


def row_at(shard: int, slot: int, total: int, shards: int, seed: int) -> int:
    """The row number that lies at a slot of a shard: the way back of place()."""
    return int(permuted(np.array([slot * shards + shard]), total, seed, backward=True)[0])


def assign_shards(df: DataFrame, shards: int, seed: int, order: Sequence[str]) -> DataFrame:
    """df with row_number, shard and slot.

    Row numbers follow `order` (nulls first; rows equal in it get neighbouring numbers); the permuted number p gives shard p % shards and slot
    p // shards, so shard sizes differ by one row at most and slots have no gaps. Only order decides, so a hot value in any column spreads evenly.
    Columns of df named row_number, shard or slot are replaced. An empty table gives an empty result.
    """
    rows = numbered(without(df, "row_number", "shard", "slot"), order, "row_number")
    total = rows.count()

    @F.pandas_udf("long")
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(permuted(number.to_numpy(), total, seed))

    p = F.col("_p")
    return rows.withColumn("_p", position("row_number")).withColumns({"shard": (p % shards).cast("int"), "slot": F.expr(f"_p div {int(shards)}")}).drop("_p")


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    narrow = docs.select("doc_id", (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return assign_shards(narrow, 16, 7, ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
