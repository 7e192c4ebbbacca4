"""Exact dedup with a split for heavy hitters: frequent digests are taken out on the map side, the others shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, thinned, written

#: A digest held by more than this share of the rows is found by the frequent-items pass for certain.
SUPPORT = 0.002
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _resolved(rows: DataFrame, support: float) -> DataFrame:
    """rows (_digest, doc_id, _row) with keep_id, group_size and kept."""
    # Misra-Gries counters in one pass, merged over partitions: at most 1 / support candidates, among them every digest above that share
    found = rows.stat.freqItems(["_digest"], support).select(F.explode("_digest_freqItems").alias("_digest"))
    candidates = F.broadcast(found)  # at most 1 / support rows by the algorithm
    size, best = F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_best")
    # candidates are verified by exact counts, combined on the map side: one row per candidate leaves a task
    winners = written(rows.join(candidates, "_digest", "left_semi").groupBy("_digest").agg(size, best))
    split = rows.join(F.broadcast(winners), "_digest", "left")  # as many rows as candidates
    heavy = split.where(F.col("_best").isNotNull())
    same = Window.partitionBy("_digest")
    light = rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti").select(
        "*", F.count(F.lit(1)).over(same).alias("group_size"), F.max(F.struct("doc_id", "_row")).over(same).alias("_best")
    )
    kept = (F.col("_best._row") == F.col("_row")).alias("kept")
    return heavy.unionByName(light).select("*", F.col("_best.doc_id").alias("keep_id"), kept)


def _keyed(docs: DataFrame) -> DataFrame:
    normal = F.translate(F.coalesce(docs["text"], F.lit("")), UPPER, UPPER.lower())
    return docs.select("doc_id", F.sha2(normal, 256).alias("_digest"), F.monotonically_increasing_id().alias("_row"))


def exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document (doc_id, text): keep_id, group_size, kept, text_sha256.

    Texts are equal if they agree after lower-casing A-Z; null is the empty text. The largest doc_id stays (null is the smallest); of rows that
    also share the doc_id, exactly one stays. Groups above the support never meet in one task; smaller ones hold that share of the rows at most.
    """
    rows = written(_keyed(docs))
    return _resolved(rows, support).select("doc_id", "keep_id", "group_size", "kept", F.col("_digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """docs less all copies but the one that stays, with all its columns.

    Rows to drop are named by doc_id and digest, so no text is shuffled while they are few. Rows that repeat both are replaced by one of them.
    """
    own = docs.columns
    keyed = docs.withColumn("_digest", F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, UPPER.lower()), 256))
    groups = _resolved(written(_keyed(docs)), support).groupBy("_digest", "doc_id").agg(F.count_if(~F.col("kept")).alias("_gone"), F.count_if("kept").alias("_stay"))
    gone = written(groups.where("_gone > 0").select("_digest", "doc_id", (F.col("_stay") > 0).alias("_stay")))
    return thinned(keyed, gone, ["_digest", "doc_id"], own)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
