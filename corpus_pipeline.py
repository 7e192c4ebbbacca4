"""The corpus pipeline: quality rules, exact dedup, near dedup, private data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taleloom.llm import exact_dedup, near_dedup, packing, private_data, quality
from taleloom.llm.common import table, written
from taleloom.session import ship_package


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship_package(spark)
    return quality.drop_low_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of equal texts."""
    ship_package(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship_package(spark)
    return near_dedup.drop_near_duplicates(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that give it away, taken out of the text."""
    ship_package(spark)
    return private_data.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of 1024."""
    ship_package(spark)
    return packing.pack(packing.pieces(docs, *packing.vocabulary()))


STAGES = [("quality rules", rules), ("exact dedup", exact), ("near dedup", near), ("private data", private), ("packing", packed)]

#: The stages cannot be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared checkpoint folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
