"""All named queries and, where SQL can express them, their equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from . import archive_queries, envelope_queries, extract_queries, search_queries, stream_queries, transcript_queries

    out: dict[str, Query] = {}
    for module in (transcript_queries, envelope_queries, archive_queries, search_queries, extract_queries, stream_queries):
        for name, q in module.QUERIES.items():
            if name in out:
                raise ValueError(f"two queries named {name}")
            out[name] = q
    return out
