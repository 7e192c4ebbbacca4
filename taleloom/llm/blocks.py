"""Documents and number tables as compressed blocks, so that a shuffle moves few rows and few bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tight(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest unsigned type that holds them; others as they are."""
    if numbers.dtype.kind not in "ui" or not len(numbers) or numbers.min() < 0:
        return numbers
    return numbers.astype(np.min_scalar_type(int(numbers.max())))


def squeezed(**columns) -> bytes:
    """Named numpy arrays or byte strings as one compressed block; whole numbers come back in the narrowest type."""
    columns = {k: v if isinstance(v, bytes) else tight(v) for k, v in columns.items()}
    arrays = {k: pa.array([v], pa.binary()) if isinstance(v, bytes) else pa.array([v.tobytes()], pa.binary()) for k, v in columns.items()}
    kinds = {k: "" if isinstance(v, bytes) else v.dtype.str for k, v in columns.items()}
    batch = pa.record_batch(list(arrays.values()), schema=pa.schema([pa.field(k, pa.binary(), metadata={"kind": kinds[k]}) for k in arrays]))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.compress(sink.getvalue(), 3)


def opened(block: bytes) -> dict:
    batch = pa.ipc.open_stream(zstandard.decompress(block)).read_next_batch()
    out = {}
    for i, f in enumerate(batch.schema):
        data, kind = batch.column(i)[0].as_py(), f.metadata[b"kind"].decode()
        out[f.name] = np.frombuffer(data, kind) if kind else data
    return out


def zipped_table(table: pa.Table | pa.RecordBatch) -> bytes:
    table = pa.Table.from_batches([table]) if isinstance(table, pa.RecordBatch) else table
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return zstandard.compress(sink.getvalue(), 3)


def unzipped_table(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(block)).read_all()


def sliced(batches: Iterator[pa.RecordBatch], text_at: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text at most; a longer text comes alone."""
    for batch in batches:
        sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(batch.column(text_at)), 0)), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + most_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def on_group(work, **fixed):
    """work(table, ...) as a function of one group without annotations, as applyInArrow wants it."""
    return lambda group: work(group, **fixed)


def on_groups(work, **fixed):
    """work(left, right, ...) as a function of two groups."""
    return lambda left, right: work(left, right, **fixed)
