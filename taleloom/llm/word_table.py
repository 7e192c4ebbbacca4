"""BPE encoding through a table of distinct words, and decoding through a join of ids to pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import on_group, on_groups, opened, sliced, squeezed, total_bytes, unzipped_table, zipped_table
from .bpe import byte_bpe
from .common import modest_batches, table

#: Text of one block of documents, and text per bucket of the word table, in bytes.
BLOCK_BYTES = 5 << 20
BUCKET_BYTES = 4 << 20
ENCODED = "doc_id long, ids binary"


def _words(text: str, special) -> list[str] | None:
    """A text's words, each with the space before it; None if white space or special strings keep it from falling apart into words.

    A byte-level BPE cuts before every space that something other than white space follows, so words have their own ids.
    """
    if special is not None and special.search(text):
        return None
    first, *rest = text.split(" ")
    if any(not w or w[0].isspace() for w in rest):
        return None
    return ([first] if first else []) + [" " + w for w in rest]


def _bucketed(texts: list[str], special, buckets: int) -> dict[int, list[str]]:
    """Distinct words of a block by bucket, in order."""
    seen: set[str] = set()
    for text in texts:
        seen.update(_words(text, special) or ())
    out: dict[int, list[str]] = {}
    for w in seen:
        out.setdefault(zlib.crc32(w.encode()) % buckets, []).append(w)
    return {b: sorted(ws) for b, ws in out.items()}


def _joined(words: list[str]) -> tuple[bytes, np.ndarray]:
    data = [w.encode() for w in words]
    return b"".join(data), np.fromiter(map(len, data), dtype="<u4", count=len(data))


def _parted(data: bytes, lengths: np.ndarray) -> list[str]:
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    return [data[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def _blocks(batches: Iterator[pa.RecordBatch], path: str, buckets: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Documents of a partition in blocks: their distinct words by bucket, or the documents themselves."""
    part, seq, special = TaskContext.get().partitionId(), 0, byte_bpe(path).special
    held: list[pa.RecordBatch] = []
    size = 0

    def emit() -> pa.RecordBatch:
        block = pa.Table.from_batches(held)
        number = (part << 32) + seq
        if not words:
            return pa.record_batch([pa.array([number]), pa.array([zipped_table(block)], pa.binary())], names=["block", "docs"])
        found = _bucketed([t or "" for t in block.column("text").to_pylist()], special, buckets)
        rows = [squeezed(**dict(zip(("data", "lengths"), _joined(ws), strict=True))) for ws in found.values()]
        return pa.record_batch([pa.array([number] * len(rows), pa.int64()), pa.array(list(found), pa.int32()), pa.array(rows, pa.binary())], names=["block", "bucket", "words"])

    for batch in sliced(batches, 1, BLOCK_BYTES):
        if held and size + batch.nbytes > BLOCK_BYTES:
            yield emit()
            held, size, seq = [], 0, seq + 1
        held.append(batch)
        size += batch.nbytes
    if held:
        yield emit()


def _encoded_words(table: pa.Table, path: str) -> pa.Table:
    """A bucket of the word table: each distinct word is encoded once; every block gets the ids of its words, in its order."""
    library = byte_bpe(path).library
    per_block = [_parted(**opened(b)) for b in table.column("words").to_pylist()]
    distinct = sorted(set().union(*per_block)) if per_block else []
    ids: dict[str, list[int]] = {}
    for at in range(0, len(distinct), 2_000):
        some = distinct[at : at + 2_000]
        ids.update(zip(some, (e.ids for e in library.encode_batch(some, add_special_tokens=False)), strict=True))
    replies = []
    for ws in per_block:
        own = list(map(ids.__getitem__, ws))
        lengths = np.fromiter(map(len, own), "<u4", len(own))
        replies.append(squeezed(ids=np.fromiter(chain.from_iterable(own), "<u4", int(lengths.sum())), lengths=lengths, check=np.array([zlib.crc32("".join(ws).encode())], "<u4")))
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "ids": pa.array(replies, pa.binary())})


def _placed(left: pa.Table, right: pa.Table, path: str, buckets: int) -> pa.Table:
    """Ids joined back to a block's documents by position."""
    if not left.num_rows:
        return pa.table({"doc_id": pa.array([], pa.int64()), "ids": pa.array([], pa.binary())})
    bpe = byte_bpe(path)
    docs = pa.concat_tables([unzipped_table(b) for b in left.column("docs").to_pylist()])
    texts = [t or "" for t in docs.column("text").to_pylist()]
    replies = dict(zip(right.column("bucket").to_pylist(), right.column("ids").to_pylist(), strict=True))
    known: dict[str, bytes] = {}
    for bucket, ws in _bucketed(texts, bpe.special, buckets).items():
        reply = opened(replies[bucket]) if bucket in replies else None
        # a source that deals out its rows anew can give other blocks on a second read; those words are encoded here
        if reply is None or len(reply["lengths"]) != len(ws) or reply["check"][0] != zlib.crc32("".join(ws).encode()):
            known.update((w, bpe.whole(w)) for w in ws)
            continue
        ends = (4 * np.cumsum(reply["lengths"], dtype=np.int64)).tolist()
        data = reply["ids"].astype("<u4").tobytes()
        known.update((w, data[a:b]) for w, a, b in zip(ws, [0, *ends], ends, strict=False))
    out = []
    for text in texts:
        words = _words(text, bpe.special)
        out.append(bpe.whole(text) if words is None else b"".join(map(known.__getitem__, words)))
    return pa.table({"doc_id": docs.column("doc_id"), "ids": pa.array(out, pa.binary())})


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Documents (doc_id, text) as (doc_id, ids): little-endian unsigned 32-bit ids of the whole text, as the tokenizers library gives them.

    Blocks of documents send their distinct words to buckets; there each distinct word of the corpus is encoded once, and the ids go back to the
    blocks, which put them together by position. A word that a third of all documents hold comes once from each block. Texts that do not fall
    apart into words (runs of spaces, special strings) are encoded whole. A null text is empty; repeated rows stay rows.
    """
    modest_batches(docs)
    narrow = docs.select("doc_id", "text")
    buckets = max(1, -(-total_bytes(narrow) // BUCKET_BYTES))
    words = narrow.mapInArrow(partial(_blocks, path=path, buckets=buckets, words=True), "block long, bucket int, words binary")
    ids = words.groupBy("bucket").applyInArrow(on_group(_encoded_words, path=path), "block long, bucket int, ids binary")
    whole = narrow.mapInArrow(partial(_blocks, path=path, buckets=buckets, words=False), "block long, docs binary")
    return whole.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(on_groups(_placed, path=path, buckets=buckets), ENCODED)


@lru_cache(maxsize=2)
def id_to_piece(path: str) -> list[bytes]:
    """The bytes of each id: the table that decoding joins to, as long as the vocabulary."""
    library = byte_bpe(path).library
    letters = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves; the others follow from U+0100 on
    byte_of = {chr(b): b for b in letters} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(letters))}
    special = library.get_added_tokens_decoder()
    pieces = [b""] * library.get_vocab_size(with_added_tokens=True)
    for i in range(len(pieces)):
        piece = library.id_to_token(i)
        pieces[i] = piece.encode() if i in special else bytes(byte_of[c] for c in piece)
    return pieces


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids_at: int) -> Iterator[pa.RecordBatch]:
    pieces = id_to_piece(path)
    for batch in sliced(batches, ids_at, 8 << 20):
        texts = [b"".join(map(pieces.__getitem__, np.frombuffer(b or b"", "<u4").tolist())).decode("utf-8", "replace") for b in batch.column(ids_at).to_pylist()]
        yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids binary, other columns) with decoded: special tokens appear as their strings; null ids decode to the empty text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(partial(_decoded, path=path, ids_at=encoded.columns.index("ids")), schema + ", decoded string")


def op8_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    both = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return both.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
