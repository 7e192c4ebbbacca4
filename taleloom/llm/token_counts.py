"""Exact token counts of every prefix of a text, by dynamic programming over the pieces of a sentencepiece BPE model."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from operator import sub

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import modest_batches, stored, table, without

SPACE = "▁"
#: Words and parts of words kept in a worker's tables before they start anew.
KEPT_WORDS = 300_000
KEPT_PARTS = 700_000
LONG_WORD = 64
LIMIT = 4096


class PrefixCounter:
    """For the piece BPE of a sentencepiece model with byte fallback and no normalisation.

    The encoding of a prefix ends with one piece t, and what stands before it is the encoding of a shorter prefix; t is the only piece for which
    the piece before it and t are what the merges make of their joined text. So each prefix needs one step over the pieces that end there.
    No piece holds a space mark behind another letter, so words (with the space marks before them) are independent and are done once each.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.rank = {self.library.id_to_piece(i): i for i in sorted(plain, key=lambda i: -self.library.get_score(i))}
        order = sorted(self.rank, key=lambda p: (-self.library.get_score(self.rank[p]), self.rank[p]))
        self.rank = {p: k for k, p in enumerate(order)}
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece of this model reaches over a word's beginning")
        self.longest = max(map(len, self.rank))
        #: Neighbouring letters that stand in no piece keep what is left of them apart from what is right.
        self.near = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.together: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-ranked neighbours first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = min((rank.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: str, right: str) -> bool:
        if len(self.together) > 1_000_000:
            self.together.clear()
        stay = self.together[(left, right)] = self.merged(left + right) == [left, right]
        return stay

    def counts(self, word: str) -> list[int]:
        """Tokens of each prefix of a word, from the empty one on."""
        rank, stays, longest, together = self.rank, self.stays, self.longest, self.together
        counts, last = [0], [""]
        for end in range(1, len(word) + 1):
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                if piece in rank and (not (before := last[start]) or (known := together.get((before, piece))) or (known is None and stays(before, piece))):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:  # a letter that the model lacks: one token per UTF-8 byte, and nothing merges with it
                counts.append(counts[end - 1] + len(word[end - 1].encode()))
                last.append("")
        return counts

    def steps(self, word: str) -> bytes:
        """Changes of the count over the word's code points, as 16-bit integers; parts that no piece joins are done once each."""
        near, parts, out, first = self.near, self.parts, [], 0
        for end in range(1, len(word) + 1):
            if end == len(word) or word[end - 1 : end + 1] not in near:
                part = word[first:end]
                steps = parts.get(part)
                if steps is None:
                    counts = self.counts(part)
                    steps = array("h", map(sub, counts[1:], counts)).tobytes()
                    if len(parts) > KEPT_PARTS:
                        parts.clear()
                    if len(part) <= LONG_WORD:
                        parts[part] = steps
                out.append(steps)
                first = end
        return b"".join(out)

    def prefixes(self, text: str) -> bytes:
        """Changes of the count over the text's code points; the first holds the mark put before every text."""
        if not text:
            return b""
        words, known = text.split(" "), self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > KEPT_WORDS:
                known.clear()
            if not all(words) or SPACE in text:  # runs of spaces belong to the word behind them
                marked = SPACE + text.replace(" ", SPACE)
                found = [self.steps(w) for w in re.findall(f"{SPACE}+[^{SPACE}]*", marked)]
                words = []
            for i, w in enumerate(words):
                if found[i] is None:
                    steps = known.get(w)
                    if steps is None:
                        steps = self.steps(SPACE + w)
                        if len(w) <= LONG_WORD:
                            known[w] = steps
                    found[i] = steps
        return b"".join(found)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _prefix_batches(batches: Iterator[pa.RecordBatch], path: str, text_at: int, names: list[str], keep_text: bool, limit: int) -> Iterator[pa.RecordBatch]:
    dp = counter(path)
    for batch in batches:
        texts = batch.column(text_at)
        totals, within, stored = [], [], []
        for value in texts:
            steps = dp.prefixes(value.as_py() or "")
            sums = np.cumsum(np.frombuffer(steps, dtype="<i2"), dtype=np.int32)
            totals.append(int(sums[-1]) if len(sums) else 0)
            fits = np.flatnonzero(sums <= limit)
            within.append(max(int(fits[-1]), 0) if len(fits) else 0)
            stored.append(steps)
        new = [pa.array(totals, pa.int64()), pa.array(within, pa.int64()), pa.array(stored, pa.binary())]
        kept = [c for i, c in enumerate(batch.columns) if keep_text or i != text_at]
        yield pa.RecordBatch.from_arrays(kept + new, names=names)


def prefix_counts(df: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with n_tokens, fits and prefix_steps (replacing columns of these names).

    n_tokens counts the whole text as the sentencepiece library does without begin and end marks; a null text is empty. prefix_steps stores the
    count at every prefix: 16-bit changes, the first for the space mark before the text, then one per code point; a running sum gives the counts.
    fits is the length in code points of the longest prefix with at most `limit` tokens. keep_text=False leaves the text out.
    """
    base = without(df, "n_tokens", "fits", "prefix_steps")
    columns = [f for f in base.schema.fields if keep_text or f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + ["n_tokens long", "fits long", "prefix_steps binary"])
    names = [f.name for f in columns] + ["n_tokens", "fits", "prefix_steps"]
    return base.mapInArrow(partial(_prefix_batches, path=path, text_at=base.columns.index(text), names=names, keep_text=keep_text, limit=limit), schema)


@F.pandas_udf(LongType())
def tokens_at(prefix_steps: pd.Series, code_points: pd.Series) -> pd.Series:
    """Exact count of the prefix with that many code points (0: of the empty text), from the stored steps. Past the end: of the whole text; null steps: 0."""
    return pd.Series([0 if not s or n <= 0 else int(np.frombuffer(s, "<i2")[: int(n) + 1].sum()) for s, n in zip(prefix_steps, code_points, strict=True)])


@F.pandas_udf(LongType())
def prefix_within(prefix_steps: pd.Series, budget: pd.Series) -> pd.Series:
    """Code points of the longest prefix with at most `budget` tokens, from the stored steps."""
    out = []
    for s, b in zip(prefix_steps, budget, strict=True):
        sums = np.cumsum(np.frombuffer(s or b"", "<i2"), dtype=np.int64)
        fits = np.flatnonzero(sums <= b)
        out.append(int(fits[-1]) if len(fits) else 0)
    return pd.Series(out)


def op2_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the count at every prefix of all documents once; every answer is read from the stored steps, no text is encoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    modest_batches(docs)
    steps = prefix_counts(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False).select("doc_id", "n_bytes", "prefix_steps")
    kept = stored(steps, compression="zstd")
    code_points = F.octet_length("prefix_steps") / 2
    answered = kept.select("doc_id", "n_bytes", tokens_at("prefix_steps", code_points.cast("long")).alias("n_tokens"), prefix_within("prefix_steps", F.lit(LIMIT).cast("long")).alias("chars_within_limit"))
    return answered.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "chars_within_limit")
