"""Hashes of words and bags of five-word shingles, for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0x5851F42D4C957F2D


def _step(k: int) -> np.uint64:
    return np.uint64(k * _GOLDEN & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    """An odd factor for each place in a shingle. They stand in no simple ratio: sums with 1, 3, 5, 7, 9 times one factor would be equal for
    "a b b a c" and "b a a b c"."""
    return _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _word_hashes(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each word (a run of bytes other than white space) in texts that begin at starts_at in the joined bytes."""
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.concatenate(([True], gap[:-1]))
    before[starts_at[starts_at < len(data)]] = True
    begin = np.flatnonzero(~gap & before)
    after = np.concatenate((gap[1:], [True]))
    ends = starts_at[(starts_at > 0) & (starts_at <= len(data))] - 1
    after[ends] = True
    end = np.flatnonzero(~gap & after) + 1
    room = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(room)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    return _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _step(1)), begin


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of texts as (text number, hash, count), sorted. A text of one to four words has one shingle, of all its words."""
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    hashes, at = _word_hashes(data, starts) if len(data) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    text = np.searchsorted(starts + lengths, at, side="right")
    odd = _places()
    n = max(0, len(hashes) - WORDS + 1)
    whole = text[:n] == text[WORDS - 1 :] if n else np.empty(0, bool)
    shingle = _mix(sum((hashes[k : k + n] * odd[k] for k in range(WORDS)), np.zeros(n, np.uint64)))[whole]
    owner = text[:n][whole]
    words = np.bincount(text, minlength=len(texts))
    short = np.flatnonzero((words > 0) & (words < WORDS))
    if len(short):
        first = np.searchsorted(text, short)
        made = [int(_mix(np.add.reduce(hashes[f : f + w] * odd[:w], keepdims=True) + np.uint64(w))[0]) for f, w in zip(first.tolist(), words[short].tolist(), strict=True)]
        shingle, owner = np.concatenate((shingle, np.array(made, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.flatnonzero(np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])))) if len(shingle) else np.empty(0, np.int64)
    return owner[new], shingle[new], np.diff(np.append(new, len(shingle)))
