"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taleloom.llm import periodic_runs as pr

from .conftest import ODD


def brute(words):
    """Every maximal stretch of every lag, less those that a smaller period explains."""
    n, out = len(words), {}
    for q in range(1, n // 3 + 1):
        same = [words[i] == words[i + q] for i in range(n - q)] + [False]
        i = 0
        while i < n - q:
            if not same[i]:
                i += 1
                continue
            j = i
            while same[j]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted(((a, b - a, q) for (a, b), q in out.items()), key=lambda r: (r[0], r[2]))


def smallest(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def _texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        vocab = rng.choice([1, 2, 3, 8, 40])
        words = [rng.randrange(vocab) for _ in range(rng.randrange(0, 140))]
        for _ in range(rng.randrange(0, 4)):
            p, at = rng.randrange(1, 30), rng.randrange(len(words) + 1)
            unit = [rng.randrange(vocab + 2) for _ in range(p)]
            words[at:at] = [unit[i % p] for i in range(rng.randrange(0, 5 * p + 30))]
        yield words


def test_runs_equal_brute_force():
    found = 0
    for words in _texts(3, 600):
        runs = pr.runs_of(words)
        assert runs == brute(words), words
        assert all(smallest(words[s : s + n]) == p for s, n, p in runs)
        found += len(runs)
    assert found > 500


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12)), max_size=5))
def test_runs_of_drawn_repeats(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert pr.runs_of(words) == brute(words)


def test_splitting_keeps_only_frequent_words():
    for words in _texts(8, 200):
        stretches = pr.surviving(words)
        assert all(b - a >= 24 and min(words[a:b].count(w) for w in set(words[a:b])) >= 3 for a, b in stretches)
        for s, n, _ in brute(words):
            assert any(a <= s and s + n <= b for a, b in stretches)


def test_long_texts_of_one_few_or_all_different_words():
    assert pr.runs_of([b"a"] * 400_000) == [(0, 400_000, 1)]
    assert pr.runs_of([b"%d" % i for i in range(300_000)]) == []
    rng = random.Random(1)
    unit = [rng.randrange(50) for _ in range(30_001)]
    assert pr.runs_of(unit * 3 + unit[:7]) == [(0, 3 * 30_001 + 7, 30_001)]
    ruler = [(i & -i).bit_length() for i in range(1, 1 << 15)]
    assert pr.runs_of(ruler) == []


def _expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def _words(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdé") * rng.randint(1, 2) for _ in range(rng.randint(0, 300))) for _ in range(n)]


@pytest.fixture
def folder(spark, docs, tmp_path):
    def make(rows):
        docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return make


def test_query_equals_brute_force(spark, folder):
    rows = [*ODD, (50, "x y " * 40), (51, "\x1c\x1d \x85 " * 30), *((100 + i, t) for i, t in enumerate(_words(5, 120)))]
    long = " ".join(_words(9, 1)[0].split() * 3) + " z " * 60_000
    got = pr.op13_periodic_runs(spark, folder([*rows, (999, long)]))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes[:6]} == {"bigint"}
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert [r for r in found if r[0] != 999] == sorted((_expected(*r) for r in rows), key=repr)
    last = next(r for r in found if r[0] == 999)
    assert last[3] >= 60_000 and last[4] == 1 and last[1] >= 1


def test_operator_on_empty_and_clashing(spark, docs, folder):
    assert pr.op13_periodic_runs(spark, folder([])).count() == 0
    df = docs([(1, "a b " * 20), (2, None)]).withColumnRenamed("key", "runs").withColumnRenamed("shard", "Collapsed")
    out = {r.doc_id: r for r in pr.with_runs(df).collect()}
    assert out[1].collapsed == "a b" and [tuple(r) for r in out[1].runs] == [(0, 40, 2)]
    assert out[2].collapsed == "" and out[2].runs == [] and out[2].lang == "en"
