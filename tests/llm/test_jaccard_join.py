"""The Jaccard join against all pairs."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from taleloom.llm import jaccard_join as jj
from taleloom.llm.shingles import bags

from .conftest import ODD


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                up[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    low = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed, groups=30, alone=80):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(25)]
    texts = []
    for _ in range(alone):
        own = [word() for _ in range(rng.randrange(1, 120))]
        texts.append(own + common if rng.random() < 0.5 else own)
    for g in range(groups):
        base = [word() for _ in range(rng.choice([6, 20, 60, 150]))]
        for _ in range(rng.choice([2, 3, 10]) if g else 150):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [word()]
            texts.append(copy[: rng.randrange(len(copy) * 3 // 4, len(copy) + 1)])
    return [" ".join(w.upper() if rng.random() < 0.1 else w for w in t) for t in texts]


def _found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("small", "slice_bytes"), [(48, 4 << 20), (2, 2000)])
def test_classes_equal_all_pairs(docs, monkeypatch, small, slice_bytes):
    monkeypatch.setattr(jj, "SMALL_REGION", small)
    texts = corpus(11)
    rng = random.Random(2)
    rows = [*ODD, *((1000 + i, t) for i, t in enumerate(texts)), *((5000 + i, rng.choice(texts)) for i in range(60)), *((9000 + i, texts[0]) for i in range(200))]
    rng.shuffle(rows)
    if slice_bytes < 4 << 20:
        monkeypatch.setattr(jj, "SLICE", slice_bytes)
    expected = brute(rows)
    assert sum(c is not None and c != d for d, _, c in expected) > 300
    assert _found(jj.jaccard_classes(docs(rows).repartition(5))) == expected


def test_exactly_four_fifths_is_linked(docs):
    a = [f"a{i}" for i in range(13)]  # nine shingles; with one word more ten
    exact = [(1, " ".join(a[:12])), (2, " ".join(a[:14]) + " z y"), (3, " ".join(a[:8])), (4, " ".join(a[:9]))]
    assert _found(jj.jaccard_classes(docs(exact))) == brute(exact)
    assert dict((d, c) for d, _, c in brute(exact))[4] == 3


def test_long_text_and_empty_table(spark, docs, tmp_path):
    rng = random.Random(5)
    long = [f"w{rng.randrange(10**6)}" for _ in range(900_000)]
    near = list(long)
    for i in range(0, 900_000, 60):
        near[i] = "other"
    rows = [(7, " ".join(near)), (8, " ".join(long)), (9, "w1 w2 w3 w4 w5 w6"), (10, None)]
    got = {d: (n, c) for d, n, c in _found(jj.jaccard_classes(docs(rows)))}
    assert got[7][1] == got[8][1] == 7 and got[9] == (2, 9) and got[10] == (0, 10)
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    empty = jj.op11_jaccard_join(spark, str(tmp_path))
    assert empty.columns[:3] == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_bags_count_copies():
    owner, element, _, size = jj._sets([b"a b c d e a b c d e a b c d e", b"a b c d e"], True)
    assert size.tolist() == [11, 1]
    assert np.bincount(owner).tolist() == [11, 1] and len(set(element[owner == 0].tolist())) == 11
    assert element[owner == 1][0] in element[owner == 0]


def test_shingles_of_few_different_words_are_told_apart():
    """All windows of five words over two and three words, and texts of one to four words, in bags of their own and together."""
    for letters in ("ab", "abc"):
        windows = [" ".join(w).encode() for n in range(1, 6) for w in itertools.product(letters, repeat=n)]
        owner, shingle, count = bags(windows)
        assert owner.tolist() == list(range(len(windows))) and len(set(shingle.tolist())) == len(windows) and set(count.tolist()) == {1}
    rng = random.Random(3)
    words = [rng.choice(["x", "yy", "z z"]) for _ in range(3000)]
    text = " ".join(words).split()
    want = Counter(tuple(text[i : i + 5]) for i in range(len(text) - 4))
    _, _, count = bags([" ".join(text).encode()])
    assert sorted(count.tolist()) == sorted(want.values())
