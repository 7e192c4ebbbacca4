"""The pipeline against a brute-force run of its stages over documents whose fate is known."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from .conftest import ODD
from .test_operators import _classes, _noise




def _documents():
    rng = random.Random(21)
    clean = [(100 + i, t) for i, t in enumerate(_noise(22, 130, 60, 110))]
    junk = [(1000 + i, " ".join(w + "$$$" for w in t.split())) for i, t in enumerate(_noise(23, 6, 60, 80))]
    copies = [(2000 + i, clean[i % 10][1].upper() if i % 2 else clean[i % 10][1]) for i in range(40)]
    near = []
    for i in range(20):
        w = clean[20 + i][1].split()
        w[rng.randrange(len(w))] = "changed"
        near.append((3000 + i, " ".join(w)))
    private = [(4000 + i, f"{t} write to user{i}@mail.example or 10.0.0.{i}") for i, t in enumerate(_noise(24, 12, 60, 90))]
    return ODD + clean + junk + copies + near + private


def _expected(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = [(i, t) for i, t in rows if t and len(t.split()) >= 50 and "$$$" not in t]
    tri = lambda w: Counter(zip(w, w[1:], w[2:]))
    kept = [(i, t) for i, t in kept if sum(n for n in tri(t.split()).values() if n > 1) == 0]
    best = {}
    for i, t in kept:
        key = t.translate(lower)
        best[key] = max(best.get(key, (-1, "")), (i, t))
    left = sorted(best.values())
    left = [min(left[i] for i in g) for g in _classes(left).values()]
    return [re.sub(r"10\.0\.0\.[0-9]+", "[IP]", re.sub(r"user[0-9]+@mail\.example", "[EMAIL]", t)) for _, t in left]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = _documents()
    table = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for t in _expected(rows):
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want.update((k, zlib.crc32(ids[k : k + 1024].tobytes())) for k in range(0, len(ids), 1024))
    assert Counter((r.start, r.ids_crc32) for r in got) == want
    by_window = {}
    for r in got:
        by_window.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_window.values():
        ends = [a + n for a, n in sorted(spans)]
        assert ends[-1] <= 1024 and [a for a, _ in sorted(spans)] == [0, *ends[:-1]]


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "private data", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
