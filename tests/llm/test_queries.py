"""Registered queries on a small folder: contract columns against brute force or the named library, and SQL."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers

from taleloom.llm import quality, sharding, suffix_dedup, token_counts, word_table

from .conftest import ODD


def _folder(docs, path, rows):
    docs(rows, extra=False).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def _sorted(rows):
    return sorted(rows, key=repr)


def test_shard_columns(spark, docs, tmp_path):
    got = sharding.op1_feistel_shards(spark, _folder(docs, tmp_path, ODD)).collect()
    want = [(i, 1 if t is None else len(t.encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD]
    assert _sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == _sorted(want)
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None and 0 <= r.shard < 16 for r in got)
    rows = Counter(r.shard for r in got)
    assert max(rows.values()) - min(rows.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in rows.items())


def test_token_columns(spark, docs, tmp_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [*ODD, (60, "word " * 5000)]
    got = token_counts.op2_prefix_token_counts(spark, _folder(docs, tmp_path, rows)).collect()
    counts = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    cut = next(r.chars_within_limit for r in got if r.doc_id == 60)
    assert len(library.encode(rows[-1][1][:cut])) <= 4096 < len(library.encode(rows[-1][1][: cut + 1]))
    assert _sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == _sorted((*c, c[2] > 4096) for c in counts)


def test_word_table_columns(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    got = word_table.op8_word_table_bpe(spark, _folder(docs, tmp_path, ODD)).collect()
    want = []
    for i, t in ODD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i, len(ids), sha(b"".join(x.to_bytes(4, "little") for x in ids)), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert _sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == _sorted(want)


def test_repeat_columns(spark, docs, tmp_path):
    passage = "the same passage of more than fifty bytes stands in several documents, with é"
    rows = [(1, "own start " + passage), (2, passage + " other end " + passage), (3, None), (4, ""), (5, "a" * 120), (6, "x" + "a" * 49 + "y"), (7, passage[:49])]
    got = suffix_dedup.op6_suffix_dedup(spark, _folder(docs, tmp_path, rows)).collect()
    seen, want = set(), []
    for i, t in rows:  # by ascending doc_id
        data = (t or "").encode()
        starts = [k for k in range(len(data) - 49) if data[k : k + 50] in seen]
        gone = {k + j for k in starts for j in range(50)}
        flags = "".join("x" if k in gone else "." for k in range(len(data)))
        want.append((i, len(data), len(gone), len(re.findall("x+", flags)), hashlib.sha256(bytes(c for k, c in enumerate(data) if k not in gone)).hexdigest()))
        seen.update(data[k : k + 50] for k in range(len(data) - 49))
    assert any(w[2] for w in want)
    assert _sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == _sorted(want)


def test_quality_query_equals_its_sql_where_fences_pass_the_floors(spark, docs, tmp_path):
    symbols = [(1000 + i, " ".join(f"{i:03}{k:02}" for k in range(52)) + " " + "#" * 20 + " abcdefghijklmnopqrstuvw") for i in range(120)]
    rows = [*symbols, (2000, symbols[0][1].replace(" ", "# ")), (2001, None), (2002, ""), (2003, "one two three four " * 30)]
    at = _folder(docs, tmp_path, rows)
    got = quality.op7_adaptive_quality(spark, at)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet/*.parquet')")
    expected = db.sql(quality.OP7_SQL)
    assert expected.columns == got.columns
    found = _sorted(tuple(r) for r in got.collect())
    assert found == _sorted(expected.fetchall()) and sum(r[got.columns.index("kept")] for r in found) == 120
