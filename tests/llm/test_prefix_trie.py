"""The conversation trie against dictionaries and against its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from taleloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, path string, least string"


def test_find_close_equals_a_stack():
    rng = random.Random(4)
    for n in (1, 2, 31, 32, 33, 700, 5000):
        for lean in (0.5, 0.9, 0.1):
            bits, open_ = [True], 1
            while len(bits) < 2 * n and open_:
                up = rng.random() < lean
                bits.append(up)
                open_ += 1 if up else -1
            bits = [*bits, *[False] * open_]
            stack, close = [], {}
            for i, b in enumerate(bits):
                if b:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            at = np.array(sorted(close))
            assert pt.Parentheses(np.array(bits)).find_close(at).tolist() == [close[i] for i in at.tolist()]
    deep = np.repeat([True, False], 100_000)
    assert pt.Parentheses(deep).find_close(np.arange(100_000)).tolist() == list(range(199_999, 99_999, -1))


def brute(rows):
    """rows of (conv_id, turn, role, text), in any order -> nodes of the rebuilt conversations."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            role, text = r or "", x or ""
            name = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[c].append(((t is not None, t or 0), role, name, text))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += p not in children
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if full[c] == p).encode()).hexdigest())
        for p, m in members.items()
    )


def _rows(seed, convs, vocab=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for t in range(rng.choice([1, 2, 2, 3, 4, 7, 30 if rng.random() < 0.05 else 1])):
            text = " ".join(rng.choice(["a", "bé", "c\x1cd"]) for _ in range(rng.randrange(vocab)))
            rows.append((c, rng.choice([t, t, t, None]) if t == 0 else t, rng.choice(["user", "assistant", None]), text))
    return rows


ODD = [
    (None, 0, "user", "no conversation"), (200, None, None, None), (200, 0, "", ""), (200, 0, "", ""), (201, 1, "user", "a\n b\x0b\tc"), (201, 1, "assistant", "z"), (202, 5, "user", "x " * 40_000),
    (203, None, "user", "first"), (203, -1, "user", "second"), (220, 0, "user", "日本 é"), (221, 0, "user", ""), (222, 9, None, "\x1c"),
]


@pytest.fixture
def folder(spark, tmp_path):
    def make(rows):
        spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
        return str(tmp_path)

    return make


def _found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in df.dtypes[:7]} == {"bigint"}
    return sorted(tuple(r) for r in df.collect())


def _key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("shard_turns", [pt.SHARD_TURNS, 120, 9])
def test_nodes_equal_brute_force_for_any_number_of_shards(spark, folder, shard_turns):
    rows = [*_rows(1, 150), *ODD, *((1000 + c, t, "user", f"same {t}") for c in range(60) for t in range(4)), *((3000, t, "user", "long") for t in range(500)), *((3020, t, "user", "long") for t in range(480))]
    df = spark.read.parquet(folder(rows) + "/conversations.parquet")
    got = pt.trie_nodes(pt.rebuilt(pt.paths(df)), shard_turns)
    assert _key(map(tuple, got.collect())) == _key(brute(rows))


def test_query_equals_brute_force_and_sql(spark, folder):
    rows = [*_rows(7, 120, 2), *((500 + c, t, "user", f"same {t}") for c in range(30) for t in range(3))]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    at = folder(rows)
    found = _key(_found_rows := [tuple(r) for r in pt.op12_prefix_trie(spark, at).collect()])
    assert found == _key(brute(rows)) and len(_found_rows) == len(found)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{at}/conversations.parquet/*.parquet')")
    assert _key(db.sql(pt.OP12_SQL).fetchall()) == found


def test_no_conversations_and_turnless_ones(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    assert pt.trie_nodes(pt.rebuilt(pt.paths(df))).count() == 0
    turnless = spark.createDataFrame([(7, b""), (3, b"")], "conv_id long, path binary")
    sha = hashlib.sha256(b"3,7").hexdigest()
    assert [tuple(r) for r in pt.trie_nodes(turnless).collect()] == [(3, 0, None, 2, 0, 1, 0, sha)]
