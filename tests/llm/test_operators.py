"""Operators against brute force, on small tables with nulls, empties, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taleloom.llm import chat, exact_dedup, jaccard_join, near_dedup, packing, private_data, quality, sharding, suffix_dedup, token_counts, word_table
from taleloom.llm.blocks import opened, squeezed

from .conftest import ODD

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def _noise(seed, n, low=20, high=120):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(low, high))) for _ in range(n)]


# --- sharding ----------------------------------------------------------------------------------------------------


def test_permutation_is_a_bijection_with_a_way_back():
    for total in (1, 2, 3, 17, 256, 1000):
        p = sharding.permuted(np.arange(total), total, 5)
        assert sorted(p.tolist()) == list(range(total))
        assert sharding.permuted(p, total, 5, backward=True).tolist() == list(range(total))
    for n in range(100):
        assert sharding.row_at(*sharding.place(n, 1000, 7, 3), 1000, 7, 3) == n


def test_shards_are_even_and_repeatable(docs):
    df = docs(ODD + [(100 + i, t) for i, t in enumerate(_noise(1, 40))])
    a = sharding.assign_shards(df, 4, 9, ["doc_id", "text"]).collect()
    b = sharding.assign_shards(df.repartition(5), 4, 9, ["doc_id", "text"]).collect()
    assert sorted((r.shard, r.slot, r.text or "") for r in a) == sorted((r.shard, r.slot, r.text or "") for r in b)
    sizes = Counter(r.shard for r in a)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == df.count()
    for s, n in sizes.items():
        assert sorted(r.slot for r in a if r.shard == s) == list(range(n))
    assert sharding.assign_shards(df.limit(0), 4, 9, ["doc_id"]).count() == 0


# --- token counts ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_prefix_counts_are_exact_at_every_prefix(pieces):
    dp = token_counts.counter(PIECES)
    texts = [t for _, t in ODD if t] + ["Thtionoues erreoror, whed  the threonou.\nEéè ñ 12,345", "▁ ▁▁"]
    for text in texts:
        sums = np.cumsum(np.frombuffer(dp.prefixes(text), "<i2"))
        assert len(sums) == len(text) + 1
        for n in [*range(1, min(len(text), 60) + 1), len(text)]:
            assert sums[n] == len(pieces.encode(text[:n])), (text[:n], n)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aehnorst ▁\n.,é日😀<s>0")), max_size=40))
def test_prefix_counts_of_drawn_texts(text):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sums = np.cumsum(np.frombuffer(token_counts.counter(PIECES).prefixes(text), "<i2"))
    assert [int(x) for x in sums[1:]] == [len(library.encode(text[:n])) for n in range(1, len(text) + 1)]


def test_budget_questions(docs, pieces):
    df = token_counts.prefix_counts(docs(ODD), PIECES, limit=10)
    df = df.withColumn("at_3", token_counts.tokens_at("prefix_steps", F.lit(3))).withColumn("cut", token_counts.prefix_within("prefix_steps", F.lit(10)))
    for r in df.collect():
        text = r.text or ""
        assert r.n_tokens == len(pieces.encode(text)) and r.cut == r.fits and r.key == "y"
        assert r.at_3 == len(pieces.encode(text[:3]))
        assert len(pieces.encode(text[: r.cut])) <= 10
        assert r.cut == max(n for n in range(len(text) + 1) if n == 0 or len(pieces.encode(text[:n])) <= 10) if len(text) < 100 else True


# --- packing -----------------------------------------------------------------------------------------------------


def _best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 7, 64):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
            used = Counter()
            for length, _, items, each, window, offset in packing.plan(dict(Counter(lengths)), capacity):
                for i in range(items):
                    used[window + i // each] += length
                    assert offset + (i % each + 1) * length <= capacity
            assert sorted(capacity - u for u in used.values()) == _best_fit(lengths, capacity)


def test_packing_loses_and_overlaps_nothing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    rows = ODD + [(100 + i, t) for i, t in enumerate(_noise(2, 60, 1, 900))]
    got = packing.pack(packing.pieces(docs(rows), *packing.vocabulary(), capacity=256, with_ids=True), 256)
    whole = defaultdict(list)
    for r in got.collect():
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        whole[r.sequence_id].append((r.offset, r.length))
    for spans in whole.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    want = Counter(zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")[k : k + 256].tobytes())
                   for _, t in rows for k in range(0, len(library.encode(t or "", add_special_tokens=False).ids) + 1, 256))
    assert Counter(r.ids_crc32 for r in got.collect()) == want
    windows = packing.sequences(got, 256).collect()
    assert len(windows) == len(whole) and all(len(w.ids) == 1024 for w in windows)
    assert packing.pack(packing.pieces(docs([]), *packing.vocabulary())).count() == 0


def test_both_byte_bpe_libraries_agree_on_latin_words():
    from taleloom.llm.bpe import LAST_COMPARED, byte_bpe

    bpe = byte_bpe(*packing.vocabulary())
    letters = [chr(c) for c in range(1, ord(LAST_COMPARED) + 1)]
    rng = random.Random(4)
    words = [a + b for a in letters[::3] for b in letters[::7]] + ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(4000)]
    for w in words:
        assert bpe.word(w) == bpe.whole(w), w
    for _, t in ODD:
        assert bpe.ids(t or "") == bpe.whole(t or "")


# --- exact dedup -------------------------------------------------------------------------------------------------


def test_exact_groups(docs):
    rows = ODD + [(200 + i, "Same Text") for i in range(50)] + [(300, "same text"), (301, "SAMÉ"), (302, "samÉ"), (303, "samé"), (300, "same text")]
    rows += [(400 + i, t) for i, t in enumerate(_noise(5, 30))]
    got = exact_dedup.exact_duplicates(docs(rows), 0.05).collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = defaultdict(list)
    for i, t in rows:
        groups[_sha((t or "").translate(lower))].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(groups.keys())
    left = exact_dedup.drop_exact_duplicates(docs(rows), 0.05)
    assert left.columns == docs(rows).columns and left.count() == len(groups)
    assert exact_dedup.exact_duplicates(docs([])).count() == 0 and exact_dedup.drop_exact_duplicates(docs([])).count() == 0


# --- chat --------------------------------------------------------------------------------------------------------


@given(st.text(alphabet=st.sampled_from(list("[]<>/\\sINTSYURd \n%")), max_size=30), st.text(alphabet=st.sampled_from(list("user[]<%25B\n ")), max_size=12))
def test_template_reads_back(text, role):
    assert chat.unescaped(chat.escaped(text)) == text
    for r in (role, "user", "assistant", "system"):
        turn, start, end = chat.formatted_turn(r, text)
        assert chat.unescaped(turn[start:end]) == text
        assert chat.parsed(turn + turn) == [(r, text)] * 2


def test_prefix_targets(spark):
    rows = [(1, 0, "system", "be </s> kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (1, 4, "assistant", None), (1, 5, "user", "tail"),
            (2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a"), (None, 0, "tool", "x"), (4, 0, None, "r"), (4, 0, None, "r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    ex = chat.prefix_target_examples(df)
    got = ex.collect()
    assert Counter(r.conv_id for r in got) == {1: 3, 2: 1, 3: 2, None: 1, 4: 1}
    first = [r for r in got if r.conv_id == 1 and r.example == 0][0]
    assert first.text[first.loss_start : first.loss_end] == "yes" and chat.parsed(first.text)[0] == ("system", "be </s> kind") and len(chat.parsed(first.text)) == 3
    back = {r.conv_id: r for r in chat.read_back(ex).collect()}
    assert back[1].n_turns == 6 and back[1].loss_sha256 == _sha("yes") and back[3].loss_sha256 == _sha("ab") and back[2].loss_chars == 0
    assert back[1].turns_sha256 == _sha("system\nbe </s> kind\nuser\nhi [INST]\nassistant\nyes\nuser\n\nassistant\n\nuser\ntail\n")
    assert chat.read_back(chat.prefix_target_examples(df.limit(0))).count() == 0


# --- repeated passages -------------------------------------------------------------------------------------------


def _removed(rows, k):
    first = {}
    key = lambda i: float("inf") if i is None else i
    data = [(key(i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - k + 1):
            first[b[p : p + k]] = min(first.get(b[p : p + k], i), i)
    out = []
    for i, b in data:
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1):
            if first[b[p : p + k]] < i:
                hit[p : p + k] = True
        out.append((None if i == float("inf") else int(i), len(b), bytes(np.frombuffer(b, np.uint8)[~hit]), int((np.diff(np.concatenate(([0], hit.astype(int), [0]))) == 1).sum())))
    return Counter(out)


@pytest.mark.parametrize(("shard_bytes", "hot"), [(1 << 22, 4096), (600, 4096), (600, 2)])
def test_repeats_match_brute_force(docs, shard_bytes, hot):
    rng = random.Random(6)
    noise = _noise(7, 30)
    shared = [" ".join(f"p{rng.randint(0, 99)}" for _ in range(30)) for _ in range(3)]
    rows = ODD + [(100 + i, t) for i, t in enumerate(noise)] + [(200 + i, noise[i][: rng.randint(40, 200)] + shared[i % 3] + noise[(i * 7) % 30][5:90]) for i in range(30)]
    rows += [(300 + i, "abc" * rng.randint(10, 60)) for i in range(6)] + [(400, noise[0]), (400, noise[0]), (100, "é" * 60 + noise[3][:70])]
    got = suffix_dedup.remove_repeats(docs(rows).repartition(3), shard_bytes=shard_bytes, hot=hot).collect()
    assert Counter((r.doc_id, r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == _removed(rows, 50)
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def test_a_bucket_of_runs_holds_little_beside_their_bytes():
    rng = np.random.default_rng(4)
    n = 20_000
    data = rng.integers(97, 123, 64 * n, dtype=np.uint8).tobytes()
    delta = np.diff(np.sort(rng.integers(0, 2**63, n, dtype=np.uint64)), prepend=np.uint64(0))
    blocks = [
        squeezed(rank=delta, doc=np.arange(n) + k, row=np.arange(n) + k, start=np.zeros(n, np.int64), size=np.full(n, 64, np.uint32), data=data)
        for k in (0, 1)
    ]
    group = pa.table({"shard": pa.array([0, 1], pa.int32()), "local": [False, False], "block": pa.array(blocks, pa.binary())})
    tracemalloc.start()
    spans = suffix_dedup._repeats(group, 50)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 * 2 * n  # a run held as Python objects takes over 500 bytes
    assert spans.column("shard").to_pylist() == [1]
    found = opened(spans.column("block")[0].as_py())
    assert sorted(found["row"].tolist()) == list(range(1, n + 1)) and set(found["end"].tolist()) == {64}


def test_runs_of_texts_ranked_together_are_those_of_each_text(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, k, dtype=np.uint8) for k in (0, 49, 50, 51, 3000, 70, 9000)]
    which, rank, start, end = suffix_dedup.runs(texts, 50)
    for i, data in enumerate(texts):
        own = which == i
        assert [w for a, b in zip(start[own], end[own], strict=True) for w in range(a, b - 49)] == list(range(max(0, len(data) - 49)))
        _, *alone = suffix_dedup.runs([data], 50)
        assert [x.tolist() for x in alone] == [x[own].tolist() for x in (rank, start, end)]
    monkeypatch.setattr(suffix_dedup, "PART", 500)  # a long text is read in parts: runs may be cut there, no window is lost
    _, _, start, end = suffix_dedup.runs(texts[-1:], 50)
    assert [w for a, b in zip(start, end, strict=True) for w in range(a, b - 49)] == list(range(8951))


def test_multikey_sort():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5, (6000, 4)).astype(np.uint64)
    order = suffix_dedup.multikey_sorted(words, small=50)
    assert sorted(order.tolist()) == list(range(6000))
    assert words[order].tolist() == sorted(words.tolist())


# --- quality -----------------------------------------------------------------------------------------------------


def _counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = list(zip(w, w[1:], w[2:]))
    n = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if n[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_junk(docs):
    clean = [(1000 + i, t) for i, t in enumerate(_noise(8, 150, 60, 120))]
    junk = [(2000 + i, " ".join(w + "###" for w in t.split())) for i, t in enumerate(_noise(9, 5, 60, 90))]
    rows = ODD + clean + junk + [(3000, "one two three four " * 30)]
    got = quality.quality(docs(rows, extra=False)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in rows:
        if i is not None:
            assert tuple(by_id[i][c] for c in quality.COUNTS) == _counts(t or "")
    assert all(by_id[i].kept for i, _ in clean) and not any(by_id[i].kept for i, _ in junk)
    assert by_id[3000].base_failed and not by_id[3000].kept
    kept = quality.drop_low_quality(docs(rows))
    assert kept.columns == docs(rows).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    assert quality.quality(docs([])).count() == 0 and quality.drop_low_quality(docs([])).count() == 0


def test_quality_keeps_a_homogeneous_source_above_the_floor(docs):
    # symbol rate 1000 * 20 / 303 = 66, in the bucket of 64 to 67; word length 12,500 in the bucket of 12,288 to 12,799
    symbols = [(1000 + i, " ".join(f"{i:03}{k:02}" for k in range(52)) + " " + "#" * 20 + " abcdefghijklmnopqrstuvw") for i in range(120)]
    junk = [(2000, symbols[0][1].replace(" ", "# "))]
    got = {r.doc_id: r for r in quality.quality(docs(symbols + junk, extra=False)).collect()}
    assert all(got[i].symbol_rate == 66 and got[i].kept for i, _ in symbols) and not got[2000].kept
    long = [(1000 + i, " ".join(f"{i:03}{k:02}" + "x" * (7 + k % 2) for k in range(60))) for i in range(120)]
    got = quality.quality(docs(long, extra=False)).collect()
    assert all(r.length_rate == 12_500 and r.kept for r in got)


# --- word table --------------------------------------------------------------------------------------------------


def test_word_table_round_trip(docs, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE_BPE)
    monkeypatch.setattr(word_table, "BUCKET_BYTES", 2000)
    rows = ODD + [(100 + i, t) for i, t in enumerate(_noise(10, 50))]
    got = word_table.decode(word_table.encode(docs(rows), BYTE_BPE), BYTE_BPE).collect()
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[(i, np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got) == want
    assert word_table.encode(docs([]), BYTE_BPE).count() == 0


# --- near-duplicates ---------------------------------------------------------------------------------------------


def _bag(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def _classes(rows):
    bags = [_bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            low, high = (bags[i] & bags[j]).total(), (bags[i] | bags[j]).total()
            if 5 * low >= 4 * high:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return groups


def test_near_classes_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 5)
    rng = random.Random(11)
    base = _noise(12, 1, 150, 150)[0].split()
    rows = list(ODD)
    for i in range(50):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, "la la la la la " * 40), (201, "la la la la la " * 45), (202, "la la la la la " * 90)] + [(300 + i, t) for i, t in enumerate(_noise(13, 20))]
    got = near_dedup.near_duplicates(docs(rows)).collect()
    groups = _classes(rows)
    want = Counter((rows[i][0], min((rows[j][0] for j in g if rows[j][0] is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    left = near_dedup.drop_near_duplicates(docs(rows))
    assert left.columns == docs(rows).columns and left.count() == len(groups)
    assert near_dedup.near_duplicates(docs([])).count() == 0 and near_dedup.drop_near_duplicates(docs([])).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    n, m = 400, 4096
    shingle = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    a, b = rng.integers(0, 9, n), rng.integers(0, 9, n)
    owner = np.repeat([0, 1], n)
    keep = np.concatenate((a, b)) > 0
    best = near_dedup.bag_min_hash(owner[keep], np.concatenate((shingle, shingle))[keep], np.concatenate((a, b))[keep], 2, m)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((best[0] == best[1]).mean() - true) < 0.03


# --- private data ------------------------------------------------------------------------------------------------


def _luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def _spans(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_private_spans_match_brute_force(docs):
    rng = random.Random(14)
    bits = ["a@b.co", "x..y@c-d.e.f", "@", ".", "_", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+44", "é", "😀", " ",
            "12", "-", "a@b", "9" * 30, "+", "79927398713", "x" * 50]
    rows = ODD + [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for i in range(120)] + [(500, "1" * 20_000 + "a." * 20_000 + "@b.c" + ".d" * 20_000)]
    got = private_data.private_data(docs(rows)).collect()
    assert Counter((r.doc_id, r.base_spans) for r in got) == Counter((i, _spans(t or "")) for i, t in rows)
    assert private_data.private_data(docs([])).count() == 0


def test_terms_that_give_an_entity_away(docs):
    plain = _noise(15, 60)
    named = [f"{t} Zanzibarian mentions mail to kim@example.org now" for t in plain[:4]]
    rows = [(i, t + " mentions") for i, t in enumerate(plain[4:])] + [(100 + i, t) for i, t in enumerate(named)] + [(200, named[0]), (200, named[0])]
    got = {r.doc_id: r for r in private_data.private_data(docs(rows)).collect()}
    at = named[0].index("Zanzibarian")
    assert f"term_removed:{at}:{at + 11}" in got[100].spans and got[100].n_email == 1
    assert not any(s.startswith("term") and named[0][int(s.split(":")[1]) : int(s.split(":")[2])] == "mentions" for s in got[100].spans.split(","))
    assert got[0].spans == ""
    clean = private_data.sanitised(docs(rows))
    assert clean.columns == docs(rows).columns
    out = clean.collect()
    assert len(out) == len(rows) and not any("Zanzibarian" in r.text or "@" in r.text for r in out) and sum("[EMAIL]" in r.text for r in out) == 6
    assert all(r.n_chars == len(r.text) for r in out if r.doc_id >= 100) and {r.text for r in out if r.doc_id < 100} == {t for i, t in rows if i < 100}
    assert private_data.sanitised(docs([])).count() == 0


def test_short_terms_and_entities_of_two_texts(docs):
    plain = _noise(25, 80)
    named = [f"{t} Kim writes from bob@example.org and" for t in plain[:2]] + [f"{t} Ana Li calls +44 20 7946 0958 and" for t in plain[2:5]]
    once = [f"{t} Zoe writes from zoe@example.net and" for t in plain[5:6]]
    # words of few texts that fall together by chance do not belong to an address: each of these stands in two texts, one of them an address's own
    rare = lambda i: " ".join(f"{chr(97 + k)}{chr(97 + i % 26)}{chr(97 + i // 26)}q" for k in range(20))
    rows = [(i, f"{t} {rare(i // 2)} writes from calls and") for i, t in enumerate(plain[8:])] + [(100 + i, t) for i, t in enumerate(named)] + [(200, once[0]), (200, once[0])]
    rows += [(300, f"{plain[6]} {rare(0)} from dan@example.com"), (301, f"{plain[7]} {rare(1)} from dan@example.com")]
    got = private_data.private_data(docs(rows)).collect()
    text = dict(rows)
    terms = {i: {text[i][int(a) : int(b)] for s in r.spans.split(",") if s.startswith("term") for _, a, b in [s.split(":")]} for r in got for i in [r.doc_id]}
    assert all(terms[i] == {"Kim"} for i in (100, 101)) and all(terms[i] == {"Ana", "Li"} for i in (102, 103, 104))
    assert not any(terms[i] for i in terms if i not in range(100, 105))
    assert not any(re.search(r"\b(Kim|Ana|Li)\b", r.text) for r in private_data.sanitised(docs(rows)).collect())


def test_terms_that_fall_together_by_chance(docs):
    # two different texts of one address in a small corpus of rare words: a term of both says nothing where such pairs are common
    rng = random.Random(30)
    letters = [f"{a}{b}z" for a in "abcdefghijklmnopqrst" for b in "abcdefghij"]
    rows = [(i, " ".join(rng.sample(letters, 20))) for i in range(16)]
    rows = [(i, t + (" kay@example.org" if i < 2 else "")) for i, t in rows]
    got = private_data.private_data(docs(rows)).collect()
    assert "qhz" in rows[0][1] and "qhz" in rows[1][1] and not any("term" in r.spans for r in got)
    # a name of two texts, one of them in many copies, is not chance: copies are one text
    rows = [(i, " ".join(rng.sample(letters, 20)) + (" Kay kay@example.org" if i < 2 else "")) for i in range(300)]
    got = private_data.private_data(docs(rows + [(1000, rows[0][1])] * 60)).collect()
    assert all(("term" in r.spans) == (r.doc_id in (0, 1, 1000)) for r in got) and len(got) == 360
