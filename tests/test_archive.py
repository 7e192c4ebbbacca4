import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from taleloom.operators import archive as A
from taleloom.operators import entities as EN
from taleloom.operators import marks as M


def test_related_stories_with_hubs_match_brute_force(spark):
    rng = random.Random(5)
    edges = set()
    for s in range(60):
        for e in rng.sample(range(4), rng.randint(0, 4)):
            edges.add((s, e))
        for e in rng.sample(range(10, 60), rng.randint(0, 2)):
            edges.add((s, e))
    facts = spark.createDataFrame([("a", s, e) for s, e in edges], "archive_id string, story_id long, entity_id long")
    stories = spark.createDataFrame([(s, s % 7 != 0) for s in range(60)], "story_id long, annotated boolean")
    of = defaultdict(set)
    for s, e in edges:
        of[s].add(e)
    want = set()
    for s in of:
        shared = [(-len(of[s] & of[t]), t) for t in of if t != s and t % 7 and of[s] & of[t]]
        want |= {(s, t, -n) for n, t in sorted(shared)[:3]}
    for hub, limit in ((1000, 8), (5, 8), (5, 2)):
        got = A.related_stories(facts, stories, 3, hub, limit).collect()
        assert {(r.story_id, r.other_id, r.n) for r in got} == want, (hub, limit)


def test_removal_leaves_no_trace(spark):
    from taleloom.sources import sinks as K

    t = {
        "recordings": spark.createDataFrame([("a", 1), ("a", 2)], "archive_id string, recording_id long"),
        "stories": spark.createDataFrame([("a", 1, 10), ("a", 2, 20)], "archive_id string, recording_id long, story_id long"),
        "facts": spark.createDataFrame([("a", 1, 10, 7), ("a", 2, 20, 8), ("a", 2, 20, None)], "archive_id string, recording_id long, story_id long, entity_id long"),
        "questions": spark.createDataFrame([(10, "x"), (20, "y")], "story_id long, text string"),
        "entities": spark.createDataFrame([("a", 7), ("a", 8), ("a", 9)], "archive_id string, entity_id long"),
    }
    out = K.remove_recordings(t, spark.createDataFrame([(1,)], "recording_id long"))
    assert [r.story_id for r in out["stories"].collect()] == [20]
    assert [r.text for r in out["questions"].collect()] == ["y"]
    assert [r.entity_id for r in out["entities"].collect()] == [8]


def test_entities_join_through_aliases_in_any_order(spark):
    rows = [("a", "person", 1, "ROSA", None, ["Dona Rosa"]), ("a", "person", 2, "Dona Rosa", "aunt", []), ("a", "person", 3, "Rosa", None, []), ("a", "place", 4, "Rosa", None, [])]
    for order in (rows, rows[::-1]):
        c = spark.createDataFrame(order, "archive_id string, kind string, claim_id int, name string, relation string, aliases array<string>")
        e, aliases, claims = EN.resolve_entities(c)
        people = [r for r in e.collect() if r.kind == "person"]
        assert len(people) == 1 and people[0].relation == "aunt" and people[0]["name"] != "ROSA"
        assert len({r.entity_id for r in claims.collect()}) == 2


def test_chain_of_aliases_is_one_entity(spark):
    rows = [("a", "person", i, f"n{i}", None, [f"n{i + 1}"]) for i in range(40)]
    c = spark.createDataFrame(rows, "archive_id string, kind string, claim_id int, name string, relation string, aliases array<string>")
    e, _, claims = EN.resolve_entities(c)
    assert e.count() == 1 and claims.count() == 40


def _greedy(hits, gap):
    out = []
    for rank, at, t in sorted(hits):
        if all(abs(t - o[2]) >= gap for o in out):
            out.append((rank, at, t))
    return set(out)


def test_spaced_choice_matches_greedy(spark):
    rng = random.Random(6)
    rows = []
    for story in range(4):
        t = 0.0
        for at in range(60):
            t += rng.choice([0.0, 0.4, 0.9, 1.4, 3.0])
            rows.append((story, 1, rng.randint(0, 2), at, round(t, 1)))
    df = spark.createDataFrame(rows, "story_id int, entity_id int, phrase_rank int, at int, time double")
    want = {(s, *h) for s in range(4) for h in _greedy([r[2:] for r in rows if r[0] == s], 1.5)}
    got = [(r.story_id, r.phrase_rank, r.at, r.time) for r in M.spaced_dedupe(df, 1.5).collect()]
    assert len(got) == len(want) and set(got) == want


def test_offsets_never_use_a_later_anchor(spark):
    rng = random.Random(7)
    off = [(s, float(rng.randint(0, 2000)), rng.randint(1, 20)) for s in range(5) for _ in range(12)]
    off = list({(s, t): (s, t, v) for s, t, v in off}.values())
    anc = [(s, float(rng.randint(0, 2000)), 1950 + rng.randint(0, 60), "said", i) for s in range(5) for i in range(6)]
    rel = [(s, t) for s, t, _ in off]
    o = spark.createDataFrame(off, "story_id int, start double, value int")
    a = spark.createDataFrame(anc, "story_id int, time double, year int, evidence string, ord int")
    r = spark.createDataFrame(rel, "story_id int, time double")
    for row in M.resolve_offsets(o, a, r, 2000, slot_seconds=50).collect():
        before = sorted([x for x in anc if x[0] == row.story_id and x[1] < row.start], key=lambda x: (-x[1], x[4]))
        if not before:
            want = None
        elif any(t > before[0][1] and t < row.start for s, t in rel if s == row.story_id):
            want = None
        else:
            want = before[0][2] + row.value if before[0][2] + row.value <= 2000 else None
        assert row.year_from == want


def test_mark_asked_and_rename(spark):
    q = spark.createDataFrame([("a", 1, "Why?", False), ("a", 2, "Who?", False)], "archive_id string, question_id int, text string, dismissed boolean")
    got = A.mark_asked(q, q.where(F.col("question_id") == 1)).collect()
    assert Counter(r.dismissed for r in got) == {True: 1, False: 1}


def test_entities_are_never_broadcast(spark):
    """Entities look small to the planner however many they are; a broadcast sends them whole through the driver."""
    from taleloom.operators import timeline as TL

    e = spark.createDataFrame([("a", i, "person", f"N {i}", None, []) for i in range(3)], "archive_id string, entity_id long, kind string, name string, relation string, aliases array<string>")
    f = spark.createDataFrame([("a", 10 + i, i % 2, "person", 1.0, 10 + i) for i in range(4)], "archive_id string, story_id long, entity_id long, kind string, start double, fact_id long")
    k = spark.createDataFrame([("a", 10, 0, "mention", "kept", 2.0)], "archive_id string, story_id long, entity_id long, kind string, status string, start double")
    y = f.select("story_id", F.when(F.col("story_id") > 10, 1990 + F.col("story_id")).alias("year"))
    s = f.select("story_id", F.lit(True).alias("annotated"))
    m = TL.mentions_union(f, k, e)
    c = f.select("archive_id", "kind", F.lit("n 1").alias("name"))
    made = {
        "timelines": (A.entity_timelines(m, y, e).select("entity_id", "first_year", "last_year", "dated", "undated"), {(0, 2002, 2002, 1, 1), (1, 2001, 2003, 2, 0)}),
        "known": (A.known_entity_flag(c, e).select("known").distinct(), {(True,)}),
        "life": (TL.life_entities(m, e).select("entity_id", "stories"), {(0, 2), (1, 2)}),
        "counts": (A.entity_counts(e, f, s).select("entity_id", "stories", "moments"), {(0, 2, 2), (1, 2, 2)}),
        "most used": (A.known_entities(e, f).select("entity_id", "uses", "rank"), {(0, 2, 1), (1, 2, 2)}),
    }
    for name, (df, want) in made.items():
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan, name
        assert {tuple(r) for r in df.collect()} == want, name


def test_names_are_small_stored_tables(spark, monkeypatch):
    """Tokens meet names by tables of known size, and only tokens that stand in a name are dealt for the last join."""
    from taleloom.operators import marks as M

    tables = []
    store = M.stored
    monkeypatch.setattr(M, "stored", lambda df: tables.append(df.columns) or store(df))
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "We met Anna Berg and Anna there."), (1, 1, 1.0, 2.0, "Berg alone.")], "recording_id long, idx int, start double, end double, text string")
    sto = spark.createDataFrame([("a", 1, 1, 0, 1)], "archive_id string, recording_id long, story_id long, seg_start int, seg_end int")
    ent = spark.createDataFrame([("a", 7, "person", "Anna Berg", None)], "archive_id string, entity_id long, kind string, name string, aliases array<string>")
    got = M.mention_hits(sto, seg, ent).collect()
    assert [(r.entity_id, r.seg, r.reason) for r in got] == [(7, 0, None)] or [(r.entity_id, r.seg) for r in got] == [(7, 0)]
    assert tables.count(["token"]) == 2
