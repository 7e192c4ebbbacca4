"""Readers, sinks and streams on small files written here."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from taleloom.operators import envelope as E
from taleloom.operators import transcript as T
from taleloom.sources import readers as R
from taleloom.sources import sinks as K
from taleloom.streaming import jobs as J


def test_recognizer_json(spark, tmp_path):
    tok = lambda t, a, b, p: {"text": t, "offsets": {"from": a, "to": b}, "p": p}
    doc = {"result": {"language": "pt"}, "transcription": [
        {"offsets": {"from": 0, "to": 2000}, "text": " A mãe veio.", "tokens": [tok("[_BEG_]", 0, 0, 1.0), tok(" A", 0, 100, 0.9), tok(" m", 100, 200, 0.8), tok("Ã", 200, 300, 0.6), tok("£e", 300, 500, 0.4), tok(" veio", 500, 900, 1.0), tok(".", 900, 1000, 1.0)]},
        {"offsets": {"from": 2000, "to": 3000}, "text": " ♪ música ♪"},
        {"offsets": {"from": 3000, "to": 4000}, "text": "  Depois   choveu. "},
    ]}
    raw = json.dumps(doc, ensure_ascii=False).replace("mãe", "mÃ£e").replace("música", "mÃºsica").replace("♪", "o").encode("latin1")
    (tmp_path / "rec1.json").write_bytes(raw)
    rows = R.read_asr_json(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.recording_id, r.idx, r.text, r.start, r.end) for r in rows][0] == ("rec1", 0, "A mãe veio.", 0.0, 2.0)
    assert [(w.text, w.start, w.end, w.p) for w in rows[0].words] == [("A", 0.0, 0.2, 0.9), ("mãe", 0.2, 1.0, 0.6), ("veio.", 1.0, 2.0, 1.0)]
    assert rows[-1].text == "Depois choveu." and rows[-1].words is None
    assert R.asr_sentences(spark, str(tmp_path)).count() >= 2


def test_sentence_breaks(spark):
    w = lambda t0, *ws: [(t0 + i * 0.5, t0 + i * 0.5 + 0.4, x, 0.5) for i, x in enumerate(ws)]
    seg = spark.createDataFrame([
        ("r", 0, 0.0, 5.0, "x", w(0.0, "One", "two.", "Three", "e.g.", "four"), 0.5),
        ("r", 1, 9.0, 10.0, "whole line", None, 0.7),
        ("r", 2, 10.0, 40.0, "x", w(10.0, *["go"] * 50), 0.5),
    ], "recording_id string, idx int, start double, end double, text string, words array<struct<start:double,end:double,text:string,p:double>>, confidence double")
    for block in (4, 1 << 16):
        got = [r.text for r in T.sentences_from_words(seg, block).orderBy("idx").collect()]
        assert got == ["One two.", "Three e.g. four", "whole line", " ".join(["go"] * 45), " ".join(["go"] * 5)]


def test_story_plan_uses_question_lines(spark):
    text = ["hi", "Could you tell us about home?", "It was small.", "We left soon.", "And the war, what do you remember?", "It was long.", "Very long."]
    seg = spark.createDataFrame([("r", i, i * 6.0, i * 6.0 + 5, t) for i, t in enumerate(text)], "recording_id string, idx int, start double, end double, text string")
    drafts = spark.createDataFrame([("r", 0, 2, 3, "«Home»", 2), ("r", 1, 5, 9, "", 5), ("r", 2, 2, 3, "again", 2)],
                                   "recording_id string, draft_no int, first_segment int, last_segment int, title string, quote_segment int")
    got = [(r.ord, r.seg_start, r.seg_end, r.title) for r in T.plan_stories(drafts, seg).orderBy("ord").collect()]
    assert got == [(0, 1, 3, "Home"), (1, 4, 6, "And the war, what do you remember")]


def test_envelope_file_and_ingest(spark, tmp_path):
    peaks = bytes([200] * 40 + [0] * 10 + [200] * 40)
    (tmp_path / "e.json").write_text(json.dumps({"source": "s", "perSecond": 20, "duration": 4.5, "peaks": base64.b64encode(peaks).decode(),
                                                "segments": [{"idx": 0, "start": 0, "end": 2, "text": "a", "words": [[0, 2, "a", 0.9]]}]}))
    env, seg = R.read_envelope_json(spark, str(tmp_path / "e.json"))
    assert env.count() == 90 and seg.first().words[0].end == 2.0
    assert [(p.start, p.end) for p in E.detect_pauses(env, block=16).collect()] == [(2.0, 2.5)]
    audio = tmp_path / "audio"
    audio.mkdir()
    (audio / "a.MP3").write_bytes(b"x" * 600)
    (audio / "b").write_bytes(b"x" * 600)
    (audio / "c.wav").write_bytes(b"x")
    (tmp_path / "m.tsv").write_text("file\tvoice\trecorded_at\tprompt\na.MP3\tv\t2020-01-02T03:04:05Z\tTell\nb\tv\tnever\t\nc.wav\tv\t\t\nd.wav\tv\t\t\n")
    m = R.read_manifest(spark, str(tmp_path / "m.tsv")).select(F.lit("a").alias("archive_id"), "*", F.lit("audio/ogg; codecs=opus").alias("mime"), F.lit("imported").alias("source"))
    arch = spark.createDataFrame([("a",)], "archive_id string")
    good, bad = R.ingest_recordings(m, R.list_files(spark, str(audio)), arch, "2024-05-06 00:00:00")
    assert {(r.original_name, r.extension, str(r.recorded_at)[:10]) for r in good.collect()} == {("a.MP3", "mp3", "2020-01-02"), ("b", "ogg", "2024-05-06")}
    assert {(r.file, r.reason) for r in bad.collect()} == {("c.wav", "recording is empty"), ("d.wav", "file not found")}


def test_tolerant_claims(spark):
    raw = spark.createDataFrame([
        ("s1", json.dumps({"people": [{"name": "Ana", "segment": "3", "explicit": True, "mention": "Ana", "relation": None}], "times": [{"year_from": 1950, "year_to": 0, "mention": "x"}],
                           "life_stage": {"value": "unknown"}, "themes": ["food", "war", "food", "work", "love", "home"], "questions": [" a ", "", "b", "c"]})),
        ("s2", "not json"),
    ], "story_id string, json string")
    claims, about = R.parse_claims(raw)
    got = {(r.kind, r.name, r.segment, r.explicit, r.year_from, r.year_to) for r in claims.collect()}
    assert got == {("person", "Ana", 3, True, None, None), ("time", None, 0, False, 1950, 1950)}
    assert {r.story_id: (r.themes, r.questions) for r in about.collect()} == {"s1": (["food", "work", "love"], ["a", "b"]), "s2": ([], [])}


def test_replacement_is_whole_and_repeatable(spark, tmp_path):
    t = K.GenerationTable(spark, str(tmp_path / "t"), "recording_id string, v int")
    row = lambda *r: spark.createDataFrame(list(r), "recording_id string, v int")
    first = row(("a", 1), ("a", 2), ("b", 3))
    t.replace(first, first, 0)
    t.replace(row(("a", 9)), row(("a", 9)), 1)
    t.replace(row(("a", 9)), row(("a", 9)), 1)
    assert sorted((r.recording_id, r.v) for r in t.read().collect()) == [("a", 9), ("b", 3)]
    t.replace(row(("x", 0)).limit(0), row(("b", 0)), 2)
    assert [(r.recording_id, r.v) for r in t.compact(str(tmp_path / "u")).read().collect()] == [("a", 9)]


def test_streams_match_batch(spark, tmp_path, sf_dir):
    from taleloom.plans import views as V

    src = tmp_path / "ticks"
    V.playback(spark, sf_dir).repartition(3).write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    batch = {(r.listener, r.story_id, r.bits) for r in J.heard_coverage(V.playback(spark, sf_dir)).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = J.heard_coverage(stream).writeStream.format("memory").queryName("heard").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.listener, r.story_id, r.bits) for r in spark.table("heard").collect()} == batch


def test_stream_ingest_and_incremental_index(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    line = lambda r, a, b, t: json.dumps({"recording_id": r, "line": f"[00:00:{a:06.3f} --> 00:00:{b:06.3f}]  {t}"})
    (src / "1.json").write_text("\n".join([line("a", 0, 4, "Hello there."), line("a", 4, 5, "Thanks for watching!"), "{}"]))
    target = K.GenerationTable(spark, str(tmp_path / "out"), "recording_id string, start double, end double, text string")
    stream = lambda: J.files_stream(spark, str(src), "recording_id string, line string")
    J.stream_ingest(stream(), J.live_lines, target, ck).awaitTermination(120)
    assert [(r.recording_id, r.start, r.end, r.text) for r in target.read().collect()] == [("a", 0.0, 4.0, "Hello there.")]
    (src / "2.json").write_text(line("a", 0, 3, "Hello again."))
    J.stream_ingest(stream(), J.live_lines, target, ck).awaitTermination(120)
    assert [r.text for r in target.read().collect()] == ["Hello again."]
    index = K.GenerationTable(spark, str(tmp_path / "ix"), "recording_id string, story_id bigint, seg_start int, seg_end int, start double, end double, text string")
    seg = lambda: target.read().withColumn("idx", F.lit(0))
    sto = lambda: spark.createDataFrame([], "recording_id string, story_id bigint, seg_start int, seg_end int")
    J.incremental_index(J.files_stream(spark, str(src), "recording_id string"), seg, sto, index, str(tmp_path / "ck2")).awaitTermination(120)
    assert [r.text for r in index.read().collect()] == ["Hello again."]


def test_line_numbers_go_on_after_a_restart(spark, tmp_path):
    src, out, ck = tmp_path / "log", str(tmp_path / "lines"), str(tmp_path / "ck")
    src.mkdir()

    def arrive(name, rows):
        (src / name).write_text("\n".join(json.dumps({"recording_id": r, "line": f"[00:00:{a:06.3f} --> 00:00:{a + 1:06.3f}]  {t}"}) for r, a, t in rows))

    def run():
        raw = J.files_stream(spark, str(src), "recording_id string, line string", files_per_trigger=1)
        J.numbered_lines(J.live_lines(raw)).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(120)

    found = lambda df: sorted((r.recording_id, r.idx, r.start, r.text) for r in df.collect())
    arrive("1.json", [("a", 2, "second"), ("a", 0, "first"), ("b", 0, "other"), ("a", 4, "Thanks for watching!")])
    run()
    seen = found(spark.read.parquet(out))
    assert [x[:2] for x in seen] == [("a", 0), ("a", 1), ("b", 0)] and seen[1][3] == "second"
    arrive("2.json", [("a", 9, "fourth"), ("a", 6, "third"), ("c", 1, "new"), ("c", 1, "new")])
    run()
    run()  # nothing new: no line twice
    batch = J.live_lines(spark.read.schema("recording_id string, line string").json(str(src)))
    for seconds in (3, 600):
        assert found(J.numbered_lines(batch, seconds)) == found(spark.read.parquet(out))
    assert set(seen) <= set(found(spark.read.parquet(out)))
    cursors = spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "recording_id string, after int")
    assert [x[:2] for x in found(J.lines_after(spark.read.parquet(out), cursors))] == [("a", 2), ("a", 3), ("c", 0), ("c", 1)]


def test_report_lists_every_section(spark):
    s = spark.createDataFrame([("a", "s", "T", 0.0, 9.0)], "archive_id string, story_id string, title string, start double, end double")
    tr = spark.createDataFrame([("s", 0, 0.0, "x")], "story_id string, idx int, start double, text string")
    f = spark.createDataFrame([("a", "s", 1, 7, "person", "Ana", "said", "Ana", 1.0, None)], "archive_id string, story_id string, fact_id int, entity_id int, kind string, value string, provenance string, evidence string, start double, note string")
    e = spark.createDataFrame([("a", 7, "Ana", "aunt")], "archive_id string, entity_id int, name string, relation string")
    r = spark.createDataFrame([("s", 2, "place", "house", "house", "no")], "story_id string, claim_no int, kind string, value string, mention string, reason string")
    m = spark.createDataFrame([("a", "s", "mention", "kept", 7, None, None, "Ana", None, None, 2.0)], "archive_id string, story_id string, kind string, status string, entity_id int, value int, year_from int, evidence string, reason string, note string, start double")
    q = spark.createDataFrame([("s", 1, "Why?", False)], "story_id string, question_id int, text string, dismissed boolean")
    mm = spark.createDataFrame([("a", "s", 7, "person", 1.0)], "archive_id string, story_id string, entity_id int, kind string, time double")
    rows = K.archive_report(s, tr, f, e, r, m, q, mm).collect()
    assert sorted(x.section[0] for x in rows) == list("1234567")
    assert json.loads(next(x.body for x in rows if x.section == "3 fact"))["entity"] == "Ana"


def test_every_query_runs_in_spark(spark, sf_dir):
    import __spark_entry__ as entry

    sqls = entry.oracle_sql()
    assert set(sqls) < set(entry.queries())
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name in ("upsert_archives", "story_links", "paragraphs", "heard_coverage", "stage_year_span", "carry_period"):
        df = entry.queries()[name](spark, sf_dir)
        r = con.execute(sqls[name])
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns)
        key = lambda row: str(tuple(None if v is None else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in row))
        assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, r.fetchall())), name


def test_listeners_who_came_equally_far_are_listed_together(spark, tmp_path):
    heard = [(i, i % 3, float(i * 37 % 100 + k)) for i in range(120) for k in (0, 2)] + [(None, 1, 50.0), (7, None, 50.0), (8, 2, None)]
    said = [(s, 10 * s + e, e * 9.0) for s in range(3) for e in range(10)] + [(1, 10, 95.0), (1, None, 5.0), (None, 4, 5.0), (2, 29, None)]
    positions = spark.createDataFrame(heard, "listener long, story_id long, position double").repartition(4)
    spark.createDataFrame(said, "story_id long, entity_id long, time double").write.parquet(str(tmp_path / "mentions"))
    mentions = spark.read.parquet(str(tmp_path / "mentions"))  # of known size, so small enough to keep the order of the listeners
    rows = J.revealed(positions, mentions).withColumn("part", F.spark_partition_id()).collect()
    reached, first = {}, {}
    for who, story, at in heard:
        if story is not None and at is not None:
            reached[who, story] = max(at, reached.get((who, story), at))
    for story, entity, at in said:
        if story is not None and at is not None:
            first[story, entity] = min(at, first.get((story, entity), at))
    want = [(who, s, e) for (who, s), far in reached.items() for (t, e), at in first.items() if s == t and far >= at - 0.3]
    assert sorted(map(repr, want)) == sorted(repr((r.listener, r.story_id, r.entity_id)) for r in rows)
    for part in {r.part for r in rows}:
        places = [(r.story_id, reached[r.listener, r.story_id]) for r in rows if r.part == part]
        assert places == sorted(places)
