"""Golden rows for text rules; the sentences are written for these tests."""

import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from taleloom.functions import text as X
from taleloom.functions import timescan
from taleloom.functions.timescan import number_value, scan_texts
from taleloom.operators import extract as E
from taleloom.operators import phrases as P
from taleloom.operators import transcript as T


def plain(text):
    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c)[0] != "M")
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split())


def found(text):
    x = scan_texts([text], [plain(text)])
    return list(x[["kind", "value", "stage", "phrase", "first_person"]].itertuples(index=False, name=None))


@pytest.mark.parametrize("text,want", [
    ("Eu tinha setenta e oito anos quando parei.", [("age", 78, None, "Eu tinha setenta e oito anos", True)]),
    ("I was nineteen when the bridge fell.", [("age", 19, None, "I was nineteen", True)]),
    ("I was there when the bridge fell.", []),
    ("She is a 40-year-old nurse.", [("age", 40, None, "40-year-old", False)]),
    ("Yo tenía quince años, y ella tenía 9 años.", [("age", 15, None, "Yo tenía quince años", True), ("age", 9, None, "tenía 9 años", False)]),
    ("Two years later we sold it.", [("offset", 2, None, "Two years later", False)]),
    ("The following year it rained.", [("offset", 1, None, "The following year", False)]),
    ("Ficamos por três anos.", [("duration", 3, None, "por três anos", False)]),
    ("He drove for 30 years.", [("duration", 30, None, "for 30 years", False)]),
    ("Quando eu era bem pequena, chovia.", [("stage", None, "childhood", "eu era bem pequena", True)]),
    ("My teenage years were loud.", [("stage", None, "youth", "my teenage years", True)]),
    ("O livro tinha 20 anos de uso.", []),
])
def test_time_expressions(text, want):
    assert found(text) == want


def test_a_batch_is_scanned_as_its_texts_are():
    far = "word " * 40
    texts = [
        "I was nineteen", "years later, eu tinha vinte e um anos", "", "tinha 9 anos trabalhando; yo tenía quince años", far + "for 30 years " + far + "my youth and twenty years later",
        "no \0 ano seguinte", "At the age of forty-two, I", "left " + far * 30 + "she is a 40-year-old", "depois de 3 anos depois de 4 anos", "por dois anos por dois anos\n",
    ]
    plain_texts = [plain(t) for t in texts]
    every = scan_texts(texts, plain_texts)
    alone = [scan_texts([t], [p]).assign(owner=i) for i, (t, p) in enumerate(zip(texts, plain_texts))]
    rows = lambda x: sorted(map(repr, x[["owner", "kind", "value", "stage", "phrase", "at", "first_person"]].astype(object).where(lambda v: v.notna(), None).itertuples(index=False, name=None)))
    assert rows(every) == sorted(r for x in alone for r in rows(x))
    for owner, phrase, at, kind in every[["owner", "phrase", "at", "kind"]].itertuples(index=False):
        assert (plain_texts if kind == "stage" else texts)[owner][at:].startswith(phrase)
    values = [(o, k, v) for o, k, v in every[["owner", "kind", "value"]].itertuples(index=False) if k != "stage"]
    assert sorted(values) == sorted([
        (0, "age", 19), (1, "age", 21), (3, "age", 9), (3, "age", 15), (4, "duration", 30), (4, "offset", 20), (6, "age", 42), (7, "age", 40), (8, "offset", 3),
        (9, "duration", 2), (9, "duration", 2)])


def test_number_value():
    assert [number_value(x) for x in ("vinte e um", "forty two", "7", "many", "noventa")] == [21, 42, 7, None, 90]


def _one(spark, col, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(col).collect()]


def test_normalize_equals_unicode_folding(spark):
    rows = ["Ação, ÉTÉ e Müller!", "Ñandú — søt straße", "ÀÉÎÕÜ çşģ", "  ", "Ὀδυσσεύς", "já-tá 12º"]
    assert _one(spark, X.normalize("t"), rows) == [plain(r) for r in rows]


def test_names(spark):
    assert _one(spark, X.display_name(F.col("t")), ["ROSA  LIMA", "Ana", "EVA"]) == ["Rosa Lima", "Ana", "EVA"]
    assert _one(spark, X.proper_alias(F.col("t")), ["the Old Mill.", "dona Clara,", "my house"]) == ["Old Mill", "Clara", None]
    assert _one(spark, X.names_institution(F.col("t")), ["the School of Arts", "School", "Maria School"]) == [True, False, False]
    assert _one(spark, X.clean_title(F.col("t")), ['«The  mill.»', "..."]) == ["The mill", ""]
    assert _one(spark, X.fallback_title(F.col("t")), ["one two three four five six seven eight.", "a b."]) == ["one two three four five six seven…", "a b"]


def test_hallucinations(spark):
    assert _one(spark, X.is_hallucination(F.col("t")), ["♪ Música ♪", "Thank you for watching!", "We sang and music played all night long", "…"]) == [True, True, False, True]


def test_years(spark):
    ts = X.tokens("t")
    assert _one(spark, E.year_supported(ts, F.lit(1978)), ["em setenta e oito", "in 1978", "78 years", "no 1979"]) == [True, True, False, False]
    assert _one(spark, E.year_is_approximate(ts, F.lit(1950)), ["por volta de 1950", "around the year 1950", "in 1950", "cerca de cinquenta"]) == [True, True, False, False]


def test_owned_kinship(spark):
    df = spark.createDataFrame([(1, "My the aunt and the aunt of Rui; nossa avó")], "recording_id int, text string")
    assert [(r.pos, r.token) for r in E.owned_kinship(df, ["recording_id"]).orderBy("pos").collect()] == [(2, "aunt"), (9, "avo")]


SEG = "recording_id string, idx int, start double, end double, text string, words array<struct<start:double,end:double,text:string,p:double>>"


def _timed(idx, text, t0=0.0):
    ws = text.split()
    return ("r", idx, t0, t0 + len(ws), text, [(t0 + i, t0 + i + 1.0, w, 0.9) for i, w in enumerate(ws)])


def test_phrases_exact_and_tolerant(spark):
    seg = spark.createDataFrame([_timed(0, "We went to Porto Novo, by boat."), _timed(1, "the gardens near the old stone mill were closed", 20.0)], SEG)
    rows = [("a", "porto novo"), ("b", "gardener near stone"), ("c", "old mill"), ("d", "garden"), ("e", "")]
    req = spark.createDataFrame([("r", 0, 9, i, p) for i, p in rows], "recording_id string, seg_from int, seg_to int, request_id string, phrase string")
    s = P.streams(seg)
    exact = {r.request_id: (r.idx, r.start, r.end, r.evidence) for r in P.locate(req, s).collect()}
    assert exact == {"a": (0, 3.0, 5.0, "Porto Novo")}
    loose = {r.request_id: (r.idx, r.evidence) for r in P.locate(req, s, tolerant=True).collect()}
    assert loose == {"a": (0, "Porto Novo"), "b": (1, "gardens near the old stone"), "d": (1, "gardens")}


def test_long_phrase_may_skip_two_words(spark):
    seg = spark.createDataFrame([_timed(0, "we saw the very big red barn burn")], SEG)
    req = spark.createDataFrame([("r", 0, 9, "x", "the red barn"), ("r", 0, 9, "y", "we the barn")], "recording_id string, seg_from int, seg_to int, request_id string, phrase string")
    got = {r.request_id: r.evidence for r in P.locate(req, P.streams(seg), tolerant=True).collect()}
    assert got == {"x": "the very big red barn"}


def test_every_letter_is_folded_as_canonical_decomposition_folds_it(spark):
    letters = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "L"]
    known = F.col("text").rlike(r"^\p{L}$")  # the JVM may know fewer letters
    rows = spark.createDataFrame([(x,) for x in letters], "text string").where(known).select("text", X.normalize("text").alias("got")).collect()
    assert len(rows) > 120_000
    assert [(r.text, r.got) for r in rows if r.got != plain(r.text)] == []


def test_syllables_within_texts(spark):
    texts = ["서울 Café 각", "힣", "가", "", None, "\U0001f600 한 글\U0001f600자 ñ"]
    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(X.normalize("text").alias("n")).collect()]
    assert got == [None if t is None else plain(t) for t in texts]


def test_patterns_that_begin_with_a_number_see_all_they_need(monkeypatch):
    """The few words around an anchor give the rows that wide stretches give."""
    said = "vinte e cinco anos depois mais tarde year years old later turned I was 33 twenty-five twenty and y año años de idade quando trabalhando for , . - the age of".split()
    pick = random.Random(5)
    texts = [" ".join(pick.choice(said) for _ in range(pick.randint(1, 40))) for _ in range(4000)]
    forms = [plain(t) for t in texts]
    near = scan_texts(texts, forms).values.tolist()
    monkeypatch.setattr(timescan, "REACH_OF_NUMBER", timescan.REACH)
    assert near == scan_texts(texts, forms).values.tolist() and len(near) > 100


def test_words_are_split_once_per_segment(spark):
    """Before, the plan split a segment's text again for each of its words."""
    rows = [(1, 0, 0.0, 1.0, " one two  three four"), (1, 1, 1.0, 2.0, ""), (1, 2, 2.0, 3.0, None)]
    got = T.interpolated_words(spark.createDataFrame(rows, "recording_id long, idx int, start double, end double, text string"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    assert sorted((r["idx"], r["pos"], r["start"], r["end"], r["text"]) for r in got.collect()) == [
        (0, 0, 0.0, 0.25, "one"), (0, 1, 0.25, 0.5, "two"), (0, 2, 0.5, 0.75, "three"), (0, 3, 0.75, 1.0, "four")]


def test_requests_of_one_segment_meet_it_on_equal_keys(spark):
    """The same hits as over spans, and the sort of the grouping holds no pieces of the segments."""
    words = [(0.0, 1.0, "in"), (1.0, 2.0, "the"), (2.0, 3.0, "old"), (3.0, 4.0, "House,")]
    seg = [(1, 0, 0.0, 4.0, "in the old House,", words), (1, 1, 4.0, 8.0, "the old house", words), (2, 0, 0.0, 4.0, "old houses", None)] * 2
    seg = spark.createDataFrame(seg, "recording_id long, idx int, start double, end double, text string, words array<struct<start:double,end:double,text:string>>")
    req = [(r, i, i, f"{r}|{i}|{p}", p) for r, i in [(1, 0), (1, 1), (2, 0), (3, 0), (1, None)] for p in ("the old house", "house", "sea")]
    req = spark.createDataFrame(req, "recording_id long, seg_from int, seg_to int, request_id string, phrase string")
    got = P.locate(req, P.streams(seg), tolerant=True, single=True)
    assert sorted(got.collect()) == sorted(P.locate(req, P.streams(seg), tolerant=True).collect()) and got.count() == 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "pieces" not in plan.split("Aggregate", 1)[1].split("\n", 1)[0]
