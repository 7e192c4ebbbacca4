"""Queries on stories, facts, entities and the life built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import archive as A
from ..operators import entities as EN
from ..operators import marks as M
from ..operators import timeline as TL
from ..sources import readers as R
from ..sources import sinks as K
from . import views as V
from .oracle import norm, sql
from .registry import Query

AS_OF = V.AS_OF


def facts(s, d):
    return V.order_facts(s, d)


def mentions(s, d):
    return TL.mentions_union(facts(s, d), V.order_marks(s, d), V.order_entities(s, d))


def dates(s, d):
    b = TL.best_date(facts(s, d).where(F.col("kind").isin("time", "life_stage")), V.archives(s, d))
    return b.join(V.archives(s, d).select("archive_id", "birth_year"), "archive_id", "left")


def life(s, d):
    x = TL.certainty(TL.sort_year(dates(s, d)))
    o = V.order_stories(s, d).select("story_id", "recorded_at", "themes", "annotated")
    return x.join(o, "story_id")


def secs(c):
    return F.unix_seconds(c)


def upsert(s, d):
    """Customers as archive settings: the last write per archive wins."""
    c = V.table(s, d, "customer")
    new = c.select(
        (F.col("c_custkey") % 97).alias("archive_id"), F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("subject"), (F.lit(1840) + F.col("c_custkey") % 200).cast("int").alias("birth_year"),
        F.when(F.col("c_custkey") % 3 == 0, "EN").otherwise(F.col("c_mktsegment")).alias("language"), F.col("c_custkey").alias("written_at"))
    old = V.table(s, d, "supplier").select(
        (F.col("s_suppkey") % 113).alias("archive_id"), F.col("s_name").alias("subject"), F.lit(1900).alias("birth_year"), F.lit("pt").alias("language"), (F.col("s_suppkey") * 10).alias("written_at"))
    return R.upsert_archives(old, new, AS_OF)


def tables(s, d):
    return {
        "recordings": V.order_recordings(s, d), "stories": V.order_stories(s, d), "facts": facts(s, d), "entities": V.order_entities(s, d), "marks": V.order_marks(s, d),
    }


ROW_KEYS = {"recordings": ["recording_id"], "stories": ["story_id"], "facts": ["fact_id"], "entities": ["archive_id", "entity_id"], "marks": ["story_id", "entity_id"]}


def _keys(t):
    """The keys of all rows that stay, table by table."""
    out = None
    for name, df in t.items():
        one = df.select(F.lit(name).alias("table_name"), F.concat_ws(":", *(F.col(k).cast("string") for k in ROW_KEYS[name])).alias("row_key"))
        out = one if out is None else out.unionByName(one)
    return out


def removed(s, d):
    t = tables(s, d)
    gone = t["recordings"].where((F.col("recording_id") % 10) < 9).select("recording_id")
    return _keys(K.remove_recordings(t, gone))


def snapshot(s, d):
    t = tables(s, d)
    wanted = t["recordings"].where(F.col("recording_id") % 4 == 1).select("original_name")
    return _keys(K.snapshot(t, wanted))


SIZES = """
  , kept as (select recording_id from o_recs where {keep}), ks as (select * from o_stories where recording_id in (from kept)), kf as (select * from o_facts where recording_id in (from kept))
  select 'recordings' as table_name, recording_id::varchar as row_key from kept union all select 'stories', story_id::varchar from ks union all select 'facts', fact_id::varchar from kf
  union all select 'marks', concat_ws(':', story_id, entity_id) from o_marks where story_id in (select story_id from ks)
  union all select 'entities', concat_ws(':', archive_id, entity_id) from o_entities e where exists (select 1 from kf where kf.archive_id = e.archive_id and kf.entity_id = e.entity_id)
"""


def patched(s, d):
    r = V.order_recordings(s, d).withColumn("models", F.create_map(F.lit("asr"), F.lit("a"), F.lit("llm"), F.col("stage")))
    p = r.where(F.col("recording_id") % 2 == 0).select(
        "recording_id", F.when(F.col("recording_id") % 4 == 0, X.literals(["stage", "models"])).otherwise(X.literals(["duration"])).alias("fields"),
        F.lit("ready").alias("stage"), F.lit(0.0).alias("duration"), F.create_map(F.lit("llm"), F.lit("b"), F.lit("embed"), F.lit("c")).alias("models"))
    x = K.patch_recordings(r, p)
    return x.select("recording_id", "stage", "duration", F.array_join(F.transform(F.array_sort(F.map_entries("models")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("models"))


def pending(s, d):
    return A.pending_recordings(V.order_recordings(s, d)).select("recording_id", secs("created_at").alias("created_s"))


def outcome(s, d):
    r = V.doc_recordings(s, d)
    seg = V.doc_lines(s, d)
    sto = V.spans(seg).where(F.col("recording_id") % 3 != 0)
    return A.recording_outcome(r, seg.where(F.col("recording_id") % 6 != 0), sto)


def summaries(s, d):
    seg = V.segments(s, d)
    x = A.story_summaries(V.stories(seg), V.doc_recordings(s, d), seg)
    return x.select("story_id", "language", secs("recorded_at").alias("recorded_s"), F.md5("quote_text").alias("quote_md5"), "quote_start", "quote_end")


def facts_of(s, d):
    wanted = V.order_stories(s, d).where("annotated").select("story_id")
    return A.facts_of_stories(facts(s, d), wanted).select("story_id", "fact_id", "kind", "value", "start")


def related(s, d):
    return A.related_stories(facts(s, d), V.order_stories(s, d)).select("story_id", "other_id", "n", "rank")


def shared(s, d):
    p = A.related_stories(facts(s, d), V.order_stories(s, d))
    return A.shared_entities(p, facts(s, d), V.order_entities(s, d)).select("story_id", "other_id", "entity_id", "name")


EDGES = ", e as (select distinct archive_id, story_id, entity_id from o_facts where entity_id is not null), ann as (select story_id from o_stories where annotated)"
RELATED = EDGES + """, rel as (select a.archive_id, a.story_id, b.story_id as other_id, count(*) as n, row_number() over (partition by a.story_id order by count(*) desc, b.story_id) as rank
  from e a join e b on a.archive_id = b.archive_id and a.entity_id = b.entity_id and a.story_id <> b.story_id where b.story_id in (from ann) group by 1, 2, 3 qualify rank <= 3)"""


def focus(s, d):
    """One focus story per archive: its newest."""
    o = V.order_stories(s, d)
    return o.groupBy("archive_id").agg(F.max_by("story_id", F.struct("recorded_at", "story_id")).alias("story_id"))


FOCUS = ", focus as (select archive_id, arg_max(story_id, (recorded_at, story_id)) as story_id from o_stories group by 1), me as (select distinct archive_id, story_id, entity_id from mentions)"


def links(s, d):
    return A.story_links(focus(s, d), mentions(s, d)).select("focus_id", "story_id", "entity_id")


def years(s, d):
    return V.order_stories(s, d).select("story_id", F.year("recorded_at").alias("year"))


def nearest(s, d):
    return A.nearest_linked(V.order_stories(s, d), mentions(s, d), years(s, d)).select("focus_id", "entity_id", "story_id", "years_apart", "rank")


def only_in(s, d):
    return A.entity_only_in(facts(s, d), V.order_entities(s, d)).select("recording_id", "kind", "n")


def orphans(s, d):
    f = facts(s, d).where(F.col("start") > 30)
    return A.drop_orphan_entities(V.order_entities(s, d), f).select("archive_id", "entity_id", "name")


def known(s, d):
    c = facts(s, d).where(F.col("entity_id").isNotNull()).select("archive_id", "fact_id", "kind", F.concat(F.lit("The "), F.col("value")).alias("a"), "entity_id")
    p = V.table(s, d, "part").select(F.col("p_partkey").alias("entity_id"), F.when(F.col("p_partkey") % 3 == 0, F.upper("p_brand")).otherwise(F.lit("nobody")).alias("name"))
    return A.known_entity_flag(c.join(A.by_merge(p), "entity_id"), V.order_entities(s, d)).select("fact_id", "name", "known")


def detail(s, d):
    seg = V.segments(s, d)
    sto = V.stories(seg)
    f = sto.select("archive_id", "story_id", "recording_id", (F.col("story_id") % 20).alias("entity_id"), F.col("story_id").alias("fact_id"), (F.col("seg_start") + 1).cast("int").alias("seg"),
                   "start", F.lit("said").alias("provenance"), F.col("title").alias("evidence"))
    e = V.table(s, d, "documents").select(F.col("lang").alias("archive_id")).distinct().select(
        "archive_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("entity_id"), F.lit("person").alias("kind")).withColumn("name", F.concat(F.lit("Person "), F.col("entity_id").cast("string")))
    x = A.entity_detail(e, f, sto, seg)
    return x.select("entity_id", "story_id", "name", F.md5("sentence").alias("sentence_md5"), F.round("cue", 3).alias("cue"))


def word_overlap(s, d):
    f = facts(s, d)
    w = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("story_id"), F.col("l_linenumber").alias("pos"), (F.col("l_quantity") + F.col("l_linenumber") / 10).alias("start"))
    w = w.withColumn("end", F.col("start") + 0.4).distinct()
    return A.word_fact_overlap(w, f).select("story_id", "pos", F.round("start", 3).alias("start"), "fact_id")


def stats(s, d):
    x = A.archive_stats(V.order_stories(s, d), V.order_recordings(s, d))
    return x.select("archive_id", "stories", F.round("story_seconds", 2).alias("story_seconds"), secs("first_recorded_at").alias("first_s"), F.round("recorded_seconds", 3).alias("recorded_seconds"))


def months(s, d):
    n = V.order_recordings(s, d)
    x = A.recordings_by_month(n, V.order_stories(s, d))
    return x.select("archive_id", F.date_format("month", "yyyy-MM").alias("month"), "recordings", F.round("seconds", 3).alias("seconds"), "stories")


def timelines(s, d):
    return A.entity_timelines(mentions(s, d), years(s, d), V.order_entities(s, d)).select("archive_id", "entity_id", "name", "first_year", "last_year", "dated", "undated")


def trail(s, d):
    t = A.timeline_points(mentions(s, d), years(s, d))
    return t.groupBy("archive_id", "entity_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("stories"))


def covered(s, d):
    return A.years_covered(life(s, d), V.archives(s, d), AS_OF)


def events(s, d):
    return TL.life_events(V.order_marks(s, d))


def reach(s, d):
    return A.reach_of_story(mentions(s, d), years(s, d), events(s, d))


def fresh_questions(s, d):
    q = V.questions(s, d)
    return A.dedupe_questions(q.where("story_id % 2 = 0"), q.where("story_id % 2 = 1 and dismissed")).select("archive_id", "question_id", "text")


def asked(s, d):
    q = V.questions(s, d)
    return A.mark_asked(q, q.where("question_id % 7 = 0")).select("question_id", "dismissed")


QV = """, q as (select role as archive_id, conv_id * 100 + turn as question_id, conv_id as story_id, trim(regexp_split_to_array(text, '[.\\n]')[1]) as text,
  (conv_id * 100 + turn) % 3 = 0 as dismissed from conversations where trim(regexp_split_to_array(text, '[.\\n]')[1]) <> '')"""


def renamed(s, d):
    o = V.order_stories(s, d)
    r = o.where(F.col("story_id") % 5 < 2).select("story_id", F.when(F.col("story_id") % 5 == 0, F.concat(F.lit("  My "), F.col("title"))).otherwise("  ").alias("title"))
    return A.rename_stories(o, r).select("story_id", "title", "title_by")


def cleared(s, d):
    o = V.order_stories(s, d)
    kept, _, previous = A.clear_interpretation(o, o, o.where(F.col("recording_id") % 3 == 0).select("recording_id"))
    return kept.select("story_id", F.lit("kept").alias("part")).unionByName(previous.select("story_id", F.lit("previous").alias("part")))


def restored(s, d):
    sto = V.order_stories(s, d).withColumn("title", F.concat(F.lit("about PART "), (F.col("story_id") % 2000).cast("string"), F.lit(" and part "), (F.col("story_id") % 2000).cast("string"), F.lit("7")))
    f = facts(s, d).select("story_id", F.col("fact_id"), F.lit("person").alias("kind"), F.concat(F.lit("Part "), (F.col("story_id") % 2000).cast("string")).alias("value"))
    return A.restore_names_in_titles(sto, f).select("story_id", "title")


def gaps(s, d):
    x = life(s, d).where("from_year is not null")
    return TL.timeline_gaps(V.archives(s, d), x, AS_OF)


GAPS = sql("""
  , l as (select * from life where from_year is not null),
  span as (select archive_id, coalesce(any_value(birth_year), min(from_year) - 2, 2014) as a, 2024 as z from arch left join (select archive_id, from_year from l) using (archive_id) group by 1),
  y as (select distinct archive_id, unnest(generate_series(from_year, to_year)) as y from l),
  p as (select archive_id, y from y join span using (archive_id) where y between a and z union select archive_id, a - 1 from span union select archive_id, z + 1 from span),
  g as (select archive_id, lag(y) over (partition by archive_id order by y) + 1 as from_year, y - 1 as to_year from p)
  select * from g where to_year - from_year + 1 >= 8 qualify row_number() over (partition by archive_id order by to_year - from_year desc, from_year) <= 2
""", "life", "o_stories", "arch")


def overflow(s, d):
    o = V.order_stories(s, d).select("archive_id", "story_id", "recorded_at", (F.year("recorded_at") + F.col("story_id") % 50 * 2).alias("year"))
    return TL.overflow_clusters(o)


def resolved(s, d):
    """Part names and brands as claims: parts that share a normalized name are one entity."""
    p = V.table(s, d, "part")
    c = p.select(F.lit(0).alias("archive_id"), F.lit("person").alias("kind"), F.col("p_partkey").alias("claim_id"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
                 F.when(F.col("p_partkey") % 5 == 0, F.col("p_type")).alias("relation"), F.when(F.col("p_partkey") % 90 == 7, F.array(F.concat(F.lit("alias "), F.col("p_size").cast("string")))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    e, a, m = EN.resolve_entities(c)
    n = m.groupBy("entity_id").agg(F.count("*").alias("claims"))
    k = a.groupBy("entity_id").agg(F.count("*").alias("aliases"))
    return e.join(n, "entity_id").join(k, "entity_id", "left").fillna(0, ["aliases"]).select("name", "norm", "relation", "claims", "aliases")


RESOLVED = f"""
  with recursive c as (select p_partkey as id, case when p_partkey % 2 = 0 then upper(p_name) else p_name end as name, {norm('p_name')} as norm, case when p_partkey % 5 = 0 then p_type end as relation,
       case when p_partkey % 90 = 7 then 'alias ' || p_size end as alias from part),
  edge as (select distinct norm as a, alias as b from c where alias is not null), both_ways as (select a, b from edge union select b, a from edge),
  node as (select norm as n from c union select alias from c where alias is not null),
  reach as (select n as root, n from node union select r.root, b.b from reach r join both_ways b on b.a = r.n),
  label as (select n, min(root) as root from reach group by 1)
  select arg_min(name, (name = upper(name), id)) as name, arg_min(norm, id) as norm, arg_min(relation, id) filter (where relation is not null) as relation, count(*) as claims, count(distinct alias) as aliases
  from c join label on label.n = c.norm group by label.root
"""


def carried(s, d):
    o = V.order_stories(s, d)
    dense = V.Window.partitionBy("recording_id").orderBy("story_id")
    x = o.withColumn("ord", F.row_number().over(dense) - 1).select("archive_id", "recording_id", "ord", "story_id")
    k = F.col("story_id")
    own = k % 3 == 0
    p = x.select("archive_id", "recording_id", "ord", "story_id", F.lit(1930).alias("birth_year"), F.when(own, (F.lit(1950) + k % 40).cast("string")).alias("value"), F.when(own, F.lit(1950) + k % 40).cast("int").alias("year_from"),
                 F.when(own, F.lit(1950) + k % 40).cast("int").alias("year_to"), F.when(own, F.when(k % 2 == 0, "said").otherwise("inferred")).alias("provenance"),
                 F.when(k % 5 == 0, "youth").alias("stage"), F.when(k % 5 == 0, F.when(k % 7 == 0, "extracted").otherwise("inferred")).alias("stage_provenance"))
    return M.carry_period(p).select("story_id", "outcome", "from_value", "carried_from", "new_stage")


CARRIED = sql("""
  , o as (select recording_id, story_id as k, row_number() over (partition by recording_id order by story_id) - 1 as ord from o_stories),
  p as (select recording_id, ord, k, case when k % 3 = 0 then 1950 + k % 40 end as y, k % 3 = 0 and k % 2 = 0 as stated, k % 3 <> 0 and not (k % 5 = 0 and k % 7 = 0) as free, case when k % 5 = 0 then 'youth' end as stage from o),
  walk as (select *, lag(y) over w as y1, coalesce(lag(stated) over w, false) as s1, coalesce(lag(free) over w, false) as f1, lag(y, 2) over w as y2, coalesce(lag(stated, 2) over w, false) as s2 from p window w as (partition by recording_id order by ord))
  select k as story_id, case when y is null and ((y1 is not null and not s1) or (s2 and f1)) then 'refused' when s1 and free then 'carried' end as outcome,
         case when y is null and s2 and f1 then y2::varchar when y is null and y1 is not null and not s1 then y1::varchar when s1 and free then y1::varchar end as from_value,
         case when s1 and free then y1 end as carried_from,
         case when s1 and free then case when y1 - 1930 <= 12 then 'childhood' when y1 - 1930 <= 25 then 'youth' when y1 - 1930 <= 59 then 'adulthood' else 'later_life' end else stage end as new_stage
  from walk
""", "o_stories")


def offsets(s, d):
    """As-of: quantities at odd part numbers are anchors, at part numbers divisible by six offsets, by ten other relatives."""
    li = V.table(s, d, "lineitem").join(V.table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("y")), "l_orderkey")
    base = li.select(F.col("l_suppkey").alias("story_id"), (F.col("l_orderkey") * 7 % 100000 + F.col("l_quantity") / 100).alias("start"), F.col("l_partkey").alias("p"), (F.col("l_quantity") % 40 + 1).cast("int").alias("value"), "y")
    off = base.where("p % 6 = 0").groupBy("story_id", "start").agg(F.min("value").alias("value"))
    anc = base.where("p % 2 = 1 and p % 5 = 0").select("story_id", F.col("start").alias("time"), F.col("y").alias("year"), F.concat(F.lit("in "), F.col("y").cast("string")).alias("evidence"), F.struct(F.col("y").alias("o"), F.col("p").alias("i")).alias("ord"))
    rel = base.where("p % 10 = 0").select("story_id", F.col("start").alias("time"))
    return M.resolve_offsets(off, anc, rel.unionByName(off.select("story_id", F.col("start").alias("time"))), AS_OF).select("story_id", "start", "value", "year_from", F.col("reason").isNull().alias("kept"))


OFFSETS = """
  with base as (select l_suppkey as story_id, l_orderkey * 7 % 100000 + l_quantity / 100 as t, l_partkey as p, (l_quantity % 40 + 1)::int as value, year(o_orderdate) as y from lineitem join orders on o_orderkey = l_orderkey),
  off as (select story_id, t, min(value) as value from base where p % 6 = 0 group by 1, 2), anc as (select story_id, t, arg_min(y, (y, p)) as y from base where p % 2 = 1 and p % 5 = 0 group by 1, 2),
  rel as (select distinct story_id, t from base where p % 10 = 0 union select story_id, t from off),
  line as (select story_id, t, max(y) as y, max(ya) as ya, max(r) as r from (select story_id, t, y, t as ya, null as r from anc union all select story_id, t, null, null, t from rel union all select story_id, t, null, null, null from off) group by 1, 2),
  seen as (select *, last_value(y ignore nulls) over w as by_, last_value(ya ignore nulls) over w as at_, max(r) over w as rt from line window w as (partition by story_id order by t rows between unbounded preceding and 1 preceding))
  select story_id, t as "start", off.value, case when ok then by_ + off.value end as year_from, ok as kept from off join (select *, by_ is not null and not coalesce(rt > at_, false) as ok0 from seen) using (story_id, t),
  lateral (select ok0 and by_ + off.value <= 2024 as ok)
"""


def quality(s, d):
    return A.evidence_quality(facts(s, d)).select("kind", "provenance", "facts", "primary_facts", "level")


def page(s, d):
    seg = V.segments(s, d)
    sto = V.stories(seg)
    f = facts(s, d).withColumn("detail", F.lit(None).cast("string")).withColumn("note", F.lit(None).cast("string"))
    p = TL.story_page(sto.select("story_id"), sto, seg, f.withColumn("story_id", F.col("story_id") * 100000), V.questions(s, d).withColumn("story_id", F.col("story_id") * 100000))
    shown = F.coalesce(*(F.get_json_object("body", f"$.{x}") for x in ("text", "title", "value")))
    return p.select("story_id", "section", "ord", F.md5(shown).alias("shown_md5"))


def whole_life(s, d):
    """Life rows over documents' stories, with order facts hung on them."""
    seg = V.segments(s, d)
    sto = V.stories(seg)
    docs = sto.select("archive_id", "story_id", "recording_id", "start", "seg_start")
    k = F.col("story_id")
    f = docs.select("archive_id", "story_id", "recording_id", k.alias("fact_id"), F.when(k % 3 == 0, "time").when(k % 3 == 1, "life_stage").otherwise("person").alias("kind"),
                    F.when(k % 3 == 2, k % 20).alias("entity_id"), F.when(k % 3 == 1, "youth").otherwise(F.lit("1970")).alias("value"), F.when(k % 3 == 0, F.lit(1970)).cast("int").alias("year_from"),
                    F.when(k % 3 == 0, F.lit(1972)).cast("int").alias("year_to"), F.lit("said").alias("provenance"), F.lit(True).alias("is_primary"), "start")
    m = docs.where(k % 4 == 0).select("archive_id", "story_id", F.lit("mention").alias("kind"), F.lit("kept").alias("status"), (k % 7).alias("entity_id"), "start", F.lit("e").alias("evidence"),
                                      F.lit(None).cast("int").alias("value"), F.lit(None).cast("int").alias("year_from"), F.lit(False).alias("anchored"), F.lit(None).cast("string").alias("note"))
    a = V.spoken_archives(s, d)
    e = a.select("archive_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))).alias("entity_id"), F.lit("person").alias("kind"), F.lit(None).cast("string").alias("relation")).withColumn("name", F.col("entity_id").cast("string"))
    q = docs.where(k % 6 == 0).select("story_id", k.alias("question_id"), F.lit("why").alias("text"), (k % 12 == 0).alias("dismissed"))
    x = TL.life_stories(a, sto, V.doc_recordings(s, d), seg, f, m, e, q)
    return x.select("story_id", "title", "language", "label", "provenance", "life_stage", "certainty", "year", "age", "people", "mentions", "open_questions", F.round("duration", 3).alias("duration"))


WHOLE_LIFE = sql("""
  select story_id, title, s.archive_id as language, case story_id % 3 when 0 then '1970' when 1 then 'youth' end as label,
         case story_id % 3 when 0 then 'said' when 1 then case when s.archive_id <> 'de' then 'inferred' else 'said' end end as provenance, case when story_id % 3 = 1 then 'youth' end as life_stage,
         case when story_id % 3 = 0 then 'range' when story_id % 3 = 1 and s.archive_id <> 'de' then 'stage' else 'none' end as certainty,
         case when story_id % 3 = 0 then 1971 when story_id % 3 = 1 and s.archive_id <> 'de' then 1954 end as year,
         case when s.archive_id <> 'de' then case story_id % 3 when 0 then 36 when 1 then 19 end end as age,
         (story_id % 3 = 2)::int + (story_id % 4 = 0)::int - (story_id % 3 = 2 and story_id % 4 = 0 and story_id % 20 = story_id % 7)::int as people,
         (story_id % 3 = 2)::int + (story_id % 4 = 0)::int as mentions, (story_id % 6 = 0 and story_id % 12 <> 0)::int as open_questions, round("end" - "start", 3) as duration
  from stories s where annotated
""", "stories")


QUERIES = {
    "upsert_archives": Query(upsert, """
        with b as (select s_suppkey % 113 as archive_id, s_name as subject, 1900 as birth_year, 'pt' as language, s_suppkey * 10 as written_at, 0 as gen from supplier
        union all select c_custkey % 97, left(trim(c_name), 80), case when 1840 + c_custkey % 200 > 1850 and 1840 + c_custkey % 200 <= 2024 then 1840 + c_custkey % 200 end, case when c_custkey % 3 = 0 then 'en' else 'auto' end, c_custkey, 1 from customer)
        select archive_id, subject, birth_year, language, written_at from b qualify row_number() over (partition by archive_id order by written_at desc, gen desc) = 1"""),
    "remove_recordings": Query(removed, sql(SIZES.format(keep="recording_id % 10 >= 9"), "o_recs", "o_stories", "o_facts", "o_marks", "o_entities")),
    "snapshot_export": Query(snapshot, sql(SIZES.format(keep="recording_id % 4 = 1 and stage = 'ready'"), "o_recs", "o_stories", "o_facts", "o_marks", "o_entities")),
    "patch_recordings": Query(patched, sql("""
        select recording_id, case when recording_id % 4 = 0 then 'ready' else stage end as stage, case when recording_id % 4 = 2 then 0.0 else duration end as duration,
        case when recording_id % 4 = 0 then 'asr=a,embed=c,llm=b' else 'asr=a,llm=' || stage end as models from o_recs""", "o_recs")),
    "pending_recordings": Query(pending, sql("select recording_id, created_s from o_recs where stage <> 'ready' and failed_stage is null", "o_recs")),
    "recording_outcome": Query(outcome, sql("""
        , n as (select recording_id, count(*) as lines from doc_lines where recording_id % 6 <> 0 group by 1), s as (select recording_id, count(*) as k from spans where recording_id % 3 <> 0 group by 1)
        select recording_id, case when failed_stage is not null then 'failed' when stage <> 'ready' then 'working' when coalesce(k, 0) > 0 then 'stories' when coalesce(lines, 0) > 0 then 'no-stories' else 'no-speech' end as outcome,
        coalesce(lines, 0) > 0 as has_transcript, coalesce(k, 0) as n_stories from recs left join n using (recording_id) left join s using (recording_id)""", "recs", "spans", "doc_lines")),
    "story_summaries": Query(summaries, sql("""
        select story_id, r.language, recorded_s, md5(g.text) as quote_md5, g."start" as quote_start, g."end" as quote_end from stories s join recs r using (recording_id)
        left join seg g on g.recording_id = s.recording_id and g.idx = quote_seg""", "stories", "recs", "seg")),
    "facts_of_stories": Query(facts_of, sql('select story_id, fact_id, kind, value, "start" from o_facts where story_id in (select story_id from o_stories where annotated)', "o_facts", "o_stories")),
    "related_stories": Query(related, sql(RELATED + " select story_id, other_id, n, rank from rel", "o_facts", "o_stories")),
    "shared_entities": Query(shared, sql(RELATED + """
        select r.story_id, r.other_id, a.entity_id, n.name from rel r join e a on a.story_id = r.story_id join e b on b.story_id = r.other_id and b.entity_id = a.entity_id
        join o_entities n on n.archive_id = r.archive_id and n.entity_id = a.entity_id""", "o_facts", "o_stories", "o_entities")),
    "story_links": Query(links, sql(FOCUS + " select f.story_id as focus_id, b.story_id, a.entity_id from focus f join me a using (archive_id, story_id) join me b on b.archive_id = a.archive_id and b.entity_id = a.entity_id and b.story_id <> a.story_id", "mentions", "o_stories")),
    "nearest_linked": Query(nearest, sql(FOCUS + """
        select f.story_id as focus_id, a.entity_id, b.story_id, abs(year(o.recorded_at) - year(o1.recorded_at)) as years_apart, row_number() over (partition by f.story_id, a.entity_id order by abs(year(o.recorded_at) - year(o1.recorded_at)), b.story_id) as rank
        from o_stories f join me a using (archive_id, story_id) join me b on b.archive_id = a.archive_id and b.entity_id = a.entity_id and b.story_id <> a.story_id
        join o_stories o on o.story_id = b.story_id join o_stories o1 on o1.story_id = f.story_id qualify rank <= 3""", "mentions", "o_stories")),
    "entity_only_in": Query(only_in, sql("""
        select recording_id, kind, count(*) as n from (select archive_id, entity_id, any_value(kind) as kind, min(recording_id) as recording_id from o_facts where entity_id is not null group by 1, 2 having count(distinct recording_id) = 1) group by 1, 2""", "o_facts")),
    "drop_orphan_entities": Query(orphans, sql('select archive_id, entity_id, name from o_entities e where exists (select 1 from o_facts f where f.archive_id = e.archive_id and f.entity_id = e.entity_id and "start" > 30)', "o_facts", "o_entities")),
    "known_entity_flag": Query(known, sql(f"""
        select fact_id, c.name, exists (select 1 from o_entities e where e.archive_id = f.archive_id and e.kind = f.kind and ({norm('e.name')} = {norm('c.name')} or {norm('e.alias')} = {norm('c.name')})) as known
        from o_facts f join (select p_partkey as entity_id, case when p_partkey % 3 = 0 then upper(p_brand) else 'nobody' end as name from part) c using (entity_id)""", "o_facts", "o_entities")),
    "entity_detail": Query(detail, sql("""
        select story_id % 20 as entity_id, story_id, 'Person ' || story_id % 20 as name, md5(g.text) as sentence_md5, round(greatest(0, s."start" - 1.2), 3) as cue
        from stories s left join seg g on g.recording_id = s.recording_id and g.idx = seg_start + 1 where annotated""", "stories", "seg")),
    "word_fact_overlap": Query(word_overlap, sql("""
        , w as (select distinct l_orderkey as story_id, l_linenumber as pos, l_quantity + l_linenumber / 10.0::double as s from lineitem)
        select story_id, pos, round(s, 3) as "start", fact_id from w join o_facts f using (story_id) where kind <> 'life_stage' and (s + s + 0.4) / 2 between f."start" - 0.02 and f."end" + 0.02""", "o_facts")),
    "archive_stats": Query(stats, sql("""
        select archive_id, stories, round(story_seconds, 2) as story_seconds, first_s, round(recorded_seconds, 3) as recorded_seconds from
        (select archive_id, min(recorded_s) as first_s, sum(duration) as recorded_seconds from o_recs group by 1) left join (select archive_id, count(*) as stories, sum("end" - "start") as story_seconds from o_stories where annotated group by 1) using (archive_id)""", "o_recs", "o_stories")),
    "entity_counts": Query(lambda s, d: A.entity_counts(V.order_entities(s, d), facts(s, d), V.order_stories(s, d)), sql("""
        select archive_id, entity_id, e.kind, name, stories, moments from o_entities e join (select archive_id, entity_id, count(distinct story_id) as stories, count(*) as moments from o_facts
        where entity_id is not null and story_id in (select story_id from o_stories where annotated) group by 1, 2) using (archive_id, entity_id)""", "o_entities", "o_facts", "o_stories")),
    "known_entities": Query(lambda s, d: A.known_entities(V.order_entities(s, d), facts(s, d)), sql("""
        select archive_id, entity_id, kind, name, uses, row_number() over (partition by archive_id, kind order by uses desc, entity_id) as rank from
        (select archive_id, entity_id, kind, count(*) as uses from o_facts where entity_id is not null group by 1, 2, 3) join (select archive_id, entity_id, name from o_entities) using (archive_id, entity_id) qualify rank <= 60""", "o_entities", "o_facts")),
    "recognizer_hints": Query(lambda s, d: A.recognizer_hints(V.order_entities(s, d), facts(s, d)), sql("""
        select archive_id, string_agg(name, ', ' order by uses desc, name) || '.' as hint from (select archive_id, name, max(uses) as uses from (select archive_id, entity_id, count(*) as uses from o_facts where entity_id is not null group by 1, 2)
        join (select archive_id, entity_id, name from o_entities) using (archive_id, entity_id) group by 1, 2 qualify row_number() over (partition by archive_id order by max(uses) desc, name) <= 40) group by 1""", "o_entities", "o_facts")),
    "theme_counts": Query(lambda s, d: A.theme_counts(V.order_stories(s, d)), sql("select archive_id, theme, count(*) as n from (select archive_id, unnest([theme1, theme2]) as theme from o_stories where annotated) group by 1, 2", "o_stories")),
    "stories_per_recording": Query(lambda s, d: A.counts_per_recording(V.order_stories(s, d)), sql("select recording_id, count(*) as n from o_stories group by 1", "o_stories")),
    "segments_per_recording": Query(lambda s, d: A.counts_per_recording(V.doc_lines(s, d)), sql("select recording_id, count(*) as n from doc_lines group by 1", "doc_lines")),
    "recordings_by_month": Query(months, sql("""
        , r as (select archive_id, strftime(to_timestamp(recorded_s) at time zone 'UTC', '%Y-%m') as month, duration, coalesce(k, 0) as k from o_recs left join (select recording_id, count(*) as k from o_stories group by 1) using (recording_id))
        select archive_id, month, count(*) as recordings, round(sum(duration), 3) as seconds, sum(k) as stories from r group by grouping sets ((archive_id, month), (archive_id))""", "o_recs", "o_stories")),
    "stories_by_decade": Query(lambda s, d: A.stories_by_decade(life(s, d)), sql("""
        select archive_id, (floor(sort_year / 10) * 10)::int as decade, case when grouping(certainty) = 1 then 'all' else certainty end as certainty, count(*) as stories from life group by grouping sets ((archive_id, decade, certainty), (archive_id, decade))""", "life")),
    "entity_timelines": Query(timelines, sql("""
        select archive_id, entity_id, name, min(y) as first_year, max(y) as last_year, count(y) as dated, 0 as undated from (select distinct m.archive_id, m.story_id, m.entity_id, year(recorded_at) as y from mentions m join o_stories using (story_id))
        join (select archive_id, entity_id, name from o_entities) using (archive_id, entity_id) group by 1, 2, 3""", "mentions", "o_stories", "o_entities")),
    "entity_trail": Query(trail, sql("""
        select archive_id, entity_id, min(y) as first_year, max(y) as last_year, count(*) as stories from (select distinct m.archive_id, m.story_id, m.entity_id, year(recorded_at) as y from mentions m join o_stories using (story_id)) group by 1, 2""", "mentions", "o_stories")),
    "years_covered": Query(covered, sql("select archive_id, any_value(2024 - a.birth_year) as years_lived, count(distinct year) as years_with_story from arch a left join (select archive_id, year from life) using (archive_id) group by 1", "life", "arch")),
    "evidence_quality": Query(quality, sql("select kind, provenance, count(*) as facts, count(*) filter (where is_primary) as primary_facts, grouping(kind) * 2 + grouping(provenance) as level from o_facts group by cube (kind, provenance)", "o_facts")),
    "marks_quality": Query(lambda s, d: A.marks_quality(V.order_marks(s, d)), sql("select kind, count(*) filter (where status = 'kept') as kept, count(*) filter (where status = 'refused') as refused from o_marks group by 1", "o_marks")),
    "first_mention_per_entity": Query(lambda s, d: A.first_mention_per_entity(mentions(s, d)), sql("select archive_id, story_id, entity_id, min(time) as first_time from mentions group by 1, 2, 3", "mentions")),
    "reach_of_story": Query(reach, sql("""
        , me as (select distinct archive_id, story_id, entity_id from mentions), t as (select archive_id, entity_id, min(year(recorded_at)) as lo, max(year(recorded_at)) as hi from me join (select story_id, recorded_at from o_stories) using (story_id) group by 1, 2)
        select story_id, min(lo) as from_year, max(hi) as to_year from (select story_id, lo, hi from me join t using (archive_id, entity_id) union all select story_id, year(recorded_at), year(recorded_at) from o_stories
        union all select story_id, year_from, year_from from o_marks where status = 'kept' and kind in ('age', 'offset')) group by 1""", "mentions", "o_stories", "o_marks")),
    "dedupe_questions": Query(fresh_questions, f"""
        with {QV[2:]} select archive_id, min(question_id) as question_id, arg_min(text, question_id) as text from q where story_id % 2 = 0 and {norm('text')} <> ''
        and (archive_id, {norm('text')}) not in (select archive_id, {norm('text')} from q where story_id % 2 = 1 and dismissed) group by archive_id, {norm('text')}"""),
    "top_open_questions": Query(lambda s, d: A.top_open_questions(V.questions(s, d)).select("archive_id", "question_id", "rank"), f"""
        with {QV[2:]} select archive_id, question_id, row_number() over (partition by archive_id order by question_id desc) as rank from q where not dismissed qualify rank <= 6"""),
    "mark_asked": Query(asked, f"with {QV[2:]} select question_id, dismissed or (archive_id, text) in (select archive_id, text from q where question_id % 7 = 0) as dismissed from q"),
    "latest_ready_recording": Query(lambda s, d: A.latest_ready_recording(V.order_recordings(s, d)), sql("select archive_id, arg_max(recording_id, (recorded_s, recording_id)) as recording_id from o_recs where stage = 'ready' group by 1", "o_recs")),
    "rename_stories": Query(renamed, sql("select story_id, case when story_id % 5 = 0 then 'My ' || title else title end as title, case when story_id % 5 = 0 then 'family' else 'archive' end as title_by from o_stories", "o_stories")),
    "clear_interpretation": Query(cleared, sql("select story_id, case when recording_id % 3 = 0 then 'previous' else 'kept' end as part from o_stories", "o_stories")),
    "restore_names_in_titles": Query(restored, sql("""
        select story_id, case when story_id in (select story_id from o_facts) then 'about Part ' || story_id % 2000 || ' and Part ' || story_id % 2000 || '7' else 'about PART ' || story_id % 2000 || ' and part ' || story_id % 2000 || '7' end as title
        from o_stories""", "o_stories", "o_facts")),
    "best_date": Query(lambda s, d: dates(s, d).select("story_id", "label", "year_from", "year_to", "provenance", "life_stage"), sql("select story_id, label, year_from, year_to, provenance, life_stage from best", "best")),
    "sort_year": Query(lambda s, d: TL.sort_year(dates(s, d)).select("story_id", "sort_year"), sql("select story_id, sort_year from life", "life")),
    "date_certainty": Query(lambda s, d: life(s, d).select("story_id", "certainty", "year", "from_year", "to_year", "age"), sql("select story_id, certainty, year, from_year, to_year, case when year >= birth_year then year - birth_year end as age from life", "life")),
    "when_display": Query(lambda s, d: TL.when_display(life(s, d)).select("story_id", "when_label", "age_label", "certainty_word"), sql("""
        select story_id, case when certainty = 'none' then 'undated' when certainty in ('exact', 'range') then label when certainty = 'stage' then '[' || label || ']' else '[c. ' || year || ']' end as when_label,
        case when year >= birth_year and certainty not in ('none', 'stage') then case when certainty in ('exact', 'range') then 'aged ' else 'about ' end || (year - birth_year) end as age_label,
        case when certainty = 'none' then 'none' else provenance end as certainty_word from life""", "life")),
    "life_stage_of_age": Query(lambda s, d: V.table(s, d, "part").select("p_partkey", X.stage_of_age(F.col("p_size")).alias("stage")), "select p_partkey, case when p_size <= 12 then 'childhood' when p_size <= 25 then 'youth' when p_size <= 59 then 'adulthood' else 'later_life' end as stage from part"),
    "stage_year_span": Query(lambda s, d: TL.stage_year_span(V.table(s, d, "part").select("p_partkey", (F.lit(1900) + F.col("p_size")).alias("birth_year"), F.element_at(X.literals(list(L.STAGE_AGES)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("life_stage")), axis=True).select("p_partkey", "stage_from", "stage_to"),
        "select p_partkey, 1900 + p_size + [0, 13, 26, 60][(p_partkey % 4 + 1)::int] as stage_from, 1900 + p_size + [12, 25, 59, 110][(p_partkey % 4 + 1)::int] as stage_to from part"),
    "year_labels": Query(lambda s, d: V.table(s, d, "part").select("p_partkey", X.year_label((F.lit(1900) + F.col("p_size") % 30).cast("int"), (F.lit(1900) + F.col("p_size") % 30 + F.when(F.col("p_partkey") % 2 == 0, 9).otherwise(F.col("p_partkey") % 5)).cast("int"), F.lit("x")).alias("label")),
        "select p_partkey, case when b = a then a::varchar when a % 10 = 0 and b = a + 9 then a || 's' else a || '–' || b end as label from (select p_partkey, 1900 + p_size % 30 as a, 1900 + p_size % 30 + case when p_partkey % 2 = 0 then 9 else p_partkey % 5 end as b from part)"),
    "theme_filter": Query(lambda s, d: TL.theme_filter(life(s, d), "music").select("story_id", "sort_year"), sql("select story_id, sort_year from life where story_id in (select story_id from o_stories where theme1 = 'music' or theme2 = 'music')", "life", "o_stories")),
    "period_filter": Query(lambda s, d: TL.period_filter(life(s, d), 1960, 1979).select("story_id", "year"), sql("select story_id, year from life where year between 1960 and 1979", "life")),
    "life_order": Query(lambda s, d: TL.life_order(life(s, d)).select("archive_id", "story_id", "year"), sql("select archive_id, story_id, year from life", "life")),
    "life_span": Query(lambda s, d: TL.life_span(V.archives(s, d), life(s, d), AS_OF), sql("select archive_id, coalesce(any_value(a.birth_year), min(from_year) - 2, 2014) as life_start, 2024 as life_end from arch a left join (select archive_id, from_year from life) using (archive_id) group by 1", "life", "arch")),
    "timeline_gaps": Query(gaps, GAPS),
    "part_of": Query(lambda s, d: TL.part_of(V.order_stories(s, d)), sql("select recording_id, story_id, row_number() over (partition by recording_id order by story_id) as part, count(*) over (partition by recording_id) as parts from o_stories", "o_stories")),
    "overflow_clusters": Query(overflow, sql("""
        , y as (select archive_id, story_id, year(recorded_at) + story_id % 50 * 2 as y, row_number() over (partition by archive_id, year(recorded_at) + story_id % 50 * 2 order by recorded_at, story_id) as rn from o_stories),
        x as (select * from y where rn > 6), yy as (select distinct archive_id, y from x), c as (select *, sum(opens) over (partition by archive_id order by y) as c from (select *, case when y - lag(y) over (partition by archive_id order by y) <= 1 then 0 else 1 end as opens from yy))
        select archive_id, min(y) over (partition by archive_id, c) as from_year, max(y) over (partition by archive_id, c) as to_year, story_id from x join c using (archive_id, y)""", "o_stories")),
    "mentions_union": Query(lambda s, d: mentions(s, d), sql("select archive_id, story_id, entity_id, kind, time from mentions", "mentions")),
    "life_events": Query(lambda s, d: events(s, d).select("story_id", "kind", "time", "evidence", "value", "year", "anchored"), sql("""select story_id, kind, "start" as time, evidence, value, year_from as year, anchored from o_marks where status = 'kept' and kind <> 'mention'""", "o_marks")),
    "life_entities": Query(lambda s, d: TL.entities_by_reach(TL.life_entities(mentions(s, d), V.order_entities(s, d))), sql("""
        select archive_id, entity_id, e.kind, name, case when e.kind = 'person' then relation end as relation, stories from (select archive_id, entity_id, count(distinct story_id) as stories from mentions group by 1, 2) join o_entities e using (archive_id, entity_id)""", "mentions", "o_entities")),
    "life_stories": Query(whole_life, WHOLE_LIFE),
    "live_stories": Query(lambda s, d: TL.live_stories(V.order_stories(s, d), facts(s, d), V.archives(s, d)).select("story_id", "annotated", "label", "found", "name", "fact_id"), sql("""
        select s.story_id, annotated, label, f.kind as found, f.value as name, fact_id from o_stories s left join (select story_id, label from best) b using (story_id)
        left join (select * from o_facts where is_primary and kind in ('person', 'place')) f using (story_id)""", "o_stories", "best", "o_facts")),
    "story_page": Query(page, sql("""
        select story_id, 'story' as section, 0 as ord, md5(title) as shown_md5 from stories union all select story_id, 'transcript', idx, md5(text) from seg g join stories s on s.recording_id = g.recording_id and g.idx between seg_start and seg_end
        union all select story_id * 100000, 'fact', fact_id, md5(value) from o_facts where story_id * 100000 in (select story_id from stories)
        union all select conv_id * 100000, 'question', conv_id * 100 + turn, md5(trim(regexp_split_to_array(text, '[.\\n]')[1])) from conversations where trim(regexp_split_to_array(text, '[.\\n]')[1]) <> '' and (conv_id * 100 + turn) % 3 <> 0 and conv_id * 100000 in (select story_id from stories)""", "stories", "seg", "o_facts")),
    "resolve_entities": Query(resolved, RESOLVED),
    "carry_period": Query(carried, CARRIED),
    "resolve_offsets": Query(offsets, OFFSETS),
}
