"""Queries on what is said: numbers, ages, names, claims and marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.timescan import time_expressions
from ..operators import archive as A
from ..operators import extract as E
from ..operators import marks as M
from ..operators import phrases as P
from ..operators import verify as VE
from . import views as V
from .oracle import in_list, norm, quoted, sql, tokens, words
from .registry import Query

AS_OF = V.AS_OF


def _spoken(s, d):
    seg = V.spoken(s, d)
    return seg, V.stories(seg)


def numbers(s, d):
    n = E.number_mentions(V.spoken_lines(s, d), ["recording_id", "idx"])
    return n.select("recording_id", "idx", F.col("at").alias("pos"), "value", "next")


NUMS = {**L.UNITS, **L.TENS}
ONES = [w for w, v in L.UNITS.items() if v < 10]


def _case(col: str, values: dict[str, int]) -> str:
    return "case " + col + " " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"


NUMBERS = sql(f"""
  , t as (select recording_id, idx, unnest(ts) as t, generate_subscripts(ts, 1) - 1 as pos, ts from (select recording_id, idx, {tokens('text')} as ts from spoken_raw)),
  w as (select recording_id, idx, pos, t, ts[pos] as p1, case when pos >= 2 then ts[pos - 1] end as p2, ts[pos + 2] as n1, ts[pos + 3] as n2, ts[pos + 4] as n3 from t),
  v as (select *, {_case('t', L.TENS)} as ten, {_case('t', L.UNITS)} as unit, t in {in_list(ONES)} as one, p1 in {in_list(L.TENS)} or (p1 in {in_list(L.NUMBER_CONNECTORS)} and p2 in {in_list(L.TENS)}) as after_ten,
        n1 in {in_list(L.NUMBER_CONNECTORS)} and n2 in {in_list(ONES)} as joined, n1 in {in_list(ONES)} as direct, {_case('n1', {w: L.UNITS[w] for w in ONES})} as u1, {_case('n2', {w: L.UNITS[w] for w in ONES})} as u2 from w)
  select recording_id, idx, pos, value, next from (
    select recording_id, idx, pos, case when regexp_full_match(t, '[0-9]{{1,4}}') then t::int when ten is not null then ten + case when joined then u2 when direct then u1 else 0 end
      when unit is not null and not (one and coalesce(after_ten, false)) then unit end as value, case when ten is not null and joined then n3 when ten is not null and direct then n2 else n1 end as next from v)
  where value is not null
""", "spoken_raw")


def expressions(s, d):
    x = time_expressions(V.spoken_lines(s, d), ["recording_id", "idx"])
    return x.select("recording_id", "idx", "kind", "value", "stage", "phrase", "first_person")


EXPRESSIONS = sql(r"""
  , m as (select recording_id, idx, text, (recording_id + idx) % 9 as t from spoken_raw)
  select recording_id, idx, case t when 0 then 'age' when 1 then 'offset' when 2 then 'duration' when 5 then 'age' when 6 then 'stage' end as kind,
    case when t in (0, 1, 2, 5) then regexp_extract(text, '(?:I was|And|there for|tinha) ([0-9]+) (?:years|anos)[^0-9]*$', 1)::int end as value, case when t = 6 then 'childhood' end as stage,
    case t when 0 then 'I was ' || regexp_extract(text, 'I was ([0-9]+) years old when', 1) || ' years old' when 1 then regexp_extract(text, 'And ([0-9]+ years later) we met', 1)
      when 2 then regexp_extract(text, 'there (for [0-9]+ years) with', 1) when 5 then regexp_extract(text, '(tinha [0-9]+ anos)\.$', 1) else 'eu era crianca' end as phrase, t in (0, 6) as first_person
  from m where t in (0, 1, 2, 5, 6)
""", "spoken_raw")


def supported(s, d):
    y = F.lit(1940) + (F.col("recording_id") * 5 + F.col("idx") * 11) % 70 + F.col("idx") % 2
    x = V.spoken_lines(s, d).withColumn("year", F.when(y >= 2000, y - 40).otherwise(y).cast("int"))
    ts = X.tokens("text")
    return x.select("recording_id", "idx", E.year_supported(ts, F.col("year")).alias("supported"), E.year_is_approximate(ts, F.col("year")).alias("approximate"))


SUPPORTED = sql("""
  , m as (select recording_id, idx, (recording_id + idx) % 9 as t, 1940 + (recording_id * 5 + idx * 11) % 70 as said, 1940 + (recording_id * 5 + idx * 11) % 70 + idx % 2 as y0, case when y0 >= 2000 then y0 - 40 else y0 end as y,
          5 + (recording_id * 3 + idx * 7) % 90 as age from spoken_raw)
  select recording_id, idx, t in (3, 4, 7) and said = y as supported, t = 7 and said = y as approximate from m
""", "spoken_raw")


def kin(s, d):
    return E.owned_kinship(V.spoken_lines(s, d), ["recording_id", "idx"]).select("recording_id", "idx", "pos", "token")


KIN = sql(f"""
  , t as (select recording_id, idx, unnest(ts) as token, generate_subscripts(ts, 1) - 1 as pos, ts from (select recording_id, idx, {tokens('text')} as ts from spoken_raw))
  select recording_id, idx, pos, token from t where token in {in_list(sorted(set(L.KINSHIP)))} and (ts[pos] in {in_list(L.FIRST_PERSON)} and pos >= 1 or (pos >= 2 and ts[pos] in {in_list(L.POSSESSIVE_BRIDGE)} and ts[pos - 1] in {in_list(L.FIRST_PERSON)}))
""", "spoken_raw")


def shapes(s, d):
    n = V.table(s, d, "part").select("p_partkey", F.concat(F.element_at(X.literals(["the ", "School of ", "", "my ", "Banco "]), (F.col("p_partkey") % 5 + 1).cast("int")), F.initcap("p_name"), F.lit(",")).alias("name"))
    x = E.name_shapes(n)
    return x.select("p_partkey", "institution", "bare_kinship", "has_proper_word", F.array_join("proper_words", " ").alias("proper"), "alias")


SHAPES = rf"""
  with n as (select p_partkey, p_partkey % 5 as k, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]) as ws, p_name from part)
  select p_partkey, k in (1, 4) as institution, false as bare_kinship, true as has_proper_word, case k when 1 then 'school ' when 4 then 'banco ' else '' end || p_name as proper,
    case k when 0 then array_to_string(ws, ' ') when 1 then 'School of ' || array_to_string(ws, ' ') when 4 then 'Banco ' || array_to_string(ws, ' ') when 2 then array_to_string(ws, ' ') end as alias from n
"""


def exact(s, d):
    seg = V.segments(s, d)
    r = V.line_claims(seg, V.spans(seg)).where(F.col("phrase") != "")
    x = P.locate(r.select("recording_id", "seg_from", "seg_to", "request_id", "phrase"), P.streams(seg))
    return x.select("request_id", "idx", "start", "end", "evidence")


CLAIMS = f"""
  , claims as (select s.recording_id, story_id, seg_start, seg_end, seg_start + 3 as claimed, array_to_string({words('text')}[2:4], ' ') as phrase
               from spans s join seg g on g.recording_id = s.recording_id and g.idx = seg_start + story_id % 3),
  located as (select story_id, claimed, g.idx, g."start", g."end", {words('g.text')} as ws, {norm('phrase')} as needle, {norm('g.text')} as hay
              from claims c join seg g on g.recording_id = c.recording_id and g.idx between seg_start and seg_end where {norm('phrase')} <> '' and contains(' ' || {norm('g.text')} || ' ', ' ' || {norm('phrase')} || ' ')),
  spot as (select *, len(string_split(trim((' ' || hay || ' ')[1:strpos(' ' || hay || ' ', ' ' || needle || ' ')]), ' ')) as before_raw, strpos(' ' || hay || ' ', ' ' || needle || ' ') as sp, len(string_split(needle, ' ')) as l from located),
  flat as (select story_id, idx, claimed, "start", "end", ws, l, case when sp = 1 then 0 else before_raw end as k,
                  flatten(list_transform(ws, lambda w, i: list_transform({tokens('w')}, lambda t: i))) as owner from spot),
  hits as (select story_id, claimed, idx, "start", "end", regexp_replace(array_to_string(ws[owner[k + 1]:owner[k + l]], ' '), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g') as evidence from flat)
"""


def nearest(s, d):
    seg = V.segments(s, d)
    r = V.line_claims(seg, V.spans(seg)).where(F.col("phrase") != "")
    h = P.locate(r.select("recording_id", "seg_from", "seg_to", "request_id", "phrase"), P.streams(seg))
    return P.nearest_evidence(h, r, ["story_id"]).select("story_id", "seg", "start", "end", "evidence")


def tolerant(s, d):
    """The same phrases with the last letter of each longer word changed."""
    seg = V.segments(s, d)
    r = V.line_claims(seg, V.spans(seg)).where(F.col("phrase") != "").withColumn("phrase", F.regexp_replace("phrase", r"(\p{L}{6,})\p{L}\b", "$1"))
    return P.locate(r.select("recording_id", "seg_from", "seg_to", "request_id", "phrase"), P.streams(seg), tolerant=True).select("request_id", "idx", "start", "end", "evidence")


def written(s, d):
    seg = V.spoken_lines(s, d)
    r = seg.select("recording_id").distinct().select("recording_id", F.lit(0).alias("seg_from"), F.lit(1 << 30).alias("seg_to"), F.explode(X.literals(V.NAMES + ["sister", "we met"])).alias("phrase"))
    r = r.withColumn("request_id", F.concat_ws("|", "recording_id", "phrase"))
    x = seg.withColumn("start", F.lit(0.0)).withColumn("end", F.lit(1.0))
    return P.written_as_name(r, x)


WRITTEN = sql(f"""
  , r as (select distinct recording_id, unnest({quoted(V.NAMES)}) as phrase from spoken_raw)
  select recording_id || '|' || phrase as request_id from r where exists (select 1 from spoken_raw x where x.recording_id = r.recording_id and regexp_matches(x.text, ' ' || r.phrase || '\\b') and not regexp_matches(x.text, '[.!?…]["”»)]? ' || r.phrase || '\\b'))
""", "spoken_raw")


def _claims(s, d):
    seg, sto = _spoken(s, d)
    return V.spoken_claims(seg, sto), seg, sto, V.spoken_archives(s, d), V.spoken_entities(s, d)


def people(s, d):
    c, seg, _, a, e = _claims(s, d)
    f, r = VE.verify_people(c, seg, a, e)
    return _verdicts(f, r)


def places(s, d):
    c, seg, _, a, e = _claims(s, d)
    f, r = VE.verify_places(c, seg, a, e)
    return _verdicts(f, r)


def _verdicts(f, r):
    none = F.lit(None).cast("string")
    good = f.select("story_id", "claim_no", "value", F.lit("kept").alias("verdict"), "provenance", "is_primary", "seg", none.alias("reason"))
    return good.unionByName(r.select("story_id", "claim_no", "value", F.lit("refused").alias("verdict"), none.alias("provenance"), F.lit(None).cast("boolean").alias("is_primary"), F.lit(None).cast("int").alias("seg"), "reason"))


def known_people(s, d):
    """Evidence of the people that claims give a known name, out of all claims; such names are all written as names."""
    c, seg, _, a, e = _claims(s, d)
    f, _ = VE.verify_people(c, seg, a, e)
    return f.where(F.col("value").isin(V.NAMES)).select("story_id", "value", "provenance", "is_primary", "seg", "start", "end", "evidence")


PEOPLE = sql(f"""
  , c as (select story_id, recording_id, seg_start, seg_end, seg_start + story_id % 5 as claimed, i as claim_no, {quoted(V.NAMES)}[((story_id + i * 5) % 12 + 1)::int] as value from sp_spans, range(3) t(i)),
  h as (select c.*, g.idx, g.start_ds, g.text, {words('text')} as ws, list_position({words('text')}, regexp_extract(text, string_split(value, ' ')[1] || '[^ ]*', 0)) as k from c join spoken g on g.recording_id = c.recording_id and g.idx between seg_start and seg_end
        where regexp_matches(g.text, '\\b' || value || '\\b')),
  m as (select *, row_number() over (partition by story_id, value, claim_no order by abs(idx - claimed), idx) as rn from h)
  select story_id, value, 'said' as provenance, rn = 1 as is_primary, idx as seg, (start_ds + 4 * (k - 1)) / 10.0::double as "start", (start_ds + 4 * (k - 1 + len(string_split(value, ' ')))) / 10.0::double as "end", value as evidence from m
""", "sp_spans", "spoken")


def times(s, d):
    c, seg, _, a, _ = _claims(s, d)
    f, r = VE.verify_times(c, seg, a, AS_OF)
    none = F.lit(None).cast("string")
    good = f.select("story_id", "claim_no", "value", "year_from", "year_to", "provenance", "seg")
    return good.unionByName(r.select("story_id", "claim_no", "value", F.lit(None).cast("int").alias("year_from"), F.lit(None).cast("int").alias("year_to"), none.alias("provenance"), F.lit(None).cast("int").alias("seg")))


def year_from_age(s, d):
    seg, sto = _spoken(s, d)
    dated = sto.where("story_id % 4 = 0").select("story_id", F.lit(1970).alias("year_from"))
    x = VE.infer_year_from_age(sto, dated, seg, V.spoken_archives(s, d), AS_OF)
    return x.select("story_id", "year_from", "seg", "evidence", "note")


YEAR_FROM_AGE = sql("""
  , a as (select story_id, arg_min(idx, idx) as seg, arg_min(5 + (g.recording_id * 3 + idx * 7) % 90, idx) as age from sp_spans s join spoken_raw g on g.recording_id = s.recording_id and idx between seg_start and seg_end
          where (g.recording_id + idx) % 9 = 0 and s.archive_id <> 'de' and story_id % 4 <> 0 group by 1)
  select story_id, 1935 + age as year_from, seg, 'I was ' || age || ' years old' as evidence, 'age_and_birth: I was ' || age || ' years old / 1935' as note from a where 1935 + age <= 2024
""", "sp_spans", "spoken_raw")


def stages(s, d):
    seg, _ = _spoken(s, d)
    return E.stated_stages(seg).select("recording_id", "idx", "stage", "phrase", "note")


STAGES = sql("""
  , m as (select recording_id, idx, (recording_id + idx) % 9 as t, 5 + (recording_id * 3 + idx * 7) % 90 as age from spoken_raw)
  select recording_id, idx, case when t = 6 or age <= 12 then 'childhood' when age <= 25 then 'youth' when age <= 59 then 'adulthood' else 'later_life' end as stage,
    case when t = 6 then 'eu era crianca' else 'I was ' || age || ' years old' end as phrase, case when t = 0 then 'Said as an age, ' || age || '.' end as note from m where t in (0, 6)
""", "spoken_raw")


def life_stages(s, d):
    c, seg, sto, a, _ = _claims(s, d)
    f, r = VE.verify_life_stage(sto, c, sto.where("story_id % 4 = 0").select("story_id", F.lit(0).alias("claim_no"), F.lit(1970).alias("year_from"), F.lit("said").alias("provenance")), seg, a)
    none = F.lit(None).cast("string")
    return f.select("story_id", "value", "provenance", "seg").unionByName(r.select("story_id", "value", none.alias("provenance"), F.lit(None).cast("int").alias("seg")))


LIFE_STAGES = sql("""
  , g as (select story_id, s.archive_id, ['childhood', 'youth', 'adulthood', 'later_life'][(story_id % 4 + 1)::int] as proposed, idx, (x.recording_id + idx) % 9 as t, 5 + (x.recording_id * 3 + idx * 7) % 90 as age, seg_start + story_id % 5 as claimed
           from sp_spans s join spoken_raw x on x.recording_id = s.recording_id and idx between seg_start and seg_end),
  st as (select *, case when t = 6 or age <= 12 then 'childhood' when age <= 25 then 'youth' when age <= 59 then 'adulthood' else 'later_life' end as stage from g where t in (0, 6)),
  said as (select story_id, arg_min(stage, (stage <> proposed, idx)) as stage, arg_min(idx, (stage <> proposed, idx)) as seg from st group by 1),
  shown as (select story_id, arg_min(idx, (abs(idx - claimed), idx)) as seg from g where t = 1 group by 1),
  b as (select distinct g.story_id, archive_id, proposed, said.stage, said.seg, shown.seg as shown_seg from g left join said using (story_id) left join shown using (story_id))
  select story_id, case when stage is not null then stage when story_id % 4 = 0 and archive_id <> 'de' then 'adulthood' else proposed end as value,
    case when stage is not null then 'extracted' when story_id % 4 = 0 and archive_id <> 'de' or shown_seg is not null then 'inferred' end as provenance,
    case when stage is not null then seg when story_id % 4 = 0 and archive_id <> 'de' then null else shown_seg end as seg from b
  union all select story_id, proposed, null, null from b where stage <> proposed
""", "sp_spans", "spoken_raw")


def _spoken_facts(s, d):
    """Every third story has one noted fact about a name, at the start of its second line."""
    seg, sto = _spoken(s, d)
    at = seg.select("recording_id", F.col("idx").alias("seg_end"), F.col("start").alias("t"))
    f = sto.join(at, ["recording_id", "seg_end"]).where("story_id % 3 = 0")
    k = F.col("story_id")
    f = f.select("archive_id", "recording_id", "story_id", k.alias("fact_id"), F.lit("person").alias("kind"), (k % 12).alias("entity_id"), F.col("t").alias("start"),
                 F.lit("said").alias("provenance"), F.lit(None).cast("int").alias("year_from"), F.lit(None).cast("int").alias("year_to"), F.lit(None).cast("string").alias("evidence"))
    every = V.spoken_entities(s, d).select("archive_id", F.lit(-1).cast("bigint").alias("recording_id"), F.lit(-1).cast("bigint").alias("story_id"), F.lit(-1).cast("bigint").alias("fact_id"), "kind", "entity_id",
                                          F.lit(None).cast("double").alias("start"), F.lit("said").alias("provenance"), F.lit(None).cast("int").alias("year_from"), F.lit(None).cast("int").alias("year_to"), F.lit(None).cast("string").alias("evidence"))
    return seg, sto, f.unionByName(every)


def mentions(s, d):
    seg, sto, f = _spoken_facts(s, d)
    m = M.mention_scan(sto, seg, f, V.spoken_entities(s, d))
    return m.select("story_id", "entity_id", "status", "seg", "start", "end", "evidence")


MENTIONS = sql(f"""
  , en as (select generate_subscripts(n, 1) - 1 + base as entity_id, unnest(n) as name from (select {quoted(V.NAMES)} as n, 0 as base union all select {quoted(V.PLACES)}, 100)),
  p as (select story_id, idx, start_ds, ws, unnest(range(1, len(ws) + 1)) as k from (select s.story_id, g.idx, g.start_ds, {words('text')} as ws from sp_spans s join spoken g on g.recording_id = s.recording_id and g.idx between seg_start and seg_end)),
  w as (select *, regexp_replace(ws[k], '[.,]$', '') as c1, ws[k] || ' ' || regexp_replace(ws[k + 1], '[.,]$', '') as c2 from p),
  q as (select story_id, entity_id, idx as seg, (start_ds + 4 * (k - 1)) / 10.0::double as "start", (start_ds + 4 * k) / 10.0::double as "end", ws[k] as evidence from w join en on name = c1
        union all select story_id, entity_id, idx, (start_ds + 4 * (k - 1)) / 10.0::double, (start_ds + 4 * (k + 1)) / 10.0::double, ws[k] || ' ' || ws[k + 1] from w join en on name = c2),
  noted as (select s.story_id, s.story_id % 12 as entity_id, g."start" as t from sp_spans s join spoken g on g.recording_id = s.recording_id and g.idx = s.seg_end where s.story_id % 3 = 0)
  select story_id, entity_id, 'kept' as status, seg, "start", "end", evidence from q where not exists (select 1 from noted n where n.story_id = q.story_id and n.entity_id = q.entity_id and abs(n.t - q."start") < 1.5)
""", "sp_spans", "spoken")


def age_marks(s, d):
    seg, sto = _spoken(s, d)
    x = M.age_and_duration_marks(M.located_expressions(sto, seg), V.spoken_archives(s, d), AS_OF)
    return x.select("story_id", "kind", "status", "value", "year_from", "seg", "evidence")


AGES = """
  , m as (select story_id, s.archive_id, idx, (g.recording_id + idx) % 9 as t, 5 + (g.recording_id * 3 + idx * 7) % 90 as age, 2 + (g.recording_id + idx) % 11 as y
          from sp_spans s join spoken_raw g on g.recording_id = s.recording_id and g.idx between seg_start and seg_end)
"""
AGE_MARKS = sql(AGES + """
  select story_id, case t when 2 then 'duration' else 'age' end as kind, case when t = 5 or (t = 0 and archive_id <> 'de' and 1935 + age > 2024) then 'refused' else 'kept' end as status,
    case t when 2 then y else age end as value, case when t = 0 and archive_id <> 'de' and 1935 + age <= 2024 then 1935 + age end as year_from, idx as seg,
    case t when 0 then 'I was ' || age || ' years old' when 2 then 'for ' || y || ' years' else 'tinha ' || age || ' anos' end as evidence from m where t in (0, 2, 5)
""", "sp_spans", "spoken_raw")


def refusals(s, d):
    """Refused ages by kind and reason."""
    seg, sto = _spoken(s, d)
    x = M.age_and_duration_marks(M.located_expressions(sto, seg), V.spoken_archives(s, d), AS_OF)
    return A.rejection_quality(x.where("status = 'refused'"))


REFUSALS = sql(AGES + """
  select 'age' as kind, case when t = 5 then 'age_of_another' else 'age_in_future' end as reason, count(*) as n
  from m where t = 5 or (t = 0 and archive_id <> 'de' and 1935 + age > 2024) group by 1, 2
""", "sp_spans", "spoken_raw")


def time_marks(s, d):
    seg, sto, f = _spoken_facts(s, d)
    x = M.time_marks(sto, seg, f, V.spoken_archives(s, d), AS_OF)
    return x.where("kind = 'offset'").select("story_id", "status", "value", "year_from", "seg", "reason")


TIME_MARKS = sql("""
  , m as (select story_id, s.archive_id, idx, (g.recording_id + idx) % 9 as t, 5 + (g.recording_id * 3 + idx * 7) % 90 as age, 2 + (g.recording_id + idx) % 11 as y from sp_spans s join spoken_raw g on g.recording_id = s.recording_id and g.idx between seg_start and seg_end),
  a as (select story_id, idx, 1935 + age as year from m where t = 0 and archive_id <> 'de' and 1935 + age <= 2024), r as (select story_id, idx from m where t in (1, 2)),
  o as (select story_id, m.idx, y, (select arg_max(year, a.idx) from a where a.story_id = m.story_id and a.idx < m.idx) as base, (select max(a.idx) from a where a.story_id = m.story_id and a.idx < m.idx) as at_, (select max(r.idx) from r where r.story_id = m.story_id and r.idx < m.idx) as rel from m where t = 1),
  v as (select *, case when base is null then 'no_year_before' when rel > at_ then 'after_relative'
        when base + y > 2024 then 'in_future' end as reason from o)
  select story_id, case when reason is null then 'kept' else 'refused' end as status, y as value, case when reason is null then base + y end as year_from, idx as seg, reason from v
""", "sp_spans", "spoken_raw")


def rederived(s, d):
    seg, sto, f = _spoken_facts(s, d)
    x = M.rederive(sto, seg, f, V.spoken_entities(s, d), V.spoken_archives(s, d), AS_OF)
    return x.select("archive_id", "story_id", "kind", "status", "seg")


REDERIVED = sql(f"""
  , age as (select s.archive_id, s.story_id, idx as seg, case when (g.recording_id + idx) % 9 = 2 then 'duration' else 'age' end as kind,
     case when (g.recording_id + idx) % 9 = 5 or ((g.recording_id + idx) % 9 = 0 and s.archive_id <> 'de' and 1935 + 5 + (g.recording_id * 3 + idx * 7) % 90 > 2024) then 'refused' else 'kept' end as status
     from sp_spans s join spoken_raw g on g.recording_id = s.recording_id and g.idx between seg_start and seg_end where (g.recording_id + idx) % 9 in (0, 2, 5)),
  men as ({MENTIONS[MENTIONS.index('  select story_id, entity_id, ' + chr(39) + 'kept'):]}),
  off as ({TIME_MARKS[TIME_MARKS.index('  select story_id, case when reason is null'):]})
  select archive_id, story_id, kind, status, seg from age union all select archive_id, story_id, 'mention', status, seg from men join sp_spans using (story_id)
  union all select archive_id, story_id, 'offset', status, seg from off join sp_spans using (story_id)
""", "sp_spans", "spoken", "spoken_raw")
REDERIVED = REDERIVED.replace(", age as (", MENTIONS[MENTIONS.index(", en as ("):MENTIONS.index("  select story_id, entity_id, 'kept'")] + TIME_MARKS[TIME_MARKS.index(", m as ("):TIME_MARKS.index("  select story_id, case when reason is null")] + ", age as (", 1)

QUERIES = {
    "number_mentions": Query(numbers, NUMBERS),
    "time_expressions": Query(expressions, EXPRESSIONS),
    "year_support": Query(supported, SUPPORTED),
    "owned_kinship": Query(kin, KIN),
    "name_shapes": Query(shapes, SHAPES),
    "locate_exact": Query(exact, sql(CLAIMS + 'select story_id as request_id, idx, "start", "end", evidence from hits', "spans", "seg")),
    "nearest_evidence": Query(nearest, sql(CLAIMS + 'select story_id, idx as seg, "start", "end", evidence from hits qualify row_number() over (partition by story_id order by abs(idx - claimed), idx) = 1', "spans", "seg")),
    "locate_tolerant": Query(tolerant, None),
    "written_as_name": Query(written, WRITTEN),
    "verify_people": Query(people, None),
    "verify_known_people": Query(known_people, PEOPLE),
    "verify_places": Query(places, None),
    "verify_times": Query(times, None),
    "infer_year_from_age": Query(year_from_age, YEAR_FROM_AGE),
    "stated_stages": Query(stages, STAGES),
    "verify_life_stage": Query(life_stages, LIFE_STAGES),
    "mention_scan": Query(mentions, MENTIONS),
    "age_and_duration_marks": Query(age_marks, AGE_MARKS),
    "rejection_quality": Query(refusals, REFUSALS),
    "offset_marks": Query(time_marks, TIME_MARKS),
    "rederive_marks": Query(rederived, REDERIVED),
}
