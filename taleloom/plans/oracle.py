"""The views of `views.py` as SQL, to check results with another engine on the same files."""

from __future__ import annotations

from ..functions import lexicon as L
from .views import NAMES, PLACES


def norm(x: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({x})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '[\s\pZ]+'), lambda w: w <> '')"


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _timed(source: str) -> str:
    return f"""
      select archive_id, recording_id, idx, text, n_words, end_ds - 4 * n_words as start_ds,
             (end_ds - 4 * n_words) / 10.0::double as "start", end_ds / 10.0::double as "end"
      from (select *, sum((recording_id * 7 + idx * 13) % 23 + 4 * n_words) over (partition by recording_id order by idx) as end_ds
            from (select *, len({words('text')}) as n_words from {source}))"""


CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "doc_lines": ((), r"""
      select lang as archive_id, doc_id as recording_id, unnest(ls) as text, (generate_subscripts(ls, 1) - 1)::int as idx
      from (select lang, doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')) as ls from documents)"""),
    "seg": (("doc_lines",), _timed("doc_lines")),
    "conv_raw": ((), "select role as archive_id, conv_id as recording_id, turn::int as idx, text from conversations"),
    "conv": (("conv_raw",), _timed("conv_raw")),
    "conv_words": (("conv",), f"""
      select recording_id, idx, (recording_id + idx) % 5 = 4 as whole, k, n_words,
             case when (recording_id + idx) % 5 = 4 then text else w end as text,
             case when (recording_id + idx) % 5 = 4 then "start" else (start_ds + 4 * k) / 10.0::double end as "start",
             case when (recording_id + idx) % 5 = 4 then "end" else (start_ds + 4 * k + 4) / 10.0::double end as "end",
             case when (recording_id + idx) % 5 = 4 then 0.5 else ((idx * 31 + k * 17) % 64) / 64.0::double end as p,
             k = n_words - 1 or (recording_id + idx) % 5 = 4 as closes_segment
      from (select *, unnest(ws) as w, generate_subscripts(ws, 1) - 1 as k from (select *, {words('text')} as ws from conv))
      where (recording_id + idx) % 5 <> 4 or k = 0"""),
    "spoken_raw": (("doc_lines",), f"""
      select archive_id, recording_id, idx, text || ' ' || case (r + i) % 9
        when 0 then 'I was ' || (5 + (r * 3 + i * 7) % 90) || ' years old when we moved to ' || place || '.'
        when 1 then 'And ' || (2 + (r + i) % 11) || ' years later we met ' || name || ' again.'
        when 2 then 'We stayed there for ' || (2 + (r + i) % 11) || ' years with ' || name || '.'
        when 3 then 'In ' || (1940 + (r * 5 + i * 11) % 70) || ' we lived in ' || place || '.'
        when 4 then 'That was my sister and ' || name || ' in ' || (1940 + (r * 5 + i * 11) % 70) || '.'
        when 5 then 'Ela tinha ' || (5 + (r * 3 + i * 7) % 90) || ' anos.'
        when 6 then 'Eu era criança quando vi minha tia.'
        when 7 then 'It was around ' || (1940 + (r * 5 + i * 11) % 70) || ' or so.'
        else 'The aunt of ' || name || ' was there.' end as text
      from (select *, recording_id as r, idx as i, {quoted(NAMES)}[((recording_id * 3 + idx) % 12 + 1)::int] as name,
                   {quoted(PLACES)}[((recording_id + idx * 3) % 10 + 1)::int] as place from doc_lines)"""),
    "spoken": (("spoken_raw",), _timed("spoken_raw")),
    "ext": (("seg",), "select archive_id, recording_id, max(idx) + 1 as n from seg group by all"),
    "spans": (("ext",), """
      select archive_id, recording_id, recording_id * 100000 + ord as story_id, ord, ord * 7 as seg_start, least(ord * 7 + 4, n - 1) as seg_end
      from (select *, unnest(generate_series(0, ((n - 1) // 7)::bigint))::int as ord from ext)"""),
    "stories": (("spans", "seg"), f"""
      select s.*, a."start", b."end", 'Story ' || story_id as title, case when story_id % 13 = 0 then 'family' else 'archive' end as title_by,
             seg_start as quote_seg, story_id % 11 <> 0 as annotated,
             {quoted(L.THEMES)}[(story_id % 16 + 1)::int] as theme1, {quoted(L.THEMES)}[(story_id // 3 % 16 + 1)::int] as theme2
      from spans s join seg a on a.recording_id = s.recording_id and a.idx = s.seg_start
                   join seg b on b.recording_id = s.recording_id and b.idx = s.seg_end"""),
    "sp_ext": (("spoken",), "select archive_id, recording_id, max(idx) + 1 as n from spoken group by all"),
    "sp_spans": (("sp_ext",), """
      select archive_id, recording_id, recording_id * 100000 + ord as story_id, ord, ord * 7 as seg_start, least(ord * 7 + 4, n - 1) as seg_end
      from (select *, unnest(generate_series(0, ((n - 1) // 7)::bigint))::int as ord from sp_ext)"""),
    "drafts": (("ext",), """
      select recording_id, k as draft_no, 5 * k - k % 2 as first_segment, 5 * k + 2 + k % 3 as last_segment,
             case when k % 4 = 3 then '' else '"Draft  ' || k || '."' end as title, 5 * k + 1 as quote_segment
      from (select *, unnest(generate_series(0, ((n - 1) // 5)::bigint)) as k from ext)"""),
    "uncovered": (("spans", "ext"), """
      select recording_id, seg_from, seg_to from (
        select recording_id, coalesce(lag(seg_end) over w, -1) + 1 as seg_from, seg_start - 1 as seg_to from spans window w as (partition by recording_id order by seg_start)
        union all
        select e.recording_id, coalesce(max(seg_end), -1) + 1, any_value(n) - 1 from ext e left join spans s using (recording_id) group by e.recording_id)
      where seg_from <= seg_to"""),
    "recs": ((), """
      select lang as archive_id, doc_id as recording_id, lang as language, 1577836800 + (doc_id * 37 % 1500) * 86400 as recorded_s,
             1577836800 + doc_id * 3600 as created_s, n_chars / 10.0::double as duration, case when doc_id % 10 = 9 then 'organizing' else 'ready' end as stage,
             case when doc_id % 17 = 3 then 'organizing' end as failed_stage, 'rec-' || doc_id as original_name from documents"""),
    # order tables
    "arch": ((), """select r_regionkey::bigint as archive_id, r_name as subject, case when r_regionkey <> 4 then 1930 + r_regionkey * 7 end as birth_year from region"""),
    "o_stories": ((), f"""
      select o_custkey % 5 as archive_id, o_custkey as recording_id, o_orderkey as story_id, o_orderkey as ord, 'Order ' || o_orderkey as title, 0.0::double as "start",
             o_totalprice / 1000.0::double as "end", o_orderstatus <> 'P' as annotated, o_orderdate as recorded_at,
             {quoted(L.THEMES)}[(o_orderkey % 16 + 1)::int] as theme1,
             {quoted(L.THEMES)}[((o_orderkey + length(o_orderpriority)) % 16 + 1)::int] as theme2 from orders"""),
    "o_facts": ((), f"""
      select archive_id, story_id, recording_id, fact_id, kind, case when kind in ('person', 'place') then p end as entity_id,
             case when kind = 'time' then y::varchar when kind = 'life_stage' then {quoted(L.STAGE_AGES)}[(p % 4 + 1)::int] else 'part ' || p end as value,
             case when kind = 'time' then y end as year_from, case when kind = 'time' then y + sk % 3 end as year_to,
             {quoted(L.PROVENANCE_RANK)}[(sk % 3 + 1)::int] as provenance, is_primary, "start", "start" + 1 as "end", 'said ' || p as evidence, n
      from (select o_custkey % 5 as archive_id, l_orderkey as story_id, o_custkey as recording_id, l_linenumber as n, l_partkey as p, l_suppkey as sk,
                   (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 as fact_id, l_quantity as "start", l_returnflag <> 'R' as is_primary,
                   case when l_linenumber in (2, 5) then 'time' when l_linenumber = 7 then 'life_stage' when l_partkey % 2 = 0 then 'place' else 'person' end as kind,
                   year(o_orderdate) - case when l_linenumber = 5 then l_suppkey % 40 else 0 end as y
            from lineitem join orders on o_orderkey = l_orderkey)"""),
    "o_entities": ((), """
      select a as archive_id, p_partkey as entity_id, case when p_partkey % 2 = 0 then 'place' else 'person' end as kind, p_name || ' ' || p_partkey as name,
             p_type as relation, p_brand as alias from part, range(5) t(a)"""),
    "o_recs": ((), """
      select c_custkey % 5 as archive_id, c_custkey as recording_id, 1577836800 + (c_custkey * 37 % 1500) * 86400 as recorded_s, 1577836800 + c_custkey * 3600 as created_s,
             abs(c_acctbal) as duration, case when c_custkey % 7 = 3 then 'indexing' else 'ready' end as stage, case when c_custkey % 19 = 4 then 'organizing' end as failed_stage,
             c_name as original_name from customer"""),
    "o_marks": (("o_facts",), """
      select archive_id, story_id, kind, status, case when kind = 'mention' then entity_id end as entity_id, "start", evidence, value,
             case when kind in ('age', 'offset') then y end as year_from, kind in ('age', 'offset') as anchored
      from (select *exclude (kind, "start", value), case when n in (1, 3) then 'mention' when n = 4 then 'age' when n = 6 then 'offset' when n = 2 then 'duration' end as kind,
                   case when fact_id % 3 = 0 then 'refused' else 'kept' end as status, "start" + 0.5 as "start", fact_id % 40 + 1 as value, 1950 + fact_id % 60 as y
            from o_facts where not is_primary) where kind is not null"""),
    "mentions": (("o_facts", "o_marks", "o_entities"), """
      select archive_id, story_id, entity_id, kind, "start" as time from o_facts where entity_id is not null
      union all
      select m.archive_id, m.story_id, m.entity_id, e.kind, m."start" from o_marks m join o_entities e on e.archive_id = m.archive_id and e.entity_id = m.entity_id
      where m.kind = 'mention' and m.status = 'kept'"""),
    "best": (("o_facts", "arch"), """
      select archive_id, story_id, birth_year, life_stage,
             case when d is not null then d.value else life_stage end as label,
             case when d is not null then d.year_from when birth_year is not null and life_stage = 'childhood' then birth_year
                  when birth_year is not null and life_stage = 'youth' then birth_year + 13 end as year_from,
             case when d is not null then d.year_to when birth_year is not null and life_stage = 'childhood' then birth_year + 12
                  when birth_year is not null and life_stage = 'youth' then birth_year + 25 end as year_to,
             case when d is not null then d.provenance when birth_year is not null and life_stage in ('childhood', 'youth') then 'inferred' else stage_provenance end as provenance
      from (select f.archive_id, story_id, any_value(birth_year) as birth_year,
                   arg_min(case when kind = 'time' then {value: f.value, year_from: year_from, year_to: year_to, provenance: f.provenance} end,
                           case when kind = 'time' then (case f.provenance when 'said' then 0 when 'extracted' then 1 else 2 end, year_to - year_from, year_from, "start", fact_id) end) as d,
                   arg_min(case when kind = 'life_stage' then f.value end, case when kind = 'life_stage' then ("start", fact_id) end) as life_stage,
                   arg_min(case when kind = 'life_stage' then f.provenance end, case when kind = 'life_stage' then ("start", fact_id) end) as stage_provenance
            from o_facts f join arch using (archive_id) where is_primary and kind in ('time', 'life_stage') group by all)"""),
    "life": (("best",), """
      select *, case when year_from is null then 'none' when life_stage is not null and provenance = 'inferred' and year_to - year_from > 3 then 'stage'
                     when year_to > year_from then case when provenance = 'inferred' then 'approximate' else 'range' end
                     when provenance = 'inferred' then 'approximate' else 'exact' end as certainty,
             case when year_to = year_from then year_from else floor((year_from + year_to) / 2.0 + 0.5)::int end as year,
             year_from - case when year_to = year_from and provenance = 'inferred' then 2 else 0 end as from_year,
             year_to + case when year_to = year_from and provenance = 'inferred' then 2 else 0 end as to_year,
             case when life_stage is not null and provenance = 'inferred' and year_to - year_from > 3 then year_from + (year_to - year_from) / 2.0 else year_from end::double as sort_year
      from best"""),
    # events
    "envelope": ((), """
      select recording_id, frame, floor(coalesce(v, 0.0) / top * 255 + 0.5)::int as peak from
        (select recording_id, top, unnest(range((select max(epoch_us(ts) // 28800000000) - min(epoch_us(ts) // 28800000000) + 1 from events))) as frame from (select recording_id, max(v) as top from
           (select user_id as recording_id, max(value) as v from events group by 1) group by 1))
        left join (select user_id as recording_id, epoch_us(ts) // 28800000000 - (select min(epoch_us(ts) // 28800000000) from events) as frame, max(value) as v from events group by 1, 2) using (recording_id, frame)"""),
    "e_stories": ((), """
      select user_id as recording_id, user_id * 10 + part as story_id, (user_id % 7) / 10.0::double + part * 2 as "start", (user_id % 7) / 10.0::double + part * 2 + 1.9::double as "end"
      from (select distinct user_id from events), range(2) t(part)"""),
    "e_seg": ((), """
      select user_id as recording_id, idx, idx / 4.0::double as "start", idx / 4.0::double + (25 - (user_id + idx) % 3 * 5) / 100.0::double as "end"
      from (select distinct user_id from events), range(18) t(idx)"""),
    "levels": (("envelope",), "select *, 20 * log10(greatest(pow(peak / 255.0::double, 2), 1e-4)) as level from envelope"),
    "silent": (("levels",), """
      select recording_id, frame, level < lo + (hi - lo) * 0.3 as silent from levels join
        (select recording_id, quantile_cont(level, 0.1) as lo, quantile_cont(level, 0.9) as hi, count(*) as n from levels group by 1) using (recording_id)
      where n >= 40 and hi - lo >= 6"""),
    "bridged": (("silent",), """
      select recording_id, frame, silent or (n <= 2 and not first and not last) as silent from
        (select *, count(*) over (partition by recording_id, grp) as n, min(frame) over (partition by recording_id, grp) = min(frame) over (partition by recording_id) as first,
                max(frame) over (partition by recording_id, grp) = max(frame) over (partition by recording_id) as last
         from (select *, sum(edge) over (partition by recording_id order by frame) as grp from
           (select *, case when silent is distinct from lag(silent) over (partition by recording_id order by frame) then 1 else 0 end as edge from silent)))"""),
    "pauses": (("bridged",), """
      select recording_id, (prev + 1) / 20.0::double as "start", frame / 20.0::double as "end", (frame - prev - 1) / 20.0::double as duration
      from (select *, lag(frame) over (partition by recording_id order by frame) as prev from bridged where not silent) where frame - prev - 1 >= 5"""),
    "bpauses": (("pauses", "e_seg"), """
      select recording_id, after, max(duration) as duration from (
        select p.recording_id, p."start", p.duration, arg_min(b.after, (greatest(0, b.f - p."end", p."start" - b.t), abs((b.f + b.t) / 2 - (p."start" + p."end") / 2), b.after)) as after
        from pauses p join (select recording_id, idx as after, least("end", nx) as f, greatest("end", nx) as t from
             (select *, lead("start") over (partition by recording_id order by idx) as nx from e_seg) where nx is not null) b
          on b.recording_id = p.recording_id and greatest(0, b.f - p."end", p."start" - b.t) <= 0.75
        group by 1, 2, 3) group by 1, 2"""),
}


def sql(body: str, *ctes: str) -> str:
    """A query over named views, with the views it needs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for d in CTE[name][0]:
            visit(d)
        if name not in order:
            order.append(name)

    for c in ctes:
        visit(c)
    head = ",\n".join(f"{n} as ({CTE[n][1]})" for n in order)
    return f"with {head}\n{body}" if head else body
