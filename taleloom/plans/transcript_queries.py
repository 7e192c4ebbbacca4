"""Queries on transcripts: text shaping, sentences, stories, chunks, paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..operators import archive as A
from ..operators import timeline as TL
from ..operators import transcript as T
from . import views as V
from .oracle import norm, quoted, sql, tokens, words
from .registry import Query


def _seg(s, d):
    return V.segments(s, d)


def _seg_sto(s, d):
    seg = V.segments(s, d)
    return seg, V.stories(seg)


def normalize_text(s, d):
    return V.table(s, d, "documents").select("doc_id", F.md5(X.normalize("text")).alias("norm_md5"))


def tokenize(s, d):
    t = V.table(s, d, "conversations").select("conv_id", "turn", F.explode(X.tokens("text")).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_conv"))


def token_stats(s, d):
    return V.doc_lines(s, d).select("recording_id", "idx", X.estimated_tokens("text").alias("est_tokens"), X.word_count("text").alias("n_words"))


def clean_titles(s, d):
    seg = _seg(s, d)
    t = seg.select("recording_id", "idx", F.concat(F.lit(' "'), F.col("text"), F.lit('." ')).alias("title"), "text")
    blank = F.when(F.col("idx") % 3 == 0, "").otherwise(F.col("title"))
    cleaned = F.coalesce(F.nullif(X.clean_title(blank), F.lit("")), X.fallback_title(F.col("text")))
    return t.select("recording_id", "idx", cleaned.alias("title"))


def display_names(s, d):
    c = V.table(s, d, "customer").select("c_custkey", F.explode(F.array("c_mktsegment", F.lower("c_mktsegment"))).alias("raw"))
    return c.select("c_custkey", "raw", X.display_name(F.col("raw")).alias("shown"))


def hallucinations(s, d):
    x = V.doc_lines(s, d)
    odd = F.when(F.col("idx") % 4 == 1, F.concat(F.lit("Thank you for watching "), F.substring("text", 1, 8))).when(
        F.col("idx") % 4 == 2, F.lit("♪ [Música] ♪")).otherwise(F.col("text"))
    x = x.withColumn("text", odd)
    return x.where(~X.is_hallucination(F.col("text"))).select("recording_id", "idx", "text")


def sentences(s, d):
    x = T.sentences_from_words(V.conversation_segments(s, d))
    return x.select("recording_id", "idx", "start", "end", "text", "confidence", F.size(F.coalesce("words", F.array())).alias("n_timed"))


SENTENCES = sql(rf"""
  select recording_id, row_number() over (partition by recording_id order by wp) - 1 as idx, "start", "end", text, confidence, n_timed from (
    select recording_id, min(wp) as wp, arg_min("start", wp) as "start", arg_max("end", wp) as "end", string_agg(text, ' ' order by wp) as text,
           case when bool_or(whole) then avg(p) else round(avg(p), 3) end as confidence, case when bool_or(whole) then 0 else count(*) end as n_timed
    from (select *, (row_number() over (partition by recording_id, run order by wp) - 1) // 45 as part from (
      select *, sum(case when opens then 1 else 0 end) over (partition by recording_id order by wp) as run from (
        select *, coalesce(lag(wp) over w is null or whole or lag(whole) over w or lag(closes) over w or "start" - lag("end") over w > 1.2, true) as opens from (
          select *, regexp_matches(text, '[.!?…]["”»)]?$') and (closes_segment or regexp_matches(lead(text) over w, '^[\p{{Lu}}¿¡"“]') or lead("start") over w - "end" > 0.6) as closes
          from (select *, row_number() over (partition by recording_id order by idx, k) as wp from conv_words)
          window w as (partition by recording_id order by wp))
        window w as (partition by recording_id order by wp))))
    group by recording_id, run, part)
  where {norm('text')} <> '' and not list_bool_or(list_transform({quoted(L.HALLUCINATIONS)}, lambda h: {norm('text')} = h or (contains({norm('text')}, h) and length({norm('text')}) < length(h) + 12)))
""", "conv_words")


def uncertain_words(s, d):
    c = V.conversation_segments(s, d)
    w = c.select("recording_id", "idx", F.posexplode("words").alias("pos", "w")).select("recording_id", "idx", "pos", "w.*")
    return T.uncertain_words(w).select("recording_id", "idx", "pos", "p")


def planned_stories(s, d):
    seg = _seg(s, d)
    return T.plan_stories(V.drafts(seg), seg)


PLANNED = sql(rf"""
  , clamped as (select recording_id, draft_no, title, quote_segment, least(greatest(least(first_segment, n - 1), 0), greatest(least(last_segment, n - 1), 0)) as a,
                       greatest(greatest(least(first_segment, n - 1), 0), greatest(least(last_segment, n - 1), 0)) as b from drafts join ext using (recording_id)),
  trimmed as (select *exclude a, case when a <= prev then prev + 1 else a end as a from (
                select *, max(b) over (partition by recording_id order by a, -b, draft_no rows between unbounded preceding and 1 preceding) as prev from clamped)),
  kept as (select recording_id, title, quote_segment, a, b, row_number() over w - 1 as ord, lag(b) over w as prev_b, lead(a) over w as next_a from trimmed where a <= b
           window w as (partition by recording_id order by a)),
  closed as (select recording_id, ord from kept k join seg s1 using (recording_id) join seg s2 using (recording_id)
             where k.prev_b is not null and s1.idx = k.prev_b + 1 and s2.idx = k.a - 1 and k.a - k.prev_b between 2 and 4 and s2."end" - s1."start" <= 25),
  bounds as (select k.recording_id, k.ord, k.title, k.quote_segment, k.a as seg_start, case when c.ord is not null then k.next_a - 1 else k.b end as seg_end,
                    k.prev_b is null and k.next_a is null as alone
             from kept k left join closed c on c.recording_id = k.recording_id and c.ord = k.ord + 1),
  sized as (select b.*, s1."start", s2."end" from bounds b join seg s1 on s1.recording_id = b.recording_id and s1.idx = b.seg_start
            join seg s2 on s2.recording_id = b.recording_id and s2.idx = b.seg_end where alone or s2."end" - s1."start" >= 8),
  quotes as (select z.recording_id, z.ord, arg_min(s.idx, (case when s.idx = quote_segment and n_words between 4 and 30 then 0 when n_words between 6 and 30 then 1
                      when s.idx = quote_segment then 2 else 3 end, case when n_words between 6 and 30 and not (s.idx = quote_segment) then -n_words else 0 end, s.idx)) as quote_seg
             from sized z join seg s on s.recording_id = z.recording_id and s.idx between z.seg_start and z.seg_end group by 1, 2)
  select z.recording_id, row_number() over (partition by z.recording_id order by z.ord) - 1 as ord, seg_start, seg_end, z."start", z."end", quote_seg,
         case when z.title <> '' then regexp_replace(regexp_replace(z.title, '^"|."$', '', 'g'), '\s+', ' ', 'g')
              when len({words("regexp_replace(q.text, '[.,;:!?…]+$', '')")}) > 7 then array_to_string({words("regexp_replace(q.text, '[.,;:!?…]+$', '')")}[1:7], ' ') || '…'
              else array_to_string({words("regexp_replace(q.text, '[.,;:!?…]+$', '')")}, ' ') end as title
  from sized z join quotes using (recording_id, ord) join seg q on q.recording_id = z.recording_id and q.idx = quote_seg
""", "drafts", "ext", "seg")


def best_quotes(s, d):
    seg, sto = _seg_sto(s, d)
    return T.best_quotes(sto.withColumn("quote_segment", F.col("seg_start") + 1), seg, ["story_id"])


def uncovered(s, d):
    seg = _seg(s, d)
    return T.uncovered(V.spans(seg), seg)


def retry_worklist(s, d):
    seg = _seg(s, d)
    return T.retry_worklist(V.spans(seg), seg)


def attach_leftovers(s, d):
    seg, sto = _seg_sto(s, d)
    return T.attach_leftovers(sto, seg).select("story_id", "seg_start", "seg_end", "start", "end")


def match_previous(s, d):
    seg, sto = _seg_sto(s, d)
    planned = sto.withColumn("start", F.col("start") + (F.col("story_id") % 4) * 5).withColumn("end", F.col("end") + (F.col("story_id") % 3) * 4)
    planned = planned.where(F.col("end") > F.col("start")).select("recording_id", "ord", "start", "end", "title")
    return T.match_previous(planned, sto).select("recording_id", "ord", "story_id", "title_by")


MATCH = sql("""
  , planned as (select recording_id, ord, "start" + story_id % 4 * 5 as s, "end" + story_id % 3 * 4 as e from stories where "end" + story_id % 3 * 4 > "start" + story_id % 4 * 5),
  pairs as (select p.recording_id, p.ord, o.story_id, o.title_by, o."start" as os, (least(e, o."end") - greatest(s, o."start")) / (greatest(e, o."end") - least(s, o."start")) as score
            from planned p join stories o on o.recording_id = p.recording_id),
  best as (select * from pairs where score >= 0.5 qualify row_number() over (partition by recording_id, ord order by score desc, os) = 1),
  one as (select * from best qualify row_number() over (partition by recording_id, story_id order by ord) = 1)
  select p.recording_id, p.ord, one.story_id, case when title_by = 'family' then 'family' else 'archive' end as title_by from planned p left join one using (recording_id, ord)
""", "stories")


def coverage_ranges(s, d):
    seg = _seg(s, d)
    return T.coverage_ranges(V.spans(seg), seg)


def chunks(s, d):
    seg = _seg(s, d)
    return T.build_chunks(seg, V.spans(seg)).select("recording_id", "story_id", "seg_start", "seg_end", "start", "end", F.md5("text").alias("text_md5"))


CHUNK_BODY = """
  , ranges as (select recording_id, seg_start as seg_from, seg_end as seg_to, story_id from spans union all select recording_id, seg_from, seg_to, null from uncovered),
  s as (select s.recording_id, seg_from, seg_to, story_id, idx, "start", "end", n_words, sum(n_words) over (partition by s.recording_id order by idx) as upto
        from seg s join ranges r on r.recording_id = s.recording_id and s.idx between seg_from and seg_to),
  jump as (select a.recording_id, a.seg_from, a.idx, max(a.seg_to) as seg_to,
                  coalesce(min(case when not (b."end" - a."start" < 28 and b.upto - b.n_words - (a.upto - a.n_words) < 90) then b.idx end), max(a.seg_to) + 1) as j
           from s a join s b on b.recording_id = a.recording_id and b.seg_from = a.seg_from and b.idx >= a.idx group by 1, 2, 3),
  step as (select recording_id, seg_from, idx, seg_to, greatest(j, idx + 1) as j from jump),
  nxt as (select *, case when j > seg_to then null when j - 1 > idx then j - 1 else j end as next from step),
  walk as (select recording_id, seg_from, idx, j, next from nxt where idx = seg_from
           union all select n.recording_id, n.seg_from, n.idx, n.j, n.next from walk w join nxt n on n.recording_id = w.recording_id and n.seg_from = w.seg_from and n.idx = w.next),
  spoken_chunks as (select w.recording_id, r.story_id, w.idx as seg_start, w.j - 1 as seg_end from walk w join ranges r on r.recording_id = w.recording_id and r.seg_from = w.seg_from),
  chunks as (select c.*, (select "start" from seg x where x.recording_id = c.recording_id and x.idx = c.seg_start) as "start",
                    (select "end" from seg x where x.recording_id = c.recording_id and x.idx = c.seg_end) as "end", t.text
             from spoken_chunks c join (select c2.recording_id, c2.seg_start, string_agg(x.text, ' ' order by x.idx) as text from spoken_chunks c2
                  join seg x on x.recording_id = c2.recording_id and x.idx between c2.seg_start and c2.seg_end group by 1, 2) t using (recording_id, seg_start))
"""
CHUNKS = sql(CHUNK_BODY + """
  select recording_id, story_id, seg_start, seg_end, "start", "end", md5(text) as text_md5 from chunks
""", "seg", "spans", "uncovered").replace("with doc_lines", "with recursive doc_lines", 1)


def fallback_chunks(s, d):
    seg, sto = _seg_sto(s, d)
    return T.fallback_chunks(seg, sto, V.doc_recordings(s, d)).select("recording_id", "story_id", "seg_start", "seg_end")


FALLBACK = sql("""
  , s as (select recording_id, 0 as seg_from, max(idx) over (partition by recording_id) as seg_to, idx, "start", "end", n_words, sum(n_words) over (partition by recording_id order by idx) as upto
        from seg where recording_id % 17 = 3),
  jump as (select a.recording_id, a.idx, max(a.seg_to) as seg_to,
                  coalesce(min(case when not (b."end" - a."start" < 28 and b.upto - b.n_words - (a.upto - a.n_words) < 90) then b.idx end), max(a.seg_to) + 1) as j
           from s a join s b on b.recording_id = a.recording_id and b.idx >= a.idx group by 1, 2),
  step as (select recording_id, idx, seg_to, greatest(j, idx + 1) as j from jump),
  nxt as (select *, case when j > seg_to then null when j - 1 > idx then j - 1 else j end as next from step),
  walk as (select recording_id, idx, j, next from nxt where idx = 0 union all select n.recording_id, n.idx, n.j, n.next from walk w join nxt n on n.recording_id = w.recording_id and n.idx = w.next)
  select recording_id, null::bigint as story_id, idx as seg_start, j - 1 as seg_end from walk
""", "seg").replace("with doc_lines", "with recursive doc_lines", 1)


def paragraphs(s, d):
    return T.paragraphs(_seg(s, d)).select("recording_id", "first", "last", "start", "end", F.md5("text").alias("text_md5"))


PARAGRAPHS = sql("""
  , s as (select *, sum(n_words) over (partition by recording_id order by idx) as upto, "start" - lag("end") over (partition by recording_id order by idx) as gap from seg),
  jump as (select a.recording_id, a.idx, least(a.idx + 4, coalesce(min(case when b.idx > a.idx and (b.gap >= 1.8 or b.upto - (a.upto - a.n_words) > 70) then b.idx end), max(b.idx) + 1)) as j
           from s a join s b on b.recording_id = a.recording_id and b.idx between a.idx and a.idx + 4 group by 1, 2),
  walk as (select recording_id, idx, j from jump where idx = 0 union all select n.recording_id, n.idx, n.j from walk w join jump n on n.recording_id = w.recording_id and n.idx = w.j)
  select w.recording_id, w.idx as first, max(s.idx) as last, arg_min(s."start", s.idx) as "start", arg_max(s."end", s.idx) as "end", md5(string_agg(s.text, ' ' order by s.idx)) as text_md5
  from walk w join seg s on s.recording_id = w.recording_id and s.idx >= w.idx and s.idx < w.j group by 1, 2
""", "seg").replace("with doc_lines", "with recursive doc_lines", 1)


def token_windows(s, d):
    return T.token_windows(_seg(s, d))


TOKEN_WINDOWS = sql("""
  , s as (select recording_id, idx, ceil(length(text) / 3.2)::bigint + 6 as cost from seg),
  c as (select *, sum(cost) over (partition by recording_id order by idx) as upto, max(idx) over (partition by recording_id) as top from s),
  jump as (select a.recording_id, a.idx, greatest(a.idx + 1, coalesce(min(case when b.upto - (a.upto - a.cost) >= 7000 then b.idx end), max(a.top) + 1)) as j
           from c a join c b on b.recording_id = a.recording_id and b.idx >= a.idx group by 1, 2),
  walk as (select recording_id, idx, j from jump where idx = 0 union all select n.recording_id, n.idx, n.j from walk w join jump n on n.recording_id = w.recording_id and n.idx = w.j)
  select recording_id, idx as first, j - 1 as last from walk
""", "seg").replace("with doc_lines", "with recursive doc_lines", 1)


def interpolated_words(s, d):
    w = T.interpolated_words(_seg(s, d))
    return w.select("recording_id", "idx", "pos", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "text")


def segment_story_map(s, d):
    seg, sto = _seg_sto(s, d)
    return A.segment_story_map(seg, sto).select("recording_id", "idx", "story_id", "title")


def segments_in_time(s, d):
    seg, sto = _seg_sto(s, d)
    return A.segments_in_story_time(seg, sto).select("story_id", "recording_id", "idx")


def segments_range(s, d):
    return _seg(s, d).where(F.col("idx").between(2, 9)).select("recording_id", "idx", "start", "end")


def embedding_documents(s, d):
    seg, sto = _seg_sto(s, d)
    return TL.embedding_documents(T.build_chunks(seg, V.spans(seg)), sto).select("recording_id", "seg_start", F.md5("embedding_text").alias("md5"))


def word_confidence(s, d):
    c = V.conversation_segments(s, d)
    w = c.select("recording_id", "idx", F.explode("words").alias("w"))
    return w.groupBy("recording_id", "idx").agg(F.round(F.avg("w.p"), 3).alias("confidence"))


QUERIES = {
    "text_normalize": Query(normalize_text, f"select doc_id, md5({norm('text')}) as norm_md5 from documents"),
    "text_tokenize": Query(tokenize, f"select token, count(*) as n, count(distinct conv_id) as n_conv from (select conv_id, unnest({tokens('text')}) as token from conversations) group by 1"),
    "text_token_stats": Query(token_stats, sql(f"select recording_id, idx, ceil(length(text) / 3.2)::int as est_tokens, len({words('text')}) as n_words from doc_lines", "doc_lines")),
    "text_clean_titles": Query(clean_titles, sql(rf"""
        select recording_id, idx, case when idx % 3 <> 0 and cleaned <> '' then cleaned
          when len(fw) > 7 then array_to_string(fw[1:7], ' ') || '…' else array_to_string(fw, ' ') end as title
        from (select *, left(trim(regexp_replace(regexp_replace(' "' || text || '." ', '^["''“”‘’«»\s\pZ]+|["''“”‘’«»\s\pZ.]+$', '', 'g'), '[\s\pZ]+', ' ', 'g')), 90) as cleaned,
                     {words("regexp_replace(text, '[.,;:!?…]+$', '')")} as fw from seg)""", "seg")),
    "text_display_names": Query(display_names, """
        select c_custkey, raw, case when length(raw) > 3 and raw = upper(raw) then upper(raw[1]) || lower(raw[2:]) else raw end as shown
        from (select c_custkey, unnest([c_mktsegment, lower(c_mktsegment)]) as raw from customer)"""),
    "drop_hallucinated_lines": Query(hallucinations, sql(f"""
        select recording_id, idx, text from (select recording_id, idx, case idx % 4 when 1 then 'Thank you for watching ' || text[1:8] when 2 then '♪ [Música] ♪' else text end as text from doc_lines)
        where {norm('text')} <> '' and not list_bool_or(list_transform({quoted(L.HALLUCINATIONS)}, lambda h: {norm('text')} = h or (contains({norm('text')}, h) and length({norm('text')}) < length(h) + 12)))""", "doc_lines")),
    "sentences_from_words": Query(sentences, SENTENCES),
    "uncertain_words": Query(uncertain_words, sql("select recording_id, idx, k as pos, p from conv_words where not whole and p < 0.4", "conv_words")),
    "segment_confidence": Query(word_confidence, sql("select recording_id, idx, round(avg(p), 3) as confidence from conv_words where not whole group by 1, 2", "conv_words")),
    "plan_stories": Query(planned_stories, PLANNED),
    "best_quotes": Query(best_quotes, sql("""
        select s.recording_id, story_id, arg_min(idx, (case when idx = seg_start + 1 and n_words between 4 and 30 then 0 when n_words between 6 and 30 then 1 when idx = seg_start + 1 then 2 else 3 end,
               case when n_words between 6 and 30 and idx <> seg_start + 1 then -n_words else 0 end, idx)) as quote_seg
        from spans s join seg g on g.recording_id = s.recording_id and g.idx between seg_start and seg_end group by 1, 2""", "spans", "seg")),
    "uncovered_stretches": Query(uncovered, sql("select * from uncovered", "uncovered")),
    "retry_worklist": Query(retry_worklist, sql("""
        select u.recording_id, seg_from, seg_to, a."start", b."end" from uncovered u join seg a on a.recording_id = u.recording_id and a.idx = seg_from
        join seg b on b.recording_id = u.recording_id and b.idx = seg_to where seg_to > seg_from and b."end" - a."start" >= 12""", "uncovered", "seg")),
    "attach_leftovers": Query(attach_leftovers, sql("""
        select story_id, x.seg_start, x.seg_end, a."start", b."end" from (
          select recording_id, story_id, case when ord = 0 then 0 else seg_start end as seg_start, coalesce(lead(seg_start) over (partition by recording_id order by ord) - 1, n - 1) as seg_end
          from spans join ext using (recording_id)) x join seg a on a.recording_id = x.recording_id and a.idx = x.seg_start join seg b on b.recording_id = x.recording_id and b.idx = x.seg_end""", "spans", "ext", "seg")),
    "match_previous_stories": Query(match_previous, MATCH),
    "coverage_ranges": Query(coverage_ranges, sql("select recording_id, seg_start as seg_from, seg_end as seg_to, story_id from spans union all select recording_id, seg_from, seg_to, null from uncovered", "spans", "uncovered")),
    "build_chunks": Query(chunks, CHUNKS),
    "fallback_chunks": Query(fallback_chunks, FALLBACK),
    "paragraphs": Query(paragraphs, PARAGRAPHS),
    "token_windows": Query(token_windows, TOKEN_WINDOWS),
    "interpolated_words": Query(interpolated_words, sql(f"""
        select recording_id, idx, pos, round("start" + pos * span, 4) as "start", round("start" + (pos + 1) * span, 4) as "end", text from (
          select recording_id, idx, "start", ("end" - "start") / greatest(len(ws), 1) as span, unnest(ws) as text, generate_subscripts(ws, 1) - 1 as pos from (select *, {words('text')} as ws from seg))""", "seg")),
    "segment_story_map": Query(segment_story_map, sql("select g.recording_id, g.idx, story_id, title from seg g join stories s on s.recording_id = g.recording_id and g.idx between seg_start and seg_end", "seg", "stories")),
    "segments_in_story_time": Query(segments_in_time, sql("""select story_id, g.recording_id, g.idx from seg g join stories s on s.recording_id = g.recording_id
        and g."start" >= s."start" - 0.05 and g."end" <= s."end" + 0.05""", "seg", "stories")),
    "segments_between": Query(segments_range, sql('select recording_id, idx, "start", "end" from seg where idx between 2 and 9', "seg")),
    "embedding_documents": Query(embedding_documents, sql(CHUNK_BODY + """
        select recording_id, seg_start, md5('title: ' || coalesce('Story ' || story_id, 'none') || ' | text: ' || text) as md5 from chunks""", "seg", "spans", "uncovered").replace("with doc_lines", "with recursive doc_lines", 1)),
}
