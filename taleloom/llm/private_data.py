"""Personal data by patterns, and terms that give protected entities away by their co-occurrence in the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import anti, attach, table, written

#: The patterns, with what keeps a Java matcher linear in long runs: possessive loops, and no start in the middle of a run that failed before.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: A text that lacks this holds no match of the kind.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
TERM = r"\p{L}++"
#: A pair of entity and term counts if fewer terms than this, as rare as the term, would stand by chance in so many of the entity's texts.
BY_CHANCE = 1.0
#: A term whose pointwise mutual information with an entity reaches these shares of the entity's information is generalised, or removed.
GENERALISE, REMOVE = 0.8, 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == "email", True).when(kind == "ip", value.rlike(OCTETS))
        .when(kind == "card", F.when(n.between(12, 19), F.call_function("luhn_check", digits)).otherwise(False)).otherwise(n.between(9, 15))
    )


def _matches(text: Column, kind: str) -> Column:
    """Matches of a kind and the lengths of the stretches before them, in code points."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    pairs = F.struct(F.lit(kind).alias("kind"), found.alias("values"), gaps.alias("gaps"))
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else text.rlike(r"[0-9][\x20-]?[0-9]")
    return F.when(hint, pairs)


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, values, gaps) -> (keys, value, start, end): positions by a running sum within the text's own matches."""
    each = rows.select(*keys, "gaps", F.posexplode("values").alias("at", "value")).withColumn("_n", F.length("value"))
    end = F.sum(F.get("gaps", F.col("at")) + F.col("_n")).over(Window.partitionBy(*keys).orderBy("at"))
    return each.withColumn("end", end.cast("int")).select(*keys, "value", (F.col("end") - F.col("_n")).alias("start"), "end")


def found_in(docs: DataFrame) -> DataFrame:
    """One written row per document: doc_id, key (hash of the text), a row number that stays, and matches by kind with the whole document if there are any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = F.filter(F.array(*(_matches(text, k) for k in KINDS)), lambda x: x.isNotNull() & (F.size(x["values"]) > 0))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    made = docs.select(whole.alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), hits.alias("_hits"))
    return written(made.select("_id", "_key", F.monotonically_increasing_id().alias("_row"), "_hits", F.when(F.size("_hits") > 0, F.col("_doc")).alias("_doc")))


def base_spans(found: DataFrame) -> DataFrame:
    """(_row, _key, kind, value, start, end) of the valid matches."""
    rows = found.select("_row", "_key", F.explode("_hits").alias("_h")).select("_row", "_key", "_h.kind", "_h.values", "_h.gaps")
    return _placed(rows, ["_row", "_key", "kind"]).where(_valid(F.col("kind"), F.col("value")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _by_chance(terms: dict[int, int], texts: int) -> Column:
    """Log2 of how many terms of at most n_term documents would stand in t_both of an entity's t_entity texts if the different texts were independent.

    terms: terms by the bits of n_term. Sets of t_both texts are bounded by the entropy of the share, which is exact if it is all of them.
    """
    upto = F.create_map(*(x for b in terms for x in (F.lit(b), F.lit(float(sum(n for c, n in terms.items() if c <= b))))))
    k, m, t = F.col("t_both"), F.col("t_entity"), F.col("t_term")
    part = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    held = F.log2(t / texts) + (k - 1) * F.log2((t - 1) / max(texts - 1, 1))
    return F.log2(F.element_at(upto, F.length(F.bin("n_term")))) + held + part(m) - part(k) - part(m - k)


def disclosing_terms(docs: DataFrame, found: DataFrame, spans: DataFrame) -> DataFrame:
    """(_row, term, ratio): terms of a document that give away an entity which the document holds.

    An entity is a value found by the patterns. From how many documents hold the entity, the term, and both, the term's pointwise mutual
    information with the entity is set against the entity's own information: the ratio is 1 if the term never occurs without the entity. All
    documents count for the frequencies. Copies of one text give nothing away, as every rare word of it is tied to the entity alike: from the
    second different text on, a pair counts unless such pairs are to be expected by chance.
    """
    value = F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind") == "ip", F.col("value")).otherwise(_digits(F.col("value")))
    held = written(spans.select("_row", "_key", F.concat_ws(":", "kind", value).alias("entity")).distinct())
    texts = held.groupBy("entity", "_key").agg(F.count(F.lit(1)).alias("n"))
    entities = texts.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("t_entity"))
    entities = written(entities.where(F.col("t_entity") > 1))
    known = attach(held, entities, ["entity"], "inner")
    of_row = known.groupBy("_row", "_key").agg(F.collect_list(F.struct("entity", "n_entity", "t_entity")).alias("_e"))
    both = found.where(F.col("_doc").isNotNull()).select("_row", _terms(F.col("_doc.text")).alias("_terms")).join(of_row, "_row")
    pairs = both.select("_row", "_key", F.explode("_e").alias("_x"), "_terms").select("_row", "_key", "_x.*", F.explode("_terms").alias("term"))
    per_text = pairs.groupBy("entity", "n_entity", "t_entity", "term", "_key").agg(F.count(F.lit(1)).alias("n"))
    together = per_text.groupBy("entity", "n_entity", "t_entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("t_both"))
    together = together.where(F.col("t_both") > 1)
    all_terms = docs.select(F.xxhash64("text").alias("_key"), F.explode(_terms(F.coalesce(F.col("text"), F.lit("")))).alias("term"))
    frequency = written(all_terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") > 1))
    total = found.count()
    told = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    ratios = together.join(frequency, "term").withColumn("ratio", F.when(own > 0, told / own).otherwise(0.0))
    exceeding = written(ratios.where(F.col("ratio") >= GENERALISE))
    sizes = {r[0]: r[1] for r in frequency.groupBy(F.length(F.bin("n_term"))).count().collect()}  # a row for each power of two
    if sizes:
        apart = attach(all_terms, written(exceeding.select("term").distinct()), ["term"], "left_semi").groupBy("term", "_key").agg(F.count(F.lit(1)))
        apart = apart.groupBy("term").agg(F.count(F.lit(1)).alias("t_term"))
        different = found.select("_key").distinct().count()
        exceeding = written(exceeding.join(apart, "term").where(_by_chance(sizes, different) < math.log2(BY_CHANCE)))
    exceeding = exceeding.select("entity", "term", "ratio")
    return attach(pairs.select("_row", "entity", "term"), exceeding, ["entity", "term"], "inner").groupBy("_row", "term").agg(F.max("ratio").alias("ratio"))


def all_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(_row, base, terms): arrays of (start, rank, end, kind), sorted; terms that touch a base span are left out. Rows without spans are not there."""
    spans = written(base_spans(found))
    rank = F.element_at(F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i)))), F.col("kind"))
    base = spans.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind"))).alias("base"))
    given = disclosing_terms(docs, found, spans)
    chosen = given.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "ratio"))).alias("_given"))
    holding = found.select("_row", F.col("_doc.text").alias("_text")).join(chosen, "_row")
    words = holding.select("_row", "_given", F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)).alias("values"), F.transform(F.split("_text", TERM, -1), F.length).alias("gaps"))
    each = words.select("_row", "_given", "gaps", F.posexplode("values").alias("at", "value")).withColumn("_n", F.length("value"))
    end = F.sum(F.get("gaps", F.col("at")) + F.col("_n")).over(Window.partitionBy("_row").orderBy("at"))
    each = each.withColumn("end", end.cast("int")).withColumn("_ratio", F.try_element_at("_given", F.lower("value"))).where(F.col("_ratio").isNotNull())
    kind = F.when(F.col("_ratio") >= REMOVE, "term_removed").otherwise("term")
    placed = each.select("_row", (F.col("end") - F.col("_n")).alias("start"), "end", kind.alias("kind"))
    terms = placed.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", "kind"))).alias("terms"))
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return base.join(terms, "_row", "left").select("_row", "base", F.coalesce(apart, F.filter("base", lambda x: F.lit(False))).alias("terms"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def private_data(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): counts by kind, base_spans and spans (kind:start:end, code points, end exclusive, comma-joined).

    A null text is empty. Matches are leftmost and don't overlap within a kind; those that fail their rule are dropped. Spans of terms that give
    an entity away follow from the whole corpus: kind `term` is to be generalised, `term_removed` to be removed. Repeated rows stay rows.
    """
    found = found_in(docs.select("doc_id", "text"))
    marked = found.select("_id", "_row").join(all_spans(docs, found), "_row", "left")
    none = F.expr("array()").cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    base, terms = F.coalesce("base", none), F.coalesce("terms", none)
    counts = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return marked.select(F.col("_id").alias("doc_id"), *counts, _listed(base).alias("base_spans"), _listed(F.sort_array(F.concat(base, terms))).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced by its kind in brackets, terms that give it away generalised to [TERM] or removed; n_chars follows the text.

    Only documents with spans are written and rebuilt; the others pass as they are.
    """
    found = found_in(docs)
    marked = written(found.join(all_spans(docs, found), "_row").select("_id", "_key", "_doc", F.sort_array(F.concat("base", "terms")).alias("_s")))
    text = F.col("_doc.text")
    tag = lambda s: F.when(s["kind"] == "term_removed", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    step = lambda a, s: F.when(
        s["start"] >= a["pos"], F.struct(F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), tag(s)).alias("out"), s["end"].alias("pos"))
    ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["pos"], s["end"]).alias("pos")))
    rebuilt = F.aggregate("_s", state, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    changed = marked.withColumn("_new", rebuilt)
    kinds = dict(docs.dtypes)
    value = lambda c: F.col("_new") if c == "text" else F.length("_new").cast(kinds[c]) if c == "n_chars" else F.col(f"_doc.`{c}`")
    others = anti(docs.withColumn("_id", F.col("doc_id")).withColumn("_key", F.xxhash64("text")), marked.select("_id", "_key").distinct(), ["_id", "_key"])
    return others.select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(changed.select(*(value(c).alias(c) for c in docs.columns)))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = private_data(table(spark, sf_dir, "documents"))
    return p.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")
