"""Quality rules whose thresholds follow the corpus: mergeable quantile sketches per language and source, then a joined filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, table, written

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A sketch with fewer documents than this gives way to the sketch of the language, then to that of all documents.
LEAST_DOCS = 100
#: Significant bits of a sketch's buckets: values are exact below 32, above that within 1/16.
SKETCH_BITS = 5
#: A threshold lies this many quartile distances beyond the upper quartile.
REACH = 4
#: Rates per thousand, and the least that a threshold may be: below it nothing is rejected.
FLOORS = {"symbol_rate": 60, "dup_line_rate": 450, "repeat_rate": 400, "length_rate": 12_000}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of quality rules and the rates made of them, by array functions inside one scan.

    Windows of three words are compared by a 64-bit hash of the words; only texts with a repeated window are sorted to find its places.
    """
    w, tri = F.col("_w"), F.col("_tri")
    n = F.size("_w")
    made = docs.withColumn("_t", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    made = made.withColumns({
        "_w": F.array_remove(F.split("_t", WORD_GAP), ""),
        "_lines": F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD_CHARACTER)),
        "n_symbols": F.regexp_count("_t", F.lit(SYMBOL)).cast("long"),
    }).drop("_t")
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    made = made.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "_n_lines": F.size("_lines"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_tri": F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>")),
    }).drop("_w", "_lines")
    ranked = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    made = made.withColumn("_ranked", F.when(F.size(F.array_distinct(tri)) < F.size(tri), ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))).drop("_tri")
    r = F.col("_ranked")
    twice = F.filter(r, lambda x, j: (F.get(r, j - 1)["h"] == x["h"]) | (F.get(r, j + 1)["h"] == x["h"]))
    made = made.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_ranked")
    p = F.col("_places")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    made = made.withColumn("n_repeat_words", covered.cast("long")).drop("_places")
    rates = {
        "symbol_rate": F.expr("n_symbols * 1000 div greatest(word_chars, 1)"),
        "dup_line_rate": F.expr("n_dup_lines * 1000 div greatest(_n_lines, 1)"),
        "repeat_rate": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
        "length_rate": F.expr("word_chars * 1000 div greatest(n_words, 1)"),
    }
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    made = made.withColumns(rates | {"base_failed": failed})
    # through a generator of one row: a filter on the counts is then not pushed below, where it would compute them once more for each use
    own = F.inline(F.array(F.struct(*COUNTS, *FLOORS, "base_failed")))
    return made.select(*(F.col(f"`{c}`") for c in docs.columns), own)


def _bucket(rate: str) -> Column:
    over = f"greatest(length(bin({rate})) - {SKETCH_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({rate}, {over}), {over})")


def _upper(bucket: str) -> Column:
    """The highest rate of a bucket."""
    return F.expr(f"{bucket} + shiftleft(1L, greatest(length(bin({bucket})) - {SKETCH_BITS}, 0)) - 1")


def sketches(counts: DataFrame) -> DataFrame:
    """Quantile sketches of the rates: documents per (lang, source, rate, bucket). Sketches of any parts of a corpus merge by adding counts.

    Documents that fail the base rules don't shape the thresholds. Partial counts are combined before the shuffle, so a hot source sends at most
    a few hundred buckets from each task.
    """
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rate"), _bucket(r).alias("bucket")) for r in FLOORS))).alias("_e")
    return counts.where("not base_failed").select("lang", "source", each).groupBy("lang", "source", "_e.rate", "_e.bucket").agg(F.count(F.lit(1)).alias("n"))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """A threshold per key and rate, from the quartiles of the merged sketch. A key has at most some hundred buckets.

    Quartiles are upper edges of their buckets, as thresholds are compared with exact rates: what lies in the bucket of the upper quartile is no outlier.
    """
    merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    by = Window.partitionBy(*keys, "rate")
    run = merged.withColumns({"below": F.sum("n").over(by.orderBy("bucket")), "docs": F.sum("n").over(by)})
    quartiles = run.groupBy(*keys, "rate").agg(
        F.max("docs").alias("docs"), *(F.min(F.when(F.col("below") * 4 >= F.col("docs") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 3))
    )
    q1, q3 = _upper("q1"), _upper("q3")
    return quartiles.select(*keys, "rate", "docs", (q3 + REACH * (q3 - q1)).alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source) with a column per rate: the sketch's own threshold, or that of its language or the corpus if it is too small."""
    sketch = written(sketch)
    own, language, corpus = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"]), _fences(sketch, [])
    language = language.select(F.col("lang").alias("_lang"), F.col("rate").alias("_rate"), F.col("docs").alias("_docs"), F.col("fence").alias("_fence"))
    corpus = corpus.select(F.col("rate").alias("_all"), F.col("fence").alias("_whole"))
    chosen = (
        own.join(language, own["lang"].eqNullSafe(F.col("_lang")) & (own["rate"] == F.col("_rate"))).join(F.broadcast(corpus), own["rate"] == F.col("_all"))
        .withColumn("at", F.when(F.col("docs") >= LEAST_DOCS, F.col("fence")).when(F.col("_docs") >= LEAST_DOCS, F.col("_fence")).otherwise(F.col("_whole")))
    )
    return chosen.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rate") == r, F.greatest("at", F.lit(floor)))).alias(f"max_{r}") for r, floor in FLOORS.items()))


def judged(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """counts with kept: the base rules hold and no rate lies over the threshold of its language and source."""
    met = attach(counts, written(limits), ["lang", "source"])
    within = F.lit(True)
    for r in FLOORS:
        within = within & (F.col(r) <= F.coalesce(F.col(f"max_{r}"), F.col(r)))
    return met.withColumn("kept", ~F.col("base_failed") & within)


def quality(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text, lang, source): counts, rates, base_failed, kept, and the thresholds that were used.

    A null text has no words and fails; null languages and sources are groups of their own. A text with no whole window of three words repeats
    nothing. The counts are written once, without the texts, and read by the sketches and by the filter.
    """
    counts = written(counted(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(counts, thresholds(sketches(counts)))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are not written: the second pass counts anew and reads the thresholds."""
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")).select("_doc", "_doc.text", "_doc.lang", "_doc.source")
    limits = thresholds(sketches(counted(docs.select("text", "lang", "source"))))
    return judged(counted(base), limits).where("kept").select("_doc.*")


def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", *COUNTS, "base_failed", "kept", *FLOORS)


def _sql() -> str:
    bucket = lambda v: f"(({v} >> greatest(length(bin({v})) - {SKETCH_BITS}, 0)) << greatest(length(bin({v})) - {SKETCH_BITS}, 0))"
    cells = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {bucket(r)} AS bucket FROM c WHERE NOT base_failed" for r in FLOORS)

    upper = lambda q: f"({q} + (1::BIGINT << greatest(length(bin({q})) - {SKETCH_BITS}, 0)) - 1)"

    def fences(name: str, keys: str) -> str:
        k = f"{keys}, " if keys else ""
        return f"""{name} AS (SELECT {k}rate, docs, {upper("q3")} + {REACH} * ({upper("q3")} - {upper("q1")}) AS fence
            FROM (SELECT {k}rate, max(docs) AS docs, min(bucket) FILTER (WHERE below * 4 >= docs * 3) AS q3, min(bucket) FILTER (WHERE below * 4 >= docs) AS q1
              FROM (SELECT {k}rate, bucket, sum(n) OVER (PARTITION BY {k}rate ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {k}rate) AS docs
                    FROM (SELECT {k}rate, bucket, count(*) AS n FROM cells GROUP BY {k}rate, bucket)) GROUP BY {k}rate))"""

    picked = ", ".join(f"max(greatest(bar, {floor})) FILTER (WHERE rate = '{r}') AS max_{r}" for r, floor in FLOORS.items())
    within = " AND ".join(f"{r} <= coalesce(max_{r}, {r})" for r in FLOORS)
    return f"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM t),
tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM hit, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
b AS (SELECT t.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines
    FROM t JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
c AS (SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 1000 // greatest(n_words, 1) AS length_rate,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b),
cells AS ({cells}),
{fences("own", "lang, source")}, {fences("tongue", "lang")}, {fences("whole", "")},
limits AS (SELECT lang, source, {picked} FROM (SELECT o.lang, o.source, o.rate, CASE WHEN o.docs >= {LEAST_DOCS} THEN o.fence WHEN g.docs >= {LEAST_DOCS} THEN g.fence ELSE v.fence END AS bar
    FROM own o JOIN tongue g ON o.rate = g.rate AND o.lang IS NOT DISTINCT FROM g.lang JOIN whole v ON o.rate = v.rate) GROUP BY lang, source)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND {within} AS kept, {", ".join(FLOORS)}
FROM c LEFT JOIN limits m ON c.lang IS NOT DISTINCT FROM m.lang AND c.source IS NOT DISTINCT FROM m.source
"""


OP7_SQL = _sql()
