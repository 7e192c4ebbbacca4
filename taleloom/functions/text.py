"""Text column expressions; all of them stay inside the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _fold_tables() -> tuple[str, str]:
    """Every lower-case letter of any script that decomposes to one base letter, with or without marks, and that letter."""
    source, target = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if parts != char and char == char.lower() and all(unicodedata.category(p)[0] == "M" for p in parts[1:]):
            source.append(char)
            target.append(parts[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _fold_tables()


# A Hangul syllable is numbered (lead * 21 + vowel) * 28 + tail; tail 0 is none.
_SYLLABLES = "\uac00", "\ud7a3"
_LEADS, _VOWELS, _TAILS = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))


def _letters_of_syllables(c: Column) -> Column:
    """Hangul syllables as their two or three letters, other characters as they are."""

    def letters(char: Column) -> Column:
        n = F.ascii(char) - ord(_SYLLABLES[0])
        pick = lambda table, at: F.substr(F.lit(table), at.cast("int"), F.lit(1))
        lead, vowel, tail = pick(_LEADS, F.floor(n / 588) + 1), pick(_VOWELS, F.floor(n % 588 / 28) + 1), n % 28
        return F.when(char.between(*map(F.lit, _SYLLABLES)), F.concat(lead, vowel, F.when(tail > 0, pick(_TAILS, tail)).otherwise(""))).otherwise(char)

    return F.array_join(F.transform(F.split(c, ""), letters), "")


def normalize(col: Column | str, keep: str = "") -> Column:
    """Lower case, no accents, single spaces between runs of letters and digits; signs in `keep` stay."""
    c = F.col(col) if isinstance(col, str) else col
    syllables = c.rlike(f"[{'-'.join(_SYLLABLES)}]")
    folded = F.translate(F.when(syllables, _letters_of_syllables(F.lower(c))).otherwise(F.lower(c)), _ACCENTED, _PLAIN)
    folded = F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(folded, r"\p{M}+", "")).otherwise(F.lower(c))
    return F.trim(F.regexp_replace(folded, rf"[^\p{{L}}\p{{N}}{keep}]+", " "))


def split_tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def tokens(col: Column | str) -> Column:
    return split_tokens(normalize(col))


def words(col: Column | str) -> Column:
    """Whitespace pieces as written."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(col: Column | str) -> Column:
    return F.size(words(col))


def estimated_tokens(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.ceil(F.length(c) / F.lit(3.2)).cast("int")


def strip_outer(col: Column, keep: str = r"\p{L}\p{N}") -> Column:
    return F.regexp_replace(col, rf"^[^{keep}]+|[^{keep}]+$", "")


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, also where `use` refers to it inside other lambdas."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def running_sum(values: Column, block: int = 64) -> Column:
    """Sums of an array's values up to and with each of them, by blocks, so that the work grows in proportion to the array."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    starts = F.sequence(F.lit(1), F.size(values), F.lit(block))

    def within(start: Column, before: Column) -> Column:
        return F.transform(F.slice(values, start, F.lit(block)), lambda _, j: before + total(F.slice(values, start, j + 1)))

    def whole(sums: Column) -> Column:
        return F.flatten(F.transform(starts, lambda start, b: once(total(F.slice(sums, F.lit(1), b)), lambda before: within(start, before))))

    return F.when(F.size(values) > 0, once(F.transform(starts, lambda start: total(F.slice(values, start, F.lit(block)))), whole))


def literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_leading(token: Column) -> Column:
    return token.isin(*L.LEADING_WORDS)


def drop_leading(token_array: Column) -> Column:
    """Drop articles and titles at the front of an array of normalized tokens."""
    keep_from = F.aggregate(
        token_array,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, t: F.struct(
            F.when(acc["open"] & is_leading(t), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["open"] & is_leading(t)).alias("open"),
        ),
        lambda acc: acc["n"],
    )
    return F.slice(token_array, keep_from + 1, F.size(token_array))


def without_articles(token_array: Column) -> Column:
    return F.filter(token_array, lambda t: ~is_leading(t))


def is_bare_kinship(name: Column) -> Column:
    core = without_articles(tokens(name))
    return (F.size(core) == 1) & F.coalesce(F.get(core, F.lit(0)).isin(*L.KINSHIP), F.lit(False))


def is_capitalized(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}")


def written_words(text: Column) -> Column:
    """Words with the signs around their letters removed, articles left out."""
    cleaned = F.transform(words(text), lambda w: strip_outer(w, r"\p{L}"))
    return F.filter(cleaned, lambda w: (w != "") & ~is_leading(normalize(w)))


def has_proper_word(text: Column) -> Column:
    return F.exists(written_words(text), is_capitalized)


def proper_words(text: Column) -> Column:
    return F.transform(F.filter(written_words(text), is_capitalized), normalize)


def is_name_word(word: Column) -> Column:
    return is_capitalized(word) & ~normalize(word).isin(*L.LINKING_WORDS, *L.LEADING_WORDS)


def names_institution(name: Column) -> Column:
    core = drop_leading(tokens(name))
    return (F.size(core) >= 2) & F.coalesce(F.get(core, F.lit(0)).isin(*L.INSTITUTIONS), F.lit(False))


def is_hallucination(text: Column) -> Column:
    def known(n: Column) -> Column:
        return (n == "") | F.exists(
            literals(L.HALLUCINATIONS),
            lambda h: (n == h) | (F.contains(n, h) & (F.length(n) < F.length(h) + L.HALLUCINATION_SLACK)),
        )

    return once(normalize(text), known)


def display_name(raw: Column) -> Column:
    """All-capitals names become initial capitals; a bare kinship word gets a capital."""
    name = F.trim(F.regexp_replace(raw, r"(?U)\s+", " "))
    shouted = (F.length(name) > 3) & (name == F.upper(name)) & name.rlike(r"\p{Lu}")
    return F.when(shouted, F.initcap(F.lower(name))).otherwise(name)


def capitalized_kinship(name: Column) -> Column:
    return F.when(is_bare_kinship(name), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))).otherwise(name)


def proper_alias(mention: Column) -> Column:
    """The mention without leading articles and closing signs, if it is written as a name."""
    pieces = F.split(F.trim(mention), r"(?U)\s+")
    skipped = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, w: F.struct(
            F.when(acc["open"] & is_leading(normalize(w)), acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["open"] & is_leading(normalize(w))).alias("open"),
        ),
        lambda acc: acc["n"],
    )
    first = F.least(skipped, F.size(pieces) - 1)
    alias = F.regexp_replace(F.array_join(F.slice(pieces, first + 1, F.size(pieces)), " "), r"[.,;:!?]+$", "")
    return F.when(is_capitalized(alias) & (F.length(alias) >= 2), alias)


def clean_title(title: Column) -> Column:
    signs = "\"'“”‘’«»"
    bare = F.regexp_replace(title, rf"(?U)^[{signs}\s]+|[{signs}\s.]+$", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, 90)


def fallback_title(quote_text: Column) -> Column:
    pieces = words(F.regexp_replace(quote_text, r"[.,;:!?…]+$", ""))
    head = F.array_join(F.slice(pieces, 1, 7), " ")
    return F.when(F.size(pieces) > 7, F.concat(head, F.lit("…"))).otherwise(head)


def stage_of_age(age: Column) -> Column:
    return (
        F.when(age <= 12, "childhood").when(age <= 25, "youth").when(age <= 59, "adulthood").otherwise("later_life")
    )


def year_label(year_from: Column, year_to: Column, fallback: Column) -> Column:
    decade = (year_from % 10 == 0) & (year_to == year_from + 9)
    return (
        F.when(
            year_from.isNotNull() & year_to.isNotNull() & (year_from != year_to),
            F.when(decade, F.concat(year_from.cast("string"), F.lit("s"))).otherwise(
                F.concat(year_from.cast("string"), F.lit("–"), year_to.cast("string"))
            ),
        )
        .when(year_from.isNotNull(), year_from.cast("string"))
        .otherwise(F.trim(fallback))
    )
