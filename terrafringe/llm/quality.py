"""Quality rules by distribution divergence, in DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SIGNS = ".,;:!?'\"()-"
#: Frequent function words of each language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "nicht"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "was"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "un", "para"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "que", "dans"],
}
#: Rules' limits. Distances are square roots of the Jensen-Shannon divergence in bits, 0 to 1.
LIMITS = {"min_words": 10, "max_repeat_percent": 20, "min_chars_judged": 100, "max_char_distance": 0.27, "min_words_judged": 100, "max_word_distance": 0.26}


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), chars, text)


def _common(languages: dict[str, list[str]]) -> list[str]:
    return sorted({w for words in languages.values() for w in words})


def _repeated_words(words: Column, n: Column, hashes: str) -> Column:
    """Words in 5-word windows that occur twice or more, given the array column of window hashes."""
    return F.when((n < 5) | (F.size(F.array_distinct(F.col(hashes))) == F.size(hashes)), F.lit(0).cast("long")).otherwise(
        F.expr(f"""
        aggregate(
          transform(array(sort_array(transform({hashes}, (h, i) -> named_struct('h', h, 'i', i)))), st ->
            transform(array(sort_array(filter(transform(st, (x, k) ->
                if((k > 0 and st[greatest(k - 1, 0)].h = x.h) or (k + 1 < size(st) and st[least(k + 1, size(st) - 1)].h = x.h), x.i, null)), i -> i is not null))), ix ->
              aggregate(transform(ix, (i, k) -> coalesce(least(5, get(ix, k + 1) - i), 5)), 0L, (a, b) -> a + b))[0]),
          0L, (a, b) -> a + b)""")
    )


def measures(docs: DataFrame, languages: dict[str, list[str]] = COMMON_WORDS, text_col: str = "text", repeats: bool = True) -> DataFrame:
    """`docs` with the arrays `_classes` and `_common` and the counts n_words, word_chars, n_symbols and, with `repeats`, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_text", text).withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    chars = F.length("_text")
    out = out.withColumn("word_chars", F.length(_without(F.col("_text"), WHITE)).cast("long"))
    out = out.withColumn("n_symbols", (chars - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"))
    signs, capitals, digits = chars - F.length(_without(F.col("_text"), SIGNS)), F.regexp_count("_text", F.lit(r"\p{Lu}")), F.length(_without(F.col("_text"), "0123456789"))
    out = out.withColumn("_signs", signs.cast("long")).withColumn("_capitals", capitals.cast("long")).withColumn("_digits", (chars - digits).cast("long"))
    small = F.col("word_chars") - F.col("_capitals") - F.col("_digits") - F.col("_signs") - F.col("n_symbols")
    out = out.withColumn("_classes", F.array(small, F.col("_capitals"), F.col("_digits"), F.col("_signs"), F.col("n_symbols"), chars - F.col("word_chars")).cast("array<double>"))
    # The common words, each between two separators, so that lengths tell their numbers.
    common = _common(languages)
    out = out.withColumn("_found", F.array_join(F.filter(F.transform("_words", F.lower), lambda w: w.isin(common)), "\x01\x01"))
    out = out.withColumn("_found", F.concat(F.lit("\x01"), "_found", F.lit("\x01")))
    size = F.length("_found")
    counts = [((size - F.length(F.replace("_found", F.lit(f"\x01{w}\x01"), F.lit("")))) / (len(w) + 2)) for w in common]
    out = out.withColumn("_common", F.array(*counts)).withColumn("_common", F.concat("_common", F.array(F.col("n_words") - F.aggregate("_common", F.lit(0.0), lambda a, b: a + b))))
    if repeats:
        lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        out = out.withColumn("_lines", lines).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        n = F.col("n_words").cast("int")
        out = out.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))

        def joined(a: str, at: int, b: str, to: int, size: Column) -> Column:
            return F.zip_with(F.slice(a, at, size), F.slice(b, to, size), lambda x, y: F.xxhash64(x, y))

        for name, a, b, to, less in (("_h2", "_h", "_h", 2, 1), ("_h4", "_h2", "_h2", 3, 3), ("_h5", "_h4", "_h", 5, 4)):
            out = out.withColumn(name, F.when(n >= 5, joined(a, 1, b, to, n - less)))
        out = out.withColumn("n_repeat_words", _repeated_words(F.col("_words"), n, "_h5"))
    return out


def _distance(counts: Column, reference: list[float]) -> Column:
    """Square root of the Jensen-Shannon divergence, in bits, of a histogram from a reference; null for no counts."""
    total, q = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b), F.array(*map(F.lit, reference))

    def part(p: Column, r: Column) -> Column:
        m = (p + r) / 2
        term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return (term(p) + term(r)) / 2

    terms = F.zip_with(F.transform(counts, lambda x: x / total), q, part)
    return F.when(total > 0, F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))))


def references(docs: DataFrame, languages: dict[str, list[str]] = COMMON_WORDS, text_col: str = "text", lang_col: str = "lang", limits: dict[str, float] = LIMITS) -> dict[str, tuple[list[float], list[float]]]:
    """Character-class and common-word histograms of each language over all its documents that are long enough to be judged.

    One row for each of the stated languages comes to the driver. A language without documents has no reference.
    """
    kept = measures(docs.filter(F.col(lang_col).isin(list(languages))), languages, text_col, repeats=False).filter(F.col("n_words") >= limits["min_words_judged"])
    n, k = 6, len(_common(languages)) + 1
    sums = [F.sum(F.col("_classes")[i]) for i in range(n)] + [F.sum(F.col("_common")[i]) for i in range(k)]
    found = {}
    for row in kept.groupBy(lang_col).agg(*sums).collect():
        classes, common = list(row[1 : n + 1]), list(row[n + 1 :])
        found[row[0]] = [x / math.fsum(classes) for x in classes], [x / math.fsum(common) for x in common]
    return found


def judge(docs: DataFrame, languages: dict[str, list[str]] = COMMON_WORDS, text_col: str = "text", lang_col: str = "lang", limits: dict[str, float] = LIMITS) -> DataFrame:
    """All columns of `docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and kept.

    A document fails the base rules with too few words or too many repeated
    ones. Of the others, a text of `min_chars_judged` characters or more must
    have its character classes, and one of `min_words_judged` words or more its
    common words, within the limits of the nearest language reference; shorter
    ones aren't judged by them (their distances are still given). Null text
    counts as empty and fails; null languages give nothing to the references;
    with no reference at all the distances are null and only the base rules
    hold. Repeated rows are judged alike. Columns of `docs` with these names
    are replaced.
    """
    refs = references(docs, languages, text_col, lang_col, limits)
    out = measures(docs, languages, text_col)

    def nearest(column: str, k: int) -> Column:
        found = [_distance(F.col(column), refs[lang][k]) for lang in sorted(refs)]
        return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")

    out = out.withColumn("char_distance", nearest("_classes", 0)).withColumn("word_distance", nearest("_common", 1))
    out = out.withColumn("base_failed", (F.col("n_words") < limits["min_words"]) | (100 * F.col("n_repeat_words") > limits["max_repeat_percent"] * F.col("n_words")))
    far = lambda size, least, column, most: (F.col(size) >= limits[least]) & (F.coalesce(F.col(column), F.lit(0.0)) > limits[most])
    bad = far("word_chars", "min_chars_judged", "char_distance", "max_char_distance") | far("n_words", "min_words_judged", "word_distance", "max_word_distance")
    out = out.withColumn("kept", ~F.col("base_failed") & ~bad)
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]
    return out.select(*[c for c in docs.columns if c not in new], *new)


def passed(judged: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of the rows of `judge`'s result that are kept.

    A plain filter would be pushed below the measures and compute them over
    and over in nested copies; a generator of one or no row takes the computed verdict.
    """
    once = F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return judged.withColumn("_once", F.explode(once)).select(*columns)
