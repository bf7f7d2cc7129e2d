"""Text columns built from JVM-side expressions only.

Character classes are written out (``\\p{L}``, ``\\p{N}``) instead of ``\\w`` because Java's default
``\\w`` is ASCII.  Null text behaves as the empty string everywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.functions.lexicons import ASCII_PUNCTUATION, COUNTED_PUNCTUATION, FUSED_WORDS, STOP_WORDS

SPACE = r"\s\x1c-\x1f"
WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def clean(text: Column) -> Column:
    """Lowercase; drop links, tags and ASCII punctuation; squeeze white space."""
    t = F.lower(text_or_empty(text))
    t = F.regexp_replace(t, rf"(?U)http[^{SPACE}]+|www[^{SPACE}]+", "")
    t = F.regexp_replace(t, r"(?d)<.*?>", "")
    t = F.translate(t, ASCII_PUNCTUATION, "")
    return F.btrim(F.regexp_replace(t, rf"(?U)[{SPACE}]+", " "))


def tokens(cleaned: Column, remove_stop_words: bool = True, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of cleaned text, with fused words taken apart and typographic quotes split off."""
    t = F.regexp_replace(cleaned, "([«“‘„»”’])", " $1 ")
    heads = "|".join(rf"{head}(?={tail}\b)" for head, tail in FUSED_WORDS.values())
    t = F.regexp_replace(t, rf"(?U)\b({heads})", "$1 ")
    words = F.filter(F.split(t, " "), lambda w: w != "")
    if remove_stop_words:
        words = F.filter(words, lambda w: ~w.isin(list(stop_words)))
    return words


def ngrams(words: Column, n: int) -> Column:
    """Space-joined runs of ``n`` words."""
    return F.when(
        F.size(words) >= n,
        F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def entries(df: DataFrame, keep: Sequence[str], items: Column, name: str) -> DataFrame:
    """One row per array entry.  The outer form keeps the optimizer from evaluating ``items`` twice, once to filter."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def top_items(items: Column, k: int) -> Column:
    """The ``k`` most frequent array entries as ``array<struct<ngram,count>>``; ties keep first appearance.

    Counting stays inside the row (sort, then run lengths), so no shuffle is needed.
    """
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("ngram"), i.alias("pos"))))

    def runs(arr: Column) -> Column:
        n = F.size(arr)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (F.get(arr, i)["ngram"] != F.get(arr, i - 1)["ngram"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda b, j: F.struct(
                    (b - F.coalesce(F.get(s, j + 1), n)).alias("neg"),
                    F.get(arr, b)["pos"].alias("pos"),
                    F.get(arr, b)["ngram"].alias("ngram"),
                ),
            ),
        )

    ranked = F.slice(F.sort_array(let(keyed, runs)), 1, k)
    picked = F.transform(ranked, lambda r: F.struct(r["ngram"].alias("ngram"), (-r["neg"]).cast("long").alias("count")))
    empty = F.array().cast("array<struct<ngram:string,count:bigint>>")
    return F.when(F.size(items) > 0, picked).otherwise(empty)


def letters_total(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def share(part: Column, whole: Column) -> Column:
    """``part / max(whole, 1)``."""
    return part.cast("double") / F.greatest(whole, F.lit(1))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def char_count_of(text: Column, chars: str) -> Column:
    """Occurrences of any of ``chars`` (literal characters), without a regular expression."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def hits(words: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(list(lexicon))))


def uppercase_count(text: Column) -> Column:
    return count_of(text, r"\p{Lu}")


def punctuation_count(text: Column) -> Column:
    return char_count_of(text, COUNTED_PUNCTUATION)


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(rf"(?U)[^{SPACE}]")))


def vector_terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lowercase words of at least two characters without stop words, as a bag-of-words vectoriser sees them."""
    words = F.regexp_extract_all(F.lower(text_or_empty(text)), F.lit(LONG_WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def raw_tokens(text: Column) -> Column:
    """Lowercase words with every punctuation mark as a token of its own."""
    return F.regexp_extract_all(
        F.lower(text_or_empty(text)), F.lit(rf"(?U){WORD}|[^\p{{L}}\p{{N}}_{SPACE}]"), F.lit(0)
    )
