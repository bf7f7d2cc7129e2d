"""Repetition inside a document, by a suffix array over its words.

The suffix array comes from prefix doubling; the ranks of all doublings also give the longest common prefix of
neighbouring suffixes.  The deepest prefix interval of a suffix is the maximal repeated substring that starts there;
the union of those spans of at least ``MIN_WORDS`` words is the covered part.  A document is kept if the covered
fraction and its longest repeat stay within limits and the plain counts don't fail it.

Null text counts as empty: no words, hence failed (fewer than 50 words).  Memory follows the longest single text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.llm.common import BLANK, map_texts

MIN_WORDS = 8  # shorter repeats are ordinary language
MAX_COVERED = 0.3  # of the words
MAX_REPEAT = 200  # words of the longest repeat
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    return rank


def doubling(ids: np.ndarray) -> list[np.ndarray]:
    """ranks[k]: order of the substrings of 2**k words at each place; the last has no equal ranks."""
    n = len(ids)
    ranks = [_dense(ids)]
    while n and ranks[-1].max() < n - 1:
        step = 1 << (len(ranks) - 1)
        follow = np.zeros(n, np.int64)
        if step < n:
            follow[:-step] = ranks[-1][step:] + 1
        ranks.append(_dense(ranks[-1] * (n + 1) + follow))
    return ranks


def longest_repeats(ids: np.ndarray, ranks: list[np.ndarray] | None = None) -> np.ndarray:
    """For each place the number of words of the longest substring that starts there and occurs elsewhere too."""
    n = len(ids)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    ranks = ranks or doubling(ids)
    suffixes = np.argsort(ranks[-1], kind="stable")
    a, b = suffixes[:-1], suffixes[1:]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        fits = np.maximum(a, b) + common + step <= n
        same = np.zeros(n - 1, bool)
        same[fits] = ranks[k][a[fits] + common[fits]] == ranks[k][b[fits] + common[fits]]
        common[same] += step
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def covered(longest: np.ndarray, least: int) -> int:
    """Words in the union of the repeated substrings of ``least`` words or more."""
    starts = np.flatnonzero(longest >= least)
    if not len(starts):
        return 0
    ends = np.maximum.accumulate(starts + longest[starts])
    return int((ends - np.maximum(starts, np.concatenate(([0], ends[:-1])))).sum())


def window_repeats(ids: np.ndarray, ranks: list[np.ndarray]) -> int:
    """Words in windows of three words that occur twice or more."""
    n = len(ids)
    if n < 4 or len(ranks) < 2 or ranks[1].max() == n - 1:
        return 0
    windows = _dense(ranks[1][: n - 2] * (n + 1) + ids[2:])
    twice = np.bincount(windows)[windows] > 1
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, float, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered fraction, longest repeat."""
    text = text or ""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in text.encode().split()], np.int64)
    n = len(ids)
    chars = len(text) - sum(text.count(c) for c in BLANK)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(BLANK)]
    repeated_lines = len(lines) - len(set(lines))
    if len(known) == n:
        return n, chars, symbols, repeated_lines, 0, 0.0, 0
    ranks = doubling(ids)
    longest = longest_repeats(ids, ranks)
    return n, chars, symbols, repeated_lines, window_repeats(ids, ranks), covered(longest, MIN_WORDS) / n, int(longest.max())


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_fraction", "longest_repeat")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_fraction double, longest_repeat long"


def repetition(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT
) -> DataFrame:
    """One row per document with the counts, base_failed and kept.

    Other columns are ignored, whatever their names; null ids stay null; repeated rows give repeated rows.
    """

    def make():
        def run(rows: dict) -> dict:
            columns = zip(*map(measure, rows["text"])) if rows["text"] else [()] * len(COLUMNS)
            return {"doc_id": rows["doc_id"]} | dict(zip(COLUMNS, map(list, columns)))

        return run

    rows = map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), make, SCHEMA)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~F.col("base_failed") & (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_repeat)
    return rows.withColumn("base_failed", failed).withColumn("kept", kept)
