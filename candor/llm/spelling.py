"""Spelling variants: words one edit apart, joined by asymmetric q-chunks.

Of two words one edit apart, the shorter (of equally long ones: the smaller) contributes two disjoint chunks, its halves; the other
contributes positional grams.  The edit touches one half at most, so the other half is a gram of the longer word, at the
same position or shifted by the difference in length, which is one at most.  Of all positional grams, only those of a
length and within the shift that can meet a chunk are written.  What is left of both words once the kept chunk is taken off is again one
edit apart, so the rule is applied again to the rest: a key holds a half and a quarter of the word.  Keys that hold
very many words are split by applying it once more, until all but one letter of the shorter word is in the key; no group is cut off.
Met words are verified by their edit distance.

Counting: a run of letters becomes a word after its letter is deleted where the CRC-32 of ``<doc_id>:<run>`` says so.  Tasks count in
bounded tables before the shuffle.  A null id counts as the empty text, null text as no words.  Repeated rows count
repeatedly; other columns are ignored.  Without words there are no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candor.lineage import cut
from candor.llm.common import bound_batches, slices, stored
from candor.llm.decontamination import parts_of
from candor.skew import attach

ONE_IN = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
LEVELS = 2
HOT = 1 << 20  # candidates of a key beyond which it is split again
HELD = 1 << 19  # words counted by a task before they are sent on

#: Bytes of Latin-1: A-Z to a-z; a-z and U+00C0 to U+00FF stay; all else is blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def noisy(word: bytes, seed: int, one_in: int = ONE_IN) -> bytes:
    """``word`` (Latin-1), without one letter if its hash says so; ``seed`` is the CRC-32 of what stands before it."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): how often each word of ``least_length`` letters or more occurs."""
    bound_batches(docs.sparkSession)

    def sent(held: Counter) -> Iterator[pa.RecordBatch]:
        words, counts = list(held), list(held.values())
        for at in range(0, len(words), 1 << 16):
            yield pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w in words[at : at + (1 << 16)]], "n": pa.array(counts[at : at + (1 << 16)], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for key, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist()):
                    seed = zlib.crc32(f"{key}:".encode())
                    for some in parts_of((text or "").encode("latin-1", "replace").translate(_FOLD)):
                        for word, n in Counter(some.split()).items():
                            if len(word) >= least_length:
                                word = noisy(word, seed)
                                if len(word) >= least_length:
                                    held[word] += n
                if len(held) >= HELD:
                    yield from sent(held)
                    held = Counter()
        yield from sent(held)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _narrowed(rows: DataFrame) -> DataFrame:
    """Rows of keys, each twice: with the first and with the last half of the chunk side's rest added to the key.

    ``at`` and ``len`` are where the rest begins and how long it is in the shorter word; ``longer`` letters more in this one.
    """
    first, rest = F.floor(F.col("len") / 2).cast("int"), F.col("len") - F.floor(F.col("len") / 2).cast("int")

    def option(tag: int, start: Column, size: Column, at: Column, left: Column) -> Column:
        return F.struct(F.xxhash64("key", F.lit(tag), F.substring("word", start, size)).alias("key"), at.alias("at"), left.cast("int").alias("len"))

    at = F.col("at")
    options = F.array(
        option(0, at + 1, first, at + first, rest),
        option(1, at + F.col("len") + F.col("longer") - rest + 1, rest, at, first),
    )
    return rows.select("word", "n", "longer", F.explode(options).alias("_o")).select("word", "n", "longer", "_o.key", "_o.at", "_o.len")


def _met(rows: DataFrame) -> DataFrame:
    chunks = rows.filter(F.col("longer") == 0).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = rows.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    return chunks.join(grams, "key").filter(
        ((F.col("longer") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    ).select("a", "b", "n_a", "n_b")


def near_words(words: DataFrame, *, hot: int = HOT, levels: int = LEVELS) -> DataFrame:
    """(a, b, n_a, n_b): pairs of words of ``words`` (word, n) that are one edit apart, each once; ``a`` is the shorter or smaller."""
    longer = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    rows = words.select("word", "n", longer).select(
        "*", F.xxhash64(F.length("word") - F.col("longer")).alias("key"), F.lit(0).alias("at"), (F.length("word") - F.col("longer")).alias("len")
    ).filter(F.col("len") > 0)
    for _ in range(levels):
        rows = _narrowed(rows)
    found = []
    while True:
        sizes = rows.groupBy("key").agg(
            F.count(F.when(F.col("longer") == 0, 1)).alias("chunks"), F.count(F.lit(1)).alias("grams"), F.max("len").alias("_l")
        ).filter((F.col("chunks") > 0) & (F.col("grams") > 1))
        split = (F.col("chunks") * F.col("grams") > hot) & (F.col("_l") > 1)
        sizes = cut(sizes.select("key", split.alias("hot")))
        placed = attach(rows, sizes, "key", how="inner")
        found.append(_met(placed.filter(~F.col("hot"))))
        if sizes.filter("hot").isEmpty():
            break
        rows = cut(_narrowed(placed.filter("hot")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last of the forms that follow each other.  Each round doubles the steps taken."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(attach(state, onward, "root"))
        state = moved.select("word", F.coalesce("_next", "root").alias("root"))
        if moved.filter(F.col("_next").isNotNull()).isEmpty():
            return state


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n).

    A word's form is its most frequent near word (ties: smallest in code-point order), if that is at least twice as frequent.
    """
    words = stored(word_counts(docs, id_col, text_col).filter(F.col("n") >= least_count), "words")
    pairs = stored(near_words(words), "near")
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(pairs.select("b", "a", "n_a"))
    best = links.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("_less"), "near")).alias("_best")
    )
    twice = -F.col("_best._less") >= 2 * F.col("n")
    known = stored(
        attach(words, best, "word").select(
            "word", F.when(twice, F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(twice, -F.col("_best._less")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(known.filter(F.col("form").isNotNull()))
    return attach(known, ends, "word").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
