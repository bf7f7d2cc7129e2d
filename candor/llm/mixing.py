"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources share ``SHARE`` times all words by weight, none above ``CEILING`` times its own size; the excess
goes to the others by weight (water level).  A source gives whole passes over its documents, in an order of hashed
ids, and a last pass that stops at the target, cutting one document.

Positions: each source has a weight schedule over training time 0..1, linear between its first and last weight and
with mean one.  Its integral times the target is the cumulative token demand; the inverse of the demand at a document's first
word is its training time, and the demand of all sources up to that time its position.  The mix is range-sorted by
position.

Sizes are summed in two steps, inside hash cells of a source and over its cells, so that no task holds a source.
Null text has size 0, null sources are one source (last in order), null ids hash as the empty text; repeated rows count as
rows of their own.  Sources without words take nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.llm.common import WORD
from candor.skew import attach

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
CELL = 3  # hex digits of the hash that name a cell: 4,096 cells a source
#: First and last weight of the schedules, repeating over the sources in order: early, steady, late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _cycle(place: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((place - 1) % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, place, weight, target) from one row (source, source_size) per source.

    Sources reach their ceiling in the order of ceiling / weight; the level that the first k at their ceiling
    leave for the rest is right for the first k at which the next one stays below its ceiling.
    """
    every = Window.orderBy("_one").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("cap_level", "place")
    ranked = (
        sizes.withColumn("_one", F.lit(1))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", _cycle(F.col("place"), weights).cast("double"))
        .withColumn("cap", (F.col("source_size") * ceiling).cast("double"))
        .withColumn("cap_level", F.col("cap") / F.col("weight"))
        .withColumn("demand", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("capped", F.sum("cap").over(by_cap) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(every) - F.sum("weight").over(by_cap) + F.col("weight"))
        .withColumn("level", (F.col("demand") - F.col("capped")) / F.col("open"))
        .withColumn("right", F.min(F.when(F.col("level") <= F.col("cap_level"), F.struct("cap_level", "place", "level"))).over(every))
    )
    target = F.coalesce(F.least("cap", F.col("right.level") * F.col("weight")), F.col("cap"))
    return ranked.select("source", "source_size", "place", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, schedules=SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: size, source_size, target, taken, and the positions of its copies (null: none).

    first_words and second_words are the words of each copy; their sum is ``taken``.  ``keep`` names columns to carry
    along.
    """
    rows = docs.select(
        *keep,
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("_order"),
    )
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_cell", F.substring("_order", 1, CELL))
    cells = rows.groupBy("_source", "_cell").agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    sizes = cells.groupBy("source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights)
    named = targets.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    within = Window.partitionBy("_source").orderBy("_cell")
    cells = attach(cells.select("_source", "_cell", (F.sum("_words").over(within) - F.col("_words")).alias("_ahead")), named, "_source")
    # The demand of all sources up to time t is a*t + b*t*t/2 words.
    first, last = (_cycle(F.col("place"), tuple(s[i] for s in schedules)) for i in (0, 1))
    total = targets.agg(F.sum(F.col("target") * first).alias("_a"), F.sum(F.col("target") * (last - first)).alias("_b"))
    inside = Window.partitionBy("_source", "_cell").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(cells, ["_source", "_cell"]).withColumn("_start", F.col("_start") + F.col("_ahead"))
    goal = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("_passes") * F.col("source_size") - F.col("_start")))
    rows = rows.withColumn("_passes", passes).withColumn("_rest", rest)
    words = [F.when(F.col("_passes") > c, F.col("size")).when(F.col("_passes") == c, F.col("_rest")).otherwise(0).cast("long") for c in (0, 1)]
    rows = rows.withColumn("first_words", words[0]).withColumn("second_words", words[1]).crossJoin(F.broadcast(total))

    def position(copy: int, taken: str) -> Column:
        done = (F.col("_start") + copy * F.col("source_size")) / F.col("target")
        time = 2 * done / (first + F.sqrt(first * first + 2 * (last - first) * done))
        return F.when(F.col(taken) > 0, F.round(F.col("_a") * time + F.col("_b") * time * time / 2, 3))

    return rows.select(
        *keep, "doc_id", "size", "source_size", "target", (F.col("first_words") + F.col("second_words")).cast("long").alias("taken"),
        "first_words", "second_words", position(0, "first_words").alias("first_position"), position(1, "second_words").alias("second_position"),
    )


def schedule(mixed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The training order: (doc_id, size, copy, words, position), a row per copy, range-sorted by position."""
    copies = F.array(*[F.struct(F.lit(c).alias("copy"), F.col(f"{n}_words").alias("words"), F.col(f"{n}_position").alias("position")) for c, n in ((0, "first"), (1, "second"))])
    out = mixed.select(*keep, "doc_id", "size", F.explode(copies).alias("_c")).select(*keep, "doc_id", "size", "_c.*").filter("words > 0")
    return out.repartitionByRange("position", "doc_id", "copy").sortWithinPartitions("position", "doc_id", "copy")
