"""Set-similarity joins that never list all pairs of a group.

Three exact reductions are combined (they change the work, not the result):

* Sets with the same content collapse into one *profile*; the pair list holds one row per pair of
  profiles, with member counts, plus a table that maps members to profiles.  A product reviewed by millions
  of one-review users yields a handful of profiles.
* Items are put in one global order, rare first.  Two sets that overlap enough must share an item early in
  both, and the position of the first shared item bounds the overlap (prefix and positional filters of the
  set-similarity-join literature: Bayardo et al. 2007, Xiao et al. 2008).  Hot items come last and are
  hardly ever joined on.
* The sizes of both sets are part of the join key, so that an item that can only matter for certain size
  combinations is only joined for those.
* Small sets (at most ``SMALL`` items) meet on two items at a time.  Sets that share ``o`` items share two of them among the
  first ``size - o + 2`` of each (the extended prefixes of Wang et al. 2012), so hardly any meet that are not alike, however
  frequent single items are; a set has at most 120 such pairs.  Only where one shared item is enough do they meet on one.
* In pairs with a larger set, light and heavy items are treated apart.  The sets of an item with at most ``LIGHT`` of them are simply paired and counted: at
  most LIGHT / 2 pairs per row, no candidates, no verification.  Only sets that meet on heavy items go through the filters
  above, in tiles of bounded size, and only heavy items are looked up to complete a count.

The position of an item inside its set is not a rank over the set (that would gather a huge set in one
task) but a lower bound from a histogram with a bounded number of slots.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.lineage import cut, written
from candor.skew import attach, tiled_join

SLOTS_PER_OCTAVE = 64
EXACT_SIZES = 8
SMALL = 16  # items of a set up to which it is a row
CLASS_RATIO = 1.25
EPS = 1e-9
LIGHT = 64  # sets of an item up to which they are paired directly


def profiles(edges: DataFrame, set_col: str, item_col: str, attributes: tuple[str, ...] = ()) -> DataFrame:
    """(set, profile, members, size): sets with equal items and attributes share the profile named after the smallest.

    Content equality is tested with the size and two independent 64-bit fingerprints that are sums over the
    set (xor), hence combined on the map side.
    """
    content = [item_col, *attributes]
    sets = edges.groupBy(set_col).agg(
        F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64(*content)).alias("_s1"),
        F.bit_xor(F.xxhash64(F.lit("second"), *reversed(content))).alias("_s2"),
    )
    named = sets.groupBy("size", "_s1", "_s2").agg(F.min(set_col).alias("profile"), F.count(F.lit(1)).alias("members"))
    return attach(sets, named, ["size", "_s1", "_s2"]).drop("_s1", "_s2")


def profile_edges(edges: DataFrame, membership: DataFrame, set_col: str) -> DataFrame:
    """Edges of the representatives only, with ``members`` and ``size``; the set column is renamed ``profile``."""
    item_cols = [c for c in edges.columns if c != set_col]
    reps = membership.filter(F.col(set_col) == F.col("profile")).select(set_col, "members", "size")
    kept = attach(edges, reps, set_col, how="inner")
    return kept.withColumnRenamed(set_col, "profile")


def rare_first(members: DataFrame, set_col: str, item_col: str) -> DataFrame:
    """Add ``pos``: a lower bound of the item's position in its set when items are ordered rare first.

    The global order is (log2 of item frequency, hash slot); a set touches at most a few thousand slots,
    so the window over its histogram is bounded however large the set is.
    """
    freq = members.groupBy(item_col).agg(F.count(F.lit(1)).alias("_f"))
    placed = attach(members, freq, item_col).withColumn(
        "_slot",
        F.floor(F.log2(F.col("_f").cast("double"))).cast("int") * SLOTS_PER_OCTAVE
        + F.pmod(F.xxhash64(item_col), F.lit(SLOTS_PER_OCTAVE)).cast("int"),
    )
    hist = placed.groupBy(set_col, "_slot").agg(F.count(F.lit(1)).alias("_k"))
    earlier = Window.partitionBy(set_col).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("pos", F.coalesce(F.sum("_k").over(earlier), F.lit(0)) + 1)
    # Joined with itself by every caller, so it is written out once.
    return cut(attach(placed, hist, [set_col, "_slot"]).drop("_slot", "_f", "_k"))


def _class_of(size: Column) -> Column:
    big = F.lit(EXACT_SIZES) + 1 + F.floor(F.log(size / F.lit(float(EXACT_SIZES))) / F.log(F.lit(CLASS_RATIO)))
    return F.when(size <= EXACT_SIZES, size).otherwise(big).cast("int")


def _class_low(k: Column) -> Column:
    big = F.floor(EXACT_SIZES * F.pow(F.lit(CLASS_RATIO), k - EXACT_SIZES - 1)) - 1
    return F.when(k <= EXACT_SIZES, k).otherwise(big)


def _needed(a: Column, b: Column, threshold: float, min_overlap: int) -> Column:
    """Overlap that sizes ``a`` and ``b`` need for a Jaccard similarity of ``threshold``."""
    return F.greatest(F.lit(min_overlap), F.ceil((a + b) * (threshold / (1 + threshold)) - EPS))


def _split(edges: DataFrame, set_col: str, item_col: str, light: int) -> tuple[DataFrame, bool]:
    """Edges with ``_heavy`` (the item has more than ``light`` sets) and ``_h`` (heavy items of the set), and whether there are any."""
    freq = edges.groupBy(item_col).agg((F.count(F.lit(1)) > light).alias("_heavy"))
    placed = written(attach(edges, freq, item_col), "placed")
    many = placed.filter("_heavy").groupBy(set_col).agg(F.count(F.lit(1)).alias("_h"))
    if placed.filter("_heavy").isEmpty():
        return placed.withColumn("_h", F.lit(0).cast("long")), False
    return written(attach(placed, many, set_col).withColumn("_h", F.coalesce("_h", F.lit(0))), "placed"), True


_SIZES = ["members_1", "members_2", "size_1", "size_2", "_h1", "_h2"]


def _sides(edges: DataFrame, set_col: str, item_col: str, value: str | None) -> tuple[DataFrame, DataFrame]:
    return tuple(
        edges.select(
            item_col, F.col(set_col).alias(f"set_{n}"), F.col("members").alias(f"members_{n}"), F.col("size").alias(f"size_{n}"),
            F.col("_h").alias(f"_h{n}"), *([F.col(value).alias(f"_v{n}")] if value else []),
        )
        for n in (1, 2)
    )


def _counted(met: DataFrame, value: str | None) -> DataFrame:
    """Shared items of each met pair, and the sum and number of their agreements."""
    agree = 1.0 - F.abs(F.col("_v1") - F.col("_v2")) / 5.0 if value else F.lit(None).cast("double")
    return met.groupBy("set_1", "set_2").agg(
        F.count(F.lit(1)).alias("shared"), *([F.sum(agree).alias("_vs"), F.count(agree).alias("_vn")] if value else []),
        *[F.max(c).alias(c) for c in _SIZES],
    )


def _overlaps(
    placed: DataFrame, set_col: str, item_col: str, value: str | None, fits: Column, needed: Column, heavy_pairs: DataFrame | None
) -> DataFrame:
    """All pairs that can reach ``needed`` shared items, with exact counts.

    ``fits`` is a condition on size_1 and size_2.  ``heavy_pairs`` (set_1 < set_2) must hold every pair in question that shares
    heavy items only; other pairs in it do no harm.
    """
    one, two = _sides(placed.filter(~F.col("_heavy")), set_col, item_col, value)
    met = one.join(two, item_col).filter((F.col("set_1") < F.col("set_2")) & fits)
    pairs = _counted(met, value)
    if heavy_pairs is not None:
        pairs = cut(pairs.filter(F.col("shared") + F.least("_h1", "_h2") >= needed))
        open_pairs = pairs.filter((F.col("_h1") > 0) & (F.col("_h2") > 0)).select("set_1", "set_2").union(heavy_pairs).distinct()
        one, two = _sides(placed.filter("_heavy"), set_col, item_col, value)
        rest = _counted(open_pairs.join(one, "set_1").join(two, ["set_2", item_col]).filter(fits), value)
        sums = [c for c in ("shared", "_vs", "_vn") if c in pairs.columns]
        both = pairs.unionByName(rest).groupBy("set_1", "set_2")
        pairs = both.agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in _SIZES])
    pairs = pairs.filter(F.col("shared") >= needed)
    out = pairs.withColumn("jaccard", F.col("shared") / (F.col("size_1") + F.col("size_2") - F.col("shared")))
    if value:
        out = out.withColumn("value_similarity", F.when(F.col("_vn") > 0, F.col("_vs") / F.col("_vn")))
    return out.drop("_vs", "_vn", "_h1", "_h2")


def _small_sets(edges: DataFrame, set_col: str, item_col: str, value: str | None) -> DataFrame:
    """(set, members, size, _items): a row per set, its few items rare first."""
    freq = edges.groupBy(item_col).agg(F.count(F.lit(1)).alias("_f"))
    item = F.struct("_f", F.col(item_col).alias("i"), *([F.col(value).alias("v")] if value else []))
    gathered = (
        attach(edges, freq, item_col).groupBy(F.col(set_col).alias("set"))
        .agg(F.max("members").alias("members"), F.max("size").alias("size"), F.sort_array(F.collect_list(item)).alias("_items"))
    )
    return written(gathered, "sets")


def _repeated(marks: DataFrame, key: list[str]) -> DataFrame:
    """Marks whose key occurs more than once, written out: most meet nothing, so only their keys are counted and they go no further."""
    often = marks.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    return written(attach(marks, often, key, how="left_semi"), "marks")


def _small_pairs(
    edges: DataFrame, set_col: str, item_col: str, value: str | None, fits: Callable[[Column, Column], Column],
    needed: Callable[[Column, Column], Column], small: int,
) -> DataFrame:
    """All pairs of sets of at most ``small`` items whose sizes fit and that share as many items as ``needed``, with exact counts."""
    sets = _small_sets(edges, set_col, item_col, value)
    size, items = F.col("size"), F.col("_items")
    partners = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(small).cast("long")), lambda n: fits(size, n))
    single = F.when(F.exists(partners, lambda n: needed(size, n) <= 1), size).otherwise(0)
    strict = F.filter(partners, lambda n: needed(size, n) >= 2)
    double = F.greatest(F.coalesce(F.array_max(F.transform(strict, lambda n: size - needed(size, n) + 2)), F.lit(0)), F.lit(0))
    first = lambda n: F.slice(items, 1, n.cast("int"))
    mark = lambda kind, at, *of: F.struct(F.lit(kind).alias("kind"), F.xxhash64(*of).alias("key"), (at + 1).cast("int").alias("at"))
    ones = F.transform(first(single), lambda x, at: mark(1, at, x["i"]))
    twos = F.transform(first(double), lambda x, at: F.transform(first(at), lambda y: mark(2, at, y["i"], x["i"])))
    marks = sets.select("set", "size", F.explode(F.concat(ones, F.flatten(twos))).alias("_m")).select("set", "size", "_m.*")
    marks = _repeated(marks, ["kind", "key"])
    side = lambda n: marks.select("kind", "key", *[F.col(c).alias(f"{c}_{n}") for c in ("set", "size", "at")])
    a, b = F.col("size_1"), F.col("size_2")
    o = needed(a, b)
    both = (o >= 2) & (F.col("at_1") <= a - o + 2) & (F.col("at_2") <= b - o + 2)
    met = tiled_join(side(1), side(2), ["kind", "key"]).filter(
        (F.col("set_1") < F.col("set_2")) & fits(a, b) & F.when(F.col("kind") == 1, o <= 1).otherwise(both)
    )
    pairs = written(met.select("set_1", "set_2").distinct(), "met")
    # Hardly any set meets another, so the sets are moved once and those that do twice more.
    asked = pairs.select(F.col("set_1").alias("set")).union(pairs.select("set_2")).distinct()
    sets = written(attach(sets, asked, "set", how="left_semi"), "met-sets")
    for n in (1, 2):
        pairs = attach(pairs, sets.toDF(*[f"{c}_{n}" for c in sets.columns]), f"set_{n}", how="inner")
    agree = lambda x, y: 1.0 - F.abs(x["v"] - y["v"]) / 5.0 if value else F.lit(1.0)
    shared = F.flatten(
        F.transform("_items_1", lambda x: F.transform(F.filter("_items_2", lambda y: y["i"] == x["i"]), lambda y: agree(x, y)))
    )
    pairs = pairs.withColumn("_agree", shared).withColumn("shared", F.size("_agree").cast("long")).filter(F.col("shared") >= o)
    out = pairs.withColumn("jaccard", F.col("shared") / (a + b - F.col("shared")))
    if value:
        known = F.filter("_agree", lambda x: x.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda t, x: t + x)
        out = out.withColumn("value_similarity", F.when(F.size(known) > 0, total / F.size(known)))
    return out.drop("_agree", "_items_1", "_items_2")


def _with_large(edges: DataFrame, set_col: str, item_col: str, small: int, least: int) -> DataFrame | None:
    """What pairs with a set of more than ``small`` items can share: the items of such sets, in sets of ``least`` items and more."""
    large = edges.filter(F.col("size") > small)
    if large.isEmpty():
        return None
    asked = edges.filter(F.col("size") >= least)
    return written(attach(asked, large.select(item_col).distinct(), item_col, how="left_semi"), "large")


def similar_sets(
    edges: DataFrame, set_col: str, item_col: str, *, threshold: float, min_overlap: int = 1, value: str | None = None, light: int = LIGHT,
    small: int = SMALL,
) -> DataFrame:
    """Pairs of profiles whose item sets have Jaccard similarity >= ``threshold`` and share ``min_overlap`` items.

    ``edges`` are profile edges (profile, item, [value], members, size).  Returns (set_1, set_2, members_1,
    members_2, shared, size_1, size_2, jaccard[, value_similarity]) with set_1 < set_2; ``value_similarity`` is the mean of
    ``1 - |v1 - v2| / 5`` over shared items.
    """
    t = max(threshold, 1e-6)
    needed = lambda a, b: _needed(a, b, t, min_overlap)
    fits = lambda a, b: (F.least(a, b) >= F.greatest(a, b) * t - EPS) & (F.least(a, b) >= needed(a, b))
    a, b = F.col("size_1"), F.col("size_2")
    edges = written(edges, "set-edges")
    found = [_small_pairs(edges.filter(F.col("size") <= small), set_col, item_col, value, fits, needed, max(small, 1))]
    rest = _with_large(edges, set_col, item_col, small, math.ceil((small + 1) * t - EPS))
    if rest is not None:
        placed, any_heavy = _split(rest, set_col, item_col, light)
        candidates = _heavy_candidates(placed, set_col, item_col, t, min_overlap) if any_heavy else None
        found.append(_overlaps(placed, set_col, item_col, value, fits(a, b) & (F.greatest(a, b) > small), needed(a, b), candidates))
    return reduce(DataFrame.unionByName, found).filter((F.col("jaccard") >= threshold - EPS) & (F.col("shared") >= min_overlap))


def _heavy_candidates(placed: DataFrame, set_col: str, item_col: str, t: float, min_overlap: int) -> DataFrame:
    """Pairs that can be similar and whose first shared item, rare first, is heavy."""
    heavy = placed.filter("_heavy").select(set_col, item_col, F.lit(True).alias("_heavy"))
    m = rare_first(placed.select(set_col, item_col, "size"), set_col, item_col)
    m = attach(m, heavy, [set_col, item_col], how="inner").select(set_col, item_col, "size", "pos")
    size, pos = F.col("size"), F.col("pos")
    partner = F.filter(
        F.sequence(_class_of(F.greatest(F.floor(size * t + EPS), F.lit(1))), _class_of(F.ceil(size / t + EPS))),
        lambda k: 1 + size - pos
        >= _needed(size, F.greatest(_class_low(k), F.ceil(size * t - EPS)), t, min_overlap),
    )
    tokens = cut(m.withColumn("_class", _class_of(size)).withColumn("_partner", F.explode(partner)))
    side = lambda cond, tag, lo, hi: tokens.filter(cond).select(
        item_col, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"),
        F.col(set_col).alias(f"_set{tag}"), F.col("size").alias(f"_size{tag}"), F.col("pos").alias(f"_pos{tag}"),
    )
    left = side(F.col("_class") <= F.col("_partner"), 1, "_class", "_partner")
    right = side(F.col("_class") >= F.col("_partner"), 2, "_partner", "_class")
    met = tiled_join(left, right, [item_col, "_lo", "_hi"]).filter(
        ((F.col("_lo") < F.col("_hi")) | (F.col("_set1") < F.col("_set2")))
        & (F.least("_size1", "_size2") >= F.greatest("_size1", "_size2") * t - EPS)
        & (
            1 + F.least(F.col("_size1") - F.col("_pos1"), F.col("_size2") - F.col("_pos2"))
            >= _needed(F.col("_size1"), F.col("_size2"), t, min_overlap)
        )
    )
    return met.select(F.least("_set1", "_set2").alias("set_1"), F.greatest("_set1", "_set2").alias("set_2")).distinct()


def overlapping_sets(edges: DataFrame, set_col: str, item_col: str, *, light: int = LIGHT, small: int = SMALL) -> DataFrame:
    """Pairs of profiles that share at least two items, with the exact count in ``shared``.

    Such a pair shares an item that is not the most frequent one of either set, so the hottest item of every
    set is left out when heavy items are joined.  ``edges`` should be a written table, as it is read several times.
    """
    edges = edges.select(set_col, item_col, "members", "size")
    two = lambda a, b: F.lit(2)
    near = _small_pairs(edges.filter(F.col("size") <= small), set_col, item_col, None, lambda a, b: F.lit(True), two, max(small, 1))
    rest = _with_large(edges, set_col, item_col, small, 2)
    if rest is None:
        return near
    placed, any_heavy = _split(rest, set_col, item_col, light)
    candidates = None
    if any_heavy:
        heavy = placed.filter("_heavy").select(set_col, item_col, F.lit(True).alias("_heavy"))
        early = rare_first(placed.select(set_col, item_col, "size"), set_col, item_col).filter(F.col("pos") < F.col("size"))
        early = cut(attach(early, heavy, [set_col, item_col], how="inner").select(set_col, item_col))
        met = tiled_join(early.withColumnRenamed(set_col, "set_1"), early.withColumnRenamed(set_col, "set_2"), item_col)
        candidates = met.filter(F.col("set_1") < F.col("set_2")).select("set_1", "set_2").distinct()
    larger = F.greatest("size_1", "size_2") > small
    return near.unionByName(_overlaps(placed, set_col, item_col, None, larger, F.lit(2), candidates))
