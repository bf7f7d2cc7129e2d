"""Hot keys: tiles, and light and heavy items of the set joins."""

import random
from collections import Counter
from itertools import combinations

import pytest
from helpers import EDGE_SCHEMA, by_user, random_edges, similar_users
from pyspark.sql import functions as F

from candor.lineage import cut
from candor.operators import similarity, suspicious
from candor.operators.similarity import overlapping_sets, profile_edges, profiles, similar_sets
from candor.skew import tiled_join


def test_tiles_join_like_a_plain_join_and_bound_a_task(spark):
    rnd = random.Random(1)
    left = [(0 if rnd.random() < 0.5 else rnd.randrange(1, 9), i) for i in range(600)] + [(None, 1)]
    right = [(0 if rnd.random() < 0.4 else rnd.randrange(1, 9), i) for i in range(500)] + [(None, 2)]
    a, b = spark.createDataFrame(left, "k int, x int"), spark.createDataFrame(right, "k int, y int")
    want = Counter((k, x, y) for k, x in left for m, y in right if k is not None and k == m)
    for tile in (20, 100_000):
        assert Counter(tuple(r) for r in tiled_join(a, b, "k", tile=tile).select("k", "x", "y").collect()) == want
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("candor.skew._FEW", 0)  # as if there were very many hot keys
        assert Counter(tuple(r) for r in tiled_join(a, b, ["k"], tile=20).select("k", "x", "y").collect()) == want


def test_tiles_of_a_hot_key_are_even(spark):
    """One product holds half of all rows: its pairs spread over the grid."""
    rows = spark.range(4_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    met = tiled_join(rows, rows.withColumnRenamed("x", "y"), "k", tile=250).filter("k = 0")
    per_cell = met.groupBy(F.pmod(F.xxhash64("k", "x"), F.lit(8)).alias("i"), F.pmod(F.xxhash64("k", "y"), F.lit(8)).alias("j")).count().collect()
    sizes = sorted(r["count"] for r in per_cell)
    assert len(sizes) == 64 and sum(sizes) == 2_000**2 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def edges_of(spark, edges):
    return spark.createDataFrame(edges, EDGE_SCHEMA)


@pytest.mark.parametrize("light", [0, 3, 64])
def test_light_and_heavy_items_give_the_same_pairs(spark, light):
    edges = random_edges(3, users=40, products=9, hot="p03")
    df = edges_of(spark, edges)
    membership = cut(profiles(df, "user_id", "product_id"))
    own = cut(profile_edges(df.select("user_id", "product_id"), membership, "user_id"))
    sets = {r.profile: frozenset(by_user(edges)[r.profile]) for r in membership.collect()}
    met = {(a, b): len(sets[a] & sets[b]) for a, b in combinations(sorted(sets), 2)}
    got = {(r.set_1, r.set_2): r.shared for r in overlapping_sets(own, "profile", "product_id", light=light).collect()}
    assert got == {k: n for k, n in met.items() if n >= 2}
    for threshold, least in ((0.4, 1), (0.7, 3)):
        found = similar_sets(own, "profile", "product_id", threshold=threshold, min_overlap=least, light=light).collect()
        want = {k: n / len(sets[k[0]] | sets[k[1]]) for k, n in met.items() if n >= least and n / len(sets[k[0]] | sets[k[1]]) >= threshold - 1e-9}
        assert {(r.set_1, r.set_2): r.jaccard for r in found} == pytest.approx(want)


def test_ratings_agree_over_light_and_heavy_items(spark, monkeypatch):
    monkeypatch.setattr(suspicious, "similar_sets", lambda *a, **k: similar_sets(*a, **k, light=4))
    edges = random_edges(8, users=40, products=8, hot="p01")
    assert {r.user_id for r in suspicious.suspicious_users(edges_of(spark, edges)).collect()} == {u for pair in similar_users(edges) for u in pair}


def test_small_sets_meet_on_two_items(spark, monkeypatch):
    """Sets that share an item only do not meet where two are needed; results are those of all pairs, beside larger sets too."""
    rng = random.Random(3)
    sets = {f"s{n:03}": frozenset(rng.sample(range(60), 4 if n < 380 else 12)) for n in range(400)}
    sets |= {f"t{n:03}": frozenset([*list(sets[f"s{n * 9:03}"])[:3], 99]) for n in range(44)}
    rows = [(s, f"i{i}", float(i % 3), 1, len(items)) for s, items in sets.items() for i in items]
    own = spark.createDataFrame(rows, "profile string, item string, rating double, members long, size long")
    met = []

    def counted(left, right, key, **options):
        out = tiled_join(left, right, key, **options)
        met.append(out.filter("set_1 < set_2").count())
        return out

    monkeypatch.setattr(similarity, "tiled_join", counted)
    found = similar_sets(own, "profile", "item", threshold=0.4, value="rating").collect()
    pairs = [(a, b, sets[a] & sets[b], sets[a] | sets[b]) for a in sets for b in sets if a < b]
    small = [p for p in pairs if p[2] and max(len(sets[p[0]]), len(sets[p[1]])) <= 8]
    assert met and met[0] < len(small) / 5
    assert {(r.set_1, r.set_2): r.shared for r in found} == {(a, b): len(x) for a, b, x, u in pairs if len(x) >= 0.4 * len(u)}
    assert {(r.set_1, r.set_2): r.shared for r in overlapping_sets(own, "profile", "item").collect()} == {(a, b): len(x) for a, b, x, _ in pairs if len(x) > 1}
