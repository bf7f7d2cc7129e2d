from collections import defaultdict
from itertools import combinations

import pytest
from helpers import (
    EDGE_SCHEMA, betweenness, bipartite, by_user, clustering, eigenvector, groups, random_edges, reviews, similar_products,
    similar_users, similarity_stats,
)

from candor.operators import centrality, graph, suspicious
from candor.operators.components import connected_components

SEEDS = [(1, None), (2, "p00"), (3, "p03")]


def edges_df(spark, edges):
    return spark.createDataFrame(edges, EDGE_SCHEMA)


def test_last_review_wins(spark):
    df = reviews(spark, [("x", "p", 1, "2023-01-02"), ("x", "p", 2, "2023-01-01"), ("x", "x", 3, "2023-01-01"), ("y", "p", 4, "2023-01-01"), ("y", "p", 5, None)])
    got = {(r.user_id, r.product_id): r.rating for r in graph.review_edges(df).collect()}
    assert got == {("x", "p"): 1.0, ("x", "x"): 3.0, ("y", "p"): 5.0}


@pytest.mark.parametrize("seed,hot", SEEDS)
def test_similar_users(spark, seed, hot):
    edges = random_edges(seed, hot=hot)
    want = similar_users(edges)
    df = edges_df(spark, edges)
    flagged = {r.user_id for r in suspicious.suspicious_users(df).collect()}
    assert flagged == {u for pair in want for u in pair}
    got = {r.user_id: r.group_id for r in suspicious.suspicious_user_groups(df).collect()}
    assert got == groups(want)
    member = {r.user_id: r.profile for r in suspicious.user_profiles(df).collect()}
    pairs = {(r.user_1, r.user_2): r.similarity for r in suspicious.user_pair_similarity(df).collect()}
    assert {tuple(sorted((member[a], member[b]))) for a, b in want} == set(pairs)
    for (a, b), value in want.items():
        assert pairs[tuple(sorted((member[a], member[b])))] == pytest.approx(value)


@pytest.mark.parametrize("threshold", [0.45, 0.6, 0.9])
def test_other_thresholds(spark, threshold):
    edges = random_edges(11)
    got = {r.user_id for r in suspicious.suspicious_users(edges_df(spark, edges), min_similarity=threshold).collect()}
    assert got == {u for pair in similar_users(edges, threshold) for u in pair}


def test_threshold_case(spark):
    edges = [("a", "p", 5.0), ("b", "p", 2.0), ("c", "q", 5.0), ("d", "q", 1.0)]
    assert {r.user_id for r in suspicious.suspicious_users(edges_df(spark, edges)).collect()} == {"a", "b"}


def test_similar_products(spark):
    edges = [(f"u{i}", p, 5.0) for p, n in (("a", 10), ("b", 10), ("c", 7), ("d", 2), ("e", 2)) for i in range(n)]
    edges += [("x", "b", 5.0), ("y", "f", 1.0), ("z", "f", 1.0), ("y", "g", 1.0), ("z", "g", 1.0)]
    df = edges_df(spark, edges)
    want = similar_products(edges)
    got = {(r.product_1, r.product_2): r.jaccard for r in suspicious.product_pair_similarity(df).collect()}
    assert set(got) == set(want) and ("a", "c") in want and ("d", "e") not in want
    assert {r.product_id: r.group_id for r in suspicious.suspicious_product_groups(df).collect()} == groups(want)


@pytest.mark.parametrize("seed,hot", SEEDS)
def test_clustering_and_stats(spark, seed, hot):
    edges = random_edges(seed, hot=hot)
    df = edges_df(spark, edges)
    got = {r.user_id: r.user_clustering for r in graph.user_clustering(df).collect()}
    assert got == pytest.approx(clustering(edges))
    stats = {r.user_id: (r.avg_user_similarity, r.max_user_similarity, r.similar_user_count) for r in graph.user_similarity_stats(df).collect()}
    want = similarity_stats(edges)
    assert set(stats) == set(want)
    for u in want:
        assert stats[u] == pytest.approx(want[u])


def test_factors_multiply_out_to_all_edges(spark):
    edges = random_edges(6, hot="p02")
    members, products, links = [df.collect() for df in graph.coreview_factors(edges_df(spark, edges))]
    of_class, profile = defaultdict(set), {r.user_id: r.profile for r in members}
    for r in products:
        of_class[r.profile].add(r.product_id)
        assert r.members == sum(p == r.profile for p in profile.values())
    weight = {(r.user_1, r.user_2): r.weight for r in links}
    users, got = by_user(edges), {}
    for a, b in combinations(sorted(profile), 2):
        x, y = sorted((profile[a], profile[b]))
        if of_class[x] & of_class[y]:
            got[a, b] = len(of_class[x]) if x == y else weight.get((x, y), 1)
    assert got == {(a, b): n for a, b in combinations(sorted(users), 2) if (n := len(users[a].keys() & users[b].keys()))}


def test_clustering_shapes(spark):
    triangle = [(u, "p", 1.0) for u in "abc"]
    path = [("a", "p", 1.0), ("b", "p", 1.0), ("b", "q", 1.0), ("c", "q", 1.0)]
    assert {r.user_clustering for r in graph.user_clustering(edges_df(spark, triangle)).collect()} == {1.0}
    assert {r.user_clustering for r in graph.user_clustering(edges_df(spark, path)).collect()} == {0.0}


@pytest.mark.parametrize("hub_rows", [1_000_000, 3])
def test_centralities(spark, hub_rows):
    edges = random_edges(5, users=18, products=7, hot="p01")
    df = edges_df(spark, edges)
    got = {(r.kind, r.id): r.betweenness for r in centrality.betweenness_centrality(df, hub_rows=hub_rows).collect()}
    assert got == pytest.approx(betweenness(edges))
    some = centrality.betweenness_centrality(df, pivots=4)
    assert some.count() == len(bipartite(edges))
    rows = centrality.eigenvector_centrality(df, hub_rows=hub_rows).collect()
    want = eigenvector(edges)
    assert want is not None and all(r.converged for r in rows)
    assert {(r.kind, r.id): r.centrality for r in rows} == pytest.approx(want)
    stopped = centrality.eigenvector_centrality(df, max_rounds=2).collect()
    assert not any(r.converged for r in stopped) and all(r.centrality > 0 for r in stopped)


def test_components(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40) if i != 20] + [("z", "y"), ("hub", "n000")] + [("hub", f"leaf{i}") for i in range(30)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == groups(pairs)


def test_partition_count_does_not_matter(spark):
    df = edges_df(spark, random_edges(7, hot="p02"))
    one = graph.user_similarity_stats(df.coalesce(1)).toPandas().sort_values("user_id").round(9).values.tolist()
    many = graph.user_similarity_stats(df.repartition(7)).toPandas().sort_values("user_id").round(9).values.tolist()
    assert one == many
