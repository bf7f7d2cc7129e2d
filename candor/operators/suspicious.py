"""Rule-based flags: look-alike users and products, and products with implausible ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.lineage import written
from candor.operators.components import connected_components
from candor.operators.graph import LOOK_ALIKE
from candor.operators.similarity import profile_edges, profiles, similar_sets
from candor.skew import attach

MIN_SIMILARITY = LOOK_ALIKE
MIN_SHARED_REVIEWERS = 3
MIN_REVIEWS, MIN_RATING, MAX_VARIANCE, MIN_SHARE = 5, 4.5, 0.5, 0.8


def user_pairs(edges: DataFrame, membership: DataFrame, *, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Similar pairs of user profiles (same products and ratings = same profile).

    similarity = (Jaccard of products + rating agreement) / 2.  Rating agreement is at most 1, so a pair
    needs a Jaccard similarity of ``2 * min_similarity - 1``, which drives the set-similarity join.
    """
    own = profile_edges(edges.select("user_id", "product_id", "rating"), membership, "user_id")
    found = similar_sets(own, "profile", "product_id", threshold=2 * min_similarity - 1, value="rating")
    return (
        found.withColumn("similarity", (F.col("jaccard") + F.col("value_similarity")) / 2)
        .filter(F.col("similarity") >= min_similarity)
        .select(
            F.col("set_1").alias("user_1"), F.col("set_2").alias("user_2"), "members_1", "members_2", "shared",
            "jaccard", F.col("value_similarity").alias("rating_similarity"), "similarity",
        )
    )


def user_profiles(edges: DataFrame) -> DataFrame:
    """(user_id, profile, members, size)."""
    return profiles(edges, "user_id", "product_id", ("rating",))


def user_pair_similarity(edges: DataFrame, *, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs of profiles, and each profile of several users with itself: its members are alike in everything.

    ``user_profiles`` has the members of a profile, so every similar pair of users can be read off both tables.
    """
    membership = written(user_profiles(edges), "members")
    one = F.lit(1.0)
    twins = _shared_profiles(membership, "user_id").select(
        F.col("profile").alias("user_1"), F.col("profile").alias("user_2"), F.col("members").alias("members_1"),
        F.col("members").alias("members_2"), F.col("size").alias("shared"), one.alias("jaccard"), one.alias("rating_similarity"), one.alias("similarity"),
    )
    return user_pairs(edges, membership, min_similarity=min_similarity).unionByName(twins)


def _shared_profiles(membership: DataFrame, key: str) -> DataFrame:
    """One row per profile that several sets have."""
    return membership.filter((F.col(key) == F.col("profile")) & (F.col("members") > 1))


def product_profiles(edges: DataFrame) -> DataFrame:
    """(product_id, profile, members, size)."""
    return profiles(edges, "product_id", "user_id")


def product_pairs(edges: DataFrame, membership: DataFrame, *, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs of product profiles with similar reviewer sets and at least three shared reviewers."""
    own = profile_edges(edges.select("product_id", "user_id"), membership, "product_id").filter(
        F.col("size") >= MIN_SHARED_REVIEWERS
    )
    return similar_sets(
        own, "profile", "user_id", threshold=min_similarity, min_overlap=MIN_SHARED_REVIEWERS
    ).filter(F.col("jaccard") >= min_similarity).select(
        F.col("set_1").alias("product_1"), F.col("set_2").alias("product_2"), "members_1", "members_2", "shared", "jaccard"
    )


def product_pair_similarity(edges: DataFrame, *, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Pairs of profiles, and each profile of several products with itself if it has enough reviewers."""
    membership = written(product_profiles(edges), "members")
    twins = _shared_profiles(membership, "product_id").filter(F.col("size") >= MIN_SHARED_REVIEWERS).select(
        F.col("profile").alias("product_1"), F.col("profile").alias("product_2"), F.col("members").alias("members_1"),
        F.col("members").alias("members_2"), F.col("size").alias("shared"), F.lit(1.0).alias("jaccard"),
    )
    return product_pairs(edges, membership, min_similarity=min_similarity).unionByName(twins)


def _flagged_members(membership: DataFrame, pairs: DataFrame, a: str, b: str, key: str, min_size: int) -> DataFrame:
    """Members of profiles that hold several sets or have a similar partner; no iteration is needed for that."""
    partners = pairs.select(F.col(a).alias("profile")).union(pairs.select(F.col(b).alias("profile"))).distinct()
    found = attach(membership, partners.withColumn("_p", F.lit(True)), "profile")
    twins = (F.col("members") >= 2) & (F.col("size") >= min_size)
    return found.filter(twins | F.col("_p")).select(key)


def suspicious_users(edges: DataFrame, *, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    membership = written(user_profiles(edges), "members")
    pairs = written(user_pairs(edges, membership, min_similarity=min_similarity).select("user_1", "user_2"), "pairs")
    return _flagged_members(membership, pairs, "user_1", "user_2", "user_id", 1)


def _groups(membership: DataFrame, pairs: DataFrame, a: str, b: str, key: str, min_size: int) -> DataFrame:
    """(group_id, member): long form, because the member list of a group is unbounded."""
    parts = connected_components(pairs, a, b).select(F.col("node").alias("profile"), "component")
    joined = attach(membership, parts, "profile")
    twins = (F.col("members") >= 2) & (F.col("size") >= min_size)
    return joined.filter(twins | F.col("component").isNotNull()).select(
        F.coalesce("component", "profile").alias("group_id"), key
    )


def suspicious_user_groups(edges: DataFrame, *, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """Connected groups of similar users; the group is named after its smallest member."""
    membership = written(user_profiles(edges), "members")
    pairs = user_pairs(edges, membership, min_similarity=min_similarity)
    return _groups(membership, pairs, "user_1", "user_2", "user_id", 1)


def suspicious_product_groups(edges: DataFrame, *, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    membership = written(product_profiles(edges), "members")
    pairs = product_pairs(edges, membership, min_similarity=min_similarity)
    return _groups(membership, pairs, "product_1", "product_2", "product_id", MIN_SHARED_REVIEWERS)


def product_metrics(edges: DataFrame) -> DataFrame:
    """Per product over distinct reviewers: count, mean, population variance, share of ratings of 4 and more."""
    return edges.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("review_count"),
        F.avg("rating").alias("avg_rating"),
        F.var_pop("rating").alias("rating_variance"),
        F.avg(F.when(F.col("rating") >= 4, 1.0).otherwise(0.0)).alias("high_rating_pct"),
    )


def suspicious_products(edges: DataFrame) -> DataFrame:
    return product_metrics(edges).filter(
        (F.col("review_count") >= MIN_REVIEWS)
        & (F.col("avg_rating") >= MIN_RATING)
        & (F.col("rating_variance") < MAX_VARIANCE)
        & (F.col("high_rating_pct") >= MIN_SHARE)
    )
