"""The graph feature table: one row per review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.lineage import written
from candor.operators.behavior import same_day_counts
from candor.operators.centrality import betweenness_centrality, eigenvector_centrality
from candor.operators.clean import ROW_KEY
from candor.operators.graph import bipartite_degrees, review_edges, user_clustering, user_similarity_stats
from candor.operators.meta import metadata_features
from candor.operators.suspicious import suspicious_products, suspicious_users
from candor.skew import attach

GRAPH_FEATURES = [
    "user_degree", "product_degree", "user_clustering", "user_betweenness", "user_eigenvector_centrality",
    "avg_user_similarity", "max_user_similarity", "similar_user_count", "is_suspicious_user",
    "is_suspicious_product", "same_day_review_count", "product_same_day_review_count", "user_review_count",
    "user_avg_rating", "user_verified_ratio", "product_avg_rating", "product_review_count",
]


def graph_features(
    df: DataFrame, users: DataFrame | None = None, products: DataFrame | None = None, *,
    order: str = ROW_KEY, target: str = "verified_purchase", centralities: bool | DataFrame = True,
) -> DataFrame:
    """(order, features..., target): every feature a double without nulls, the target outside the features.

    Clustering is that of the co-review graph (on the bipartite graph it is 0 for everyone).  The edge table,
    read by every part, is written out once.  ``centralities`` may be a table of them by user, else they are taken from ``df`` or left out.
    """
    edges = written(review_edges(df, order=order), "edges")
    user_degree, product_degree = bipartite_degrees(edges)
    flagged = suspicious_users(edges).withColumn("is_suspicious_user", F.lit(1.0))
    per_user = (
        user_degree.select("user_id", "user_degree")
        .join(user_clustering(edges), "user_id", "left")
        .join(user_similarity_stats(edges), "user_id", "left")
        .join(flagged, "user_id", "left")
    )
    if isinstance(centralities, DataFrame):
        per_user = per_user.join(centralities, "user_id", "left")
    elif centralities:
        for name, table in (
            ("user_betweenness", betweenness_centrality(edges).withColumnRenamed("betweenness", "v")),
            ("user_eigenvector_centrality", eigenvector_centrality(edges).withColumnRenamed("centrality", "v")),
        ):
            mine = table.filter("kind = 'user'").select(F.col("id").alias("user_id"), F.col("v").alias(name))
            per_user = per_user.join(mine, "user_id", "left")
    bad = suspicious_products(edges).select("product_id", F.lit(1.0).alias("is_suspicious_product"))
    per_product = product_degree.join(bad, "product_id", "left")
    base = [order, "user_id", "product_id", "date", *([target] if target in df.columns else [])]
    rows = attach(df.select(*base), per_user, "user_id")
    rows = attach(rows, per_product, "product_id")
    rows = metadata_features(same_day_counts(rows, order=order), users, products, order=order)
    names = [c for c in GRAPH_FEATURES if c in rows.columns]
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]
    return rows.select(order, *values, *[c for c in (target,) if c in df.columns])
