"""Joins with user and product metadata.

Metadata tables grow with the data, so nothing is broadcast by hand: Spark does so when the statistics
say the table is small, otherwise the join shuffles, and hot users and products are split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.functions.dates import whole_days
from candor.operators.clean import ROW_KEY
from candor.skew import attach

NEW_ACCOUNT_DAYS = 7
EARLY_REVIEW_DAYS = 3


def _prefixed(meta: DataFrame, key: str, prefix: str, taken: list[str]) -> DataFrame:
    """Prefix metadata columns whose names the reviews already use or that both metadata tables have."""
    clash = set(taken) | {"avg_rating", "review_count"}
    return meta.select(key, *[F.col(c).alias(prefix + c if c in clash else c) for c in meta.columns if c != key])


def join_users(df: DataFrame, users: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    """``days_since_joining`` and the new-account flag (false, not null, when nothing is known)."""
    joined = attach(df, _prefixed(users, "user_id", "user_meta_", df.columns), "user_id")
    days = whole_days(F.col("date"), F.col("join_date"))
    return joined.withColumns(
        {"days_since_joining": days, "is_new_account_review": F.coalesce(days <= NEW_ACCOUNT_DAYS, F.lit(False))}
    )


def join_products(df: DataFrame, products: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    joined = attach(df, _prefixed(products, "product_id", "product_meta_", df.columns), "product_id")
    return joined.withColumn("days_since_listing", whole_days(F.col("date"), F.col("listing_date")))


def account_age(df: DataFrame, users: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    joined = attach(df, _prefixed(users, "user_id", "user_meta_", df.columns), "user_id")
    age = whole_days(F.col("date"), F.col("join_date"))
    return joined.withColumns(
        {"account_age_days": age, "is_suspicious_new_account": F.coalesce(age <= NEW_ACCOUNT_DAYS, F.lit(False))}
    )


def product_age(df: DataFrame, products: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    joined = attach(df, _prefixed(products, "product_id", "product_meta_", df.columns), "product_id")
    age = whole_days(F.col("date"), F.col("listing_date"))
    return joined.withColumns(
        {"product_age_days": age, "is_suspicious_early_review": F.coalesce(age <= EARLY_REVIEW_DAYS, F.lit(False))}
    )


def first_per_key(meta: DataFrame, key: str) -> DataFrame:
    """One metadata row per key: the smallest row, a map-side combinable choice."""
    rest = [c for c in meta.columns if c != key]
    return meta.groupBy(key).agg(F.min(F.struct(*rest)).alias("_m")).select(key, *[F.col(f"_m.{c}").alias(c) for c in rest])


def metadata_features(
    df: DataFrame, users: DataFrame | None, products: DataFrame | None, *, order: str = ROW_KEY
) -> DataFrame:
    """Metadata looked up per review (one match at most), missing values as 0, under model feature names."""
    out = df
    if users is not None:
        u = first_per_key(users.select("user_id", "review_count", "avg_rating", "verified_purchases"), "user_id")
        total = F.col("review_count")
        u = u.select(
            "user_id",
            total.cast("double").alias("user_review_count"),
            F.col("avg_rating").cast("double").alias("user_avg_rating"),
            F.when(total > 0, F.col("verified_purchases") / total).otherwise(0.0).alias("user_verified_ratio"),
        )
        out = attach(out, u, "user_id")
    if products is not None:
        p = first_per_key(products.select("product_id", "avg_rating", "review_count"), "product_id").select(
            "product_id",
            F.col("avg_rating").cast("double").alias("product_avg_rating"),
            F.col("review_count").cast("double").alias("product_review_count"),
        )
        out = attach(out, p, "product_id")
    added = [c for c in out.columns if c not in df.columns]
    return out.fillna(0.0, subset=added) if added else out
