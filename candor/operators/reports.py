"""Report tables: what the overview, network and insight pages show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.functions.dates import whole_days
from candor.operators.clean import ROW_KEY
from candor.operators.meta import NEW_ACCOUNT_DAYS
from candor.skew import attach

BURST_DAY_REVIEWS = 3
PREVIEW_CHARS = 100


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One row out of one-row tables with different columns."""
    names = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def _count_if(condition):
    return F.sum(F.when(condition, 1).otherwise(0))


def user_product_metrics(df: DataFrame, users: DataFrame | None = None, *, order: str = ROW_KEY) -> DataFrame:
    """One row: users and products with one and with several reviews, pairs, and shares of new and verified."""
    n = F.count(F.lit(1)).alias("n")
    one, many = F.col("n") == 1, F.col("n") > 1
    parts = [
        df.groupBy("user_id").agg(n).agg(
            _count_if(one).alias("users_with_single_review"), _count_if(many).alias("users_with_multiple_reviews")
        ),
        df.groupBy("product_id").agg(n).agg(
            _count_if(one).alias("products_with_single_review"), _count_if(many).alias("products_with_multiple_reviews")
        ),
        df.groupBy("user_id", "product_id").agg(n).agg(
            F.count(F.lit(1)).alias("user_product_pairs"),
            _count_if(many).alias("user_product_pairs_with_multiple_reviews"),
        ),
    ]
    if users is not None:
        joined = attach(df.select(order, "user_id", "date", "verified_purchase"), users.select("user_id", "join_date"), "user_id")
        fresh = whole_days(F.col("date"), F.col("join_date")) <= NEW_ACCOUNT_DAYS
        parts.append(
            joined.agg(
                F.avg(F.when(fresh, 1.0).otherwise(0.0)).alias("new_user_review_percentage"),
                F.avg(F.col("verified_purchase").cast("double")).alias("verified_purchase_percentage"),
            )
        )
    return side_by_side(parts)


def summary_cards(df: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Totals for the overview page; ``users`` and ``products`` are the flagged ids."""
    unverified = _count_if(~F.col("verified_purchase"))
    total = F.count(F.lit(1))
    return side_by_side(
        [
            df.agg(
                total.alias("total_reviews"),
                unverified.alias("unverified_reviews"),
                F.when(total > 0, F.round(unverified / total * 100, 1)).otherwise(0.0).alias("unverified_pct"),
            ),
            users.agg(F.count(F.lit(1)).alias("suspicious_users")),
            products.agg(F.count(F.lit(1)).alias("flagged_products")),
        ]
    )


def rating_distribution(df: DataFrame, *, by_verified: bool = True) -> DataFrame:
    keys = ["verified_purchase", "rating"] if by_verified and "verified_purchase" in df.columns else ["rating"]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def verification_status(df: DataFrame) -> DataFrame:
    return df.groupBy("verified_purchase").agg(F.count(F.lit(1)).alias("n"))


def daily_burst_days(df: DataFrame, *, user_id: str | None = None, product_id: str | None = None) -> DataFrame:
    """Reviews per calendar day, overall or of one user or product, with days above three marked."""
    if user_id:
        df = df.filter(F.col("user_id") == user_id)
    elif product_id:
        df = df.filter(F.col("product_id") == product_id)
    days = df.filter(F.col("date").isNotNull()).groupBy(F.to_date("date").alias("day")).agg(F.count(F.lit(1)).alias("review_count"))
    return days.withColumn("is_burst", F.col("review_count") > BURST_DAY_REVIEWS)


def flag_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(_count_if(F.col("is_suspicious")).alias("suspicious"), F.count(F.lit(1)).alias("total"))


def network_stats(edges: DataFrame, highlighted: DataFrame | None = None) -> DataFrame:
    """Counts of users, products and edges, density over all nodes, and highlighted users."""
    parts = [
        edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("d")).agg(
            F.count(F.lit(1)).alias("users"), F.coalesce(F.sum("d"), F.lit(0)).alias("edges")
        ),
        edges.select("product_id").distinct().agg(F.count(F.lit(1)).alias("products")),
    ]
    if highlighted is not None:
        parts.append(highlighted.agg(F.count(F.lit(1)).alias("highlighted_users")))
    else:
        parts.append(edges.agg(F.lit(0).cast("bigint").alias("highlighted_users")))
    n = (F.col("users") + F.col("products")).cast("double")
    return side_by_side(parts).withColumn(
        "density", F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0)
    )


def network_nodes(edges: DataFrame, highlighted: DataFrame) -> DataFrame:
    """(kind, id, degree, is_highlighted)."""
    users = edges.groupBy("user_id").agg(F.count(F.lit(1)).alias("degree"))
    marked = users.join(highlighted.select("user_id").withColumn("_h", F.lit(True)), "user_id", "left")
    products = edges.groupBy("product_id").agg(F.count(F.lit(1)).alias("degree"))
    return marked.select(
        F.lit("user").alias("kind"), F.col("user_id").alias("id"), "degree", F.coalesce("_h", F.lit(False)).alias("is_highlighted")
    ).union(products.select(F.lit("product"), "product_id", "degree", F.lit(False)))


def network_edges(edges: DataFrame, highlighted: DataFrame) -> DataFrame:
    """Edges with the highlight flag of their user."""
    marked = attach(
        edges.select("user_id", "product_id", "rating", "date"),
        highlighted.select("user_id").withColumn("_h", F.lit(True)), "user_id",
    )
    return marked.withColumn("is_highlighted", F.coalesce("_h", F.lit(False))).drop("_h")


def preview(text_col: str):
    """The first characters of a text for a table cell; the text itself is always processed whole."""
    return F.concat(F.substring(text_col, 1, PREVIEW_CHARS), F.lit("..."))


def top_suspicious(flagged: DataFrame, *, n: int = 5, order: str = ROW_KEY) -> DataFrame:
    """The first flagged rows, by score if there is one, else by date."""
    rows = flagged.filter("is_suspicious")
    if "fake_probability" in flagged.columns:
        return rows.orderBy(F.desc("fake_probability"), order).limit(n)
    return rows.orderBy(F.col("date").asc_nulls_last(), order).limit(n)


def recent_suspicious(df: DataFrame, *, n: int = 10, order: str = ROW_KEY) -> DataFrame:
    """The latest unverified reviews, formatted for display."""
    rows = df.filter(~F.col("verified_purchase")).orderBy(F.col("date").desc_nulls_last(), order).limit(n)
    return rows.select(
        order, "user_id", "product_id", "rating", F.date_format("date", "yyyy-MM-dd").alias("date"),
        preview("review_text").alias("review_text"),
    )
