"""Cleaning, row filters, samples, flags and feature alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candor.skew import attach

CRITICAL = ("user_id", "product_id", "review_text")
ROW_KEY = "review_id"


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows without user, product or text."""
    return df.dropna(subset=list(CRITICAL))


def deduplicate(df: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    """Keep the first row, by ``order``, of each (user, product, text).

    A grouped minimum rather than a ranked window: copies meet in the map-side combine, so a text that
    makes up a third of the table never gathers in one task.
    """
    rest = [c for c in df.columns if c not in CRITICAL and c != order]
    first = F.min(F.struct(order, *rest)).alias("_first")
    kept = df.groupBy(*CRITICAL).agg(first)
    return kept.select(*[F.col(c) if c in CRITICAL else F.col(f"_first.{c}").alias(c) for c in df.columns])


def coerce_rating(df: DataFrame) -> DataFrame:
    """Numeric rating; rows whose rating is missing or unreadable are dropped."""
    if "rating" not in df.columns:
        return df
    return df.withColumn("rating", F.col("rating").try_cast("double")).filter(
        F.col("rating").isNotNull() & ~F.isnan("rating")
    )


def coerce_date(df: DataFrame) -> DataFrame:
    """Unreadable dates become null; the row stays."""
    if dict(df.dtypes).get("date") != "string":
        return df
    from candor.sources.reviews import strict_date

    return df.withColumn("date", strict_date(F.col("date")))


def clean_reviews(df: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    """The full cleaner.  Sorting is left to :func:`by_date` at the sink; operators do not depend on row order."""
    return (
        df.transform(drop_incomplete)
        .transform(lambda d: deduplicate(d, order=order))
        .transform(coerce_rating)
        .transform(coerce_date)
    )


def by_date(df: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    """Ascending date, undated rows last, ties by row key: a range-partitioned sort."""
    return df.orderBy(F.col("date").asc_nulls_last(), order)


def filter_reviews(df: DataFrame, kind: str | None = None, value: str | None = None) -> DataFrame:
    """Reviews of one user or product, or the unverified ones; an empty value means no filter."""
    if kind == "user" and value:
        return df.filter(F.col("user_id") == value)
    if kind == "product" and value:
        return df.filter(F.col("product_id") == value)
    if kind == "suspicious":
        return df.filter(~F.col("verified_purchase"))
    return df


def fixed_sample(df: DataFrame, n: int = 100, *, seed: int = 42, order: str = ROW_KEY) -> DataFrame:
    """At most ``n`` rows, the same ones on every run: smallest hashes of row key and seed (a bounded top-k)."""
    ranked = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(order).cast("string"), F.lit(str(seed)))))
    return ranked.orderBy("_h", order).limit(n).drop("_h")


def threshold_flags(df: DataFrame, *, score: str = "fake_probability", suspicious: float = 0.7, fake: float = 0.5) -> DataFrame:
    return df.withColumns(
        {"is_suspicious": F.col(score) >= suspicious, "predicted_fake": (F.col(score) >= fake).cast("int")}
    )


def membership_flags(
    df: DataFrame, users: DataFrame, products: DataFrame, *, order: str = ROW_KEY
) -> DataFrame:
    """Flag rows whose user or product is in the given id tables (one row per id)."""
    u = users.select("user_id").withColumn("_u", F.lit(True))
    p = products.select("product_id").withColumn("_p", F.lit(True))
    flagged = attach(attach(df, u, "user_id"), p, "product_id")
    is_user, is_product = F.coalesce("_u", F.lit(False)), F.coalesce("_p", F.lit(False))
    return flagged.withColumns(
        {
            "is_suspicious_user": is_user,
            "is_suspicious_product": is_product,
            "is_suspicious": is_user | is_product,
        }
    ).drop("_u", "_p")


def risk_band(df: DataFrame, *, score: str = "fake_probability") -> DataFrame:
    """Readable verdict and an authenticity score out of 100."""
    p = F.col(score)
    return df.withColumns(
        {
            "authenticity": F.round(100 - p * 100, 1),
            "result": F.when(p >= 0.8, "Highly Suspicious")
            .when(p >= 0.6, "Somewhat Suspicious")
            .otherwise("Likely Authentic"),
        }
    )


def align_features(df: DataFrame, expected: Sequence[str], *, keep: Sequence[str] = (ROW_KEY,)) -> DataFrame:
    """``expected`` columns in order as doubles; absent columns and nulls become 0."""
    return df.select(
        *keep,
        *[
            F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c)
            for c in expected
        ],
    )


def has_known_feature(df: DataFrame, expected: Sequence[str]) -> bool:
    """False means a model over ``expected`` has nothing to score and must answer 0."""
    return any(c in df.columns for c in expected)


def label(df: DataFrame, *, target: str = "verified_purchase") -> DataFrame:
    """1 = not a verified purchase."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.withColumn("label", (~F.col(target)).cast("double"))
