"""Posting behaviour: bursts, entropies, per-user and per-product aggregates.

Every feature is first aggregated per key, with map-side combine, and then attached to the review rows
by a join whose hot keys adaptive execution can split.  No window ever spans all rows of one user or product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candor.lineage import written
from candor.functions.dates import DAY_MICROS, micros, weekday
from candor.operators.clean import ROW_KEY
from candor.operators.meta import account_age, product_age
from candor.skew import attach

HIGH_RATING = 4
EXTREME_RATINGS = (1, 5)
BURST_WINDOW_DAYS = 7


def _share_or_null(condition: Column) -> Column:
    """Share of rows that meet ``condition``; null, not 0, when none does."""
    n = F.sum(F.when(condition, 1).otherwise(0))
    return F.when(n > 0, n / F.count(F.lit(1)))


def burstiness(df: DataFrame, key: str, *, window_days: float = BURST_WINDOW_DAYS) -> DataFrame:
    """Per key: rows, gaps of at most ``window_days`` to the previous review, and their share of the rows.

    Reviews are first counted into cells as wide as the window.  Inside a cell every gap is short enough,
    so a cell of n reviews contributes n - 1; across cells only the step from the last review of one
    to the first of the next has to be looked at.  The window below therefore sees at most
    history / window rows per key, however many reviews the key has.
    """
    if window_days < 0:
        raise ValueError("window_days must not be negative")
    width = max(int(window_days * DAY_MICROS), 1)
    ts = micros(F.col("date"))
    cells = df.groupBy(key, F.floor(ts / F.lit(width)).alias("_cell")).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ts).alias("_first"), F.max(ts).alias("_last")
    )
    before = F.lag("_last").over(Window.partitionBy(key).orderBy(F.col("_cell").asc_nulls_last()))
    step = F.when((F.col("_first") - before) <= width, 1).otherwise(0)
    inside = F.when(F.col("_cell").isNull(), 0).otherwise(F.col("_n") - 1)
    per_key = cells.withColumn("_gaps", inside + step).groupBy(key).agg(
        F.sum("_n").alias("n_reviews"), F.sum("_gaps").alias("max_burst")
    )
    return per_key.withColumn("burstiness_score", F.col("max_burst") / F.col("n_reviews"))


def burst_intervals(df: DataFrame, key: str, *, window_days: float = BURST_WINDOW_DAYS) -> DataFrame:
    """The short gaps themselves, run-length encoded: one row per (key, date, gap length) with its count.

    Equal timestamps are merged first; the predecessor is searched inside one-day cells, and only the first
    timestamp of a cell looks at the cell before it.  Long form, since a list per key would be unbounded.
    """
    ts = micros(F.col("date"))
    stamps = (
        df.filter(F.col("date").isNotNull())
        .groupBy(key, "date")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(ts).alias("_ts"))
        .withColumn("_cell", F.floor(F.col("_ts") / F.lit(DAY_MICROS)))
    )
    cells = stamps.groupBy(key, "_cell").agg(F.max("_ts").alias("_last"))
    by_key = Window.partitionBy(key).orderBy("_cell")
    cells = cells.select(key, "_cell", F.lag("_last").over(by_key).alias("_cell_before"))
    in_cell = Window.partitionBy(key, "_cell").orderBy("_ts")
    gaps = stamps.join(cells, [key, "_cell"]).withColumn(
        "_gap", F.col("_ts") - F.coalesce(F.lag("_ts").over(in_cell), F.col("_cell_before"))
    )
    step = F.struct((F.col("_gap") / float(DAY_MICROS)).alias("interval_days"), F.lit(1).cast("bigint").alias("n"))
    tied = F.struct(F.lit(0.0).alias("interval_days"), (F.col("_n") - 1).alias("n"))
    return (
        gaps.select(key, "date", F.explode(F.array(step, tied)).alias("_g"))
        .select(key, "date", F.col("_g.interval_days").alias("interval_days"), F.col("_g.n").alias("interval_count"))
        .filter((F.col("interval_count") > 0) & (F.col("interval_days") <= window_days))
        .groupBy(key, "date", "interval_days")
        .agg(F.sum("interval_count").alias("interval_count"))
    )


def _entropy(counts: list[Column]) -> Column:
    """Base-2 entropy of a list of counts."""
    total = reduce(lambda a, b: a + b, counts)
    weighted = reduce(lambda a, b: a + b, [F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0) for c in counts])
    return F.when(total > 0, F.log2(total.cast("double")) - weighted / total).otherwise(0.0)


def posting_entropy(df: DataFrame) -> DataFrame:
    """Per user: entropy of the hour of day and of the weekday; null for users with a single review.

    31 conditional counts per user in one aggregation, one shuffle.
    """
    hours, days = list(range(24)), list(range(7))
    hour, day = F.hour("date"), weekday(F.col("date"))
    agg = df.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(hour == h, 1)).alias(f"_h{h}") for h in hours],
        *[F.count(F.when(day == d, 1)).alias(f"_d{d}") for d in days],
    )
    many = F.col("_n") > 1
    return agg.select(
        "user_id",
        F.when(many, _entropy([F.col(f"_h{h}") for h in hours])).alias("hour_entropy"),
        F.when(many, _entropy([F.col(f"_d{d}") for d in days])).alias("day_entropy"),
    )


def user_stats(df: DataFrame) -> DataFrame:
    """One row per user: counts, mean, sample variance, extreme and verified shares."""
    aggs = [
        F.count(F.lit(1)).alias("user_review_count"),
        F.countDistinct("product_id").alias("user_product_count"),
        F.avg("rating").alias("user_avg_rating"),
        F.var_samp("rating").alias("user_rating_variance"),
        _share_or_null(F.col("rating").isin(*EXTREME_RATINGS)).alias("user_extreme_rating_pct"),
    ]
    if "verified_purchase" in df.columns:
        aggs.append(_share_or_null(F.col("verified_purchase")).alias("user_verified_ratio"))
    return df.groupBy("user_id").agg(*aggs)


def product_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("product_review_count"),
        F.countDistinct("user_id").alias("product_user_count"),
        F.avg("rating").alias("product_avg_rating"),
        F.var_samp("rating").alias("product_rating_variance"),
        _share_or_null(F.col("rating") >= HIGH_RATING).alias("product_high_rating_pct"),
    )


def user_behavior(df: DataFrame, users: DataFrame | None = None, *, order: str = ROW_KEY) -> DataFrame:
    stats = user_stats(df).drop("user_verified_ratio")
    out = attach(df, stats, "user_id").withColumn(
        "rating_deviation", F.abs(F.col("rating") - F.col("user_avg_rating"))
    )
    return out if users is None else account_age(out, users, order=order)


def product_behavior(df: DataFrame, products: DataFrame | None = None, *, order: str = ROW_KEY) -> DataFrame:
    out = attach(df, product_stats(df), "product_id").withColumn(
        "product_rating_deviation", F.abs(F.col("rating") - F.col("product_avg_rating"))
    )
    return out if products is None else product_age(out, products, order=order)


def user_verified_ratio(df: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    return attach(df, user_stats(df).select("user_id", "user_verified_ratio"), "user_id")


def same_day_counts(
    df: DataFrame, *, user_name: str = "same_day_review_count", product_name: str | None = "product_same_day_review_count",
    order: str = ROW_KEY,
) -> DataFrame:
    """Reviews of the same user, and of the same product, on the same calendar day (0 for undated rows).

    All counts are taken from the rows as they came, and only days with several reviews are joined back: any other dated row counts itself.
    """
    day = F.to_date("date")
    dated = df.filter(day.isNotNull())
    out = df.withColumn("_day", day)
    for key, name in (("user_id", user_name), ("product_id", product_name)):
        if name:
            counts = dated.groupBy(key, day.alias("_day")).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)
            alone = F.when(F.col("_day").isNotNull() & F.col(key).isNotNull(), 1).otherwise(0).cast("long")
            out = attach(out, counts, [key, "_day"]).withColumn(name, F.coalesce(name, alone))
    return out.drop("_day")


def daily_review_count(df: DataFrame, *, order: str = ROW_KEY) -> DataFrame:
    """How many reviews the user wrote on that day."""
    return same_day_counts(df, user_name="daily_review_count", product_name=None, order=order)


def calendar_parts(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "hour_of_day": F.hour("date"),
            "day_of_week": weekday(F.col("date")),
            "month": F.month("date"),
            "year": F.year("date"),
        }
    )


def burst_features(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return burstiness(df, key).select(
        key,
        F.col("burstiness_score").alias(f"{prefix}_burstiness_score"),
        F.col("max_burst").alias(f"max_{prefix}_burst"),
    )


def behavioral_features(
    df: DataFrame, users: DataFrame | None = None, products: DataFrame | None = None, *, order: str = ROW_KEY
) -> DataFrame:
    """All per-user and per-product features next to each review.

    The per-key tables are joined among themselves (one row per key each), so the wide review rows are
    shuffled once by user and once by product.
    """
    from candor.operators.graph import bipartite_degrees, review_edges, user_clustering

    edges = written(review_edges(df, order=order), "edges")
    user_degree, product_degree = bipartite_degrees(edges)
    per_user = (
        user_stats(df)
        .join(burst_features(df, "user_id", "user"), "user_id")
        .join(posting_entropy(df), "user_id")
        .join(user_degree, "user_id")
        .join(user_clustering(edges), "user_id", "left")
        .fillna(0.0, subset=["user_clustering"])
    )
    per_product = (
        product_stats(df)
        .join(burst_features(df, "product_id", "product"), "product_id")
        .join(product_degree, "product_id")
    )
    out = attach(df, per_user, "user_id")
    out = attach(out, per_product, "product_id")
    out = out.transform(calendar_parts).withColumns(
        {
            "rating_deviation": F.abs(F.col("rating") - F.col("user_avg_rating")),
            "product_rating_deviation": F.abs(F.col("rating") - F.col("product_avg_rating")),
        }
    ).drop("month", "year")
    if users is not None:
        out = account_age(out, users, order=order)
    return out if products is None else product_age(out, products, order=order)
