from datetime import datetime

import pytest
from helpers import reviews
from pyspark.sql import functions as F

from candor.operators import behavior, meta, reports
from candor.skew import attach


def test_burstiness(spark):
    df = reviews(
        spark,
        [
            ("one", "p", 5, "2023-01-01"),
            ("same", "p", 5, "2023-01-01"), ("same", "p", 5, "2023-01-01"),
            ("edge", "p", 5, "2023-01-01"), ("edge", "p", 5, "2023-01-08"), ("edge", "p", 5, "2023-01-15 00:00:01"),
            ("undated", "p", 5, "2023-01-01"), ("undated", "p", 5, None), ("undated", "p", 5, None),
            ("across", "p", 5, "1969-12-31 23:00:00"), ("across", "p", 5, "1970-01-01 01:00:00"), ("across", "p", 5, "1971-01-01"),
        ],
    )
    got = {r.user_id: (r.n_reviews, r.max_burst) for r in behavior.burstiness(df, "user_id").collect()}
    assert got == {"one": (1, 0), "same": (2, 1), "edge": (3, 1), "undated": (3, 0), "across": (3, 1)}
    score = {r.user_id: r.burstiness_score for r in behavior.burstiness(df, "user_id").collect()}
    assert score["one"] == 0.0 and score["same"] == 0.5
    gaps = {(r.user_id, r.interval_days): r.interval_count for r in behavior.burst_intervals(df, "user_id").collect()}
    assert gaps[("same", 0.0)] == 1 and gaps[("edge", 7.0)] == 1 and len(gaps) == 3
    narrow = {r.user_id: r.max_burst for r in behavior.burstiness(df, "user_id", window_days=0.05).collect()}
    assert narrow["same"] == 1 and narrow["across"] == 0
    with pytest.raises(ValueError):
        behavior.burstiness(df, "user_id", window_days=-1)


def test_entropy(spark):
    df = reviews(
        spark,
        [
            ("single", "p", 5, "2023-01-01 10:00:00"),
            ("same", "p", 5, "2023-01-01 10:00:00"), ("same", "p", 5, "2023-01-01 10:30:00"),
            ("two", "p", 5, "2023-01-01 10:00:00"), ("two", "p", 5, "2023-01-02 11:00:00"),
        ],
    )
    got = {r.user_id: (r.hour_entropy, r.day_entropy) for r in behavior.posting_entropy(df).collect()}
    assert got["single"] == (None, None) and got["same"] == (0.0, 0.0) and got["two"] == (1.0, 1.0)


def test_null_shares_and_variance(spark):
    df = reviews(spark, [("a", "p", 3, "2023-01-01", False), ("b", "p", 5, "2023-01-01", True), ("b", "q", 1, "2023-01-02", False)])
    rows = {r.user_id: r for r in behavior.user_stats(df).collect()}
    assert rows["a"].user_rating_variance is None and rows["a"].user_extreme_rating_pct is None
    assert rows["a"].user_verified_ratio is None and rows["b"].user_verified_ratio == 0.5
    assert rows["b"].user_rating_variance == 8.0 and rows["b"].user_extreme_rating_pct == 1.0
    full = behavior.behavioral_features(df)
    assert full.count() == 3 and "user_clustering" in full.columns


def test_metadata_boundaries(spark):
    df = reviews(
        spark,
        [("early", "p", 5, "2022-12-31 12:00:00"), ("seven", "p", 5, "2023-01-08"), ("eight", "p", 5, "2023-01-09"), ("nobody", "p", 5, "2023-01-01"), ("twice", "p", 5, "2023-01-01")],
    )
    joined = datetime(2023, 1, 1)
    users = spark.createDataFrame(
        [("early", joined, 2, 4.0, 1), ("seven", joined, 0, 4.0, 0), ("eight", joined, 2, 4.0, 1), ("twice", joined, 1, 1.0, 1), ("twice", joined, 2, 1.0, 1)],
        "user_id string, join_date timestamp, review_count long, avg_rating double, verified_purchases long",
    )
    got = {r.user_id: (r.account_age_days, r.is_suspicious_new_account) for r in meta.account_age(df, users).collect()}
    assert got["early"] == (-1.0, True) and got["seven"] == (7.0, True) and got["eight"] == (8.0, False)
    assert got["nobody"] == (None, False)
    assert meta.join_users(df, users).count() == 6
    features = meta.metadata_features(df, users, None)
    assert features.count() == 5
    assert {r.user_id: r.user_verified_ratio for r in features.collect()}["seven"] == 0.0


def test_profile_row(spark):
    df = reviews(spark, [("a", "p", 5, "2023-01-01"), ("a", "p", 5, "2023-01-02"), ("b", "q", 5, "2023-01-03", False)])
    row = reports.user_product_metrics(df).first()
    assert (row.users_with_single_review, row.users_with_multiple_reviews) == (1, 1)
    assert (row.user_product_pairs, row.user_product_pairs_with_multiple_reviews) == (2, 1)


def test_hot_key_is_split(spark):
    """A key with almost all rows: adaptive execution must split its partition."""
    keep = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in keep}
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 20 > 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 500)).alias("user_id"), "id"
        )
        stats = rows.groupBy("user_id").agg(F.count("*").alias("n"))
        out = attach(rows, stats, "user_id")
        total = out.agg(F.sum("n"), F.count("*"))
        assert total.first()[1] == 200_000
        out.write.format("noop").mode("overwrite").save()
        collected = out.selectExpr("user_id", "n", "spark_partition_id() AS part")
        parts = collected.filter("user_id = 'hot'").select("part").distinct().count()
        assert parts > 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
