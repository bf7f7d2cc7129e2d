"""Known results on the sample tables."""

import pytest
from golden import FLAGGED_PRODUCTS, SOLE_UNFLAGGED_USER, write_tables
from pyspark.sql import functions as F

from candor.operators import behavior, clean, graph, meta, reports, suspicious
from candor.plans.analysis import analyze
from candor.sources.reviews import load


@pytest.fixture()
def paths(tmp_path):
    return write_tables(tmp_path)


@pytest.fixture()
def tables(spark, paths):
    rows, users, products = load(spark, *paths)
    return clean.clean_reviews(rows).cache(), users, products


def test_rules_result(spark, paths, tmp_path):
    out = analyze(spark, paths[0], output=str(tmp_path / "out"), bool_mode="truthy").collect()
    assert len(out) == 60 and all(r.verified_purchase for r in out)
    for r in out:
        assert r.is_suspicious_user == (r.user_id != SOLE_UNFLAGGED_USER)
        assert r.is_suspicious_product == (r.product_id in FLAGGED_PRODUCTS)
        assert r.is_suspicious == (r.is_suspicious_user or r.is_suspicious_product)
    written = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert written.count() == 60


def test_strict_booleans_and_network(tables):
    df, _, _ = tables
    assert {r.verified_purchase: r.n for r in reports.verification_status(df).collect()} == {True: 35, False: 25}
    edges = graph.review_edges(df)
    assert {r.product_id for r in suspicious.suspicious_products(edges).collect()} == {"p606", "p789"}
    stats = reports.network_stats(edges, suspicious.suspicious_users(edges)).first()
    assert (stats.users, stats.products, stats.edges, stats.highlighted_users) == (60, 10, 60, 59)
    assert round(stats.density, 4) == 0.0248


def test_burst_days_and_product_bursts(tables):
    df, _, _ = tables
    days = {str(r.day): r.review_count for r in reports.daily_burst_days(df).filter("is_burst").collect()}
    assert days == {"2023-01-15": 15, "2023-01-16": 12}
    bursts = {r.product_id: (r.max_burst, round(r.burstiness_score, 6)) for r in behavior.burstiness(df, "product_id").collect()}
    assert bursts["p123"] == (4, 0.666667) and bursts["p505"] == (1, 0.25) and bursts["p789"] == (5, 0.714286)


def test_variances(tables):
    df, _, _ = tables
    sample = {r.product_id: r for r in behavior.product_stats(df).collect()}
    population = {r.product_id: r for r in suspicious.product_metrics(graph.review_edges(df)).collect()}
    assert round(sample["p606"].product_rating_variance, 6) == 0.571429
    assert round(population["p606"].rating_variance, 6) == 0.489796
    assert population["p789"].high_rating_pct == 1.0


def test_metadata_ages(tables):
    df, users, products = tables
    assert products.count() == 9
    ages = meta.account_age(df, users).agg(
        F.min("account_age_days"), F.max("account_age_days"), F.sum(F.col("is_suspicious_new_account").cast("int"))
    ).first()
    assert tuple(ages) == (3, 2161, 12)
    early = meta.product_age(df, products).agg(
        F.min("product_age_days"), F.max("product_age_days"), F.sum(F.col("is_suspicious_early_review").cast("int")),
        F.sum(F.col("product_age_days").isNull().cast("int")),
    ).first()
    assert tuple(early) == (5, 304, 0, 7)
