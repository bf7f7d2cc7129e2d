import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from candor.models.split import stratified_split, with_folds
from candor.operators import clean
from candor.sources.reviews import parse_products, parse_reviews, parse_users, read_products, read_reviews, read_users

RAW = "review_id string, user_id string, product_id string, rating string, review_text string, date string, verified_purchase string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_cleaner(spark):
    df = raw(
        spark,
        [
            ("1", "u", "p", "5", "fine", "2023-01-02", "True"),
            ("2", "u", "p", "1", "fine", "2023-01-01", "True"),  # copy: first row stays
            ("3", None, "p", "5", "x", "2023-01-02", "True"),
            ("4", "u", "p", "abc", "y", "2023-01-02", "True"),
            ("5", "u", "p", "4", "z", "not a date", "True"),
            ("6", "u", "p", "4", None, "2023-01-02", "True"),
        ],
    )
    out = clean.by_date(clean.clean_reviews(df)).collect()
    assert [(r.review_id, r.rating, r.date is None) for r in out] == [("1", 5.0, False), ("5", 4.0, True)]


def test_booleans_and_bad_dates(spark):
    df = raw(spark, [(str(i), "u", "p", "1", "t", "2023-01-01", v) for i, v in enumerate(["True ", "False", "1", None])])
    strict = [r.verified_purchase for r in parse_reviews(df).orderBy("review_id").collect()]
    assert strict == [True, False, True, False]
    truthy = [r.verified_purchase for r in parse_reviews(df, bool_mode="truthy").orderBy("review_id").collect()]
    assert truthy == [True, True, True, True]
    bad = raw(spark, [("1", "u", "p", "1", "t", "soon", "True")])
    with pytest.raises(PySparkException):
        parse_reviews(bad).collect()


def test_optional_tables(spark, tmp_path):
    assert read_users(spark, None) is None and read_users(spark, str(tmp_path / "none.csv")) is None
    path = tmp_path / "p.csv"
    path.write_text('product_id,product_name,listing_date\np1,TV 55",2022-11-01\np2,Desk,2022-11-01 \np3,"A, B",x\n')
    assert [r.product_id for r in read_products(spark, str(path)).collect()] == ["p1"]
    assert [r.product_id for r in read_products(spark, str(path), trim_dates=True).orderBy("product_id").collect()] == ["p1", "p2"]
    users = spark.createDataFrame([("u", "2020-01-01", "3", "x")], "user_id string, join_date string, review_count string, avg_rating string")
    row = parse_users(users).first()
    assert row.review_count == 3 and row.avg_rating is None
    assert parse_products(spark.createDataFrame([("p",)], "product_id string")).count() == 1


def test_file_order_keys(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("user_id,product_id,rating,review_text,date\n" + "".join(f"u{i},p,5,t{i},2023-01-01\n" for i in range(50)))
    rows = read_reviews(spark, str(path)).orderBy("review_id").collect()
    assert [r.user_id for r in rows] == [f"u{i}" for i in range(50)]


def test_flags_and_bands(spark):
    df = spark.createDataFrame([("a", 0.8), ("b", 0.7), ("c", 0.6), ("d", 0.5), ("e", 0.4)], "review_id string, fake_probability double")
    rows = clean.risk_band(clean.threshold_flags(df)).orderBy("review_id").collect()
    assert [r.is_suspicious for r in rows] == [True, True, False, False, False]
    assert [r.predicted_fake for r in rows] == [1, 1, 1, 1, 0]
    assert [r.result.split()[0] for r in rows] == ["Highly", "Somewhat", "Somewhat", "Likely", "Likely"]
    assert rows[0].authenticity == 20.0


def test_filters_alignment_label(spark):
    df = spark.createDataFrame([("1", "u1", "p1", True, None), ("2", "u2", "p1", False, 3)], "review_id string, user_id string, product_id string, verified_purchase boolean, a int")
    assert clean.filter_reviews(df, "user", "u1").count() == 1
    assert clean.filter_reviews(df, "product", "").count() == 2
    assert clean.filter_reviews(df, "suspicious").first().review_id == "2"
    aligned = clean.align_features(df, ["b", "a"]).orderBy("review_id").collect()
    assert [tuple(r) for r in aligned] == [("1", 0.0, 0.0), ("2", 0.0, 3.0)]
    assert not clean.has_known_feature(df, ["b"])
    assert [r.label for r in clean.label(df).orderBy("review_id").collect()] == [0.0, 1.0]
    with pytest.raises(ValueError):
        clean.label(df, target="missing")


def test_split_is_exact_and_repeatable(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("review_id"), (F.col("id") % 3 == 0).alias("verified_purchase"))
    split = stratified_split(df)
    counts = {(r.verified_purchase, r.split): r["count"] for r in split.groupBy("verified_purchase", "split").count().collect()}
    assert counts[(True, "test")] == int(335 * 0.2) and counts[(False, "test")] == int(668 * 0.2)
    again = stratified_split(df.repartition(7))
    assert split.exceptAll(again).isEmpty()
    assert stratified_split(df, stratify=None).filter("split = 'test'").count() == 200
    folds = with_folds(df, 5).groupBy("fold").count().collect()
    assert len(folds) == 5 and min(r["count"] for r in folds) > 100


def test_sample(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("review_id"))
    assert clean.fixed_sample(df).exceptAll(clean.fixed_sample(df.repartition(5))).isEmpty()
    assert clean.fixed_sample(df).count() == 100 and clean.fixed_sample(df.limit(7)).count() == 7


def test_attach_meets_keys_of_different_types(spark):
    from candor.skew import attach

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (7, "c")], "k int, v string")
    for kind in ("int", "bigint", "string"):
        values = spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string").selectExpr(f"cast(k as {kind}) k", "w")
        got = {(r["v"], r["w"]) for r in attach(rows, values, "k").collect()}
        assert got == {("a", "x"), ("b", "y"), ("c", None)}
    with pytest.raises(TypeError):
        attach(rows, spark.createDataFrame([(1.5, "x")], "k double, w string"), "k")
