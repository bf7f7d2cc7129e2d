import random

import pytest
from helpers import ts
from pyspark.sql import functions as F

from candor.models.ensemble import BLEND, EnsembleModel, ensemble_importances, feature_importances, train_ensemble
from candor.models.forest import ForestModel, forest, graph_pipeline, text_pipeline, train_graph, train_text
from candor.models.search import GraphGrid, TextGrid, first_trees, named, search_graph, search_text
from candor.models.split import with_folds
from candor.models.tfidf import tfidf_weights, vocabulary
from candor.operators.metrics import roc_auc
from candor.plans.analysis import score_batch

SMALL = {"trees": 10, "depth": 4}
SCHEMA = (
    "review_id string, user_id string, product_id string, rating double, review_text string, date timestamp, "
    "verified_purchase boolean"
)


def planted(spark, n=160, fake=True):
    rnd, rows = random.Random(1), []
    for i in range(n):
        bad = fake and i % 3 == 0
        words = ["amazing", "unbelievable", "buy", "now"] if bad else ["works", "fine", "after", "month", "battery"]
        text = " ".join(rnd.choices(words + ["item", "thing"], k=8))
        product = f"p{rnd.randint(0, 2)}" if bad else f"p{rnd.randint(3, 12)}"
        rows.append((f"r{i:03}", f"u{i % 60}", product, 5.0 if bad else float(rnd.randint(1, 5)), text, ts("2023-01-01"), not bad))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def training(spark):
    return train_ensemble(planted(spark), text={**SMALL, "min_df": 2}, graph=SMALL)


def test_ensemble_learns(training):
    assert roc_auc(training.held_out, "label", BLEND).first().roc_auc > 0.8
    assert 0.0 <= training.model.nlp_weight <= 1.0
    assert training.held_out.count() == 31  # floor(0.2 n) of each class
    assert training.metrics["confusion_matrix"].agg(F.sum("n")).first()[0] == 31
    assert "verified_purchase" not in training.model.graph.feature_names


def test_save_and_load(spark, training, tmp_path):
    path = str(tmp_path / "model")
    training.model.save(spark, path)
    training.model.save(spark, path)  # overwrites
    loaded = EnsembleModel.load(spark, path)
    rows = planted(spark)
    features = rows.select("review_id", *[F.lit(1.0).alias(c) for c in loaded.graph.feature_names])
    one = training.model.scores(rows, features=features).orderBy("review_id").toPandas()
    two = loaded.scores(rows, features=features).orderBy("review_id").toPandas()
    assert one.equals(two)
    no_features = loaded.scores(rows, features=rows.select("review_id")).agg(F.max("graph_probability")).first()[0]
    assert no_features == 0.0


def test_importances(spark, training):
    top = feature_importances(spark, training.model.text, 3).collect()
    assert len(top) == 3 and top[0].importance >= top[1].importance
    both = ensemble_importances(spark, training.model)
    assert both.filter("feature LIKE 'Graph_%'").count() == 10 and both.filter("feature LIKE 'NLP_%'").count() == 10


def test_score_batch(spark, training):
    new = spark.createDataFrame([("n1", "amazing unbelievable buy now", 5.0)], "review_id string, review_text string, rating double")
    row = score_batch(new, planted(spark), training.model).collect()
    assert len(row) == 1 and row[0].user_id == "new_user" and 0.0 <= row[0].fake_probability <= 1.0
    assert row[0].result in ("Highly Suspicious", "Somewhat Suspicious", "Likely Authentic")


def test_one_forest_by_itself(spark, training, tmp_path):
    path = str(tmp_path / "text")
    training.model.text.save(spark, path)
    rows = planted(spark, 20)
    one, two = ({r.review_id: r.p for r in m.score(rows, "p").collect()} for m in (training.model.text, ForestModel.load(spark, path)))
    assert one == two and len(set(one.values())) > 1
    training.model.text.save(spark, path)  # overwrites
    ForestModel(None, ["a"], 1.0).save(spark, path)
    loaded = ForestModel.load(spark, path)
    assert (loaded.pipeline, loaded.feature_names, loaded.constant) == (None, ["a"], 1.0)


def test_single_class(spark):
    df = planted(spark, 12, fake=False).withColumn("label", F.lit(0.0))
    model = train_text(df)
    assert model.score(df, "p").agg(F.max("p")).first()[0] == 0.0
    assert train_text(df.withColumn("label", F.lit(1.0))).constant == 1.0


def numbers(spark, n=90):
    rnd = random.Random(3)
    rows = [(f"r{i}", float(i % 2), i % 2 + rnd.gauss(0, 0.8), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "review_id string, label double, a double, b double")


def test_full_grids_have_all_points():
    assert len(TextGrid().points()) == 24 and len(GraphGrid().points()) == 18
    assert len({named(p) for p in TextGrid().points()}) == 24 and len({named(p) for p in GraphGrid().points()}) == 18


def test_graph_search_equals_fitting_every_point(spark):
    """Points with the largest number of trees are plain fits, fold by fold."""
    df, grid = numbers(spark), GraphGrid(trees=(3, 8), depths=(2, 5), min_split=(2, 10))
    found = {r.params: r for r in search_graph(df, ["a", "b"], grid, folds=3).collect()}
    assert set(found) == {named(p) for p in grid.points()} and sum(r.is_best for r in found.values()) == 1
    best = max(r.mean_auc for r in found.values())
    assert next(r for r in found.values() if r.is_best).mean_auc == best > 0.7
    folded = with_folds(df, 3)
    for point in ({"trees": 8, "depth": 5, "min_split": 2}, {"trees": 8, "depth": 2, "min_split": 10}):
        scores = []
        for k in range(3):
            model = train_graph(folded.filter(F.col("fold") != k).select("label", "a", "b"), ["a", "b"], **point)
            scores.append(roc_auc(model.score(folded.filter(F.col("fold") == k), "score")).first().roc_auc)
        assert found[named(point)].mean_auc == pytest.approx(sum(scores) / 3)


def test_first_trees_answer_like_a_forest(spark):
    rows = graph_pipeline(["a", "b"]).getStages()[0].transform(numbers(spark)).select("review_id", "features", "label")
    model = forest(trees=6, depth=4).fit(rows)
    whole = {r.review_id: r.probability[1] for r in model.transform(rows).collect()}
    some = {r.review_id: r.p for r in first_trees(model, rows, 6, "p").collect()}
    assert some == pytest.approx(whole)
    few = {r.review_id: r.p for r in first_trees(model, rows, 2, "p").collect()}
    want = [{r.review_id: r.q[1] for r in t.setProbabilityCol("q").setRawPredictionCol("").setPredictionCol("").transform(rows).collect()} for t in model.trees[:2]]
    assert few == pytest.approx({k: (want[0][k] + want[1][k]) / 2 for k in few})


def test_text_search_and_training_at_the_best_point(spark):
    df = planted(spark, 90).select("review_id", "review_text", (~F.col("verified_purchase")).cast("double").alias("label"))
    grid = TextGrid(features=(4, 40), max_n=(1, 2), trees=(2, 5), depths=(3,), tfidf={"min_df": 1, "max_df": 0.95})
    found = search_text(df, grid=grid, folds=3).collect()
    assert len(found) == 8 and max(r.mean_auc for r in found) > 0.95
    model = train_text(df, grid=grid, folds=3)
    assert roc_auc(model.score(df, "score")).first().roc_auc > 0.95


def test_one_class_in_a_fold(spark):
    df = numbers(spark, 12).withColumn("label", F.when(F.col("review_id") == "r1", 1.0).otherwise(0.0))
    found = search_graph(df, ["a", "b"], GraphGrid(trees=(2,), depths=(2,), min_split=(2,)), folds=3).collect()
    assert len(found) == 1 and found[0].is_best


def test_tfidf_equals_the_pipeline_and_a_hand_count(spark):
    import math

    rows = [("a", "Alpha beta beta gamma"), ("b", "alpha gamma delta"), ("c", "delta delta the"), ("d", None), ("e", ""), ("f", "beta alpha")]
    df = spark.createDataFrame(rows, "review_id string, review_text string")
    got = {(r.review_id, r.term): r.weight for r in tfidf_weights(df, max_features=3, max_n=1, min_df=1, max_df=0.9).collect()}
    idf = lambda d: math.log(7 / (d + 1)) + 1
    raw = {("a", "alpha"): idf(3), ("a", "beta"): 2 * idf(2), ("b", "alpha"): idf(3), ("b", "delta"): idf(2), ("c", "delta"): 2 * idf(2), ("f", "alpha"): idf(3), ("f", "beta"): idf(2)}
    norms = {d: math.sqrt(sum(v * v for (x, _), v in raw.items() if x == d)) for d, _ in raw}
    assert got == pytest.approx({k: v / norms[k[0]] for k, v in raw.items()})
    model = text_pipeline(max_features=3, max_n=1, min_df=1, max_df=0.9).getStages()
    words = model[0].transform(df)
    assert vocabulary(words, "_terms", size=3, min_df=1, max_df=0.9) == ["alpha", "beta", "delta"]
    counts = model[1].fit(words)
    vectors = model[3].transform(model[2].fit(counts.transform(words)).transform(counts.transform(words)))
    dense = {(r.review_id, t): w for r in vectors.collect() for t, w in zip(counts.vocabulary, r.features.toArray().tolist()) if w}
    assert dense == pytest.approx(got)


def test_queries_use_the_operators_defaults_and_full_grids(spark, sf_dir, monkeypatch):
    from candor.plans import queries

    asked, searched = {}, []
    monkeypatch.setattr(queries, "train_ensemble", lambda *args, **options: asked.update(options))
    monkeypatch.setattr(queries, "_trained", {})
    queries.trained(spark, sf_dir)
    assert not asked

    def table(*args, **options):
        searched.append((len(args), options))
        return spark.createDataFrame([("", 0.5, True)], "params string, mean_auc double, is_best boolean")

    monkeypatch.setattr(queries, "search_text", table)
    monkeypatch.setattr(queries, "search_graph", table)
    monkeypatch.setattr(queries, "graph_features", lambda df, *_, **__: df.select("review_id", "verified_purchase", *[F.lit(0.0).alias(c) for c in queries.GRAPH_FEATURES]))
    assert queries.queries()["grid_search"](spark, sf_dir).count() == 2 and searched == [(1, {}), (2, {})]


def test_model_queries_take_features_of_all_reviews(spark, sf_dir, monkeypatch):
    from types import SimpleNamespace

    from candor.plans import queries

    built, used = [], []

    def features(df, users=None, products=None, *, centralities=True):
        built.append((df.count(), users is not None, products is not None, centralities))
        return df.select("review_id", "verified_purchase", *[F.lit(0.0).alias(c) for c in queries.GRAPH_FEATURES])

    def scores(rows, features):
        return rows.select("review_id", F.lit(0.5).alias(BLEND))

    def table(data, *names):
        used.append(data.count())
        return spark.createDataFrame([("", 0.5, True)], "params string, mean_auc double, is_best boolean")

    model = SimpleNamespace(save=lambda *_: None, scores=scores)
    monkeypatch.setattr(queries, "graph_features", features)
    monkeypatch.setattr(queries, "search_text", table)
    monkeypatch.setattr(queries, "search_graph", table)
    monkeypatch.setattr(queries, "trained", lambda *_: SimpleNamespace(model=model))
    monkeypatch.setattr(queries.EnsembleModel, "load", staticmethod(lambda *_: model))
    every, labelled = queries._text_reviews(spark, sf_dir).count(), queries._labelled_text(spark, sf_dir).count()
    queries.queries()["grid_search"](spark, sf_dir).collect()
    told = queries.queries()["model_roundtrip"](spark, sf_dir).collect()
    assert labelled < every and built == [(every, True, True, True)] * 2 and used == [labelled] * 2
    assert len(told) == every and all(r[BLEND] == r["original_probability"] for r in told)
