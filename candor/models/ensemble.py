"""The blend of both forests: train, score, evaluate, save, load."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candor.lineage import cut
from candor.models.forest import ForestModel, train_graph, train_text
from candor.models.split import stratified_split
from candor.operators.clean import ROW_KEY, align_features, has_known_feature, label
from candor.operators.metrics import classification_report, confusion_matrix, ensemble_score, roc_auc, tune_weights
from candor.plans.features import GRAPH_FEATURES, graph_features

NLP, GRAPH, BLEND = "nlp_probability", "graph_probability", "fake_probability"


@dataclass
class EnsembleModel:
    text: ForestModel
    graph: ForestModel
    nlp_weight: float = 0.5

    @property
    def graph_weight(self) -> float:
        return 1.0 - self.nlp_weight

    def scores(
        self, df: DataFrame, users: DataFrame | None = None, products: DataFrame | None = None, *,
        text_col: str = "review_text", order: str = ROW_KEY, features: DataFrame | None = None,
    ) -> DataFrame:
        """(order, nlp_probability, graph_probability, fake_probability) per review."""
        texts = self.text.score(df.select(order, text_col), NLP).select(order, NLP)
        if features is None:
            features = graph_features(df, users, products, order=order)
        names = self.graph.feature_names
        if has_known_feature(features, names):
            graphs = self.graph.score(align_features(features, names, keep=(order,)), GRAPH).select(order, GRAPH)
        else:
            graphs = features.select(order, F.lit(0.0).alias(GRAPH))
        return ensemble_score(texts.join(graphs, order), NLP, GRAPH, self.nlp_weight, BLEND)

    def predict_proba(self, df: DataFrame, users=None, products=None, *, order: str = ROW_KEY, **options) -> DataFrame:
        """``df`` with ``fake_probability``."""
        return df.join(self.scores(df, users, products, order=order, **options).select(order, BLEND), order)

    def predict(self, df: DataFrame, users=None, products=None, *, order: str = ROW_KEY, **options) -> DataFrame:
        """``df`` with ``fake_probability`` and ``predicted`` (1 from 0.5 on)."""
        scored = self.predict_proba(df, users, products, order=order, **options)
        return scored.withColumn("predicted", (F.col(BLEND) >= 0.5).cast("int"))

    def evaluate(self, labelled: DataFrame) -> dict[str, DataFrame]:
        """Metric tables over a scored, labelled table (see :meth:`scores` and :func:`candor.operators.clean.label`)."""
        judged = labelled.withColumn("predicted", (F.col(BLEND) >= 0.5).cast("int"))
        return {
            "classification_report": classification_report(judged),
            "confusion_matrix": confusion_matrix(judged),
            "roc_auc": roc_auc(judged, "label", BLEND),
            "nlp_roc_auc": roc_auc(judged, "label", NLP),
            "graph_roc_auc": roc_auc(judged, "label", GRAPH),
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """Write both forests and the weights under ``path``, replacing what is there.  Each forest can be loaded by itself."""
        self.text.save(spark, f"{path}/text")
        self.graph.save(spark, f"{path}/graph")
        weights = spark.createDataFrame([(self.nlp_weight, self.graph_weight)], "nlp_weight double, graph_weight double")
        weights.coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "EnsembleModel":
        weight = spark.read.parquet(f"{path}/weights").first().nlp_weight
        return EnsembleModel(ForestModel.load(spark, f"{path}/text"), ForestModel.load(spark, f"{path}/graph"), weight)


@dataclass
class Training:
    model: EnsembleModel
    held_out: DataFrame
    metrics: dict[str, DataFrame]


def train_ensemble(
    reviews: DataFrame, users: DataFrame | None = None, products: DataFrame | None = None, *,
    text_col: str = "review_text", target: str = "verified_purchase", test_size: float = 0.2, seed: int = 42,
    order: str = ROW_KEY, text: dict | None = None, graph: dict | None = None, save_path: str | None = None,
) -> Training:
    """Train both forests on 80 % of the rows; tune the blend and evaluate on the rest.

    Graph features come from the whole review graph.  The target is a label next to the features, never one of them.
    ``text`` and ``graph`` are keyword arguments of the two trainers (grid, trees, depth).
    """
    labelled = label(reviews, target=target).filter(F.col("label").isNotNull())
    rows = cut(stratified_split(labelled.select(order, text_col, target, "label"), test_size=test_size, seed=seed, stratify=target, order=order))
    features = cut(graph_features(reviews, users, products, order=order))
    # The training sets are read once per tree level, so they are worth keeping; they spill to disk if large.
    text_train = rows.filter("split = 'train'").persist()
    graph_train = features.drop(target).join(rows.filter("split = 'train'").select(order, "label"), order).persist()
    names = [c for c in GRAPH_FEATURES if c in features.columns]
    text_model = train_text(text_train, text_col, **(text or {}))
    graph_model = train_graph(graph_train, names, **(graph or {}))
    text_train.unpersist()
    graph_train.unpersist()
    model = EnsembleModel(text_model, graph_model)
    held_out = rows.filter("split = 'test'")
    known = features.join(held_out.select(order), order, "left_semi")
    scored = cut(
        model.scores(held_out.select(order, text_col), text_col=text_col, order=order, features=known).join(
            held_out.select(order, "label"), order
        )
    )
    best = tune_weights(scored, NLP, GRAPH).first()
    if best is not None and best.roc_auc is not None and best.roc_auc > 0:
        model.nlp_weight = best.nlp_weight
    scored = ensemble_score(scored.drop(BLEND), NLP, GRAPH, model.nlp_weight, BLEND)
    if save_path:
        model.save(reviews.sparkSession, save_path)
    return Training(model, scored, model.evaluate(scored))


def feature_importances(spark: SparkSession, model: ForestModel, n: int = 20) -> DataFrame:
    """The ``n`` most important features."""
    table = spark.createDataFrame(model.importances(), "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(n)


def ensemble_importances(spark: SparkSession, model: EnsembleModel, n: int = 10) -> DataFrame:
    """Top text features and the first graph features, each times the weight of its forest."""
    text = feature_importances(spark, model.text, n).select(
        F.concat(F.lit("NLP_"), "feature").alias("feature"), (F.col("importance") * model.nlp_weight).alias("importance")
    )
    graph = spark.createDataFrame(model.graph.importances()[:n], "feature string, importance double").select(
        F.concat(F.lit("Graph_"), "feature").alias("feature"), (F.col("importance") * model.graph_weight).alias("importance")
    )
    return text.unionByName(graph)
