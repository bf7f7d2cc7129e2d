"""Exact classification metrics as aggregations: AUC, curves, confusion matrix, report.

Scores are first reduced to (score, positives, negatives).  Running totals over the distinct scores are taken
in two steps, inside score ranges and across their totals, so that no task sees all scores.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256
RANGE_ERROR = 0.001


def _ranges(scores: DataFrame, column: str) -> DataFrame:
    """Add ``_range``: about equally filled score ranges.  The split points (at most 257 numbers) go to the driver."""
    probs = [i / RANGES for i in range(1, RANGES)]
    points = sorted(set(scores.stat.approxQuantile(column, probs, RANGE_ERROR)))
    splits = [float("-inf"), *points, float("inf")]
    return Bucketizer(splits=splits, inputCol=column, outputCol="_range", handleInvalid="error").transform(scores)


def ranked_scores(
    df: DataFrame, label: str = "label", score: str = "score", by: str | None = None
) -> DataFrame:
    """Per distinct score: ``pos``, ``neg``, and ``tp``, ``fp`` = positives and negatives at or above it.

    ``by`` keeps several score lists apart (one per ensemble weight).
    """
    keys = [by] if by else []
    table = (
        df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("neg"),
        )
    )
    ranged = _ranges(table, "score")
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    # At most RANGES rows per list: safe to scan in one task and to broadcast.
    above = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    offsets = totals.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"),
        F.sum("_p").over(whole).alias("positives"),
        F.sum("_n").over(whole).alias("negatives"),
    )
    return (
        ranged.join(F.broadcast(offsets), [*keys, "_range"])
        .withColumn("tp", F.sum("pos").over(inside) + F.col("_p0"))
        .withColumn("fp", F.sum("neg").over(inside) + F.col("_n0"))
        .drop("_range", "_p0", "_n0")
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", by: str | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half; null when only one class is present."""
    keys = [by] if by else []
    r = ranked_scores(df, label, score, by)
    # Positives above each negative, half of those at the same score.
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return r.groupBy(*keys).agg(
        won.alias("_won"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives")
    ).select(
        *keys,
        F.when(
            (F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_won") / (F.col("positives") * F.col("negatives"))
        ).alias("roc_auc"),
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr), one point per distinct score plus the origin at an infinite threshold."""
    points = ranked_scores(df, label, score).select(
        F.col("score").alias("threshold"),
        (F.col("fp") / F.col("negatives")).alias("fpr"),
        (F.col("tp") / F.col("positives")).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.union(origin)


def pr_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(threshold, precision, recall, baseline) per distinct score, plus the end point (1, 0)."""
    ranked = ranked_scores(df, label, score)
    baseline = F.col("positives") / (F.col("positives") + F.col("negatives"))
    points = ranked.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("positives")).alias("recall"),
        baseline.alias("baseline"),
    )
    end = ranked.agg(F.max(baseline).alias("baseline")).select(
        F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), "baseline"
    )
    return points.union(end)


def _cells(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row with the four counts."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(
        count(~y & ~p).alias("tn"), count(~y & p).alias("fp"), count(y & ~p).alias("fn"), count(y & p).alias("tp")
    )


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n) with all four cells present."""
    cells = _cells(df, label, predicted)
    rows = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return cells.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(c).alias("n")) for a, p, c in rows])
        ).alias("c")
    ).select("c.*")


def classification_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(name, precision, recall, f1, support) for both classes, accuracy, and the two averages."""
    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    c = _cells(df, label, predicted)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    c = c.withColumns(
        {
            "p0": ratio(tn, tn + fn), "r0": ratio(tn, tn + fp), "p1": ratio(tp, tp + fp), "r1": ratio(tp, tp + fn),
            "s0": tn + fp, "s1": tp + fn,
        }
    )
    f1 = lambda p, r: F.when(F.col(p) + F.col(r) > 0, 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r))).otherwise(0.0)
    c = c.withColumns({"f0": f1("p0", "r0"), "f1": f1("p1", "r1"), "s": F.col("s0") + F.col("s1")})
    accuracy = ratio(tn + tp, F.col("s"))

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("name"), p.alias("precision"), r.alias("recall"), f.alias("f1"), s.alias("support"))

    def macro(x):
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x):
        return ratio(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), F.col("s"))

    rows = [
        row("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", accuracy, accuracy, accuracy, F.col("s")),
        row("macro avg", macro("p"), macro("r"), macro("f"), F.col("s")),
        row("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("s")),
    ]
    return c.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def ensemble_score(df: DataFrame, nlp: str, graph: str, weight: float, out: str = "fake_probability") -> DataFrame:
    """``weight`` times the text score plus the rest times the graph score; a missing score counts 0."""
    return df.withColumn(
        out, weight * F.coalesce(nlp, F.lit(0.0)) + (1 - weight) * F.coalesce(graph, F.lit(0.0))
    )


def weight_grid() -> list[float]:
    """0, 0.1, ... 1.0."""
    return [i * 0.1 for i in range(11)]


def weight_aucs(df: DataFrame, nlp: str, graph: str, label: str = "label") -> DataFrame:
    """(weight, roc_auc) for the eleven blends, in one pass over the scores."""
    w = F.col("weight")
    blended = df.select(label, nlp, graph, F.explode(F.array(*[F.lit(x) for x in weight_grid()])).alias("weight")).select(
        label, "weight", (w * F.col(nlp) + (1 - w) * F.col(graph)).alias("score")
    )
    return roc_auc(blended, label, "score", by="weight")


def tune_weights(df: DataFrame, nlp: str, graph: str, label: str = "label") -> DataFrame:
    """The blend with the best AUC; the smallest text weight wins ties."""
    best = weight_aucs(df, nlp, graph, label).orderBy(F.desc("roc_auc"), "weight").limit(1)
    return best.select(F.col("weight").alias("nlp_weight"), (1 - F.col("weight")).alias("graph_weight"), "roc_auc")
