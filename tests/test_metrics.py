import random

import pytest

from candor.operators import metrics


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, score double")


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


CASES = {
    "perfect": [(1, 0.9), (1, 0.8), (0, 0.2)],
    "reversed": [(1, 0.1), (0, 0.8), (0, 0.2)],
    "tied": [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.1)],
    "random": [(random.Random(i).random() < 0.4, round(random.Random(1000 + i).random(), 2)) for i in range(400)],
}


@pytest.mark.parametrize("name", CASES)
def test_auc_and_curves(spark, name):
    rows = [(int(y), s) for y, s in CASES[name]]
    df = frame(spark, rows)
    assert metrics.roc_auc(df).first().roc_auc == pytest.approx(brute_auc(rows))
    p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
    want = {s: (sum(1 - y for y, x in rows if x >= s) / n, sum(y for y, x in rows if x >= s) / p) for _, s in rows}
    want[float("inf")] = (0.0, 0.0)
    got = {r.threshold: (r.fpr, r.tpr) for r in metrics.roc_curve(df).collect()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k])
    pr = {r.threshold: (r.precision, r.recall, r.baseline) for r in metrics.pr_curve(df).collect()}
    assert pr[float("inf")] == (1.0, 0.0, pytest.approx(p / len(rows)))
    low = min(s for _, s in rows)
    assert pr[low][:2] == (pytest.approx(p / len(rows)), 1.0)


def test_auc_ignores_monotone_change(spark):
    rows = [(int(y), s) for y, s in CASES["random"]]
    changed = [(y, s**3 + 7) for y, s in rows]
    assert metrics.roc_auc(frame(spark, changed)).first()[0] == pytest.approx(brute_auc(rows))


def test_one_class(spark):
    assert metrics.roc_auc(frame(spark, [(0, 0.4), (0, 0.6)])).first().roc_auc is None


def test_report_and_confusion(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0)]
    df = spark.createDataFrame(rows, "label int, predicted int")
    cells = {(r.actual, r.predicted): r.n for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 1, (1, 0): 1, (1, 1): 1}
    report = {r["name"]: r for r in metrics.classification_report(df).collect()}
    assert report["0"].precision == pytest.approx(2 / 3) and report["1"].recall == 0.5
    assert report["accuracy"].f1 == 0.6 and report["macro avg"].support == 5
    assert report["weighted avg"].recall == pytest.approx(0.6)
    one = metrics.confusion_matrix(spark.createDataFrame([(0, 0)], "label int, predicted int")).collect()
    assert len(one) == 4


def test_weights(spark):
    rows = [(1, 0.9, 0.1), (0, 0.2, 0.8), (1, 0.7, 0.3), (0, 0.4, 0.6)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    best = metrics.tune_weights(df, "a", "b").first()
    assert best.roc_auc == 1.0
    assert best.nlp_weight == pytest.approx(0.6)
    assert metrics.weight_aucs(df, "a", "b").count() == 11
    blend = metrics.ensemble_score(spark.createDataFrame([(0.5, None)], "a double, b double"), "a", "b", 0.4).first()
    assert blend.fake_probability == pytest.approx(0.2)
