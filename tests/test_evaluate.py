import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from flowsight.operators import evaluate as ev


def frame(spark, pairs):
    return spark.createDataFrame([(int(y), float(s)) for y, s in pairs], "y int, score double")


def pairs(seed, n, digits):
    rng = random.Random(seed)
    return [(rng.random() < 0.3 + 0.4 * (s > 0.5), s) for s in (round(rng.random(), digits) for _ in range(n))]


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_curves_match_brute_force(spark, digits):
    data = pairs(digits, 500, digits)
    df = frame(spark, data)
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    won = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(won / len(pos) / len(neg))

    curve = {r.threshold: r for r in ev.pr_curve(df).collect()}
    assert set(curve) == {s for _, s in data}
    ap, before, best = 0.0, 0.0, None
    for t in sorted(curve, reverse=True):
        tp, fp = sum(s >= t for s in pos), sum(s >= t for s in neg)
        p, r = tp / (tp + fp), tp / len(pos)
        assert (curve[t].tp, curve[t].fp) == (tp, fp)
        assert (curve[t].precision, curve[t].recall) == (pytest.approx(p), pytest.approx(r))
        ap += (r - before) * p
        before = r
        f1 = 2 * p * r / (p + r + 1e-12)
        if best is None or f1 >= best[0]:
            best = (f1, t)
    assert ev.average_precision(df).first().average_precision == pytest.approx(ap)
    assert ev.best_threshold(df).first().best_threshold == (0.95 if best[1] >= 0.99 else best[1])


def test_auc_agrees_with_the_library(spark):
    df = frame(spark, pairs(7, 400, 2)).withColumn("label", F.col("y").cast("double"))
    wanted = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(df)
    assert ev.roc_auc(df).first().roc_auc == pytest.approx(wanted)


def test_many_distinct_scores_use_many_buckets(spark):
    data = pairs(3, 3000, 12)
    totals = ev.score_totals(frame(spark, data), buckets=20)
    last = totals.orderBy("score").first()
    assert (last.tp, last.fp) == (last.all_pos, last.all_neg)
    assert totals.count() == 3000
    plan = totals._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def test_threshold_near_one_is_capped(spark):
    df = frame(spark, [(1, 0.995), (0, 0.2)])
    assert ev.best_threshold(df).first().best_threshold == 0.95


def test_one_class_only(spark):
    df = frame(spark, [(1, 0.9), (1, 0.4)])
    assert ev.roc_auc(df).first().roc_auc is None
    cells = ev.rates(ev.confusion(ev.predict(df, 0.5))).first()
    assert (cells.tn, cells.fp, cells.fn, cells.tp) == (0, 0, 1, 1)
    assert (cells.recall, cells.precision, cells.fpr) == (0.5, 1.0, 0.0)
    empty = ev.rates(ev.confusion(ev.predict(df.limit(0), 0.5))).first()
    assert (empty.tp, empty.recall, empty.accuracy) == (0, 0.0, 0.0)


def test_report_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "y int, pred int")
    rows = {r.label: r for r in ev.classification_report(df).collect()}
    assert rows["1"].precision == pytest.approx(2 / 3) and rows["1"].recall == pytest.approx(2 / 3)
    assert rows["0"].precision == 0.5 and rows["0"].support == 2
    assert rows["accuracy"].f1 == pytest.approx(0.6) and rows["accuracy"].support == 5
    assert rows["macro avg"].recall == pytest.approx((0.5 + 2 / 3) / 2)
    assert rows["weighted avg"].recall == pytest.approx((0.5 * 2 + 2 / 3 * 3) / 5)


def test_summary_by_kind_of_dataset(spark):
    data = [("a", 1, 0.9), ("a", 1, 0.8), ("b", 1, 0.1), ("c", 0, 0.9), ("c", 0, 0.0)]
    df = ev.predict(spark.createDataFrame(data, "source_file string, y int, score double"), 0.5)
    report = ev.dataset_report(df)
    rates = {r.source_file: (r.status, r.rate) for r in report.collect()}
    assert rates == {"a": ("ATTACK", 1.0), "b": ("ATTACK", 0.0), "c": ("BENIGN", 0.5)}
    kinds = {r.status: r for r in ev.evaluation_summary(report).collect()}
    assert (kinds["ATTACK"].datasets, kinds["ATTACK"].samples, kinds["ATTACK"].detected) == (2, 3, 2)
    assert kinds["ATTACK"].average_rate == 0.5
    assert (kinds["BENIGN"].fp, kinds["BENIGN"].tn) == (1, 1)


def test_importance_dominance(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "feature string, importance double")
    rows = ev.importance_report(df).orderBy("rank").collect()
    assert [(r.feature, r.share, r.dominant) for r in rows] == [("a", 0.75, True), ("b", 0.25, False)]
