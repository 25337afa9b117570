import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsight.operators import evaluate as ev, model as md
from flowsight.functions.decision import attack_score, reason_text, top_class, top_contributions
from flowsight.plans import jobs
from flowsight.schema import FEATURES, Policy

SMALL = md.Training(trees=8, depth=3, learning_rate=0.3, min_leaf=5)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(1200):
        x = [round(rng.random(), 3) for _ in FEATURES]
        attack = x[3] + 0.5 * x[7] + 0.2 * rng.random() > 0.9
        data.append((*x, "xss" if attack else "benign"))
    return spark.createDataFrame(data, ", ".join([*(f"{c} double" for c in FEATURES), "label string"]))


@pytest.fixture(scope="module")
def trained(spark, rows, tmp_path_factory):
    return jobs.train(rows, SMALL, str(tmp_path_factory.mktemp("model") / "m"))


def test_training_learns_and_reports(trained):
    m = trained.metrics.first()
    assert m.roc_auc > 0.95 and m.pr_auc > 0.95
    assert m.tn + m.fp + m.fn + m.tp == pytest.approx(240, abs=2)
    assert 0 < trained.threshold < 1


def test_model_survives_storage(spark, rows, trained):
    model, meta = md.load_model(spark, trained.path)
    assert meta.threshold == trained.threshold and list(meta.features) == FEATURES
    assert (meta.label_positive, meta.label_negative) == (1, 0)
    a, b = md.score(rows, trained.model), md.score(rows, model)
    assert a.exceptAll(b).isEmpty()
    assert a.filter("score < 0 OR score > 1").isEmpty()


def shapley(path, x, d):
    """Shapley values of one leaf from the definition."""
    taken = dict(zip(path.features, path.taken(x[None, :])[0]))
    share = dict(zip(path.features, path.share))

    def worth(known):
        return path.value * np.prod([float(taken[f]) if f in known else share[f] for f in path.features])

    out = np.zeros(d)
    n = len(path.features)
    for f in path.features:
        others = [g for g in path.features if g != f]
        for k in range(n):
            for s in combinations(others, k):
                w = factorial(k) * factorial(n - k - 1) / factorial(n)
                out[f] += w * (worth({*s, f}) - worth(set(s)))
    return out


def test_contributions(spark, rows, trained):
    paths = md.model_paths(md.tree_nodes(spark, f"{trained.path}/model"), trained.model.treeWeights)
    x = np.array([r[: len(FEATURES)] for r in rows.limit(20).collect()], dtype=float)
    got = md.explain_batch(paths, x)
    for i in range(3):
        assert got[i] == pytest.approx(sum(shapley(p, x[i], x.shape[1]) for p in paths))
    # Base and contributions add up to the model's log-odds.
    df = md.contributions(md.margin(rows, trained.model), paths)
    total = F.aggregate("contributions", F.lit(2 * md.base_margin(paths)), lambda a, c: a + c)
    assert df.filter(F.abs(total - F.col("log_odds")) > 1e-9).isEmpty()


def random_tree(rng, number, depth, features):
    """Leaves of a random tree over some features, with their intervals and shares."""
    leaves = []

    def grow(level, box):
        if level == depth or rng.random() < 0.1:
            low, high, share = np.array(list(box.values())).reshape(-1, 3).T
            leaves.append(md.Path(rng.gauss(0, 1), np.array(list(box), dtype=int), low, high, share, number))
            return
        f, bound, part = rng.choice(features), round(rng.random(), 1), rng.uniform(0.05, 0.95)
        low, high, share = box.get(f, (-np.inf, np.inf, 1.0))
        grow(level + 1, {**box, f: (low, min(high, bound), share * part)})
        grow(level + 1, {**box, f: (max(low, bound), high, share * (1 - part))})

    grow(0, {})
    return leaves


@pytest.mark.parametrize("depth, limit", [(1, 8), (4, 8), (6, 8), (6, 3), (7, 0)])
def test_trees_as_arrays_equal_single_leaves(monkeypatch, depth, limit):
    rng = random.Random(depth)
    paths = [p for n in range(6) for p in random_tree(rng, n, depth, range(9))]
    x = np.array([[round(rng.random(), 1) for _ in range(9)] for _ in range(300)])
    x[0, 3] = np.nan
    monkeypatch.setattr(md, "TABLE_FEATURES", limit)
    monkeypatch.setattr(md, "EXPLAINED_ROWS", 128)
    wanted = np.zeros(x.shape)
    for p in paths:
        if len(p.features):
            taken = p.taken(np.where(np.isnan(x), np.inf, x))
            wanted[:, p.features] += p.value * md.leaf_shares(taken.astype(float), p.share)
    assert md.explain_batch(paths, x) == pytest.approx(wanted, abs=1e-12)


def test_best_round_waits():
    assert md.best_round([5, 4, 4, 3, 3.5, 3.2, 2], 2) == (3, True)
    assert md.best_round([5, 4, 4, 3, 3.5, 3.2, 2], 3) == (6, False)
    assert md.best_round([1.0], 1) == (0, False)


def test_training_with_patience_ends_at_the_best_round(spark, rows):
    noisy = rows.withColumn("y", F.when(F.pmod(F.xxhash64(*FEATURES), F.lit(4)) == 0, 1 - (F.col("label") == "xss").cast("int")).otherwise((F.col("label") == "xss").cast("int")))
    settings = md.Training(trees=24, depth=4, learning_rate=0.5, min_leaf=2, patience=3)
    marked = md.prepare_training(noisy, [*FEATURES, "label"], "y", settings).checkpoint()
    model, losses = md.fit_with_patience(marked, training=settings)
    best = min(range(len(losses)), key=losses.__getitem__)
    assert model.getNumTrees == best + 1 <= settings.trees
    assert len(losses) == min(best + 1 + settings.patience, settings.trees)
    again = md.validation_curve(model, marked.filter("is_validation"))
    assert again == pytest.approx(losses[: best + 1])


def test_only_attacks_are_explained(spark, rows, trained):
    paths = md.model_paths(md.tree_nodes(spark, f"{trained.path}/model"), trained.model.treeWeights)
    df = md.score(rows, trained.model).withColumn("is_attack", F.col("score") >= 0.8)
    out = md.explain_alerts(df, paths)
    assert out.filter("is_attack = (reason IS NULL)").isEmpty()
    reason = out.filter("is_attack").first().reason
    assert "syn_ratio (+" in reason and len(reason.split(", ")) <= 3


def test_reason_text(spark):
    df = spark.createDataFrame([([0.1, -1.0, 0.456, 0.2, 0.1],), ([-1.0, 0.0, 0.0, 0.0, -2.0],)], "v array<double>")
    out = df.select(reason_text(top_contributions(["a", "b", "c", "d", "e"], F.col("v"))).alias("r"))
    assert [r.r for r in out.collect()] == ["c (+0.46), d (+0.20), a (+0.10)", "global bias"]


def test_scores_from_probabilities(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],)], "p array<double>")
    p = F.col("p")
    row = df.select(attack_score(p, vector=False).alias("a"), attack_score(p, 0, vector=False).alias("b"), top_class(p, ["x", "y", "z"], vector=False).alias("c")).first()
    assert (row.a, row.b, row.c) == (0.5, 0.8, "y")


def test_importances(spark, trained):
    report = ev.importance_report(md.feature_importances(spark, trained.model)).orderBy("rank").collect()
    assert report[0].feature == "syn_ratio" and len(report) == 13
    assert sum(r.share for r in report) == pytest.approx(1)


def test_holdout_evaluation(rows, trained):
    held = rows.withColumn("source_file", F.when(F.col("label") == "benign", "BenignTraffic.csv").otherwise("XSS.csv"))
    extra = held.limit(5).withColumn("source_file", F.lit("Monday-WorkingHours.csv"))
    scored = jobs.evaluate_holdout(held.unionByName(extra).drop("label"), trained.model, trained.threshold)
    report = {r.source_file: r for r in ev.dataset_report(scored).collect()}
    assert set(report) == {"BenignTraffic.csv", "XSS.csv"}
    assert report["XSS.csv"].status == "ATTACK" and report["XSS.csv"].rate > 0.8


def test_detection_job(spark, rows, trained):
    windows = rows.limit(60).select(
        F.lit(1).alias("sensor_id"),
        F.timestamp_seconds(F.monotonically_increasing_id() * 10).alias("window_start"),
        F.timestamp_seconds(F.monotonically_increasing_id() * 10 + 10).alias("window_end"),
        *FEATURES,
        F.lit("10.0.0.50").alias("top_src_ip"),
    ).checkpoint()
    alerts = jobs.detect(windows, trained, Policy(threshold=0.6)).collect()
    assert len(alerts) == 60
    for a in alerts:
        assert (a.reason is not None) == (a.state == "ATTACK")
        assert a.threat.threat == "Command & Control Server"


def test_model_queries_use_the_operators_settings():
    from flowsight.plans import model_queries

    assert model_queries.SETTINGS == md.Training()
