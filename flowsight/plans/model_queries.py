"""Queries that train on the given tables. Scores have no SQL form; counts and sums over them do."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.operators import clean, evaluate as ev, model as md, split
from flowsight.operators.features import window_features
from flowsight.plans import adapters, jobs
from flowsight.plans.adapters import WINDOW
from flowsight.plans.policy_queries import POLICY
from flowsight.plans.reference_sql import WINDOWED
from flowsight.plans.registry import query
from flowsight.plans.training_queries import SPLIT, positioned
from flowsight.schema import FEATURES
from flowsight.session import materialize

# The operator's own settings; early stopping ends the training.
SETTINGS = md.Training()
_trained: dict[tuple[str, str], tuple] = {}
_windows: dict[tuple[str, str], DataFrame] = {}


def trained(spark, sf_dir):
    """(parts of the converted rows, detector), made once per session and folder."""
    run = (spark.sparkContext.applicationId, sf_dir)
    if run not in _trained:
        parts = materialize(split.split_by_file(positioned(spark, sf_dir)), "parts")
        rows = clean.core_columns(parts.filter(F.col("part") == "train"))  # training takes distinct rows
        _trained[run] = (parts, jobs.train(rows, SETTINGS))
    return _trained[run]


def windows(spark, sf_dir):
    """Feature windows of the flows, made once per session and folder."""
    run = (spark.sparkContext.applicationId, sf_dir)
    if run not in _windows:
        _windows[run] = materialize(window_features(adapters.flows(spark, sf_dir), WINDOW), "windows")
    return _windows[run]


def explained(spark, sf_dir):
    """Feature windows with contributions and the model's own log-odds."""
    _, detector = trained(spark, sf_dir)
    paths = md.model_paths(md.tree_nodes(spark, f"{detector.path}/model"), detector.model.treeWeights)
    rows = md.margin(windows(spark, sf_dir), detector.model)
    return md.contributions(rows, paths), 2 * md.base_margin(paths)


@query()
def training_metrics(spark, sf_dir):
    return trained(spark, sf_dir)[1].metrics


@query()
def feature_importance(spark, sf_dir):
    return ev.importance_report(md.feature_importances(spark, trained(spark, sf_dir)[1].model))


@query()
def window_scores(spark, sf_dir):
    rows = md.score(windows(spark, sf_dir), trained(spark, sf_dir)[1].model)
    return rows.select("sensor_id", "window_start", "score")


@query()
def holdout_report(spark, sf_dir):
    parts, detector = trained(spark, sf_dir)
    held = parts.filter(F.col("part") == "test")
    return ev.dataset_report(jobs.evaluate_holdout(held, detector.model, detector.threshold))


@query(f"""
WITH {SPLIT}
SELECT CASE WHEN source_file = 'BenignTraffic' THEN 'BENIGN' ELSE 'ATTACK' END AS status,
       count(DISTINCT source_file) AS datasets, count(*) AS samples
FROM parted WHERE part = 'test' GROUP BY 1""")
def holdout_samples(spark, sf_dir):
    parts, detector = trained(spark, sf_dir)
    held = parts.filter(F.col("part") == "test")
    report = ev.dataset_report(jobs.evaluate_holdout(held, detector.model, detector.threshold))
    return ev.evaluation_summary(report).select("status", "datasets", "samples")


@query()
def explanations(spark, sf_dir):
    rows, _ = explained(spark, sf_dir)
    pushes = [F.col("contributions")[i].alias(f"push_{c}") for i, c in enumerate(FEATURES)]
    return rows.select("sensor_id", "window_start", *pushes)


@query(f"""
WITH {WINDOWED} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS unexplained FROM features""")
def explanation_sums(spark, sf_dir):
    """Contributions and base must add up to the model's log-odds in every row."""
    rows, base = explained(spark, sf_dir)
    total = F.aggregate("contributions", F.lit(base), lambda a, c: a + c)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.abs(total - F.col("log_odds")) > 1e-6).alias("unexplained"),
    )


@query()
def detection_alerts(spark, sf_dir):
    # The detector knows packet summaries, not these windows, so its scores stay near the middle.
    policy = replace(POLICY, threshold=0.5, instant_block=0.9)
    return jobs.detect(windows(spark, sf_dir), trained(spark, sf_dir)[1], policy)
