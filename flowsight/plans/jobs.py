"""Whole jobs: training, holdout evaluation, detection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.functions.labels import binary_label, excluded_dataset, inferred_label
from flowsight.operators import clean, evaluate as ev, model as md, policy as po
from flowsight.operators.alerts import as_alerts
from flowsight.operators.enrich import enrich_threat
from flowsight.schema import FEATURES, KEY, Policy
from flowsight.session import materialize, scratch_dir


@dataclass
class Trained:
    model: GBTClassificationModel
    path: str
    threshold: float
    metrics: DataFrame


def train(training: DataFrame, settings: md.Training = md.Training(), path: str | None = None) -> Trained:
    """Fit, tune and store a detector from distinct (features, label) rows.

    The rows are stored once, in even tasks; every round of the trees and every metric reads that table.
    """
    spark = training.sparkSession
    features = clean.select_feature_columns(training)
    rows = training.withColumn("y", binary_label(F.col("label"))).dropDuplicates([*features, "label"])
    rows = md.stored_training(rows, [*features, "label"], "y", settings, training.count())
    model = md.fit(rows, features, training=settings, spread=False) if settings.patience is None else md.fit_with_patience(rows, features, training=settings)[0]
    held = rows.filter("is_validation").select(*features, "y")
    scored = materialize(md.score(held, model, features).select("y", "score"), "validation")
    metrics = materialize(md.validation_metrics(scored), "metrics")
    threshold = metrics.first()["best_threshold"]
    path = path or scratch_dir(spark, "model")
    md.save_model(model, path, threshold, features)
    return Trained(model, path, threshold, metrics)


def evaluate_holdout(
    held: DataFrame, model: GBTClassificationModel, threshold: float, features=FEATURES
) -> DataFrame:
    """Scored and thresholded rows of the datasets that belong in the evaluation.

    The reports of ``operators.evaluate`` apply to the result.
    """
    name = F.col("source_file")
    rows = held.filter(~excluded_dataset(name))
    given = F.col("label") if "label" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("label", F.coalesce(given, inferred_label(name)))
    rows = clean.prepare_features(rows, features)
    rows = rows.withColumn("y", binary_label(F.col("label"), "benign_normal"))
    scored = md.score(rows, model, features).select("source_file", "y", "score")
    return ev.predict(scored, threshold)


def detect(
    windows: DataFrame,
    trained: Trained,
    policy: Policy | DataFrame = Policy(),
    features=FEATURES,
    key: str = KEY,
) -> DataFrame:
    """Alert events of feature rows: score, decide, explain the attacks, add threat context."""
    scored = md.score(clean.prepare_features(windows, features), trained.model, features)
    scored = materialize(scored, "scored")
    decided = po.decide(scored, policy, key, staged=True)
    nodes = md.tree_nodes(windows.sparkSession, f"{trained.path}/model")
    paths = md.model_paths(nodes, trained.model.treeWeights)
    return as_alerts(enrich_threat(md.explain_alerts(decided, paths, features)), key)
