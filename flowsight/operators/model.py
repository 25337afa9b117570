"""Boosted-tree detector: training, scoring, importances, explanations, storage."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import groupby
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsight.functions.decision import attack_score, reason_text, top_contributions
from flowsight.operators import evaluate as ev
from flowsight.operators.lookups import lookup_small
from flowsight.operators.split import balanced_weights, below_cut, class_weights, row_hash, stratified_cuts, stratified_split
from flowsight.schema import FEATURES
from flowsight.session import materialize


@dataclass(frozen=True)
class Training:
    """Training settings. Depth 6 stands for trees of 63 leaves."""

    learning_rate: float = 0.05
    trees: int = 2000
    depth: int = 6
    min_leaf: int = 50
    row_share: float = 0.8
    column_share: float = 0.8
    min_improvement: float = 1e-5
    validation_share: float = 0.2
    seed: int = 42
    #: Rounds without a better validation loss after which training ends; None for Spark's own rule.
    patience: int | None = None


def assemble(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Adds the feature vector ``_x``. The columns must be free of nulls."""
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


#: Training rows of one task, at most about: the trees' passes keep some 300 bytes of each. Every pass
#: shuffles the sums of its nodes once a task, so more tasks than that move more and find no more.
TASK_ROWS = 1_000_000
#: Rows below which a task of its own is not worth it.
LEAST_ROWS = 20_000


#: Rounds after which the rows' margins are stored and their history is cut. Storing them writes a pair
#: of numbers for every row.
STORED_ROUNDS = 50
LEAST_TASKS = "spark.sql.files.minPartitionNum"


def in_even_tasks(rows: DataFrame, n: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The rows in even tasks, however few or uneven the files are that hold them.

    ``n`` is how many there are at most, if that is known; columns ``by`` that tell the rows apart save a sort.
    """
    n = rows.count() if n is None else n
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-n // TASK_ROWS), min(cores, n // LEAST_ROWS)), *by)


def fit(
    rows: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = "y",
    weight: str | None = "weight",
    validation: str | None = "is_validation",
    training: Training = Training(),
    spread: bool = True,
) -> GBTClassificationModel:
    """Boosted trees; with a validation column, training ends when its loss stops improving.

    Spark reads the rows several times. ``spread=False`` says that they are stored in files of one task each;
    else they are dealt out each time.
    """
    trees = GBTClassifier(
        featuresCol="_x",
        labelCol=label,
        maxIter=training.trees,
        maxDepth=training.depth,
        stepSize=training.learning_rate,
        minInstancesPerNode=training.min_leaf,
        subsamplingRate=training.row_share,
        featureSubsetStrategy=str(training.column_share),
        validationTol=training.min_improvement,
        seed=training.seed,
        checkpointInterval=STORED_ROUNDS,
    )
    if weight:
        trees = trees.setWeightCol(weight)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    used = [c for c in (label, weight, validation) if c]
    vectors = assemble(rows, features).select("_x", *used)
    if spread:
        return trees.fit(in_even_tasks(vectors))
    # a task for every file, where Spark would put several of them together
    conf = rows.sparkSession.conf
    before = conf.get(LEAST_TASKS, None)
    conf.set(LEAST_TASKS, len(rows.inputFiles()))
    try:
        return trees.fit(vectors)
    finally:
        conf.set(LEAST_TASKS, before) if before else conf.unset(LEAST_TASKS)


def validation_curve(model: GBTClassificationModel, held: DataFrame, features: Sequence[str] = FEATURES, label: str = "y") -> list[float]:
    """Loss over held-out rows, each of weight 1, after each round of the trees."""
    rows = assemble(held, features).select("_x", F.col(label).alias(model.getLabelCol()))
    if model.isSet(model.weightCol):
        rows = rows.withColumn(model.getWeightCol(), F.lit(1.0))
    return list(model.evaluateEachIteration(rows))


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round (from 0) of least loss, and whether ``patience`` rounds without a better one followed."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        if i - best >= patience:
            return best, True
    return best, False


def fit_with_patience(
    rows: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = "y",
    weight: str | None = "weight",
    validation: str = "is_validation",
    training: Training = Training(patience=200),
) -> tuple[GBTClassificationModel, list[float]]:
    """Boosted trees up to the best round, and the validation curve that shows it.

    Spark ends training at the first round without improvement, or not at all. Here training runs for
    twice the patience, then for twice as long, until the curve has stood still for ``patience``
    rounds. Rounds depend on the seed and the rounds before alone, so the model of the best round is
    trained by asking for that many.
    """
    train, held = rows.filter(~F.col(validation)), rows.filter(validation)
    rounds = min(training.trees, 2 * training.patience)
    while True:
        model = fit(train, features, label, weight, None, replace(training, trees=rounds))
        losses = validation_curve(model, held, features, label)
        best, still = best_round(losses, training.patience)
        if still or rounds >= training.trees:
            break
        rounds = min(training.trees, 2 * rounds)
    if best + 1 < rounds:
        model = fit(train, features, label, weight, None, replace(training, trees=best + 1))
    return model, losses[: best + 1 + training.patience]


def prepare_training(
    rows: DataFrame, key: Sequence[str], label: str = "y", training: Training = Training()
) -> DataFrame:
    """Adds a stratified validation mark and balanced class weights."""
    marked = stratified_split(rows, key, label, training.validation_share, training.seed)
    return balanced_weights(marked, label)


def stored_training(rows: DataFrame, key: Sequence[str], label: str = "y", training: Training = Training(), n: int | None = None) -> DataFrame:
    """As :func:`prepare_training` for distinct ``rows``, ``n`` at most, from a table in even files.

    The rows are made, hashed and dealt out once. Cuts and weights come from two columns of that table and
    are stored, a row per class, so that every reader only compares.
    """
    hashed = materialize(in_even_tasks(rows, n, key).withColumn("_hash", row_hash(key, training.seed)), "training")
    cuts = stratified_cuts(hashed, label, training.validation_share).withColumnRenamed("cut", "_cut")
    classes = materialize(lookup_small(class_weights(hashed, label), cuts, [label]), "classes")
    return lookup_small(hashed, classes, [label]).withColumn("is_validation", below_cut("_hash")).drop("_hash", "_cut")


def score(
    df: DataFrame, model: GBTClassificationModel, features: Sequence[str] = FEATURES, name: str = "score"
) -> DataFrame:
    """Adds P(attack); for batch and streaming rows."""
    out = model.transform(assemble(df, features))
    return out.withColumn(name, attack_score(F.col("probability"))).select(*df.columns, name)


def feature_importances(
    spark: SparkSession, model: GBTClassificationModel, features: Sequence[str] = FEATURES
) -> DataFrame:
    """One row (feature, importance) per model feature."""
    values = [(name, float(v)) for name, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(values, "feature string, importance double")


# --- explanations ---


@dataclass(frozen=True)
class Path:
    """A leaf: for each feature on the way to it, the interval that leads there and the share of
    training rows that take those turns."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    tree: int = 0

    def taken(self, x: np.ndarray) -> np.ndarray:
        cells = x[:, self.features]
        return (cells > self.low) & (cells <= self.high)


def paths_of(tree: dict[int, T.Row], weight: float, number: int = 0) -> list[Path]:
    """All leaves of one tree, from its stored nodes by id."""
    leaves = []

    def walk(node, box: dict[int, tuple[float, float, float]]):
        if node["leftChild"] < 0:
            low, high, share = np.array(list(box.values())).reshape(-1, 3).T
            leaves.append(
                Path(weight * node["prediction"], np.array(list(box), dtype=int), low, high, share, number)
            )
            return
        feature = node["split"]["featureIndex"]
        bound = node["split"]["leftCategoriesOrThreshold"][0]
        low, high, share = box.get(feature, (-np.inf, np.inf, 1.0))
        for child, interval in [
            (tree[node["leftChild"]], (low, min(high, bound))),
            (tree[node["rightChild"]], (max(low, bound), high)),
        ]:
            part = child["rawCount"] / node["rawCount"]
            walk(child, {**box, feature: (*interval, share * part)})

    walk(tree[0], {})
    return leaves


def leaf_shares(taken: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf worth 1, for each row of turn indicators.

    A feature that is known contributes its indicator, an unknown one its training share, and a
    coalition is worth the product. Summed over coalition sizes that is a polynomial per feature.
    """
    d = len(share)
    size_weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    out = np.empty(taken.shape)
    for i in range(d):
        others = np.zeros((len(taken), d))
        others[:, 0] = 1.0
        for j in range(d):
            if j != i:
                known = np.zeros_like(others)
                known[:, 1:] = others[:, :-1] * taken[:, j : j + 1]
                others = others * share[j] + known
        out[:, i] = (others @ size_weight) * (taken[:, i] - share[i])
    return out


#: Leaves that more features lead to are worked out one by one.
TABLE_FEATURES = 8
#: Rows that are explained at a time.
EXPLAINED_ROWS = 2048


@dataclass(frozen=True)
class Leaves:
    """Leaves of one tree as arrays (leaves x features on the way).

    ``cuts`` are the tree's comparisons, (feature, bound); two more that are never and always met
    stand behind them. ``low`` and ``high`` are places in that list. Shorter ways are filled up with
    turns that are always taken and that all training rows take, which changes no Shapley value.
    """

    value: np.ndarray
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    cut_features: np.ndarray
    cut_bounds: np.ndarray


def leaves_of(paths: Sequence[Path]) -> Leaves:
    size = max(len(p.features) for p in paths)
    cuts = sorted({(int(f), b) for p in paths for f, *ends in zip(p.features, p.low, p.high) for b in ends if np.isfinite(b)})
    place = {c: i for i, c in enumerate(cuts)}
    low = np.full((len(paths), size), len(cuts))
    high = low + 1
    features, share = np.zeros(low.shape, dtype=np.int64), np.ones(low.shape)
    for i, p in enumerate(paths):
        for j, (f, lo, hi) in enumerate(zip(p.features, p.low, p.high)):
            low[i, j], high[i, j] = place.get((int(f), lo), len(cuts)), place.get((int(f), hi), len(cuts) + 1)
        features[i, : len(p.features)], share[i, : len(p.features)] = p.features, p.share
    cut_features, cut_bounds = np.array(cuts, dtype=float).reshape(-1, 2).T
    return Leaves(np.array([p.value for p in paths]), features, low, high, share, cut_features.astype(int), cut_bounds)


def leaf_tables(share: np.ndarray) -> np.ndarray:
    """Shapley values of leaves worth 1: (sets of taken turns, leaves, features).

    A set is a number whose bit i says that turn i is taken. The sum over coalitions is a polynomial
    per set (see :func:`leaf_shares`), and a set's comes from that of the set without its last turn.
    """
    leaves, d = share.shape
    sets = np.arange(1 << d)
    poly = np.zeros((1 << d, leaves, d + 1))
    product = np.ones((1 << d, leaves))
    poly[0, :, 0] = 1.0
    for j in range(d):
        old, new = slice(0, 1 << j), slice(1 << j, 2 << j)
        poly[new] = poly[old] * share[:, j, None]
        poly[new, :, 1:] += poly[old, :, :-1]
        product[new] = product[old] * share[:, j]
    weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    known = poly[:, :, :d] @ weight
    absent = product[sets[::-1]]  # of the turns that are not in the set
    bits = 1 << np.arange(d)
    taken = (sets[:, None] & bits > 0)[:, None, :] - share
    with_turn, without = sets[:, None] | bits, sets[:, None] & ~bits
    return taken * absent[with_turn].transpose(0, 2, 1) * known[without].transpose(0, 2, 1)


def explain_tree(tree: Leaves, x: np.ndarray) -> np.ndarray:
    """Contributions (rows x features) of one tree, all its leaves at once."""
    below = (x.T[tree.cut_features] <= tree.cut_bounds[:, None]) if len(tree.cut_bounds) else np.zeros((0, len(x)), bool)
    # rows on the same side of every cut share their values
    sides = np.packbits(below.T, axis=1)
    sides = np.ascontiguousarray(np.pad(sides, ((0, 0), (0, -sides.shape[1] % 8 or 8 * (not sides.shape[1])))))
    keys = sides.view(np.uint64 if sides.shape[1] == 8 else np.dtype((np.void, sides.shape[1])))[:, 0]
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    below = np.vstack([below[:, first], np.zeros((1, len(first)), bool), np.ones((1, len(first)), bool)])
    leaves, d = tree.features.shape
    codes = np.zeros((leaves, len(first)), dtype=np.uint8)
    for j in range(d):
        codes |= (below[tree.high[:, j]] > below[tree.low[:, j]]).view(np.uint8) << j
    table = (leaf_tables(tree.share) * tree.value[:, None]).reshape(-1, d)
    each = table.take(codes.T.astype(np.int64) * leaves + np.arange(leaves), axis=0).reshape(len(first), -1)
    return (each @ np.eye(x.shape[1])[tree.features.ravel()])[which]


def model_leaves(paths: Sequence[Path]) -> tuple[list[Leaves], list[Path]]:
    """The trees as arrays, and the leaves with too many features on their way."""
    short = [p for p in paths if 0 < len(p.features) <= TABLE_FEATURES]
    trees = [leaves_of(list(own)) for _, own in groupby(sorted(short, key=lambda p: p.tree), key=lambda p: p.tree)]
    return trees, [p for p in paths if len(p.features) > TABLE_FEATURES]


def explain_leaves(trees: Sequence[Leaves], long: Sequence[Path], x: np.ndarray) -> np.ndarray:
    """Contributions (rows x features) to the margin."""
    out = np.zeros(x.shape)
    x = np.where(np.isnan(x), np.inf, x)  # at a split, a number that is none goes right
    for start in range(0, len(x), EXPLAINED_ROWS):
        rows, into = x[start : start + EXPLAINED_ROWS], out[start : start + EXPLAINED_ROWS]
        for tree in trees:
            into += explain_tree(tree, rows)
        for path in long:
            # Rows that take the same turns towards a leaf share their values.
            bits = 1 << np.arange(len(path.features))
            codes, which = np.unique(path.taken(rows) @ bits, return_inverse=True)
            turns = (codes[:, None] & bits > 0).astype(float)
            into[:, path.features] += (path.value * leaf_shares(turns, path.share))[which]
    return out


def explain_batch(paths: Sequence[Path], x: np.ndarray) -> np.ndarray:
    return explain_leaves(*model_leaves(paths), x)


def tree_nodes(spark: SparkSession, model_path: str) -> DataFrame:
    """Stored nodes of a saved model, one row per (tree, node)."""
    return spark.read.parquet(f"{model_path}/data")


def model_paths(nodes: DataFrame, tree_weights: Sequence[float]) -> list[Path]:
    """Leaves of all trees. The table is as large as the model, which the driver holds anyway."""
    trees: dict[int, dict[int, T.Row]] = {}
    for row in nodes.select("treeID", "nodeData").toLocalIterator():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    return [p for t in sorted(trees) for p in paths_of(trees[t], tree_weights[t], t)]


def base_margin(paths: list[Path]) -> float:
    """Margin of a row nothing is known about."""
    return float(sum(p.value * np.prod(p.share) for p in paths))


def contributions(
    df: DataFrame,
    paths: list[Path],
    features: Sequence[str] = FEATURES,
    only: str | None = None,
    name: str = "contributions",
) -> DataFrame:
    """Adds each feature's contribution to the log-odds of an attack (model order).

    ``only`` names a boolean column; other rows get null and cost nothing. The trees are sent to
    each executor once.
    """
    model = df.sparkSession.sparkContext.broadcast(model_leaves(paths))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def explain(cells: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in cells:
            out = [None] * len(batch)
            wanted = np.flatnonzero(batch.notna())
            if len(wanted):
                # Log-odds are twice the margin.
                values = 2 * explain_leaves(*model.value, np.stack(batch.iloc[wanted].to_list()))
                for place, row in zip(wanted, values):
                    out[place] = row
            yield pd.Series(out, dtype=object)

    cells = F.array(*[F.col(c).cast("double") for c in features])
    return df.withColumn(name, explain(F.when(F.col(only), cells) if only else cells))


def explain_alerts(
    df: DataFrame,
    paths: list[Path],
    features: Sequence[str] = FEATURES,
    top_n: int = 3,
    only: str = "is_attack",
) -> DataFrame:
    """Adds ``reason``: the features that pushed an attack's score up most."""
    out = contributions(df, paths, features, only, "_contributions")
    top = top_contributions(list(features), F.col("_contributions"), top_n)
    return out.withColumn("reason", F.when(F.col(only), reason_text(top))).drop("_contributions")


def margin(df: DataFrame, model: GBTClassificationModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """Adds the model's ``log_odds``."""
    out = model.transform(assemble(df, features))
    odds = vector_to_array("rawPrediction")[1] * 2
    return out.withColumn("log_odds", odds).select(*df.columns, "log_odds")


# --- evaluation and storage ---


def validation_metrics(scored: DataFrame) -> DataFrame:
    """One row: ROC-AUC, PR-AUC, best threshold, and the confusion and rates there."""
    best = ev.best_threshold(scored)
    limit = best.select("best_threshold").scalar()
    cells = ev.rates(ev.confusion(ev.predict(scored, limit)))
    return cells.withColumns(
        {
            "roc_auc": ev.roc_auc(scored).scalar(),
            "pr_auc": ev.average_precision(scored).scalar(),
            "best_threshold": limit,
        }
    )


def save_model(
    model: GBTClassificationModel,
    path: str,
    threshold: float,
    features: Sequence[str] = FEATURES,
    data_path: str = "",
) -> None:
    """Stores the model, and what is needed to use it as one JSON row."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/model")
    meta = [(float(threshold), list(features), 1, 0, data_path)]
    schema = "threshold double, features array<string>, label_positive int, label_negative int, csv_path string"
    spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, T.Row]:
    schema = "threshold double, features array<string>, label_positive int, label_negative int, csv_path string"
    meta = spark.read.schema(schema).json(f"{path}/meta").first()
    return GBTClassificationModel.load(f"{path}/model"), meta
