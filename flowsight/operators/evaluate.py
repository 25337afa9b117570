"""Detection quality: confusion, reports, ROC and precision-recall metrics, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsight.functions.scalars import ratio

# Rank buckets for curves over distinct scores; also the size of the table of their totals.
CURVE_BUCKETS = 500

# A threshold at or above the first is replaced by the second.
CAP_FROM, CAP_TO = 0.99, 0.95
F1_EPSILON = 1e-12


def _count(hit: Column) -> Column:
    return F.count_if(F.coalesce(hit, F.lit(False)))


def predict(scores: DataFrame, threshold: float | Column, score: str = "score") -> DataFrame:
    """Adds ``pred``: 1 from the threshold on."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scores.withColumn("pred", (F.col(score) >= limit).cast("int"))


def confusion(predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts tn, fp, fn, tp of ``y`` against ``pred`` (in one row, or per group)."""
    y, p = F.col("y"), F.col("pred")
    return predicted.groupBy(*(by or [])).agg(
        _count((y == 0) & (p == 0)).alias("tn"),
        _count((y == 0) & (p == 1)).alias("fp"),
        _count((y == 1) & (p == 0)).alias("fn"),
        _count((y == 1) & (p == 1)).alias("tp"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Adds recall, precision, false positive rate and accuracy; 0 where nothing was counted."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ["tn", "fp", "fn", "tp"])
    return counts.withColumns(
        {
            "recall": ratio(tp, tp + fn),
            "precision": ratio(tp, tp + fp),
            "fpr": ratio(fp, tn + fp),
            "accuracy": ratio(tn + tp, tn + fp + fn + tp),
        }
    )


def dataset_report(predicted: DataFrame, by: str = "source_file") -> DataFrame:
    """Per dataset: rows, detections, accuracy, score range, and what its detections mean.

    A dataset is an ATTACK one when most of its rows are attacks; its rate is then the detection
    rate, otherwise the false positive rate.
    """
    counts = predicted.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("pred").cast("long").alias("detected"),
        F.avg(F.col("y").cast("double")).alias("_share"),
        F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"),
        F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.sum(F.col("y")).cast("long").alias("true_attacks"),
        _count((F.col("y") == 1) & (F.col("pred") == 1)).alias("tp"),
        _count((F.col("y") == 0) & (F.col("pred") == 1)).alias("fp"),
        _count((F.col("y") == 0) & (F.col("pred") == 0)).alias("tn"),
        _count((F.col("y") == 1) & (F.col("pred") == 0)).alias("fn"),
    )
    return (
        counts.withColumn("status", F.when(F.col("_share") > 0.5, "ATTACK").otherwise("BENIGN"))
        .withColumn("rate", ratio(F.col("detected").cast("double"), F.col("samples").cast("double")))
        .drop("_share")
    )


def evaluation_summary(datasets: DataFrame) -> DataFrame:
    """Totals over the attack and the benign datasets; rates and scores averaged over datasets."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    return datasets.groupBy("status").agg(
        F.count(F.lit(1)).alias("datasets"),
        total("samples"),
        total("detected"),
        F.avg("rate").alias("average_rate"),
        F.avg("mean_score").alias("average_score"),
        F.min("min_score").alias("min_score"),
        F.max("max_score").alias("max_score"),
        *[total(c) for c in ["tp", "fp", "tn", "fn"]],
    )


def classification_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, their macro and weighted averages, accuracy."""
    pairs = predicted.groupBy("y", "pred").agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array_distinct(F.array("y", "pred"))).alias("class")
    n = F.col("n")
    hit = (F.col("y") == F.col("class")) & (F.col("pred") == F.col("class"))
    classes = (
        pairs.select("y", "pred", "n", each)
        .groupBy("class")
        .agg(
            F.sum(F.when(hit, n).otherwise(0)).cast("double").alias("hits"),
            F.sum(F.when(F.col("pred") == F.col("class"), n).otherwise(0)).cast("double").alias("said"),
            F.sum(F.when(F.col("y") == F.col("class"), n).otherwise(0)).alias("support"),
        )
        .withColumn("precision", ratio(F.col("hits"), F.col("said")))
        .withColumn("recall", ratio(F.col("hits"), F.col("support").cast("double")))
        .withColumn("f1", ratio(2 * F.col("hits"), F.col("said") + F.col("support")))
    )
    measures = ["precision", "recall", "f1"]
    per_class = classes.select(F.col("class").cast("string").alias("label"), *measures, "support")
    totals = classes.agg(
        F.sum("support").alias("all"),
        F.sum("hits").alias("right"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[
            ratio(F.sum(F.col(m) * F.col("support")), F.sum("support").cast("double")).alias(f"weighted_{m}")
            for m in measures
        ],
    )
    accuracy = ratio(F.col("right"), F.col("all").cast("double"))
    line = lambda label, values: F.struct(
        F.lit(label).alias("label"),
        *[v.alias(m) for m, v in zip(measures, values)],
        F.col("all").alias("support"),
    )
    summary = totals.select(
        F.explode(
            F.array(
                line("accuracy", [accuracy] * 3),
                line("macro avg", [F.col(f"macro_{m}") for m in measures]),
                line("weighted avg", [F.col(f"weighted_{m}") for m in measures]),
            )
        ).alias("line")
    ).select("line.*")
    return per_class.unionByName(summary)


def class_balance(labelled: DataFrame) -> DataFrame:
    """Rows, positives and their percentage."""
    return labelled.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("y"), F.lit(0)).cast("long").alias("positives")
    ).withColumn(
        "percent", 100 * ratio(F.col("positives").cast("double"), F.col("rows").cast("double"))
    )


# --- curves over distinct scores ---


def score_totals(scores: DataFrame, score: str = "score", buckets: int = CURVE_BUCKETS) -> DataFrame:
    """Per distinct score: positives and negatives at it (``pos``, ``neg``), at or above it
    (``tp``, ``fp``), and overall (``all_pos``, ``all_neg``).

    Rows are first counted per distinct score. The running totals are then split over score
    quantiles: each quantile adds up its own scores, starting from the totals of the quantiles
    above it, which are a table of at most ``buckets`` rows.
    """
    counted = (
        scores.filter(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.sum(F.col("y")).cast("long").alias("pos"),
            F.sum(1 - F.col("y")).cast("long").alias("neg"),
        )
    )
    # Asking for the counts here too makes the three uses of `counted` one plan, computed once.
    listed = F.when(F.col("pos") + F.col("neg") > 0, F.col("score"))
    marks = F.lit([i / buckets for i in range(1, buckets)])
    bounds = counted.agg(
        F.array_distinct(F.percentile_approx(listed, marks, 10 * buckets)).alias("_bounds")
    )
    # Number of quantile bounds at or above the score: 0 is the top quantile. Never null, or the
    # join on it would push a null check (and this search) below the count, to every single row.
    above_score = F.filter("_bounds", lambda b: b >= F.col("score"))
    bucket = F.coalesce(F.size(above_score), F.lit(0))
    placed = counted.withColumn("_bounds", bounds.scalar()).withColumn("_bucket", bucket).drop("_bounds")
    totals = placed.groupBy("_bucket").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    every = W.partitionBy(F.lit(0))
    above = every.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "_bucket",
        "_pos",
        "_neg",
        F.coalesce(F.sum("_pos").over(above), F.lit(0)).alias("pos"),
        F.coalesce(F.sum("_neg").over(above), F.lit(0)).alias("neg"),
    ).agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct("_bucket", F.struct("pos", "neg")))).alias("above"),
            F.sum("_pos").alias("pos"),
            F.sum("_neg").alias("neg"),
        )
    )
    down = W.partitionBy("_bucket").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    start = F.col("_starts.above")[F.col("_bucket")]
    return placed.withColumn("_starts", starts.scalar()).select(
        "score",
        "pos",
        "neg",
        (start["pos"] + F.sum("pos").over(down)).alias("tp"),
        (start["neg"] + F.sum("neg").over(down)).alias("fp"),
        F.col("_starts.pos").alias("all_pos"),
        F.col("_starts.neg").alias("all_neg"),
    )


def pr_curve(scores: DataFrame, score: str = "score") -> DataFrame:
    """Precision and recall with each distinct score as the threshold."""
    t = score_totals(scores, score)
    return t.select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        # With no positives at all, every threshold finds all of them.
        F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("all_pos").cast("double")), F.lit(1.0)).alias("recall"),
        "tp",
        "fp",
    )


def average_precision(scores: DataFrame, score: str = "score") -> DataFrame:
    """Sum over thresholds of the recall gained times the precision there."""
    t = score_totals(scores, score)
    gained = ratio(F.col("pos").cast("double"), F.col("all_pos").cast("double"))
    precision = ratio(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    return t.agg(F.coalesce(F.sum(gained * precision), F.lit(0.0)).alias("average_precision"))


def roc_auc(scores: DataFrame, score: str = "score") -> DataFrame:
    """Chance that a positive scores above a negative, ties counting half; null with one class."""
    t = score_totals(scores, score)
    below = F.col("all_neg") - F.col("fp")
    won = F.col("pos").cast("double") * (below.cast("double") + F.col("neg").cast("double") / 2)
    pairs = F.col("all_pos").cast("double") * F.col("all_neg").cast("double")
    return t.agg(F.sum(F.try_divide(won, pairs)).alias("roc_auc"))


def best_threshold(scores: DataFrame, score: str = "score") -> DataFrame:
    """The threshold with the highest F1 (the lowest one on ties), capped for practical use."""
    curve = pr_curve(scores, score)
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * p * r / (p + r + F.lit(F1_EPSILON))
    best = curve.withColumn("f1", f1).orderBy(F.desc("f1"), "threshold").limit(1)
    capped = F.when(F.col("threshold") >= CAP_FROM, F.lit(CAP_TO)).otherwise(F.col("threshold"))
    return best.select(capped.alias("best_threshold"), "f1")


def importance_report(importances: DataFrame) -> DataFrame:
    """Features by importance with their share, and whether the top one holds over half.

    ``importances`` has one row per model feature.
    """
    every = W.partitionBy(F.lit(0))
    ranked = every.orderBy(F.desc("importance"), "feature")
    share = ratio(F.col("importance"), F.sum("importance").over(every))
    return importances.select(
        "feature",
        "importance",
        share.alias("share"),
        F.row_number().over(ranked).alias("rank"),
    ).withColumn("dominant", (F.col("rank") == 1) & (F.col("share") > 0.5))
