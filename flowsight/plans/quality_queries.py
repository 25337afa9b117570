"""Queries over labelled scores: detection quality reports and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsight.operators import evaluate as ev
from flowsight.plans import adapters
from flowsight.plans.adapters import DATASETS
from flowsight.plans.registry import query, rounded

THRESHOLD = 0.65
NAMES_SQL = "[" + ", ".join(f"'{d}'" for d in DATASETS) + "]"

LABELLED = f"""
labelled AS (
  SELECT {NAMES_SQL}[CAST(1 + l_suppkey % {len(DATASETS)} AS INTEGER)] AS source_file,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         round(least(1.0::DOUBLE, l_discount * 5 + l_tax + l_quantity / 200), 4) AS score
  FROM lineitem
), predicted AS (
  SELECT *, CASE WHEN score >= {THRESHOLD} THEN 1 ELSE 0 END AS pred FROM labelled
)"""

RATES_SQL = """
  coalesce(round_even(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6), 0) AS recall,
  coalesce(round_even(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6), 0) AS precision,
  coalesce(round_even(fp / nullif(CAST(tn + fp AS DOUBLE), 0), 6), 0) AS fpr,
  round_even((tn + tp) / CAST(tn + fp + fn + tp AS DOUBLE), 6) AS accuracy"""

CELLS_SQL = """
  count(*) FILTER (y = 0 AND pred = 0) AS tn, count(*) FILTER (y = 0 AND pred = 1) AS fp,
  count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 1 AND pred = 1) AS tp"""


def predicted(spark, sf_dir):
    return ev.predict(adapters.labelled_scores(spark, sf_dir), THRESHOLD)


@query(f"WITH {LABELLED}, cells AS (SELECT {CELLS_SQL} FROM predicted) SELECT *, {RATES_SQL} FROM cells")
def confusion(spark, sf_dir):
    return rounded(ev.rates(ev.confusion(predicted(spark, sf_dir))))


REPORT = f"""{LABELLED}, report AS (
  SELECT source_file, count(*) AS samples, CAST(sum(pred) AS BIGINT) AS detected,
         avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS accuracy, avg(score) AS mean_score,
         min(score) AS min_score, max(score) AS max_score, CAST(sum(y) AS BIGINT) AS true_attacks,
         {CELLS_SQL}, CASE WHEN avg(y) > 0.5 THEN 'ATTACK' ELSE 'BENIGN' END AS status,
         sum(pred) / CAST(count(*) AS DOUBLE) AS rate
  FROM predicted GROUP BY 1
)"""


@query(f"""
WITH {REPORT}
SELECT * REPLACE (round_even(accuracy, 6) AS accuracy, round_even(mean_score, 6) AS mean_score,
                  round_even(min_score, 6) AS min_score, round_even(max_score, 6) AS max_score,
                  round_even(rate, 6) AS rate) FROM report""")
def dataset_report(spark, sf_dir):
    return rounded(ev.dataset_report(predicted(spark, sf_dir)))


@query(f"""
WITH {REPORT}
SELECT status, count(*) AS datasets, CAST(sum(samples) AS BIGINT) AS samples,
       CAST(sum(detected) AS BIGINT) AS detected, round_even(avg(rate), 6) AS average_rate,
       round_even(avg(mean_score), 6) AS average_score, round_even(min(min_score), 6) AS min_score,
       round_even(max(max_score), 6) AS max_score, CAST(sum(tp) AS BIGINT) AS tp,
       CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn
FROM report GROUP BY 1""")
def evaluation_summary(spark, sf_dir):
    return rounded(ev.evaluation_summary(ev.dataset_report(predicted(spark, sf_dir))))


@query(f"""
WITH {LABELLED}, classes AS (
  SELECT c AS class, CAST(count(*) FILTER (y = c AND pred = c) AS DOUBLE) AS hits,
         CAST(count(*) FILTER (pred = c) AS DOUBLE) AS said, count(*) FILTER (y = c) AS support
  FROM predicted, (VALUES (0), (1)) v(c) GROUP BY 1
), measured AS (
  SELECT *, coalesce(hits / nullif(said, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall,
         2 * hits / (said + support) AS f1 FROM classes
), lines AS (
  SELECT CAST(class AS VARCHAR) AS label, precision, recall, f1, support FROM measured
  UNION ALL
  SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM measured
  UNION ALL
  SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM measured
  UNION ALL
  SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support) FROM measured
)
SELECT label, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
       round_even(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM lines""")
def classification_report(spark, sf_dir):
    return rounded(ev.classification_report(predicted(spark, sf_dir)))


@query(f"""
WITH {LABELLED}
SELECT count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, round_even(100.0 * sum(y) / count(*), 6) AS percent
FROM labelled""")
def class_balance(spark, sf_dir):
    return rounded(ev.class_balance(adapters.labelled_scores(spark, sf_dir)))


CURVE = f"""{LABELLED}, counted AS (
  SELECT score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM labelled GROUP BY 1
), curve AS (
  SELECT *, CAST(sum(pos) OVER d AS BIGINT) AS tp, CAST(sum(neg) OVER d AS BIGINT) AS fp,
         sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM counted WINDOW d AS (ORDER BY score DESC)
), pr AS (
  SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(all_pos AS DOUBLE) AS recall FROM curve
)"""


@query(f"""
WITH {CURVE}
SELECT score AS threshold, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall, tp, fp FROM pr""")
def pr_curve(spark, sf_dir):
    return rounded(ev.pr_curve(adapters.labelled_scores(spark, sf_dir)), 6, ["precision", "recall"])


@query(f"WITH {CURVE} SELECT round_even(sum(pos / CAST(all_pos AS DOUBLE) * precision), 6) AS average_precision FROM pr")
def average_precision(spark, sf_dir):
    return rounded(ev.average_precision(adapters.labelled_scores(spark, sf_dir)))


@query(f"""
WITH {CURVE}
SELECT round_even(sum(pos * (all_neg - fp + neg / 2.0::DOUBLE) / (all_pos * all_neg)), 6) AS roc_auc FROM pr""")
def roc_auc(spark, sf_dir):
    return rounded(ev.roc_auc(adapters.labelled_scores(spark, sf_dir)))


@query(f"""
WITH {CURVE}, scored AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM pr)
SELECT CASE WHEN score >= 0.99 THEN 0.95 ELSE score END AS best_threshold, round_even(f1, 6) AS f1
FROM scored ORDER BY scored.f1 DESC, score LIMIT 1""")
def best_threshold(spark, sf_dir):
    return rounded(ev.best_threshold(adapters.labelled_scores(spark, sf_dir)), 6, ["f1"])


@query(f"""
WITH {LABELLED}, stats AS (
  SELECT source_file AS feature, sum(score) AS importance FROM labelled GROUP BY 1
)
SELECT feature, round_even(importance, 4) AS importance,
       round_even(importance / sum(importance) OVER (), 6) AS share,
       CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS rank,
       row_number() OVER (ORDER BY importance DESC, feature) = 1
         AND importance / sum(importance) OVER () > 0.5 AS dominant
FROM stats""")
def importance_ranking(spark, sf_dir):
    stats = adapters.labelled_scores(spark, sf_dir).groupBy(
        F.col("source_file").alias("feature")
    ).agg(F.sum("score").alias("importance"))
    return rounded(rounded(ev.importance_report(stats), 4, ["importance"]), 6, ["share"])
