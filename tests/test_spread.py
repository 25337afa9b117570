"""Work that must not grow in one task, or move rows to find a few numbers."""

from pyspark.sql import functions as F

from flowsight.operators import model, split
from flowsight.plans import jobs
from flowsight.schema import FEATURES


def test_cuts_and_weights_leave_the_rows_where_they_are(spark, plan_of):
    rows = spark.range(1000).select(
        "id", (F.col("id") % 2).alias("y"), F.lit("BenignTraffic").alias("source_file"), F.col("id").alias("row_position")
    )
    marked = [split.stratified_split(rows, ["id"]), split.balanced_weights(rows), split.split_by_file(rows)]
    for df in marked:
        plan = plan_of(df)
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert df.count() == 1000


def test_training_rows_are_dealt_out_once(spark, plan_of, monkeypatch):
    monkeypatch.setattr(model, "TASK_ROWS", 1000)
    given, fit = [], model.GBTClassifier.fit

    def seen(self, rows):
        given.append(("Exchange " in plan_of(rows).replace("BroadcastExchange ", ""), sorted(rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect())))
        return fit(self, rows)

    monkeypatch.setattr(model.GBTClassifier, "fit", seen)
    cells = [(F.xxhash64("id", F.lit(c)) % 100 + (F.col("id") % 2) * 30).cast("double").alias(c) for c in FEATURES]
    rows = spark.range(20_000).select(*cells, F.when(F.col("id") % 2 == 0, "benign").otherwise("xss").alias("label")).checkpoint()
    trained = jobs.train(rows.union(rows.limit(100)).coalesce(1), model.Training(trees=2, depth=2))
    shuffled, sizes = given[0]
    assert not shuffled and 21 == len(sizes) and max(sizes) < 1500
    assert trained.model.getNumTrees == 2 and spark.conf.get(model.LEAST_TASKS, None) is None
    marked = [how(rows.withColumn("y", (F.col("label") == "xss").cast("int")), [*FEATURES, "label"]) for how in (model.stored_training, model.prepare_training)]
    stored, plain = (m.select(*FEATURES, "label", "y", "is_validation", "weight") for m in marked)
    assert stored.count() == 20_000 and stored.exceptAll(plain).isEmpty() and plain.exceptAll(stored).isEmpty()


def test_training_rows_lie_in_even_tasks(spark, monkeypatch):
    monkeypatch.setattr(model, "TASK_ROWS", 100)
    rows = model.in_even_tasks(spark.range(1000).coalesce(1))
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and sum(sizes) == 1000 and max(sizes) < 150
    assert model.in_even_tasks(spark.range(0)).count() == 0
