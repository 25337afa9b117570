"""Connected components of a link table, by label exchange with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsight.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that links reach, for every node of ``links`` (a, b: long).

    Each round a node takes the smallest label among its neighbours and itself, then the label of
    that label, so distances at least halve. Labels are written in the shared folder after every
    round; only a count of changes comes to the driver. A table without links gives no rows.
    """
    links = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        heard = (
            links.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("near"))
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        step = lower.join(far, "near").select("node", F.least("near", "far").alias("label"), "old")
        step = materialize(step, "labels")
        changed = step.filter(F.col("label") != F.col("old")).limit(1).count()
        labels = step.select("node", "label")
        if not changed:
            return labels
