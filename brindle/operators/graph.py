"""Connected components as a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of edges (a, b): label is the smallest node that it can reach.

    Each round takes the least label among the neighbours, then that label's
    own label, so chains shorten by more than half; it ends when nothing
    changes. No edges: no rows. Hubs are hot only in joins, which Spark splits,
    and in minima, which are taken before the shuffle.
    """
    both = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("other"))
        step = labels.join(near, "node").select("node", F.least("label", "other").alias("next"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = cut(step.join(jump, "next").select("node", F.least("next", "far").alias("label"), "was"))
        labels = new.select("node", "label")
        if not new.where("label <> was").limit(1).count():
            return labels
