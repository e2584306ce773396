"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """node and root of every node that has a link; `edges` has long columns a and b.

    Nodes are ranked by a hash, so that ids in order along a path don't matter. Each round
    joins every node to the least of its neighbours and contracts the links; about half of
    the nodes go each time. Rounds end when no link is left, and each is checkpointed.
    """
    one = edges.select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y")).where("x <> y").distinct()
    names = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.xxhash64("node").alias("label"))
    one, labels = cut_lineage(one), cut_lineage(names)
    while not one.isEmpty():
        both = one.union(one.select("y", "x"))
        least = cut_lineage(both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low")))
        one = (
            one.join(least, "x")
            .select(F.col("low").alias("x2"), "y")
            .join(least.withColumnRenamed("x", "y"), "y")
            .select(F.col("x2").alias("x"), F.col("low").alias("y"))
            .where("x <> y")
            .distinct()
        )
        one = cut_lineage(one)
        labels = cut_lineage(labels.join(least, F.col("label") == F.col("x"), "left").select("node", F.coalesce("low", "label").alias("label")))
    tops = labels.groupBy("label").agg(F.min("node").alias("root"))
    return labels.join(tops, "label").select("node", "root")
