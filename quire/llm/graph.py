"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.llm.shared import remove, written


def components(edges: DataFrame) -> DataFrame:
    """v and the least vertex of its component, for the vertices of ``edges`` (columns a and b).

    Least labels go along the edges and labels jump to their own labels, so the
    rounds grow with the logarithm of the diameter. Each round is written to the
    shared folder; the driver sees only the number of changes."""
    edges = edges.where("a <> b").select("a", "b")
    both = written(edges.union(edges.select("b", "a")).distinct())
    labels = written(both.select(F.col("a").alias("v")).distinct().withColumn("label", F.col("v")))
    held: list[DataFrame] = [labels]
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        lower = written(lower)
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("further"))
        new = written(lower.join(jump, "label").select("v", F.least("label", "further").alias("label"), "old"))
        changed = new.where("label <> old").limit(1).count()
        remove(lower, *held)
        held = [new]
        labels = new.select("v", "label")
        if not changed:
            remove(both)
            return labels
