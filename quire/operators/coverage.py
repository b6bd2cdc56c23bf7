"""Coverage of concepts by maps and other notes, and the watchdog for notes that no index routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def classified(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Concepts (path, domain) as mounted (a map links them), pending (another note does) or orphan; edges: target, from_map."""
    seen = edges.groupBy(F.col("target").alias("path")).agg(F.bool_or("from_map").alias("mapped"))
    state = F.when(F.col("mapped").isNull(), "orphan").when(F.col("mapped"), "mounted").otherwise("pending")
    return concepts.join(seen, "path", "left").select("path", F.coalesce("domain", F.lit("(none)")).alias("domain"), state.alias("state"))


def coverage(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of each domain."""
    states = ("mounted", "pending", "orphan")
    return classified(concepts, edges).groupBy("domain").agg(F.count("*").alias("concepts"), *(F.count_if(F.col("state") == s).alias(s) for s in states))


def unrouted(notes: DataFrame, mapped: DataFrame, routes: dict[str, str]) -> DataFrame:
    """Notes of a routed type that their index doesn't link (notes: path, type; mapped: index, target; routes: type to index)."""
    spark = notes.sparkSession
    route = spark.createDataFrame(sorted(routes.items()), "type string, index string")
    due = notes.join(F.broadcast(route), "type")  # as many rows as the contract has routes
    return due.join(mapped.select("index", F.col("target").alias("path")).distinct(), ["index", "path"], "left_anti")
