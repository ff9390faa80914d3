"""Connected components by DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.session import materialise


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """vertices(v), edges(a, b) -> (v, component): the least vertex of its component.

    Each round every vertex takes the least label among its neighbours' and its own, then the label of its label
    (pointer jumping), so long chains halve. Labels are written to the shared folder each round, which cuts the
    lineage; only the count of changes comes to the driver. Vertices without edges are their own components. Hot
    vertices are pre-aggregated by min before the shuffle.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = vertices.select("v").distinct().withColumn("component", F.col("v"))
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "v", "left").select("v", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = lower.select(F.col("v").alias("component"), F.col("component").alias("root"))
        new = materialise(lower.join(roots, "component", "left").select("v", "old", F.coalesce(F.least("component", "root"), "component").alias("component")), "labels")
        changed = not new.where("old <> component").isEmpty()
        labels = new.select("v", "component")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
