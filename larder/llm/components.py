"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.store import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for all nodes of edges (a, b).

    Each round a node takes the least label of its neighbours, then the label of that label, so labels
    travel in doubling steps. Every round is a stored table; labels never reach the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
    labels = stored(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = step.join(labels.select(F.col("node").alias("via"), F.col("component").alias("beyond")), "via")
        moved = stored(jump.select("node", "old", F.least("via", "beyond").alias("component")))
        labels = moved.select("node", "component")
        if moved.filter("old <> component").isEmpty():
            return labels


def merged(component: DataFrame, links: DataFrame) -> DataFrame:
    """node, component after further links (a, b): those between two components are the edges, once each."""
    of_a, of_b = (component.select(F.col("node").alias(s), F.col("component").alias(f"of_{s}")) for s in "ab")
    edges = links.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    joined = components(stored(edges.filter("a <> b").distinct()))
    up = joined.select(F.col("node").alias("component"), F.col("component").alias("up"))
    moved = component.join(up, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    return stored(moved.union(joined.join(component, "node", "left_anti").select("node", "component")))
