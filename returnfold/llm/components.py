"""Distributed connected components by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of edges (a, b): component is the least node that a node is linked with.

    Each round, a node takes the least label among its own and its neighbours', and then that label's
    own label, so a path of n edges needs about log n rounds. A label is one row however many links a
    node has: a hub's links meet in a partial minimum, and the join against them is one that Spark can
    split. Each round is a stored table, so a lost executor costs no more than its tasks. Nulls and
    loops are left out.
    """
    pairs = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = stored(pairs.union(pairs.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        fresh = stored(least.join(jump, "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("old")).alias("moved")), "labels")
        labels = fresh.select("node", "label")
        if fresh.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
