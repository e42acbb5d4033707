"""Connected components by repeated hooking and contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the least node of its component.

    Each round every node hooks onto its least neighbour if that is less than
    itself, the trees are flattened by pointer jumping, and edges are rewritten
    to roots. At least every second node that still has an edge disappears in a
    round, so the number of rounds grows with the logarithm of the nodes.
    Tables are written between steps, so nothing is recomputed after a loss.
    """
    edges = edges.select("a", "b")
    both = edges.union(edges.select("b", "a"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    left = cut(edges.where("a != b").distinct(), "edges")
    first = True
    while not left.isEmpty():
        hooks = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("to")).where(F.col("to") < F.col("a"))
        hooks = cut(hooks.select(F.col("a").alias("x"), "to"), "hooks")
        while True:
            far = hooks.select(F.col("x").alias("to"), F.col("to").alias("next"))
            jumped = cut(hooks.join(far, "to", "left").select("x", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jump")
            done = jumped.where("moved").isEmpty()
            hooks = jumped.select("x", "to")
            if done:
                break
        for c in ("a", "b"):
            left = left.join(hooks.withColumnRenamed("x", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        left = cut(left.where("a != b").select("a", "b").distinct(), "edges")
        labels = labels.join(hooks.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = cut(labels, "labels")
        first = False
    return cut(labels, "labels") if first else labels
