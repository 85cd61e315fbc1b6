"""Connected components of an edge table by hooking, jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import discard, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of an edge; component is one of its nodes.

    Each round hooks every node to its smallest neighbour, jumps once, and contracts the edges,
    so that only edges between different labels remain. Every round is written to the shared
    folder and the tables of the round before are deleted; the driver sees no more than whether
    edges are left. Node ids that are hashes make the rounds few.
    """
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent"))
        hook = hooked = written(hook, "hooks")
        jump = hook.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        hook = written(hook.join(jump, "parent").select("node", F.col("grand").alias("parent")), "jumps")
        moved = labels.join(hook.withColumnRenamed("node", "component"), "component", "left")
        old, labels = labels, written(moved.select("node", F.coalesce("parent", "component").alias("component")), "labels")
        discard(old)
        to = hook.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        both_ends = left.join(hook.withColumnRenamed("node", "a"), "a").join(to, "b")
        old, left = left, written(both_ends.select(F.least("parent", "pb").alias("a"), F.greatest("parent", "pb").alias("b")).where("a <> b").distinct(), "edges")
        discard(old, hooked, hook)
    discard(left)
    return labels
