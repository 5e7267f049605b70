"""Connected components of a distributed edge list, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.storage import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge list (a, b): the component is the smallest node reachable.

    Each round hooks every node's label under the smallest label next to it and then jumps labels to their own
    labels, so that the number of rounds grows with the logarithm of the longest chain. Labels and edges are
    written to the shared folder after each round. Self links give their node; null ends are ignored.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    pairs = stored(edges.union(edges.select("b", "a")).distinct())
    label = stored(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        before = pairs
        # Edges between labels; an edge inside a component is done.
        left = label.select(F.col("node").alias("a"), F.col("component").alias("la"))
        right = label.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        pairs = stored(pairs.join(left, "a").join(right, "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        discard(before)
        hook = pairs.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("low")).where("low < root")
        hook = stored(hook)
        if hook.isEmpty():
            discard(pairs, hook)
            break
        # From now on edges run between roots. A root's new label is the end of its chain of hooks.
        chain, old = hook.select("root", F.col("low").alias("end")), [label, hook]
        while True:
            step = stored(hook_step(chain))
            old.append(step)
            chain = step.select("root", "end")
            if step.where("moved").isEmpty():
                break
        moved = label.join(chain, label["component"] == chain["root"], "left")
        label = stored(moved.select("node", F.coalesce("end", "component").alias("component")))
        discard(*old)
    return label


def hook_step(chain: DataFrame) -> DataFrame:
    """Every root's end replaced by its end's end; moved tells whether it had one."""
    far = chain.select(F.col("root").alias("end"), F.col("end").alias("far"))
    return chain.join(far, "end", "left").select("root", F.coalesce("far", "end").alias("end"), F.col("far").isNotNull().alias("moved"))
