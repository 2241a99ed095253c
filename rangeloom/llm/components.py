"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, few, keep


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node that links reach, for every node of a link.

    Each round, every node takes the smallest of itself and its neighbours, and links are redrawn between what was
    taken; loops and repeats go. A hub is a group of a sum with partial sums, never a collected list. The number of
    rounds grows with the logarithm of the longest path, each ends in written tables, and nothing goes to the driver.
    """
    cut = lambda df: few(keep(df, "components"))
    edges = cut(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())
    labels = cut(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("y"))
        jump = step.select(F.col("x").alias("y"), F.col("y").alias("z"))
        step = cut(step.join(jump, "y", "left").select("x", F.coalesce("z", "y").alias("y")))  # two steps at once
        moved = labels.join(step, labels["root"] == step["x"], "left").select("node", F.coalesce("y", "root").alias("root"))
        s1, s2 = step.select(F.col("x").alias("a"), F.col("y").alias("na")), step.select(F.col("x").alias("b"), F.col("y").alias("nb"))
        redrawn = edges.join(s1, "a").join(s2, "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).where("a <> b")
        # Every link is redrawn, so what was connected stays connected.
        old = [edges, labels, step]
        edges, labels = cut(redrawn.distinct()), cut(moved)
        for df in old:
            drop_kept(df)
    return labels
