"""Connected components of a graph given as edges, without collecting links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import discard, materialise


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 linked by a[i]-b[i]: each node's smallest reachable node."""
    label = np.arange(n)
    if len(a):
        while True:
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, before, label)
            label = label[label]
            if (label == before).all():
                break
    return label


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component: the smallest node reachable.

    Each round gives every node its smallest neighbour as parent, turns its other links into links between that
    parent and them, and replaces parents by their parents. Minima are combined before they are shuffled, and joins
    have one side with a row a key, so a node with very many links splits as a skewed join. Rounds grow with the
    logarithm of the longest chain. Loops and repeated links don't matter; null ends are left out; no links give no
    rows.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    linked = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    now, path = materialise(linked.withColumn("more", F.lit(1)), "links")
    while True:
        parent = now.groupBy("a").agg(F.min("b").alias("p"))
        other = now.join(parent, "a").where("b != p").select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"), F.lit(1).alias("more"))
        above = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        jumped = parent.join(above, "p", "left").select("a", F.coalesce("q", "p").alias("b"), F.when(F.col("q").isNotNull(), 1).otherwise(0).alias("more"))
        after = jumped.unionByName(other).groupBy("a", "b").agg(F.max("more").alias("more"))
        then, new = materialise(after, "links")
        more = then.agg(F.max("more")).first()[0]
        discard(spark, path)
        now, path = then, new
        if not more:
            break
    child = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return child.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
