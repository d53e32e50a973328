"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomrow.llm._shared import checkpoint, shuffled


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as (a, b): from each node to the least of its component, but for itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        if (open_ := low != high).any():
            np.minimum.at(label, high[open_], low[open_])
        else:
            break
        while (label != (up := label[label])).any():
            label = up
        u, v = u[open_], v[open_]
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def components(links: DataFrame) -> DataFrame:
    """Rows node, root for every node of links (columns a, b; not null): root is the least node reachable.

    Alternates large-star and small-star steps: each node passes its least
    neighbour to its larger ones, then to its smaller ones, until nothing
    changes. Every step is an aggregate by node, combined before the shuffle,
    and a join with what it gives. That is written to the shared folder first:
    both sides of the join are then dealt for the join alone, so that adaptive
    execution can split a hub's links. No links give no rows.
    """
    size = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    was = size(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = both.join(shuffled(least), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # in large every a has larger number than b
        large = checkpoint(large)
        low = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(shuffled(low), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        now = checkpoint(small)
        if (size_now := size(now)) == was:
            break
        was = size_now
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
