"""Connected components of an edge table, distributed and exact."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within one task reduced to a star for each component: each node
    but the smallest, with the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        p, q = parent[left], parent[right]
        apart = p != q
        if not apart.any():
            break
        left, right, p, q = left[apart], right[apart], p[apart], q[apart]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node with an edge but the smallest of its
    component; component is that smallest node.  ``edges`` has long columns a
    and b.  Alternating large-star and small-star rounds: minima are partially
    aggregated, so a node with very many edges is no hot group."""
    star = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    while not star.isEmpty() and not star.join(star.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
