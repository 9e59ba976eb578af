"""Connected components: of edge tables by alternating stars, and of small arrays within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphvein.llm.common import released, stored


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges a[i] - b[i] among 0 .. n - 1."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def forest(p: np.ndarray, q: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A spanning forest of the edges p[s] - q[t], so that tiles hand on no lists of links."""
    nodes, at = np.unique(np.concatenate([p[s], q[t]]), return_inverse=True)
    root = local_components(len(nodes), at[: len(s)], at[len(s) :])
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[root[moved]]], 1)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """id and component (its least id) of each node of edges (a long, b long).

    Large-star and small-star steps by turns: each node's larger neighbours, then its smaller ones, are
    tied to the least of them, until the edges are stars. Each round is written to the shared folder.
    """
    stars = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = hung.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct()
        following = stored(small, "edges")
        seen = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        released(stars)
        stars = following
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    ties = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ties.unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
