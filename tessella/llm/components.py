"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is joins and partial aggregates over the edges, written to the shared folder, so lineage
stays short and nothing but two numbers a round reaches the driver. Hubs, nodes with a large share of
all edges, get their smallest neighbour from a broadcast of bounded size. Edges only shrink towards
stars; the number of rounds grows with the logarithm of the longest path.

Edge cases: repeated edges, both directions of one and loops count once or not at all; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, join_on_hot_keys, store


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return r.n, r.h


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_on_hot_keys(both, least, "u").filter(F.col("v") > F.col("u"))
    return moved.select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_on_hot_keys(down, least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v, longs, u != v) to (u, v): each node that isn't its component's smallest, and that one.

    An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    now, path = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        after, new = store(_small_star(_large_star(now)), "edges")
        drop(spark, path)
        now, path, before = after, new, state
        state = _state(now)
        if state == before:
            break
    return now


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest index in the component of each of ``n`` nodes, for edges held in memory."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
