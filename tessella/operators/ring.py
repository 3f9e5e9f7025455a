"""Consistent hashing: virtual nodes, owners of keys, and what moves when members change.

A key belongs to the first ``n`` distinct nodes clockwise from its hash. The ring is cut at its virtual
nodes into intervals, each with its owners in order; this table has one row a virtual node, its size
is known from the member list, and it is sent to all tasks as an array that keys are looked up in by
binary search. Without a shuffle, each key is placed where it is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash60

VNODES = 150
#: Rings up to so many intervals are broadcast; it bounds the table at a few MB.
MOST = 100_000


def vnode_hash(node: str, i: int) -> int:
    return int(hashlib.md5(f"{node}#{i}".encode()).hexdigest()[:15], 16)


def vnodes(nodes: list[str], count: int = VNODES) -> list[tuple[int, str]]:
    return sorted((vnode_hash(n, i), n) for n in set(nodes) for i in range(count))


def intervals(nodes: list[str], n: int, count: int = VNODES) -> list[tuple[int, list[str]]]:
    """(hash, owners in order) of each virtual node: the owners of keys up to that hash."""
    ring = vnodes(nodes, count)
    if len(ring) > MOST:
        raise ValueError(f"a ring of {len(ring)} virtual nodes is not broadcast")
    want = min(n, len(set(nodes)))
    out = []
    for i, (h, _) in enumerate(ring):
        owners: list[str] = []
        k = i
        while len(owners) < want:
            node = ring[k % len(ring)][1]
            if node not in owners:
                owners.append(node)
            k += 1
        out.append((h, owners))
    return out


def ring_table(spark: SparkSession, nodes: list[str], count: int = VNODES) -> DataFrame:
    return spark.createDataFrame(vnodes(nodes, count), "hash long, node string")


def owners(keys: DataFrame, nodes: list[str], n: int, count: int = VNODES) -> DataFrame:
    """Adds owners (array of node names, preferred first) to rows with a string column key."""
    if not nodes:
        return keys.withColumn("owners", F.array().cast("array<string>"))
    table = intervals(nodes, n, count)
    shared = keys.sparkSession.sparkContext.broadcast((np.array([h for h, _ in table], np.int64), [o for _, o in table]))

    @F.pandas_udf("array<string>")
    def find(h: pd.Series) -> pd.Series:
        at, who = shared.value
        return pd.Series([who[i] for i in np.searchsorted(at, h.to_numpy()) % len(at)])

    return keys.withColumn("owners", find(hash60("key")))


def owner_rows(keys: DataFrame, nodes: list[str], n: int, count: int = VNODES) -> DataFrame:
    """(key, rank from 1, node)."""
    placed = owners(keys.select("key"), nodes, n, count)
    return placed.select("key", F.posexplode("owners").alias("pos", "node")).select("key", (F.col("pos") + 1).cast("long").alias("rank"), "node")


def moved(keys: DataFrame, before: list[str], after: list[str], n: int = 1, count: int = VNODES) -> DataFrame:
    """Keys whose owners differ between two member lists."""
    both = owners(owners(keys.select("key"), before, n, count).withColumnRenamed("owners", "owners_before"), after, n, count)
    return both.withColumnRenamed("owners", "owners_after").filter(F.array_sort("owners_before") != F.array_sort("owners_after"))


def co_replicas(spark: SparkSession, nodes: list[str], n: int, count: int = VNODES) -> DataFrame:
    """(node, peer): nodes that share some key's owners. From the ring alone."""
    pairs = sorted({(a, b) for _, o in intervals(nodes, n, count) for a in o for b in o if a != b})
    return spark.createDataFrame(pairs, "node string, peer string")


def shared_keys(keys: DataFrame, nodes: list[str], n: int, a: str, b: str, count: int = VNODES) -> DataFrame:
    """Keys that both nodes own: what the two have to reconcile."""
    placed = owners(keys, nodes, n, count)
    return placed.filter(F.array_contains("owners", a) & F.array_contains("owners", b)).drop("owners")
