"""Merkle trees over replica rows: leaves, roll-up, divergence, and the plan that reconciles two sides.

A leaf is the XOR of the hashes of its rows (key, clock and tombstone hashed together), so it is a
partial aggregate; parents hash their children in order, and empty leaves count as 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import bucket, hash60

FANOUT, DEPTH, REPAIR_BUDGET = 16, 2, 10_000


def entry_hash() -> Column:
    return hash60(F.concat_ws("|", F.col("key").cast("string"), F.col("wall").cast("string"), F.col("logical").cast("string"), F.col("node"), F.col("deleted").cast("int").cast("string")))


def leaf_of(fanout: int = FANOUT, depth: int = DEPTH) -> Column:
    return bucket(hash60(F.col("key").cast("string")), fanout**depth)


def leaves(rows: DataFrame, cutoff: int | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(idx, hash, n) of the leaves that hold rows older than the cutoff (the grace period)."""
    old = rows if cutoff is None else rows.filter(F.col("wall") < cutoff)
    return old.groupBy(leaf_of(fanout, depth).alias("idx")).agg(F.bit_xor(entry_hash()).alias("hash"), F.count("*").alias("n"))


def levels(found: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(level, idx, hash) of the whole tree; level 0 is the root, level ``depth`` the leaves."""
    spark = found.sparkSession
    every = spark.range(fanout**depth).withColumnRenamed("id", "idx")
    level = every.join(found.select("idx", "hash"), "idx", "left").select("idx", F.coalesce("hash", F.lit(0)).cast("long").alias("hash"))
    out = level.withColumn("level", F.lit(depth))
    for k in reversed(range(depth)):
        children = F.sort_array(F.collect_list(F.struct("idx", "hash")))  # exactly ``fanout`` of them
        text = F.array_join(F.transform(children, lambda c: c["hash"].cast("string")), ",")
        level = level.withColumn("parent", F.floor(F.col("idx") / F.lit(fanout))).groupBy("parent").agg(hash60(text).alias("hash")).select(F.col("parent").alias("idx"), "hash")
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select(F.col("level").cast("long").alias("level"), "idx", "hash")


def divergent(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves that differ between two sides; a leaf that one side lacks counts as empty."""
    x, y = a.select("idx", F.col("hash").alias("a")), b.select("idx", F.col("hash").alias("b"))
    both = x.join(y, "idx", "full_outer").select("idx", F.coalesce("a", F.lit(0)).alias("hash_a"), F.coalesce("b", F.lit(0)).alias("hash_b"))
    return both.filter("hash_a != hash_b")


def plan(a: DataFrame, b: DataFrame, cutoff: int | None = None, fanout: int = FANOUT, depth: int | None = None) -> DataFrame:
    """(key, action): pull from b, push to b, or conflict (equal clocks, different rows).

    Only rows of divergent leaves are joined. One cutoff holds for trees and rows on both sides. Without a
    depth the tree gets one that fits the rows; the plan is the same at any.
    """
    depth = depth or fitting_depth(a.count(), fanout)
    old = (lambda d: d) if cutoff is None else (lambda d: d.filter(F.col("wall") < cutoff))
    apart = divergent(leaves(a, cutoff, fanout, depth), leaves(b, cutoff, fanout, depth)).select("idx")  # fanout ** depth rows at most
    pick = lambda d, n: old(d).withColumn("idx", leaf_of(fanout, depth)).join(F.broadcast(apart), "idx", "left_semi").select("key", F.struct("wall", "logical", "node").alias(f"s{n}"), F.struct("value", "deleted").alias(f"v{n}"))
    both = pick(a, 1).join(pick(b, 2), "key", "full_outer")
    action = (
        F.when(F.col("s1").isNull() | (F.col("s1") < F.col("s2")), "pull").when(F.col("s2").isNull() | (F.col("s2") < F.col("s1")), "push").when(~F.col("v1").eqNullSafe(F.col("v2")), "conflict")
    )
    return both.select("key", action.alias("action")).filter("action is not null")


def budgeted(actions: DataFrame, budget: int = REPAIR_BUDGET) -> DataFrame:
    """The first ``budget`` actions by key: what one round repairs."""
    return actions.orderBy("key").limit(budget)


def reconciled(a: DataFrame, b: DataFrame) -> DataFrame:
    """What both sides hold after a full round."""
    from .replication import last_writer

    cols = ["key", "value", "deleted", "wall", "logical", "node"]
    return last_writer(a.select(cols).unionByName(b.select(cols)))


def stats(a: DataFrame, b: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Rows scanned on both sides, divergent leaves and planned repairs, one row."""
    old = (lambda d: d) if cutoff is None else (lambda d: d.filter(F.col("wall") < cutoff))
    scanned = old(a).select("key").unionByName(old(b).select("key")).agg(F.count("*").alias("scanned"))
    apart = divergent(leaves(a, cutoff), leaves(b, cutoff)).agg(F.count("*").alias("divergent"))
    acts = plan(a, b, cutoff).agg(F.count_if(F.col("action") == "pull").alias("pulls"), F.count_if(F.col("action") == "push").alias("pushes"))
    return scanned.crossJoin(apart).crossJoin(acts)  # one row each


def fitting_depth(rows: int, fanout: int = FANOUT, leaf_rows: int = 1_000, most: int = 5) -> int:
    """The depth at which a leaf holds about ``leaf_rows`` rows, so that a few differences leave most leaves equal."""
    depth = 1
    while depth < most and fanout**depth * leaf_rows < rows:
        depth += 1
    return depth


def check_digest(fanout: int, depth: int, replication: int, initiator: str, target: str) -> None:
    """Refuse a request that names no ends, or a tree that can't be built."""
    if not initiator or not target:
        raise ValueError("both ends of the comparison must be named")
    if fanout < 2 or depth < 1 or replication < 1:
        raise ValueError("fanout >= 2, depth >= 1 and a replication factor >= 1 are needed")


def subtree(tree: DataFrame, path: list[int], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(child, hash) of the node that ``path`` leads to from the root, in the ``levels`` of a tree."""
    if len(path) >= depth or any(not 0 <= p < fanout for p in path):
        raise ValueError(f"a path has fewer than {depth} steps below {fanout}")
    node = 0
    for p in path:
        node = node * fanout + p
    inside = (F.col("level") == len(path) + 1) & (F.col("idx") >= node * fanout) & (F.col("idx") < (node + 1) * fanout)
    return tree.filter(inside).select((F.col("idx") - node * fanout).alias("child"), "hash")


def leaf_keys(rows: DataFrame, leaf: int | None = None, cutoff: int | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """(idx, key, wall, logical, node, deleted) of a leaf, or of all, as they are compared key by key."""
    old = rows if cutoff is None else rows.filter(F.col("wall") < cutoff)
    placed = old.select(leaf_of(fanout, depth).alias("idx"), "key", "wall", "logical", "node", "deleted")
    return placed if leaf is None else placed.filter(F.col("idx") == leaf)
