"""Replicas: last writer wins, quorum reads, repair, hints and membership.

Replica rows are (replica, key, value, deleted, wall, logical, node); a version is newer by
(wall, logical, node) in that order. The winner is an aggregate, so the order in which replicas were
written or read never matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import running

#: The order in which a target's hints are drained.
DRAIN = ["wall", "logical", "key"]
#: Liveness and ring states.
ALIVE, SUSPECT, DEAD = 0, 1, 2
NONE, JOINING, ACTIVE = 0, 1, 2
HINT_TTL_NS = 24 * 3600 * 10**9


def stamp(prefix: str = "") -> Column:
    return F.struct(*(F.col(prefix + c) for c in ("wall", "logical", "node")))


def last_writer(rows: DataFrame) -> DataFrame:
    """Each key's newest row over all replicas."""
    win = F.max_by(F.struct("wall", "logical", "node", "value", "deleted"), stamp())
    return rows.groupBy("key").agg(win.alias("w")).select("key", "w.*")


def newest_stamp(rows: DataFrame) -> DataFrame:
    """The largest clock of a batch: what the receiver's clock has to pass."""
    return rows.agg(F.max(stamp()).alias("s")).select("s.wall", "s.logical", "s.node")


def quorum_read(rows: DataFrame, keys: DataFrame, replicas: list[str], r: int) -> DataFrame:
    """Read each key from the first ``r`` of ``replicas`` and take the newest answer.

    state: hit, tombstone, miss if none of them has the key. Deterministic: a replica's place in the
    list stands for its speed.
    """
    asked = rows.filter(F.col("replica").isin(replicas[:r])).join(keys.select("key").distinct(), "key", "left_semi")
    win = last_writer(asked).withColumn("state", F.when(F.col("deleted"), "tombstone").otherwise("hit"))
    out = keys.join(win, "key", "left")
    return out.select("key", F.coalesce("state", F.lit("miss")).alias("state"), F.when(F.col("state") == "hit", F.col("value")).alias("value"), "wall", "logical", "node")


def write_status(writes: DataFrame, owners: DataFrame, members: DataFrame, w: int) -> DataFrame:
    """Fan-out of writes to their owners: acknowledgements, hints, and whether ``w`` voters answered.

    A voter that is dead gets a hint; joining members are learners and never count.
    """
    state = members.select(F.col("node").alias("owner"), "liveness", "ring")
    sent = writes.select("key").join(owners.select("key", F.col("node").alias("owner")), "key").join(F.broadcast(state), "owner")
    voter = F.col("ring") != JOINING
    counts = sent.groupBy("key").agg(
        F.count_if(voter).alias("voters"), F.count_if(voter & (F.col("liveness") == ALIVE)).alias("acks"), F.count_if(F.col("liveness") == DEAD).alias("hints")
    )
    return counts.withColumn("ok", F.col("acks") >= w)


def readable(members: DataFrame) -> DataFrame:
    """Members a read may go to: not dead (suspects still answer) and not joining."""
    return members.filter((F.col("liveness") != DEAD) & (F.col("ring") != JOINING))


def repair_targets(rows: DataFrame, replicas: list[str]) -> DataFrame:
    """(key, replica, reason) of each replica whose copy is missing or older than the winner."""
    win = last_writer(rows).select("key", stamp().alias("win"))
    held = rows.select("key", "replica", stamp().alias("own"))
    every = win.withColumn("replica", F.explode(F.array(*map(F.lit, replicas))))
    state = every.join(held, ["key", "replica"], "left")
    return state.filter(F.col("own").isNull() | (F.col("own") < F.col("win"))).select("key", "replica", F.when(F.col("own").isNull(), "missing").otherwise("stale").alias("reason"))


def repair_rows(rows: DataFrame, replicas: list[str]) -> DataFrame:
    """The winners to append at each target, clock and tombstone unchanged."""
    return repair_targets(rows, replicas).join(last_writer(rows), "key").select("replica", "key", "value", "deleted", "wall", "logical", "node")


def gossip(states: DataFrame, self_node: str | None = None) -> DataFrame:
    """Merge member reports (node, addr, liveness, incarnation): highest incarnation, then worst liveness.

    Told that it isn't alive, the node itself refutes with the next incarnation. Ring states are not
    gossip and aren't merged.
    """
    best = states.groupBy("node").agg(F.max(F.struct("incarnation", "liveness")).alias("s"), F.max_by("addr", "incarnation").alias("addr")).select("node", "addr", "s.incarnation", "s.liveness")
    if self_node is None:
        return best
    refute = (F.col("node") == self_node) & (F.col("liveness") != ALIVE)
    return best.select("node", "addr", F.when(refute, F.col("incarnation") + 1).otherwise(F.col("incarnation")).alias("incarnation"), F.when(refute, F.lit(ALIVE)).otherwise(F.col("liveness")).alias("liveness"))


def freshest(updates: DataFrame, limit: int = 10) -> DataFrame:
    """The updates to piggyback next: those sent least often so far."""
    return updates.orderBy(F.desc("remaining"), "node").limit(limit)


def pending_hints(hints: DataFrame, target: str | None = None) -> DataFrame:
    """Live hints (target, wall, logical, node, key, size, tombstone)."""
    live = hints.filter("not tombstone")
    return live if target is None else live.filter(F.col("target") == target)


def split_expired(hints: DataFrame, now_ns: int | Column, ttl_ns: int = HINT_TTL_NS) -> DataFrame:
    """Adds expired: older than the time to live."""
    return hints.withColumn("expired", (F.lit(now_ns) if isinstance(now_ns, int) else now_ns) - F.col("wall") > ttl_ns)


def within_capacity(hints: DataFrame, capacity: int) -> DataFrame:
    """Adds accepted: hints are taken a target in order until their sizes would pass its capacity."""
    return running(hints, ["target"], DRAIN, used=("sum", F.col("size"))).withColumn("accepted", F.col("used") <= capacity)


def hint_batches(hints: DataFrame, max_items: int = 500, max_bytes: int = 512 << 10) -> DataFrame:
    """Adds batch: drain order of a target cut by running item count and running bytes."""
    placed = running(hints, ["target"], DRAIN, items=("sum", F.lit(1)), upto=("sum", F.col("size")))
    by_items = F.floor((F.col("items") - 1) / F.lit(max_items))
    by_bytes = F.floor((F.col("upto") - F.col("size")) / F.lit(max_bytes))
    return placed.withColumn("batch", F.greatest(by_items, by_bytes).cast("long")).drop("items", "upto")


def drainable(hints: DataFrame, members: DataFrame, now_ns: int, ttl_ns: int = HINT_TTL_NS) -> DataFrame:
    """Unexpired hints whose target is alive, with its address."""
    alive = members.filter(F.col("liveness") == ALIVE).select(F.col("node").alias("target"), "addr")
    return split_expired(pending_hints(hints), now_ns, ttl_ns).filter("not expired").drop("expired").join(F.broadcast(alive), "target")
