"""Cluster control as tables: status, anti-entropy rounds, broadcast buffers, hint retries.

The loops of a running cluster are schedules here: which peer a node reconciles with at which tick, what
a round changes, which updates go out next. Each is a table over all nodes, so a round of a whole cluster
is one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written
from .catalog import retransmit_limit
from .replication import DEAD, NONE, last_writer, stamp

#: Updates that wait for broadcast at most, and updates a message carries.
BUFFER, CARRIED = 128, 10
ROW = ["key", "value", "deleted", "wall", "logical", "node"]


def status(members: DataFrame, ring: DataFrame) -> DataFrame:
    """One row a member (node, addr, liveness, incarnation) with its ring state and the ring's version."""
    version = F.max("version").over(Window.partitionBy(F.lit(1)))  # a few rows of settings
    placed = ring.select("node", "ring", version.alias("version"))
    return members.join(F.broadcast(placed), "node", "left").withColumn("ring", F.coalesce("ring", F.lit(NONE)))


def node_info(members: DataFrame, ring: DataFrame, node: str) -> DataFrame:
    """(node, addr, liveness, ring) of one node."""
    return status(members, ring).filter(F.col("node") == node).select("node", "addr", "liveness", "ring")


def ticks(peers: DataFrame, rounds: int) -> DataFrame:
    """(tick, node, peer): at each tick a node reconciles with the next of its peers (node, peer) in turn."""
    w = Window.partitionBy("node")  # a node has a few peers
    placed = peers.select("node", "peer").withColumn("at", F.row_number().over(w.orderBy("peer")) - 1).withColumn("of", F.count("*").over(w))
    every = placed.withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    return every.filter(F.col("tick") % F.col("of") == F.col("at")).select(F.col("tick").cast("long").alias("tick"), "node", "peer")


def admitted_triggers(triggers: DataFrame, most: int) -> DataFrame:
    """Reconciliations that start: a pair runs once at a time, and a node takes part in ``most`` at once, the earliest first."""
    pair = F.struct(F.least("node", "peer").alias("a"), F.greatest("node", "peer").alias("b"))
    once = triggers.withColumn("pair", pair).groupBy("tick", "pair").agg(F.min("seq").alias("seq"))
    both = once.select("tick", "seq", "pair", F.explode(F.array("pair.a", "pair.b")).alias("node"))
    ranked = both.withColumn("n", F.row_number().over(Window.partitionBy("tick", "node").orderBy("seq")))
    return ranked.groupBy("tick", "seq", "pair").agg(F.max("n").alias("n")).filter(F.col("n") <= most).select("tick", "seq", F.col("pair.a").alias("node"), F.col("pair.b").alias("peer"))


def anti_entropy(rows: DataFrame, meetings: list[tuple[str, str]]) -> DataFrame:
    """Replica rows after some meetings, one after the other: both sides of each hold the newest of either."""
    now = rows
    for i, (a, b) in enumerate(meetings):
        pair = now.filter(F.col("replica").isin(a, b))
        merged = last_writer(pair.select(ROW)).withColumn("replica", F.explode(F.array(F.lit(a), F.lit(b))))
        now = written(now.filter(~F.col("replica").isin(a, b)).unionByName(merged.select(now.columns)), f"meeting-{i}")
    return now


def trigger(rows: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """A meeting on demand: the rows after it, and its (peer, keys_scanned, divergent_leaves, keys_repaired)."""
    from . import merkle

    side = lambda n: rows.filter(F.col("replica") == n).select(ROW)
    found = merkle.stats(side(a), side(b)).select(F.lit(b).alias("peer"), F.col("scanned").alias("keys_scanned"), F.col("divergent").alias("divergent_leaves"), (F.col("pulls") + F.col("pushes")).alias("keys_repaired"))
    return anti_entropy(rows, [(a, b)]), found


def replicate(rows: DataFrame, writes: DataFrame) -> DataFrame:
    """Replica rows after writes (replica, key, value, deleted, wall, logical, node) arrived, newest wins."""
    both = rows.unionByName(writes.select(rows.columns))
    win = F.max_by(F.struct("value", "deleted", "wall", "logical", "node"), stamp())
    return both.groupBy("replica", "key").agg(win.alias("w")).select("replica", "key", "w.*").select(rows.columns)


def broadcasts(updates: DataFrame, nodes: int, capacity: int = BUFFER) -> DataFrame:
    """The buffer after updates (node, incarnation, liveness, seq) came: each with its sends left, the fullest and newest kept."""
    fresh = updates.withColumn("remaining", F.lit(retransmit_limit(nodes)))
    return fresh.orderBy(F.desc("remaining"), F.desc("seq")).limit(capacity)  # the buffer's size is its feature


def carried(buffer: DataFrame, limit: int = CARRIED) -> tuple[DataFrame, DataFrame]:
    """What the next message carries, and the buffer after it: only what went counts down, and exhausted updates go."""
    placed = buffer.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("remaining"), F.desc("seq"))))  # a buffer of bounded size
    sent = placed.filter(F.col("place") <= limit).drop("place", "remaining")
    left = placed.withColumn("remaining", F.when(F.col("place") <= limit, F.col("remaining") - 1).otherwise(F.col("remaining")))
    return sent, left.filter("remaining > 0").drop("place")


def retries(attempts: DataFrame, most: int, delay_ns: int) -> DataFrame:
    """(batch, attempt, at, ok) of replays (batch, start_ns, fails): every ``delay_ns`` until one succeeds or ``most`` failed."""
    tries = F.sequence(F.lit(1), F.least(F.col("fails") + 1, F.lit(most)).cast("int"))
    each = attempts.select("batch", "fails", "start_ns", F.explode(tries).alias("attempt"))
    return each.select("batch", F.col("attempt").cast("long").alias("attempt"), (F.col("start_ns") + F.col("attempt").cast("long") * F.lit(delay_ns).cast("long")).alias("at"), (F.col("attempt") > F.col("fails")).alias("ok"))


def reapable(members: DataFrame, now: int, timeout: int) -> DataFrame:
    """Members (node, liveness, ring, dead_since) that are forgotten: dead for the timeout and in no ring."""
    return members.filter((F.col("liveness") == DEAD) & (F.col("ring") == NONE) & (F.lit(now) - F.col("dead_since") >= F.lit(timeout)))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
