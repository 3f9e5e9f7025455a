"""Batches and transactions: sequence assignment, overlays of uncommitted writes, conflict checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running
from .versions import newest


def assign_sequences(batch: DataFrame, base: int) -> DataFrame:
    """Contiguous sequences after ``base`` in the order of op_ordinal; no task sorts the whole batch."""
    ranked = running(batch, [], ["op_ordinal"], n=("sum", F.lit(1)))
    return ranked.withColumn("seq", (F.lit(base) + F.col("n")).cast("long")).drop("n")


def apply_batch(log: DataFrame, batch: DataFrame, base: int) -> DataFrame:
    """The log after an atomic batch of (op_ordinal, key, value, tombstone); later operations on a key win."""
    return log.unionByName(assign_sequences(batch, base).select("key", "seq", "value", "tombstone"))


def overlay(log: DataFrame, at: int, buffer: DataFrame) -> DataFrame:
    """A transaction's view: the snapshot under its own writes, which win whatever their sequence.

    Deletes stay as tombstones, as in the raw scan.
    """
    own = newest(buffer).withColumn("own", F.lit(1))
    seen = newest(log, at).withColumn("own", F.lit(0))
    cols = [c for c in seen.columns if c not in ("key", "own")]
    return seen.unionByName(own).groupBy("key").agg(*(F.max_by(c, "own").alias(c) for c in cols), (F.max("own") == 1).alias("own_write"))


def point_get(log: DataFrame, at: int, buffer: DataFrame, keys: DataFrame) -> DataFrame:
    """A transaction's point read: its own newest write of a key, else the snapshot. state, seq and value."""
    asked = keys.select("key").distinct()
    view = overlay(log.join(asked, "key", "left_semi"), at, buffer.join(asked, "key", "left_semi"))
    state = F.when(F.col("tombstone").isNull(), "miss").when(F.col("tombstone"), "tombstone").otherwise("hit")
    return keys.join(view, "key", "left").select("key", state.alias("state"), F.when(state == "hit", F.col("value")).alias("value"), F.coalesce("own_write", F.lit(False)).alias("own_write"))


def conflicts(log: DataFrame, at: int, writes: DataFrame) -> DataFrame:
    """Keys of the write set that someone committed after the snapshot; none means it may commit.

    The whole log is checked, whether flushed or not. Reads aren't tracked, so write skew is possible.
    """
    later = log.filter(F.col("seq") > at).groupBy("key").agg(F.max("seq").alias("seq"))
    return writes.select("key").distinct().join(later, "key")


def commit(log: DataFrame, at: int, buffer: DataFrame, base: int) -> DataFrame | None:
    """The rows to append for a transaction, or None on conflict. An empty buffer commits nothing."""
    if not conflicts(log, at, buffer).isEmpty():
        return None
    return assign_sequences(buffer, base).select("key", "seq", "value", "tombstone")
