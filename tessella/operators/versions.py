"""Point-in-time reads over a version log: rows (key, seq, value, tombstone), one a version.

A snapshot is a sequence number; a read at snapshot S sees each key's newest version with seq <= S.
Newest-per-key is an aggregate (``max_by``), so versions are combined before the shuffle; tombstones
are only dropped after it, or an older value would come back to life.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: State labels of a point read.
HIT, TOMBSTONE, MISS = "hit", "tombstone", "miss"


def newest(log: DataFrame, at: int | Column | None = None, key: str = "key") -> DataFrame:
    """Each key's newest visible version, tombstones included."""
    seen = log if at is None else log.filter(F.col("seq") <= at)
    others = [c for c in seen.columns if c not in (key, "seq")]
    return seen.groupBy(key).agg(F.max("seq").alias("seq"), *(F.max_by(c, "seq").alias(c) for c in others))


def scan(log: DataFrame, at: int | None = None) -> DataFrame:
    """Live rows at a snapshot. Sort the result where an order is needed."""
    return newest(log, at).filter(~F.col("tombstone")).drop("tombstone")


def in_range(log: DataFrame, start=None, end=None) -> DataFrame:
    """Keys in [start, end); None is open. The bounds reach the file scan."""
    if start is not None:
        log = log.filter(F.col("key") >= start)
    return log if end is None else log.filter(F.col("key") < end)


def text_successor(prefix: str) -> str | None:
    """The smallest string after all strings with this prefix, by code points; None: no bound."""
    cut = prefix.rstrip("\U0010ffff")
    if not cut:
        return None
    after = ord(cut[-1]) + 1
    return cut[:-1] + chr(0xE000 if 0xD800 <= after <= 0xDFFF else after)


def with_prefix(log: DataFrame, prefix: str) -> DataFrame:
    return in_range(log, prefix or None, text_successor(prefix))


def point_states(log: DataFrame, keys: DataFrame, at: int) -> DataFrame:
    """For each asked key: hit, tombstone or miss, and the value and seq of a hit.

    The log is cut down to the asked keys before it is aggregated.
    """
    found = newest(log.join(keys.select("key").distinct(), "key", "left_semi"), at)
    state = F.when(F.col("tombstone").isNull(), MISS).when(F.col("tombstone"), TOMBSTONE).otherwise(HIT)
    return keys.join(found, "key", "left").select("key", state.alias("state"), *(F.when(state == HIT, F.col(c)).alias(c) for c in ("seq", "value")))


def ranked(log: DataFrame) -> DataFrame:
    """All versions with their rank in the key, newest first from 1."""
    w = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("rank", F.row_number().over(w).cast("long"))


def watermark(registry: DataFrame) -> DataFrame:
    """The oldest open snapshot and how many are open; a snapshot may be open several times."""
    return registry.filter("not closed").agg(F.min("seq").alias("watermark"), F.count("*").alias("open_snapshots"))


def next_sequence(log: DataFrame) -> int:
    """The sequence after the largest in the log; 1 for an empty one."""
    return (log.agg(F.max("seq")).first()[0] or 0) + 1


def check_keys(rows: DataFrame) -> DataFrame:
    """Fail on an empty or missing key; the rows are used only if they pass."""
    empty = F.raise_error(F.lit("empty key"))
    text = F.col("key").cast("string")
    return rows.withColumn("key", F.when(text.isNotNull() & (F.length(text) > 0), F.col("key")).otherwise(empty))
