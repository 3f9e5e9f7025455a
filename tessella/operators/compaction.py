"""Runs and levels: merging, rewriting, version garbage collection, and what to compact next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .versions import newest

#: Defaults: runs in level 0 that trigger a compaction; size of level 1 and growth a level; levels.
L0_TRIGGER, L1_BYTES, GROWTH, LEVELS = 4, 256 << 20, 10, 7


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """All versions of all runs; equal (key, seq) keep the run that comes first."""
    tagged = [r.withColumn("prio", F.lit(i)) for i, r in enumerate(runs)]
    return reduce(DataFrame.unionByName, tagged).groupBy("key", "seq").agg(F.min_by("value", "prio").alias("value"), F.min_by("tombstone", "prio").alias("tombstone"))


def rewrite(log: DataFrame, files: int) -> DataFrame:
    """The log in sorted runs with disjoint key ranges, every version kept: what a compaction writes."""
    return log.repartitionByRange(files, "key").sortWithinPartitions("key", F.desc("seq"))


def write_runs(log: DataFrame, path: str, files: int) -> None:
    """Write sorted runs whose footers prune by key range and whose Bloom filters prune by key."""
    rewrite(log, files).write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", "1000000").parquet(path)


def collect_versions(log: DataFrame, watermark: int, bottom: bool = False) -> DataFrame:
    """Drop versions no open snapshot can see: keep all after the watermark and each key's newest up to it.

    At the bottom level a tombstone that is a key's newest version up to the watermark hides nothing
    and goes too. Reads at any snapshot from the watermark on are unchanged.
    """
    floor = newest(log, watermark)  # one hash aggregate, no window and no join
    if bottom:
        floor = floor.filter("not tombstone")
    return log.filter(F.col("seq") > watermark).unionByName(floor.select(log.columns))


def level_stats(files: DataFrame) -> DataFrame:
    """Files, bytes, smallest and largest key of each level. files: (level, file, first_key, last_key, bytes)."""
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


def pick_level(files: DataFrame) -> DataFrame:
    """Levels with their compaction score (1 or more is due), the most urgent first of equals."""
    limit = F.lit(L1_BYTES) * F.pow(F.lit(GROWTH), F.col("level") - 1)
    score = F.when(F.col("level") == 0, F.col("files") / F.lit(L0_TRIGGER)).otherwise(F.col("bytes") / limit)
    scored = level_stats(files).filter(F.col("level") < LEVELS - 1).withColumn("score", score)
    return scored.withColumn("picked", (F.col("score") >= 1) & (F.row_number().over(Window.orderBy(F.desc("score"), "level")) == 1))


def overlapping(inputs: DataFrame, below: DataFrame, width: int) -> DataFrame:
    """Pairs of files whose key ranges touch (both ends included), for long keys.

    A range join: both sides are cut at multiples of ``width`` and joined on the cell; a pair counts in
    the cell of its overlap's start only, so it comes out once.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    a = inputs.select(F.col("file").alias("file_a"), F.col("first_key").alias("fa"), F.col("last_key").alias("la"), F.explode(F.sequence(cell("first_key"), cell("last_key"))).alias("cell"))
    b = below.select(F.col("file").alias("file_b"), F.col("first_key").alias("fb"), F.col("last_key").alias("lb"), F.explode(F.sequence(cell("first_key"), cell("last_key"))).alias("cell"))
    hit = a.join(b, "cell").filter((F.col("fa") <= F.col("lb")) & (F.col("fb") <= F.col("la")))
    return hit.filter(F.col("cell") == F.floor(F.greatest("fa", "fb") / F.lit(width))).select("file_a", "file_b")
