"""Benchmark workloads: operation mixes over uniform or Zipf keys, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash60

#: Share of reads of the standard mixes.
MIXES = {"A": 0.5, "B": 0.95, "C": 1.0}


def make_key(index: Column) -> Column:
    return F.format_string("key-%016d", index)


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash: the same on every run, every partitioning and every engine."""
    return F.shiftright(hash60(F.concat_ws("|", *(p.cast("string") for p in parts))), 8) / F.lit(float(1 << 52))


def operations(spark: SparkSession, n: int, keys: int, mix: str, zipf_s: float = 0.0, seed: int = 1) -> DataFrame:
    """(i, op, key) of ``n`` operations; ``zipf_s`` over 1 prefers small keys by a power law."""
    if mix not in MIXES:
        raise ValueError(f"unknown mix {mix}")
    u = _unit(F.col("i"), F.lit(seed), F.lit("key"))
    if zipf_s > 1:
        # inverse of the continuous law on [1, keys]
        e = 1.0 - zipf_s
        index = F.floor(F.pow(1 + u * F.lit(float(keys) ** e - 1), F.lit(1 / e))) - 1
    else:
        index = F.floor(u * keys)
    rows = spark.range(n).withColumnRenamed("id", "i")
    op = F.when(_unit(F.col("i"), F.lit(seed), F.lit("op")) < MIXES[mix], "get").otherwise("put")
    return rows.select("i", op.alias("op"), make_key(F.least(index, F.lit(keys - 1)).cast("long")).alias("key"))
