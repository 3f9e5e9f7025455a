"""Hashes that Spark and a SQL oracle agree on, and the buckets made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash60(text: Column | str) -> Column:
    """The first 60 bits of the MD5 of a string, as a positive long."""
    return F.conv(F.substring(F.md5(F.col(text) if isinstance(text, str) else text), 1, 15), 16, 10).cast("long")


def bucket(hashed: Column, leaves: int) -> Column:
    return F.pmod(hashed, F.lit(leaves))


def bucket_path(index: Column, fanout: int, depth: int) -> Column:
    """The digits of a leaf's index in base ``fanout``, from the root down."""
    return F.array(*(F.pmod(F.floor(index / F.lit(fanout**k)), F.lit(fanout)) for k in reversed(range(depth))))


def config_digest(dim: Column, metric: Column, m: Column, ef_construct: Column) -> Column:
    """Digest of the settings that must agree between replicas (search width and limits don't count)."""
    return hash60(F.concat_ws("|", *(c.cast("string") for c in (dim, metric, m, ef_construct))))
