"""Running sums and maxima over long groups, without one task holding a group.

A plain window sorts each of its groups in one task. Here rows are cut into ranges of (group, order);
windows run inside the ranges, and each range's totals, one row a range and group, give the offset of
the ranges after it. The ranges are written first, so that both uses see the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import written


def running(df: DataFrame, by: list[str], order: list[str], **values: tuple[str, Column]) -> DataFrame:
    """Adds inclusive running values: name=("sum" or "max", column), by ``by`` in the total order ``order``."""
    named = {n: f"_{n}" for n in values}
    ranges = df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id())
    cut = written(ranges.withColumns({named[n]: c for n, (_, c) in values.items()}), "ranges")
    fold = {"sum": F.sum, "max": F.max}
    w = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumns({n: fold[how](named[n]).over(w) for n, (how, _) in values.items()})
    totals = cut.groupBy("_range", *by).agg(*(fold[how](named[n]).alias(f"_all_{n}") for n, (how, _) in values.items()))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", *by, *(fold[how](f"_all_{n}").over(before).alias(f"_before_{n}") for n, (how, _) in values.items()))
    # groups may be null, and all their rows stay
    place = offsets.withColumnsRenamed({c: f"_of_{c}" for c in ["_range", *by]})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in ["_range", *by]]
    joined = local.join(place, reduce(lambda a, b: a & b, same)).drop(*(f"_of_{c}" for c in ["_range", *by]))
    add = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.greatest(a, b)}
    return joined.withColumns({n: add[how](F.col(n), F.col(f"_before_{n}")) for n, (how, _) in values.items()}).drop("_range", *named.values(), *(f"_before_{n}" for n in values))
