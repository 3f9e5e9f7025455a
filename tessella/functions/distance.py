"""Vector distances as Spark expressions, in double precision.

L2 is squared; cosine distance is 1 - similarity and 0 if a side has no length; inner product is
negated, so smaller is nearer in all three.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metric codes of a collection.
L2, COSINE, INNER = 1, 2, 3


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(1 - _dot(a, b) / norm)


def inner_product(a: Column, b: Column) -> Column:
    return -_dot(a, b)


def by_metric(metric: int):
    """The expression of a metric code; anything else is an error."""
    try:
        return {L2: l2_squared, COSINE: cosine, INNER: inner_product}[metric]
    except KeyError:
        raise ValueError(f"unknown metric {metric}") from None


def matrix(metric: int, queries: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Distances of all rows of two matrices, for Arrow batches: one matrix product."""
    q, b = queries.astype(np.float64), base.astype(np.float64)
    dot = q @ b.T
    if metric == INNER:
        return -dot
    qq, bb = (q * q).sum(1)[:, None], (b * b).sum(1)[None, :]
    if metric == L2:
        return np.maximum(qq + bb - 2 * dot, 0.0)
    if metric == COSINE:
        norm = np.sqrt(qq) * np.sqrt(bb)
        return np.where(norm == 0, 0.0, 1 - dot / np.where(norm == 0, 1.0, norm))
    raise ValueError(f"unknown metric {metric}")
