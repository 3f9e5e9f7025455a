"""Hybrid logical clocks over event streams.

``now`` is a closed form: the wall part is the running maximum of the physical times, the logical part
counts the events since it last grew. ``receive`` folds remote clocks in and depends on each of them,
so it runs in order a node, as one sequential pass over that node's events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running

#: How far ahead of the physical time a remote clock may be.
MAX_DRIFT_NS = 60 * 10**9


def now(events: DataFrame, order: str = "i") -> DataFrame:
    """Adds wall and logical to rows of (node, ``order``, physical) with positive physical times."""
    held = running(events, ["node"], [order], wall=("max", F.col("physical")))
    return held.withColumn("logical", (F.row_number().over(Window.partitionBy("node", "wall").orderBy(order)) - 1).cast("long"))


def step(state: tuple[int, int], physical: int, received: tuple[int, int] | None, max_drift: int = MAX_DRIFT_NS) -> tuple[tuple[int, int], bool]:
    """One event on a clock: the new state and whether it was accepted. ``received`` None: a local event."""
    wall, logical = state
    if received is None:
        return ((physical, 0), True) if physical > wall else ((wall, logical + 1), True)
    other, ticks = received
    if other - physical > max_drift:
        return state, False
    top = max(wall, other, physical)
    counts = [t for w, t in ((wall, logical), (other, ticks)) if w == top]
    return (top, max(counts) + 1 if counts else 0), True


def steps(state: tuple[int, int], physical: np.ndarray, remote: np.ndarray, wall: np.ndarray, logical: np.ndarray, max_drift: int = MAX_DRIFT_NS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``step`` over events in their order: wall, logical and accepted of each; ``remote`` marks those that bring a clock.

    An accepted event makes the clock the greatest of its (wall, logical + 1), the same of what it brings, and
    (physical, 0). So less the number of accepted events the clock is a running maximum of pairs.
    """
    ok = ~remote | (wall - physical <= max_drift)
    done = np.concatenate([[0], np.cumsum(ok)])
    brings = remote & (wall >= physical)
    top = np.concatenate([[state[0]], np.where(ok, np.where(brings, wall, physical), np.iinfo(np.int64).min)])
    ticks = np.concatenate([[state[1]], np.where(ok & brings, logical + 1, 0)]) - done
    best = np.maximum.accumulate(top)
    run = np.concatenate([[0], np.cumsum(best[1:] > best[:-1])])
    low = int(ticks.min())
    span = int(ticks.max()) - low + 2
    if span * (int(run[-1]) + 1) > np.iinfo(np.int64).max:  # logical parts too far apart to lay the runs side by side
        out = []
        for p, r, w, t in zip(physical.tolist(), remote.tolist(), wall.tolist(), logical.tolist()):
            state, good = step(state, p, (w, t) if r else None, max_drift)
            out.append((*state, good))
        return tuple(np.array(x) for x in zip(*out))
    held = np.maximum.accumulate(np.where(top == best, ticks - low + 1, 0) + run * span) - run * span + low - 1
    return best[1:], (held + done)[1:], ok


def receive(events: DataFrame, max_drift: int = MAX_DRIFT_NS) -> DataFrame:
    """Fold rows (node, i, physical, remote_wall, remote_logical): adds wall, logical and accepted.

    Rows are spread by node and sorted by i in each partition; the fold keeps only the running state,
    so a node's history never has to fit in memory.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, (0, 0)
        for b in batches:  # Arrow keeps nanoseconds exact beside nulls, which float columns would not
            out = []
            for n, physical, wall, logical in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if n != node:
                    node, state = n, (0, 0)
                state, ok = step(state, physical, None if wall is None else (wall, logical), max_drift)
                out.append((*state, ok))
            added = [pa.array([o[k] for o in out], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*b.schema.names, "wall", "logical", "accepted"])

    given = events.select("node", "i", "physical", "remote_wall", "remote_logical")
    schema = "node string, i long, physical long, remote_wall long, remote_logical long, wall long, logical long, accepted boolean"
    return given.repartition("node").sortWithinPartitions("node", "i").mapInArrow(fold, schema)
