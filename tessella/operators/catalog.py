"""Small versioned tables: vector collections, ring membership, and the helpers that read them.

Both are a few rows of settings; changes are checked against what is there and give a new table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import by_metric
from .replication import ACTIVE, DEAD, JOINING

#: Defaults of a collection.
M, EF_CONSTRUCT, EF_SEARCH = 16, 200, 50
COLLECTION = "name string, dim int, metric int, m int, ef_construct int, ef_search int, max_vectors long"


class Exists(ValueError):
    """The collection is already there."""


class Conflict(ValueError):
    """Someone changed the table since it was read, or the change doesn't fit the member's state."""


def create_collection(catalog: DataFrame, name: str, dim: int, metric: int, m: int = M, ef_construct: int = EF_CONSTRUCT, ef_search: int = EF_SEARCH, max_vectors: int = 0) -> DataFrame:
    """The catalog with one more collection; a limit of 0 is none."""
    by_metric(metric)
    if not name or dim < 1 or m < 2 or ef_construct < 1 or ef_search < 1 or max_vectors < 0:
        raise ValueError("a name, dim >= 1, m >= 2, widths >= 1 and a limit >= 0 are needed")
    if not catalog.filter(F.col("name") == name).isEmpty():
        raise Exists(name)
    return catalog.unionByName(catalog.sparkSession.createDataFrame([(name, dim, metric, m, ef_construct, ef_search, max_vectors)], COLLECTION))


def collection(catalog: DataFrame, name: str):
    """The collection's row, or None."""
    return catalog.filter(F.col("name") == name).first()


RING = "version long, node string, addr string, ring int"


def change_ring(ring: DataFrame, expected: int, node: str, action: str, addr: str = "") -> DataFrame:
    """The next version of a ring table (RING) after join, activate or remove of a node.

    ``expected`` is the version the caller saw; another one is a conflict. A node joins once, only a
    joining node is activated, and the last active node can't go.
    """
    rows = ring.collect()  # one row a node
    version = max((r.version for r in rows), default=0)
    if version != expected:
        raise Conflict(f"version {version}, not {expected}")
    state = {r.node: (r.addr, r.ring) for r in rows}
    if action == "join" and node not in state:
        state[node] = (addr, JOINING)
    elif action == "activate" and state.get(node, ("", None))[1] == JOINING:
        state[node] = (state[node][0], ACTIVE)
    elif action == "remove" and node in state and {n for n, (_, s) in state.items() if s == ACTIVE} != {node}:
        del state[node]
    else:
        raise Conflict(f"{action} of {node}")
    return ring.sparkSession.createDataFrame([(version + 1, n, a, s) for n, (a, s) in sorted(state.items())], RING)


def roles(members: DataFrame) -> DataFrame:
    """Adds role (voter or learner), routable (not dead) and alive (liveness 0)."""
    role = F.when(F.col("ring") == JOINING, "learner").otherwise("voter")
    return members.select("*", role.alias("role"), (F.col("liveness") != DEAD).alias("routable"), (F.col("liveness") == 0).alias("alive"))


def retransmit_limit(nodes: int, factor: int = 4) -> int:
    """How often an update is gossiped: a multiple of the logarithm of the cluster's size."""
    return factor * max(1, math.ceil(math.log2(max(2, nodes))))


def graph_bytes(nodes: int, dim: int, m: int = M) -> int:
    """Estimated memory of a graph index: vectors, links of all layers and a fixed part a node."""
    links = 2 * m + m / (m - 1)
    return int(nodes * (4 * dim + 8 * links + 64))


def show_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"
