"""Vector collections: versioned rows, exact search, verification, and search over replicas.

Vector rows are (id, vec, wall, logical, deleted, ...); tombstones carry a version. A missing or zero
version is a forced write: it wins over what came before it in ``arrival`` order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import distance as D

#: Bytes of query vectors a search broadcasts at most, and of a matrix of distances; larger query sets are searched in blocks.
QUERY_BYTES, MATRIX_BYTES, ROWS, OVERSAMPLE = 32 << 20, 32 << 20, 1_024, 4


def latest(rows: DataFrame, by: tuple[str, ...] = ("wall", "logical")) -> DataFrame:
    """Each id's newest row, tombstones included."""
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), F.struct(*by)).alias("r")).select("id", "r.*")


def live(rows: DataFrame) -> DataFrame:
    return latest(rows).filter(~F.col("deleted"))


def get_latest(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """For each asked id: found, deleted and the version."""
    state = latest(rows.join(ids.select("id").distinct(), "id", "left_semi"))
    return ids.join(state, "id", "left").select("id", F.col("deleted").isNotNull().alias("found"), F.coalesce("deleted", F.lit(False)).alias("deleted"), "wall", "logical")


def check_dimension(rows: DataFrame, dim: int) -> DataFrame:
    """Fail on a vector of another length; the search goes on only over checked rows."""
    bad = F.raise_error(F.concat(F.lit(f"vector of {dim} components wanted, got "), F.size("vec").cast("string")))
    return rows.withColumn("vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(bad))


def admitted(rows: DataFrame, incoming: DataFrame, limit: int) -> DataFrame:
    """Incoming rows a collection of at most ``limit`` live ids takes: updates always, inserts in id order."""
    have = live(rows).select("id")
    room = max(0, limit - have.count())
    inserts = incoming.join(have, "id", "left_anti").orderBy("id").limit(room)
    return incoming.join(have, "id", "left_semi").unionByName(inserts)


def knn(base: DataFrame, query: list[float], k: int, metric: int = D.L2) -> DataFrame:
    """The k nearest rows to one vector: (id, distance), ties by id. One pass, top k a task."""
    if k < 1:
        return base.sparkSession.createDataFrame([], "id long, distance double")
    return _knn_block(base.filter("vec is not null"), [Row(qid=0, vec=list(query))], k, metric).select("id", "distance")


def knn_batch(base: DataFrame, queries: DataFrame, k: int, metric: int = D.L2) -> DataFrame:
    """(qid, rank from 1, id, distance) of the k nearest base rows of each query (qid, vec), exact.

    Queries go to all tasks in blocks of a checked size; each task keeps only the k best of its rows
    for each query, as one matrix product an Arrow batch, so the shuffle carries k rows a query and task.
    The product only preselects, with room for its rounding; what is returned are sums added up component
    by component, so distances and ties don't depend on the number of queries.
    """
    # collected on the driver: the stated query set, cut into blocks of a bounded size
    rows = queries.select("qid", "vec").orderBy("qid").collect()
    if not rows or k < 1:
        return base.sparkSession.createDataFrame([], "qid long, rank long, id long, distance double")
    step = max(1, QUERY_BYTES // max(8, 8 * len(rows[0].vec)))
    out = None
    for i in range(0, len(rows), step):
        part = _knn_block(base, rows[i : i + step], k, metric)
        out = part if out is None else out.unionByName(part)
    return out


def _knn_block(base: DataFrame, rows: list, k: int, metric: int) -> DataFrame:
    q = np.array([r.vec for r in rows], np.float64)
    shared, room = base.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), q)), (MATRIX_BYTES, ROWS)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        best = Nearest(q, k, metric, *room)
        for b in batches:
            if b.num_rows:
                best.offer(np.asarray(b.column(0), np.int64), np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1))
        yield best.batch(qids)

    return top(base.select(F.col("id").cast("long"), "vec").mapInArrow(search, FOUND), k)


#: What searches of a task return.
FOUND = "qid long, id long, distance double"


def top(found: DataFrame, k: int) -> DataFrame:
    """(qid, rank, id, distance) of each query's k best of all tasks."""
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("qid", "rank", "id", "distance")


class Nearest:
    """The k nearest of the rows offered so far, for each of some queries: k rows a query, and ``room`` bytes of matrices."""

    def __init__(self, q: np.ndarray, k: int, metric: int, room: int = MATRIX_BYTES, rows: int = ROWS):
        self.q, self.k, self.metric = q, k, metric
        self.rows_at_once, self.queries_at_once = rows, max(1, room // (64 * rows))
        self.d, self.i = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)

    def offer(self, ids: np.ndarray, vecs: np.ndarray, asking: np.ndarray | None = None) -> None:
        """Rows for all queries, or for those with the numbers ``asking``."""
        asking = np.arange(len(self.q)) if asking is None else asking
        for a in range(0, len(ids), self.rows_at_once):
            for b in range(0, len(asking), self.queries_at_once):
                self._offer(ids[a : a + self.rows_at_once], vecs[a : a + self.rows_at_once], asking[b : b + self.queries_at_once])

    def _offer(self, ids: np.ndarray, own: np.ndarray, who: np.ndarray) -> None:
        q, k = self.q[who], self.k
        # pairs that may be among the k best: rounding moves a product by far less than the slack
        rough = D.matrix(self.metric, q, own)
        slack = np.abs(rough)
        slack += (1 + (q * q).sum(1))[:, None]
        slack += (own * own).sum(1)[None, :]
        slack *= 1e-6
        bound = self.d[who, k - 1]
        rough -= slack
        use = rough <= bound[:, None]
        if len(own) > k and np.count_nonzero(use) > 4 * k * len(who):
            slack *= 2
            slack += rough
            slack.partition(k - 1, axis=1)
            use = rough <= np.minimum(bound, slack[:, k - 1])[:, None]
        r, c = np.nonzero(use)
        if not r.size:
            return
        d = exact_pairs(self.metric, q, own, r, c)
        some, r = np.unique(r, return_inverse=True)
        at = who[some]
        of = np.concatenate([np.repeat(np.arange(len(at)), k), r])
        d, i = np.concatenate([self.d[at].ravel(), d]), np.concatenate([self.i[at].ravel(), ids[c]])
        order = np.lexsort((i, d, of))
        first = order[np.searchsorted(of[order], np.arange(len(at)))[:, None] + np.arange(k)]
        self.d[at], self.i[at] = d[first], i[first]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance), nearest first, equal ones by id."""
        r, c = np.nonzero(self.d < np.inf)
        return r, self.i[r, c], self.d[r, c]

    def batch(self, qids: np.ndarray) -> pa.RecordBatch:
        r, i, d = self.rows()
        return pa.RecordBatch.from_arrays([pa.array(qids[r]), pa.array(i), pa.array(d)], ["qid", "id", "distance"])


#: Pairs whose exact distances are summed at once.
PAIRS = 16_384


def exact_pairs(metric: int, q: np.ndarray, b: np.ndarray, qs: np.ndarray, bs: np.ndarray) -> np.ndarray:
    """Distances of the pairs (q[qs], b[bs]), added up component by component, as the expressions do: bit for bit the same."""
    out = [_exact(metric, q[qs[i : i + PAIRS]].T.copy(), b[bs[i : i + PAIRS]].T.copy()) for i in range(0, len(qs), PAIRS)]
    return np.concatenate(out) if out else np.empty(0)


def _exact(metric: int, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(q.shape[1])
    if metric == D.L2:
        for x, y in zip(q, b):
            t = y - x
            out += t * t
        return out
    dot, qq, bb = out, np.zeros(q.shape[1]), np.zeros(q.shape[1])
    for x, y in zip(q, b):
        dot += y * x
        qq += x * x
        bb += y * y
    if metric == D.INNER:
        return -dot
    norm = np.sqrt(bb) * np.sqrt(qq)
    return np.where(norm == 0, 0.0, 1 - dot / np.where(norm == 0, 1.0, norm))


def search_verified(index: DataFrame, rows: DataFrame, query: list[float], k: int, ef: int | None = None, metric: int = D.L2) -> DataFrame:
    """Candidates from an index, possibly stale, checked against the newest rows: deleted ids drop out,
    changed vectors are measured again. ``ef`` candidates (2 k by default) are looked at."""
    found = knn(index, query, ef or 2 * k, metric).select("id")  # ef rows
    now = live(rows.join(F.broadcast(found), "id", "left_semi"))
    return knn(now, query, k, metric)


def distributed_search(replicas: DataFrame, query: list[float], k: int, oversample: int = OVERSAMPLE, metric: int = D.L2, truth: DataFrame | None = None) -> DataFrame:
    """Search rows (replica, id, vec, wall, logical, deleted) of several replicas as one.

    Each replica gives its k * oversample nearest live rows; they are deduplicated by newest version,
    validated against ``truth`` (default: the newest row of any replica) and ranked again.
    """
    per = k * oversample
    q = F.array(*(F.lit(float(x)) for x in query))
    own = replicas.groupBy("replica", "id").agg(F.max_by(F.struct("vec", "wall", "logical", "deleted"), F.struct("wall", "logical")).alias("r")).select("replica", "id", "r.*")
    near = own.filter("not deleted").withColumn("d", D.by_metric(metric)(F.col("vec"), q))
    w = Window.partitionBy("replica").orderBy("d", "id")
    picked = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per)
    merged = picked.groupBy("id").agg(F.max_by(F.struct("vec", "wall", "logical"), F.struct("wall", "logical")).alias("r")).select("id", "r.*")
    known = latest((truth if truth is not None else replicas).join(F.broadcast(merged.select("id")), "id", "left_semi"))
    newer = F.struct("n.wall", "n.logical") > F.struct("m.wall", "m.logical")
    checked = merged.alias("m").join(known.alias("n"), F.col("m.id") == F.col("n.id"), "left")
    use = checked.filter(F.col("n.id").isNull() | ~newer | ~F.col("n.deleted"))
    vec = F.when(newer, F.col("n.vec")).otherwise(F.col("m.vec"))
    return knn(use.select(F.col("m.id").alias("id"), vec.alias("vec")), query, k, metric)


def stale_copies(replicas: DataFrame, names: list[str]) -> DataFrame:
    """(id, replica, reason) of replicas whose newest row of an id is missing or old."""
    own = replicas.groupBy("replica", "id").agg(F.max(F.struct("wall", "logical")).alias("own"))
    win = own.groupBy("id").agg(F.max("own").alias("win"))
    every = win.withColumn("replica", F.explode(F.array(*map(F.lit, names))))
    state = every.join(own, ["id", "replica"], "left")
    return state.filter(F.col("own").isNull() | (F.col("own") < F.col("win"))).select("id", "replica", F.when(F.col("own").isNull(), "missing").otherwise("stale").alias("reason"))


def repair_rows(replicas: DataFrame, names: list[str]) -> DataFrame:
    """The newest rows, all their columns, to append on each replica that lacks them."""
    columns = [c for c in replicas.columns if c != "replica"]
    return stale_copies(replicas, names).select("id", "replica").join(latest(replicas.select(columns)), "id").select("replica", *columns)


def reconcile_index(index: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, action) that bring a saved index (id, wall, logical) up to date: insert, update, remove."""
    now = latest(rows).select("id", "deleted", F.struct("wall", "logical").alias("now"))
    had = index.select("id", F.struct("wall", "logical").alias("had"))
    both = now.join(had, "id", "full_outer")
    gone = F.col("now").isNull() | F.coalesce("deleted", F.lit(False))
    action = F.when(F.col("had").isNotNull() & gone, "remove").when(F.col("had").isNull() & ~gone, "insert").when(~gone & (F.col("now") > F.col("had")), "update")
    return both.select("id", action.alias("action")).filter("action is not null")


#: A typed metadata value: exactly one field is set.
META = "map<string, struct<s: string, i: bigint, d: double, b: boolean, x: binary>>"
_FIELD = {str: "s", bool: "b", int: "i", float: "d", bytes: "x"}


def meta_value(value: Column, field: str) -> Column:
    """A typed metadata value (of ``META``) of a column: field s, i, d, b or x."""
    kinds = {"s": "string", "i": "bigint", "d": "double", "b": "boolean", "x": "binary"}
    return F.struct(*((value if f == field else F.lit(None)).cast(k).alias(f) for f, k in kinds.items()))


def with_meta(rows: DataFrame, name: str, value: str | bool | int | float | bytes) -> DataFrame:
    """Rows whose metadata field has this value in its own type; applied before the search, so k rows are found."""
    return rows.filter(F.col("meta")[name][_FIELD[type(value)]] == F.lit(value))


def shown_meta(rows: DataFrame) -> DataFrame:
    """Metadata as text, as replies show it: map<string, string>."""
    text = lambda _, v: F.coalesce(v["s"], v["i"].cast("string"), v["d"].cast("string"), v["b"].cast("string"), F.hex(v["x"]))
    return rows.withColumn("meta", F.transform_values("meta", text))


def provenance(replicas: DataFrame) -> DataFrame:
    """For each id where its rows came from: (replica, wall, logical) in that order."""
    return replicas.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("replica", "wall", "logical"))).alias("sources"))  # a few replicas an id


def replicate(writes: DataFrame, owners: DataFrame, members: DataFrame) -> DataFrame:
    """Fan-out of vector rows (id, ..) to their owners (id, node): replica, hinted and the row.

    A dead owner's copy is hinted instead of stored; every column of the row goes along.
    """
    state = members.select(F.col("node").alias("replica"), "liveness")
    sent = writes.join(owners.select("id", F.col("node").alias("replica")), "id").join(F.broadcast(state), "replica")  # one row a member
    return sent.withColumn("hinted", F.col("liveness") == 2).drop("liveness")


def applied(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Each replica's newest row of an id after more rows arrived in any order."""
    both = stored.unionByName(arrived.select(stored.columns))
    others = [c for c in stored.columns if c not in ("replica", "id")]
    return both.groupBy("replica", "id").agg(F.max_by(F.struct(*others), F.struct("wall", "logical")).alias("r")).select("replica", "id", "r.*")


def dimension_report(rows: DataFrame, dim: int) -> DataFrame:
    """(ok, n): how many vectors have the collection's number of components."""
    return rows.groupBy((F.size("vec") == dim).alias("ok")).agg(F.count("*").alias("n"))
