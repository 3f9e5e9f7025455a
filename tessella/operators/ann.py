"""Approximate nearest neighbours: inverted file cells, and graphs a partition.

IVF: centroids come from a bounded sample, every row is put into its nearest cell, and a query looks
only into the cells nearest to it. HNSW: rows are dealt into parts of bounded size, each part builds
a navigable graph of its own, and a query takes the best of all parts. Both return exact distances of
what they find. Queries and new nodes go through numpy many at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from .vectors import FOUND, QUERY_BYTES, Nearest, exact_pairs, top

#: Rows that centroids are fitted on, and rows of one graph, at most.
SAMPLE, PART = 50_000, 20_000
#: Bytes of a matrix of distances or of gathered vectors, about.
BLOCK_BYTES = 32 << 20


def fit_cells(base: DataFrame, cells: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids by Lloyd's rounds over ``SAMPLE`` rows at most, chosen by a hash of the id."""
    rows = base.select("vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    x = np.array(rows["vec"].tolist(), np.float64)
    if not len(x):
        return np.empty((0, 0))
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = D.matrix(D.L2, x, c).argmin(1)
        for j in range(len(c)):
            if (near == j).any():
                c[j] = x[near == j].mean(0)
    return c


def ivf_search(base: DataFrame, queries: DataFrame, k: int, cells: int = 64, probes: int = 8, metric: int = D.L2) -> DataFrame:
    """(qid, rank, id, distance) of the k nearest rows in the probed cells of each query.

    One scan: a batch's rows go to their cells, and each cell's rows are measured against the queries that probe it,
    as a matrix product; a task keeps k rows a query.
    """
    c = fit_cells(base, cells)
    asked = queries.select("qid", "vec").orderBy("qid").collect()  # the stated query set, cut into blocks of a bounded size
    if not len(c) or not asked or k < 1:
        return base.sparkSession.createDataFrame([], "qid long, rank long, id long, distance double")
    out, step = None, max(1, QUERY_BYTES // max(8, 8 * c.shape[1]))
    for i in range(0, len(asked), step):
        part = _ivf_block(base, asked[i : i + step], k, c, probes, metric)
        out = part if out is None else out.unionByName(part)
    return out


def _ivf_block(base: DataFrame, rows: list, k: int, c: np.ndarray, probes: int, metric: int) -> DataFrame:
    q = np.array([r.vec for r in rows], np.float64)
    near = np.argsort(D.matrix(D.L2, q, c), axis=1, kind="stable")[:, :probes]
    shared = base.sparkSession.sparkContext.broadcast((np.array([r.qid for r in rows], np.int64), q, near, c))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, near, c = shared.value
        asking = [np.flatnonzero((near == j).any(1)) for j in range(len(c))]
        best = Nearest(q, k, metric)
        for b in batches:
            if b.num_rows:
                ids, x = np.asarray(b.column(0), np.int64), np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
                cell = D.matrix(D.L2, x, c).argmin(1)
                for j in np.unique(cell):
                    best.offer(ids[cell == j], x[cell == j], asking[j])
        yield best.batch(qids)

    return top(base.select(F.col("id").cast("long"), "vec").mapInArrow(search, FOUND), k)


class Graph:
    """A hierarchical navigable small world over rows of a matrix; the links of a layer are a matrix of node numbers.

    In the lowest layer each node keeps, both ways and whatever is nearer, its link to one earlier node: a tree of
    few branches a node. So every node leads to every other, also among many copies or around a few near all.
    """

    def __init__(self, dim: int, m: int = 16, ef_construct: int = 200, metric: int = D.L2, seed: int = 11, max_bytes: int = 0):
        if dim < 1 or m < 2 or ef_construct < 1:
            raise ValueError("dim >= 1, m >= 2 and ef_construct >= 1 are needed")
        self.m, self.ef, self.metric = m, ef_construct, metric
        self.rng = np.random.default_rng(seed)
        self.vecs = np.empty((0, dim))
        self.ids: list[int] = []
        self.levels = np.empty(0, np.int64)
        self.links: list[np.ndarray] = []  # a layer each: a row a node, its neighbours, then -1
        self.parent = np.empty(0, np.int64)
        self.deleted: set[int] = set()
        self.max_bytes, self.bytes = max_bytes, 0  # 0: no limit
        self.entry = -1

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the rows of two matrices, one by one."""
        dot = np.einsum("ij,ij->i", a, b)
        if self.metric == D.INNER:
            return -dot
        aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        if self.metric == D.L2:
            return np.maximum(aa + bb - 2 * dot, 0.0)
        norm = np.sqrt(aa) * np.sqrt(bb)
        return np.where(norm == 0, 0.0, 1 - dot / np.where(norm == 0, 1.0, norm))

    def _spread(self, near: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which ``m`` of each row's near nodes, nearest first, to link: nearer to it than to one another; the pruned fill up."""
        there = np.isfinite(d)
        free, kept = there.copy(), np.zeros_like(there)
        own = self.vecs[near]
        size = np.einsum("ijk,ijk->ij", own, own)
        every = np.arange(len(near))
        for _ in range(self.m):
            some = free.any(1)
            if not some.any():
                break
            at = free.argmax(1)
            kept[every[some], at[some]] = True
            dot = (own @ own[every, at][:, :, None])[:, :, 0]
            if self.metric == D.L2:
                between = size + size[every, at][:, None] - 2 * dot
            elif self.metric == D.INNER:
                between = -dot
            else:
                norm = np.sqrt(size) * np.sqrt(size[every, at])[:, None]
                between = np.where(norm == 0, 0.0, 1 - dot / np.where(norm == 0, 1.0, norm))
            free &= (between > d) & ~kept
        rest = there & ~kept
        return kept | (rest & (np.cumsum(rest, 1) <= (self.m - kept.sum(1))[:, None]))

    def _adopt(self, first: int, near: np.ndarray, used: np.ndarray) -> None:
        """The earlier node that each node from ``first`` on stays linked with: the nearest with a free branch."""
        most, free = max(2, self.m // 2), 0
        for n, row in enumerate(near.tolist(), first):
            if not n:
                continue
            p = next((x for x in row if x < n and used[x] < most), -1)
            if p < 0:
                while used[free] >= most:
                    free += 1
                p = free
            self.parent[n] = p
            used[p] += 1

    def _link(self, layer: int, first: int) -> None:
        """Links of a layer with its nodes from ``first`` on: each takes its place among the ``ef_construct`` nearest
        of the nodes before it, as inserting them in turn with a beam that misses none. Full nodes keep the links that are
        among the nearest ``m`` / 2 to their end, then their own nearest: nodes far from all others stay linked, too."""
        member = np.flatnonzero(self.levels >= layer)
        x, start, cap = self.vecs[member], int(np.searchsorted(member, first)), self.m if layer else 2 * self.m
        rows = max(1, BLOCK_BYTES // (8 * max(len(member), min(self.ef, len(member)) * x.shape[1])))
        used = np.bincount(self.parent[self.parent >= 0], minlength=len(self.ids))
        edges = []
        for a in range(start, len(member), rows):
            b = min(a + rows, len(member))
            d = D.matrix(self.metric, x[a:b], x[:b])
            d[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = np.inf
            width = min(self.ef, b)
            near = np.argpartition(d, width - 1, axis=1)[:, :width] if width < b else np.broadcast_to(np.arange(b), d.shape)
            d = np.take_along_axis(d, near, 1)
            order = np.lexsort((near, d), axis=1)
            near, d = member[np.take_along_axis(near, order, 1)], np.take_along_axis(d, order, 1)
            if not layer:
                self._adopt(a, near, used)
            r, c = np.nonzero(self._spread(near, d))
            edges.append((member[r + a], near[r, c]))
        new, old = (np.concatenate(e) for e in zip(*edges)) if edges else (np.empty(0, np.int64),) * 2
        had_from, had_at = np.nonzero(self.links[layer] >= 0) if layer < len(self.links) else (np.empty(0, np.int64),) * 2
        had_to = self.links[layer][had_from, had_at] if had_from.size else had_from
        child = np.flatnonzero(self.parent >= 0) if not layer else np.empty(0, np.int64)
        rank = np.repeat([0, 2, 4], [len(child), len(child), 2 * len(new) + len(had_from)])
        src = np.concatenate([child, self.parent[child], new, old, had_from])
        dst = np.concatenate([self.parent[child], child, old, new, had_to])
        _, once = np.unique(src * len(self.ids) + dst, return_index=True)  # the first of equal ones: the tree's
        src, dst, rank = src[once], dst[once], rank[once]
        far = np.concatenate([self._pairs(self.vecs[src[i : i + 20_000]], self.vecs[dst[i : i + 20_000]]) for i in range(0, len(src), 20_000)] or [np.empty(0)])
        into = np.lexsort((src, far, dst))
        place = np.empty(len(into), np.int64)  # of a link among those to the same node
        place[into] = np.arange(len(into)) - np.searchsorted(dst[into], dst[into])
        order = np.lexsort((dst, far, rank + (place >= self.m // 2), src))
        src, dst = src[order], dst[order]
        at = np.arange(len(src)) - np.searchsorted(src, src)
        self.links[layer : layer + 1] = [np.full((len(self.ids), cap), -1, np.int64)]
        self.links[layer][src[at < cap], at[at < cap]] = dst[at < cap]

    def node_bytes(self, level: int) -> int:
        """What a node of a level is counted with: its vector, room for its links and a fixed part."""
        return 4 * self.vecs.shape[1] + 8 * self.m * (level + 2) + 64

    def add(self, ids: list[int], vecs: np.ndarray) -> None:
        """Insert new ids. An id that is there, a wrong length or a full graph are refused before anything changes."""
        if len(set(ids)) != len(ids) or not set(ids).isdisjoint(self.ids):
            raise ValueError("an id is in the graph already")
        if vecs.shape != (len(ids), self.vecs.shape[1]):
            raise ValueError("vectors of another length")
        if not ids:
            return
        levels = [int(-math.log(1 - self.rng.random()) / math.log(self.m)) for _ in ids]
        size = sum(map(self.node_bytes, levels))
        if self.max_bytes and self.bytes + size > self.max_bytes:
            raise MemoryError(f"the graph may hold {self.max_bytes} bytes")
        self.bytes += size
        first = len(self.ids)
        self.vecs = np.concatenate([self.vecs, vecs])
        self.ids = self.ids + ids
        self.levels = np.concatenate([self.levels, np.array(levels, np.int64)])
        self.parent = np.concatenate([self.parent, np.full(len(ids), -1)])
        for layer in range(int(self.levels.max()) + 1):
            self._link(layer, first)
        self.entry = int(self.levels.argmax())

    def remove(self, ids: set[int]) -> None:
        """Mark nodes deleted: they still lead on, but aren't returned."""
        self.deleted |= {n for n, i in enumerate(self.ids) if i in ids}

    def _descend(self, q: np.ndarray) -> np.ndarray:
        """For each query the node that the layers above the second lead to."""
        at = np.full(len(q), self.entry)
        far = self._pairs(self.vecs[at], q)
        for links in self.links[:1:-1]:
            on = np.arange(len(q))
            while on.size:
                to = links[at[on]]
                r, c = np.nonzero(to >= 0)
                d = np.full(to.shape, np.inf)
                d[r, c] = self._pairs(self.vecs[to[r, c]], q[on[r]])
                best = d.argmin(1)
                d, to = (z[np.arange(len(on)), best] for z in (d, to))
                nearer = d < far[on]
                on, d, to = on[nearer], d[nearer], to[nearer]
                at[on], far[on] = to, d
        return at

    def _beam(self, q: np.ndarray, start: tuple[np.ndarray, np.ndarray], ef: int, layer: int, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of the ``ef`` nearest live nodes of a layer, for queries in step, found from pairs of (query, node).

        Deleted nodes lead on but take no place among them, so the beam keeps its width.
        """
        n, b, links, step = len(self.ids), len(q), self.links[layer], max(16, ef // 4)
        seen = np.zeros(b * n, bool)
        seen[start[0] * n + start[1]] = True
        place = np.arange(len(start[0])) - np.searchsorted(start[0], start[0])
        num, far = np.zeros((b, place.max() + 1), np.int64), np.full((b, place.max() + 1), np.inf)
        num[start[0], place], far[start[0], place] = start[1], self._pairs(self.vecs[start[1]], q[start[0]])
        fresh = np.isfinite(far)
        bound = np.full(b, np.inf)
        while True:
            r, c = np.nonzero(fresh & (np.cumsum(fresh, 1) <= step))  # the nearest that haven't led on yet
            if not r.size:
                break
            fresh[r, c] = False
            to = links[num[r, c]]
            key = (r[:, None] * n + to)[to >= 0]
            key = np.unique(key[~seen[key]])
            seen[key] = True
            r, to = np.divmod(key, n)
            d = self._pairs(self.vecs[to], q[r])
            use = d < bound[r]
            r, to, d = r[use], to[use], d[use]
            if not r.size:
                continue
            count = np.bincount(r, minlength=b)
            at = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            more = [np.full((b, count.max()), x) for x in (0, np.inf, False)]
            for z, v in zip(more, (to, d, True)):
                z[r, at] = v
            num, far, fresh = (np.concatenate(z, 1) for z in zip((num, far, fresh), more))
            far[gone[num] & ~fresh] = np.inf
            order = np.argsort(far, axis=1, kind="stable")
            num, far, fresh = (np.take_along_axis(z, order, 1) for z in (num, far, fresh))
            live = np.isfinite(far) & ~gone[num]
            place = np.cumsum(live, 1)
            keep = np.isfinite(far) & (place - live < ef)
            far[~keep], fresh = np.inf, fresh & keep
            bound = np.where(place[:, -1] >= ef, np.where(keep, far, -np.inf).max(1), np.inf)
            width = int(keep.sum(1).max())
            num, far, fresh = num[:, :width], far[:, :width], fresh[:, :width]
        r, c = np.nonzero(np.isfinite(far) & ~gone[num])
        return r, num[r, c]

    def _reach(self, start: int, links: list[np.ndarray]) -> np.ndarray:
        """Which nodes links lead to from a node, as truth values."""
        seen = np.zeros(len(self.ids), bool)
        seen[start], front = True, np.array([start])
        while front.size:
            to = np.unique(np.concatenate([x[front].ravel() for x in links]))
            front = to[(to >= 0) & ~seen[np.maximum(to, 0)]]
            seen[front] = True
        return seen

    def search_many(self, q: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the k nearest live nodes found with beam ``ef``, in this order by distance and id."""
        ids, gone, n = np.array(self.ids, np.int64), np.zeros(len(self.ids), bool), len(self.ids)
        gone[list(self.deleted)] = True
        out, ef = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], max(ef, k)
        step = max(1, BLOCK_BYTES // (n + 48 * min(ef, n) + 16 * max(16, ef // 4) * 2 * self.m * self.vecs.shape[1]))
        for a in range(0, len(q) if self.entry >= 0 else 0, step if ef < n else len(q)):
            own = q[a : a + step] if ef < n else q
            start = self._descend(own)
            if ef < n:
                r, node = np.arange(len(own)), start
                if len(self.links) > 1:  # as wide in the second layer: what is near to a query far from all stands apart
                    r, node = self._beam(own, (r, node), ef, 1, np.zeros(n, bool))
                r, node = self._beam(own, (r, node), ef, 0, gone)
                d = exact_pairs(self.metric, own, self.vecs, r, node)
                order = np.lexsort((ids[node], d, r))
                r, node, d = r[order], node[order], d[order]
                use = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((r[use] + a, ids[node[use]], d[use]))
                continue
            # a beam that holds all nodes takes every live one that links lead to
            left = np.ones(len(own), bool)
            while left.any():
                ahead = self._reach(int(start[left][0]), self.links[:1])
                same = left & (start == start[left][0]) if not ahead.all() else left & self._leads(int(start[left][0]))[start]
                best = Nearest(own[same], k, self.metric)
                use = np.flatnonzero(ahead & ~gone)
                best.offer(ids[use], self.vecs[use])
                r, i, d = best.rows()
                out.append((np.flatnonzero(same)[r], i, d))
                left &= ~same
        r, i, d = (np.concatenate(z) for z in zip(*out))
        order = np.lexsort((i, d, r))
        return r[order], i[order], d[order]

    def _leads(self, to: int) -> np.ndarray:
        """Which nodes lead to a node by the links of the lowest layer."""
        src, at = np.nonzero(self.links[0] >= 0)
        dst = self.links[0][src, at]
        seen = np.zeros(len(self.ids), bool)
        seen[to], front = True, seen.copy()
        front[to] = True
        while front.any():
            front = np.bincount(src[front[dst]], minlength=len(seen)).astype(bool) & ~seen
            seen |= front
        return seen

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """(distance, id) of the k nearest live nodes found with beam ``ef``."""
        _, i, d = self.search_many(np.asarray(q, np.float64)[None], k, ef)
        return list(zip(d.tolist(), i.tolist()))

    def stats(self) -> dict[str, int]:
        return {"live": len(self.ids) - len(self.deleted), "deleted": len(self.deleted), "levels": len(self.links), "bytes": self.bytes}

    def cleanup(self) -> "Graph":
        """A new graph of the live nodes only."""
        keep = [n for n in range(len(self.ids)) if n not in self.deleted]
        out = Graph(self.vecs.shape[1], self.m, self.ef, self.metric)
        out.add([self.ids[n] for n in keep], self.vecs[keep])
        return out

    def table(self) -> pa.Table:
        """(node, id, vec, links of each layer, deleted), to be saved; the first link of a node is its tree's."""
        n = np.arange(len(self.ids))
        node, layer, at, to = (np.concatenate(z) for z in zip(*((r, np.full(len(r), k), c, x[r, c]) for k, x in enumerate(self.links) for r, c in [np.nonzero(x >= 0)])))
        to = to[np.lexsort((at, layer, node))]
        outer = np.concatenate([[0], np.cumsum(self.levels + 1)])
        inner = np.concatenate([[0], np.cumsum(np.bincount(outer[node] + layer, minlength=outer[-1]))])
        links = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(to)))
        vecs = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * self.vecs.shape[1], pa.int32()), pa.array(self.vecs.ravel()))
        return pa.table({"node": pa.array(n), "id": pa.array(self.ids, pa.int64()), "vec": vecs, "links": links, "deleted": pa.array(np.isin(n, list(self.deleted)))})

    def rows(self) -> list[tuple]:
        """The rows of ``table``."""
        return [tuple(r.values()) for r in self.table().to_pylist()]

    @classmethod
    def load(cls, rows: list[tuple] | pa.Table, m: int = 16, ef_construct: int = 200, metric: int = D.L2) -> "Graph":
        """The graph of saved rows; vectors of several lengths or broken links are refused."""
        t = rows if isinstance(rows, pa.Table) else pa.table(dict(zip(("node", "id", "vec", "links", "deleted"), map(pa.array, zip(*rows)))))
        t = t.sort_by("node").combine_chunks()
        vec, links, n = (t.column("vec").combine_chunks(), t.column("links").combine_chunks(), t.num_rows)
        size = vec.value_lengths().unique().to_pylist()
        if len(size) != 1 or t.column("node").to_pylist() != list(range(n)):
            raise ValueError("not the rows of one graph")
        g = cls(size[0], m, ef_construct, metric)
        g.vecs, g.ids = np.asarray(vec.flatten(), np.float64).reshape(n, -1), t.column("id").to_pylist()
        g.levels = np.asarray(links.value_lengths(), np.int64) - 1
        inner = links.flatten()
        count, to = np.asarray(inner.value_lengths(), np.int64), np.asarray(inner.flatten(), np.int64)
        if (to >= n).any() or (to < 0).any():
            raise ValueError("a link leads out of the graph")
        node = np.repeat(np.repeat(np.arange(n), g.levels + 1), count)
        layer = np.repeat(np.concatenate([np.arange(k + 1) for k in g.levels]), count)
        at = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count)
        for k in range(int(g.levels.max()) + 1):
            own = layer == k
            g.links.append(np.full((n, max(m if k else 2 * m, int(at[own].max(initial=0)) + 1)), -1, np.int64))
            g.links[k][node[own], at[own]] = to[own]
        g.parent = np.where(g.links[0][:, 0] < np.arange(n), g.links[0][:, 0], -1)
        g.deleted = set(np.flatnonzero(np.array(t.column("deleted").to_pylist(), bool)).tolist())
        g.entry = int(g.levels.argmax())
        g.bytes = sum(g.node_bytes(int(x)) for x in g.levels)
        return g


GRAPH = "part long, node long, id long, vec array<double>, links array<array<long>>, deleted boolean"


def build_graphs(base: DataFrame, m: int = 16, ef_construct: int = 200, metric: int = D.L2) -> DataFrame:
    """The graphs of all parts as a table (GRAPH) to be written and searched later."""
    parts = max(1, math.ceil(base.count() / PART))

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        vecs = np.asarray(rows.column("vec").combine_chunks().flatten(), np.float64).reshape(rows.num_rows, -1)
        g = Graph(vecs.shape[1], m, ef_construct, metric)
        g.add(rows.column("id").to_pylist(), vecs)
        return g.table().add_column(0, "part", [pa.repeat(rows.column("part")[0], rows.num_rows)])

    dealt = base.select(F.col("id").cast("long"), "vec", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    return dealt.groupBy("part").applyInArrow(build, GRAPH)


def search_graphs(graphs: DataFrame, queries: DataFrame, k: int, ef_search: int = 100, removed: DataFrame | None = None, metric: int = D.L2) -> DataFrame:
    """(qid, rank, id, distance) from saved graphs; ids in ``removed`` lead on but aren't returned."""
    rows = queries.select("qid", "vec").orderBy("qid").collect()  # the stated query set, cut into blocks of a bounded size
    if not rows:
        return graphs.sparkSession.createDataFrame([], "qid long, rank long, id long, distance double")
    if removed is not None:
        gone = removed.select("id").distinct().withColumn("gone", F.lit(True))
        graphs = graphs.join(gone, "id", "left").withColumn("deleted", F.col("deleted") | F.coalesce("gone", F.lit(False)))

    step = max(1, QUERY_BYTES // max(8, 8 * len(rows[0].vec)))
    out = None
    for i in range(0, len(rows), step):  # a block's size is checked before it is broadcast
        part = _search_block(graphs, rows[i : i + step], k, ef_search, metric)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(graphs: DataFrame, rows: list, k: int, ef_search: int, metric: int) -> DataFrame:
    shared = graphs.sparkSession.sparkContext.broadcast(([r.qid for r in rows], np.array([r.vec for r in rows], np.float64)))

    def part(rows: pa.Table) -> pa.Table:
        qids, q = shared.value
        i, ids, d = Graph.load(rows.drop_columns("part"), metric=metric).search_many(q, k, ef_search)
        return pa.table({"qid": pa.array(np.array(qids, np.int64)[i]), "id": pa.array(ids), "distance": pa.array(d)})

    found = graphs.select("part", "node", "id", "vec", "links", "deleted").groupBy("part").applyInArrow(part, "qid long, id long, distance double")
    return top(found, k)


def hnsw_search(base: DataFrame, queries: DataFrame, k: int, m: int = 16, ef_construct: int = 200, ef_search: int = 100, metric: int = D.L2) -> DataFrame:
    """(qid, rank, id, distance): each part's graph answers every query, the best k of all parts stay."""
    return search_graphs(build_graphs(base, m, ef_construct, metric), queries, k, ef_search, None, metric)


def graph_stats(graphs: DataFrame, m: int = 16) -> DataFrame:
    """Nodes, tombstones, levels and estimated bytes of each saved graph."""
    levels = F.size("links")
    size = 4 * F.size("vec") + 8 * m * (levels + 1) + 64
    return graphs.groupBy("part").agg(F.count("*").alias("nodes"), F.count_if("deleted").alias("deleted"), F.max(levels).cast("long").alias("levels"), F.sum(size).cast("long").alias("bytes"))


def rebuild(rows: DataFrame, m: int = 16, ef_construct: int = 200, metric: int = D.L2) -> DataFrame:
    """The graphs of a collection from its stored rows: what a start without a snapshot does."""
    from .vectors import live

    return build_graphs(live(rows).select("id", "vec"), m, ef_construct, metric)


def snapshot_all(collections: dict[str, DataFrame], folder: str, number: int) -> dict[str, str]:
    """Write the graphs of all collections as snapshot ``number``; their folders by name."""
    paths = {}
    for name, graphs in collections.items():
        paths[name] = f"{folder}/{name}/snapshot-{number:08d}"
        graphs.write.parquet(paths[name])
    return paths


def snapshots(spark, folder: str, name: str) -> list[str]:
    """A collection's complete snapshots, the newest first; one without its success mark doesn't count."""
    from ..workspace import file_system

    fs, at = file_system(spark, f"{folder}/{name}")
    found = [s.getPath().toString() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted((p for p in found if fs.exists(file_system(spark, f"{p}/_SUCCESS")[1])), reverse=True)


def cleanup_snapshots(spark, folder: str, name: str, keep: int = 1) -> list[str]:
    """Delete a collection's snapshots but the newest; what went."""
    from ..workspace import file_system

    old = snapshots(spark, folder, name)[keep:]
    for path in old:
        fs, at = file_system(spark, path)
        fs.delete(at, True)
    return old
