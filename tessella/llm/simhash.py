"""SimHash near-duplicates: fingerprints, links at a Hamming radius through BK-trees, components.

A fingerprint has 64 bits; bit i is set if over half of the text's shingle hashes have it set. Equal
fingerprints form one class before anything is linked, so exact copies cost one row however many there
are.

Shards: of three separate blocks of b bits, two fingerprints at 2 or fewer differing bits agree in at
least one, so every link is whole in the shard of some block's value. b is derived from the number of
classes, so that a shard holds about ``SHARD`` of them at any size. Each shard has a BK-tree, whose
children are keyed by their integer Hamming distance to the parent; every class of the shard queries it
and follows only the edges within the radius of its own distance, so the trees alone decide the links.
A shard over ``TREE`` classes gets several trees and blocks of queries that visit each of them, so no
task holds more than ``TREE`` nodes and ``TREE`` queries. A shard sends back only its spanning forest.
Trees stand in the tasks of their shard and are not broadcast: together they are the fingerprints of all
documents, which have no bound and must not pass through the driver.

Components come from star steps over the forest edges (components.py).

Edge cases: null, empty and word-free texts have fingerprint zero and link like any other; texts with
fewer words than a shingle hash their whole word sequence; repeated rows share a class; ids may repeat
(each row stays); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop, id_and_bytes, join_on_hot_keys, map_arrow, store
from .components import components, forest

SHARD, TREE, QUERIES, STEP = 1_024, 16_384, 2_048, 200_000
SEED = 42
#: Byte value -> its eight bits as eight byte lanes, to add up to 255 hashes at once.
LANES = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(body: bytes, width: int) -> list[int]:
    words = body.lower().split()  # of bytes: lower-cases A-Z only, splits at ASCII white space only
    if not words:
        return []
    text, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(text, SEED)]
    starts = [0, *accumulate([len(w) + 1 for w in words])]
    return [digest(text[a : b - 1], SEED) for a, b in zip(starts, starts[width:])]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs (of the given sizes, zero allowed) of 64-bit hashes."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not some.size:
        return out
    size = sizes[some]
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    blocks = -(-size // 255)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    at = np.repeat(begin, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], at, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), first, axis=0)
    bits = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little")
    out[some] = bits.view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the signed 64-bit fingerprint ``fp`` of every whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, hashes, sizes = [], [], []
        for i, body in enumerate(batch.column(1)):
            own = shingle_hashes(body.as_py(), width)
            hashes += own
            sizes.append(len(own))
            if len(hashes) >= STEP or i + 1 == batch.num_rows:
                prints.append(majority(np.array(hashes, np.uint64), np.array(sizes)))
                hashes, sizes = [], []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(prints).view(np.int64))], ["doc_id", "fp"])

    return map_arrow(id_and_bytes(docs, id_col, text_col), run, "doc_id long, fp long")


class BKForest:
    """BK-trees over groups of distinct fingerprints, built and searched level by level in numpy.

    Nodes are positions in ``fps``; ``group`` is sorted and says which tree a node belongs to.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        self.fps = fps
        self.names, self.roots = np.unique(group, return_index=True)
        rest = np.setdiff1d(np.arange(len(fps)), self.roots)
        here = self.roots[np.searchsorted(self.names, group[rest])]
        edges, children = [], []
        while rest.size:
            edge = here * 65 + np.bitwise_count(fps[rest] ^ fps[here])
            found, first, of = np.unique(edge, return_index=True, return_inverse=True)
            child = rest[first]
            edges.append(found)
            children.append(child)
            down = child[of] != rest
            rest, here = rest[down], child[of][down]
        self.edges = np.concatenate(edges) if edges else np.empty(0, np.int64)
        order = np.argsort(self.edges, kind="stable")
        self.edges = self.edges[order]
        self.children = np.concatenate(children)[order] if children else np.empty(0, np.int64)

    def within(self, fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``fps``, node) of every node of the query's tree at ``radius`` or less."""
        at = np.searchsorted(self.names, group)
        has = np.flatnonzero((at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == group)) if len(self.names) else np.empty(0, np.int64)
        query, node = has, self.roots[at[has]] if len(has) else has
        found = []
        while query.size:
            d = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            found.append((query[near], node[near]))
            # a node's edges stand in the order of their distances: those within the radius are one range
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            count = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), side="right") - low
            ramp = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            query, node = np.repeat(query, count), self.children[np.repeat(low, count) + ramp]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found])


def shard_links(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """The spanning forest of a shard's links. Columns: fp, node (held by the tree, else only a query)."""
    held = np.unique(pdf["fp"].to_numpy()[pdf["node"].to_numpy()])
    fps = np.unique(pdf["fp"].to_numpy()[pdf["asks"].to_numpy()])
    tree = BKForest(held.view(np.uint64), np.zeros(len(held), np.int64))
    names = np.union1d(held, fps)
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for i in range(0, len(fps), QUERIES):
        some = fps[i : i + QUERIES]
        q, n = tree.within(some.view(np.uint64), np.zeros(len(some), np.int64), radius)
        root = forest(np.concatenate([u, np.searchsorted(names, some[q])]), np.concatenate([v, np.searchsorted(names, held[n])]), len(names))
        u = np.flatnonzero(root != np.arange(len(names)))
        v = root[u]
    return pd.DataFrame({"u": names[u], "v": names[v]})


def block_bits(classes: int) -> int:
    """Bits of a block so that a block's value is shared by about ``SHARD`` of so many classes; 21 fit thrice."""
    return min(21, max(0, math.ceil(math.log2(max(1, classes) / SHARD))))


def link_edges(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints ``fp`` (each once) linked at ``radius`` or fewer bits."""
    if not 0 <= radius <= 2:
        raise ValueError("three blocks are exact up to a radius of 2")
    bits = block_bits(classes.count())
    value = lambda k: F.shiftrightunsigned("fp", 21 * k).bitwiseAND((1 << bits) - 1)
    blocks = [value(k) * 4 + k for k in range(3 if bits else 1)]
    dealt, _ = store(classes.select("fp", F.explode(F.array(*blocks)).alias("shard")), "dealt")
    large = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > TREE).select("shard", F.ceil(F.col("n") / TREE).cast("long").alias("trees"))
    parts = dealt.join(large, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("fp"), "trees"))
    # row i of the grid holds tree i, column j the j-th block of queries; a class is in one row and one column
    row = F.transform(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1), lambda j: F.struct(F.col("own").alias("tree"), j.alias("block")))
    column = F.transform(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1), lambda i: F.struct(i.alias("tree"), F.col("own").alias("block")))
    visits = parts.select("shard", "fp", "own", F.explode(F.array_distinct(F.concat(row, column))).alias("at"))
    cells = visits.select("shard", "fp", "at.tree", "at.block", (F.col("at.tree") == F.col("own")).alias("node"), (F.col("at.block") == F.col("own")).alias("asks"))
    return cells.groupBy("shard", "tree", "block").applyInPandas(lambda pdf: shard_links(pdf, radius), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable)."""
    prints, _ = store(fingerprints(docs, width, id_col, text_col), "prints")
    classes, path = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    edges = link_edges(classes.select("fp"), radius)
    stars = components(edges)
    rooted = classes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted, _ = store(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_class, _ = store(join_on_hot_keys(rooted.select("fp", F.col("n").alias("rows"), "root"), least, "root").select("fp", "component_id", F.col("rows").alias("n")), "named")
    named = join_on_hot_keys(prints, of_class, "fp")
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
