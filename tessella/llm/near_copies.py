"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, as components.

At that similarity two 64-bit fingerprints differ in about ten bits, too many for blocks that must agree,
so shards are dealt by minima instead: of ``BANDS`` * ``ROWS`` hash functions each text keeps the smallest
hash among its shingles, and texts that agree in all ``ROWS`` minima of a band share a shard (at 0.8 a pair
misses all bands once in 5,000). Equal sets form one class before, so copies cost one row, and shards are
named by their smallest class, so that the bands of one family fall together. In a shard a BK-tree over the
SimHash fingerprints proposes the pairs at ``RADIUS`` bits or fewer, nearest first, and the exact similarity
of the shingle sets decides every link. A shard of more than ``CELL`` classes is first compared with its
smallest class, which connects most of a family of copies; the trees are then searched for all classes
outside the shard's largest component. Pairs that are connected already
aren't looked at again.

Scale: what is shuffled for every text is its fingerprint and minima, not its words. Only classes that
share a shard send their shingle sets (8 bytes a shingle). A shard of more than ``CELL`` classes becomes a
grid of cells, so no task holds more than two times ``CELL`` sets of it; members of hot keys are looked up
in broadcasts of bounded size. Components come from star steps (components.py).

Edge cases: texts are compared by their words as in simhash.py; null, empty and word-free texts are copies
of each other and of nothing else; fewer words than a shingle are one shingle; very long texts are read
whole; ids may repeat (each row stays) or be null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_bytes, join_on_hot_keys, map_arrow, store
from .components import components
from .simhash import BKForest, majority, shingle_hashes

WIDTH, SIMILARITY, BANDS, ROWS, RADIUS, CELL = 5, 0.8, 16, 4, 24, 1_024
#: Shingles that are hashed at once, and pairs that are compared between two looks at what is connected.
STEP, PAIRS = 4_096, 256
#: Ids of texts whose sets are needed are broadcast up to this many (8 bytes each).
BROADCAST_IDS = 500_000
_FACTORS = np.random.default_rng(97).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a text's shingles."""
    out = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), STEP):
        out = np.minimum(out, (hashes[None, i : i + STEP] * _FACTORS[:, None]).min(1))
    return out


def shingle_set(body: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    return np.unique(np.array(shingle_hashes(body, width), np.uint64))


def set_name(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, name of the shingle set, its size, fingerprint and the keys of its bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, sizes, fps, bands = [], [], [], []
        for body in batch.column(1):
            every = np.array(shingle_hashes(body.as_py(), width), np.uint64)
            own = np.unique(every)
            names.append(set_name(own))
            sizes.append(len(own))
            fps.append(int(majority(every, np.array([len(every)])).view(np.int64)[0]))
            low = minima(own).reshape(BANDS, ROWS) if len(own) else []
            bands.append([xxhash.xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(low)])
        cols = [batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "name", "size", "fp", "bands"])

    return map_arrow(id_and_bytes(docs, id_col, text_col), run, "doc_id long, name binary, size int, fp long, bands array<long>")


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= similarity * max(len(a), len(b)) else 0
    return common > 0 and common >= similarity * (len(a) + len(b) - common)


def similar_pairs(fps: np.ndarray, sets: list[np.ndarray], asks: np.ndarray, held: np.ndarray, known: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is similar between ``asks`` and ``held`` (positions) beyond the ``known`` components."""
    tree = BKForest(fps[held], np.zeros(len(held), np.int64))
    q, n = tree.within(fps[asks], np.zeros(len(asks), np.int64), RADIUS)
    u, v = asks[q], held[n]
    sizes = np.array([len(s) for s in sets])
    use = (known[u] != known[v]) & (np.minimum(sizes[u], sizes[v]) >= similarity * np.maximum(sizes[u], sizes[v]))
    u, v = u[use], v[use]
    order = np.lexsort((v, u, np.bitwise_count(fps[u] ^ fps[v])))
    u, v = u[order], v[order]
    links: list[tuple[int, int]] = []
    over = np.unique(known, return_inverse=True)[1].tolist()  # components of components, as a forest of parents

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    parent = list(range(len(sets)))
    at = 0
    while at < len(u):
        for a, b in zip(u[at : at + PAIRS].tolist(), v[at : at + PAIRS].tolist()):
            x, y = top(over[a]), top(over[b])
            if x != y and similar(sets[a], sets[b], similarity):
                parent[max(x, y)] = min(x, y)
                links.append((a, b))
        at += PAIRS
        if len(u) - at > 4 * PAIRS:  # what got connected meanwhile goes all at once
            root = np.array([top(x) for x in range(len(parent))])[np.array(over)]
            left = np.flatnonzero(root[u[at:]] != root[v[at:]]) + at
            u, v, at = u[left], v[left], 0
    return links


def _cell_links(similarity: float):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        names, first, of = np.unique(table["class"].to_numpy(), return_index=True, return_inverse=True)
        node, asks = np.zeros(len(names), bool), np.zeros(len(names), bool)
        node[of[table["node"].to_numpy()]] = True
        asks[of[table["asks"].to_numpy()]] = True
        sets = [np.frombuffer(b, np.uint64) for b in table["body"].take(pa.array(first)).to_pylist()]
        links = similar_pairs(table["fp"].to_numpy()[first].view(np.uint64), sets, np.flatnonzero(asks), np.flatnonzero(node), table["root"].to_numpy()[first], similarity)
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.Table.from_arrays([pa.array(names[u]), pa.array(names[v])], schema=schema)

    return run


def _hub_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of classes with the smallest class of their shard."""
    pairs = members.select("class", F.col("shard").alias("hub")).filter("class != hub")
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    of_hub, _ = store(sets.select(F.col("class").alias("hub"), F.col("body").alias("other")).join(sizes, "hub"), "of-hub")
    both = join_on_hot_keys(pairs.join(sets, "class"), of_hub, "hub").select("class", "hub", "body", "other")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), similarity) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        kept = batch.filter(pa.array(ok, pa.bool_()))
        return pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["u", "v"])

    return map_arrow(both, run, "u long, v long")


def _links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All links: shards that one task holds are searched at once, larger ones by their hub and then by cells."""
    small = members.filter(F.col("n") <= CELL).select("shard", "class", "fp", F.col("class").alias("root"), F.lit(True).alias("node"), F.lit(True).alias("asks"))
    found = small.join(sets, "class").groupBy("shard").applyInArrow(_cell_links(similarity), "u long, v long")
    large = members.filter(F.col("n") > CELL)
    if large.isEmpty():
        return found
    first, _ = store(_hub_links(large, sets, similarity), "first")
    return found.unionByName(first).unionByName(_rest_links(large, sets, first, similarity))


def _rest_links(members: DataFrame, sets: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Links that BK-trees find in the shards that the ``known`` links (u, v), each class by its smallest, leave apart."""
    placed = members.join(known.groupBy(F.col("u").alias("class")).agg(F.min("v").alias("root")), "class", "left").withColumn("root", F.coalesce("root", "class"))
    placed, _ = store(placed.select("shard", "class", "fp", "root"), "placed")
    parts = placed.groupBy("shard", "root").agg(F.count("*").alias("m"))
    apart = parts.groupBy("shard").agg(F.sum("m").alias("n"), F.max("m").alias("m"), F.max_by("root", F.struct("m", "root")).alias("largest"), F.count("*").alias("roots")).filter("roots > 1")
    apart = apart.select("shard", "n", "largest", F.ceil(F.col("n") / CELL).cast("long").alias("trees"), F.ceil((F.col("n") - F.col("m")) / CELL).cast("long").alias("blocks"))
    todo, _ = store(join_on_hot_keys(placed, store(apart, "apart")[0], "shard"), "todo")
    asks, mix = F.col("root") != F.col("largest"), F.xxhash64("class")
    own = todo.withColumn("tree", F.pmod(mix, "trees")).withColumn("block", F.pmod(mix, "blocks")).withColumn("asking", asks)
    row = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.col("tree").alias("tree"), j.alias("block")))
    column = F.when(F.col("asking"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("trees") - 1), lambda i: F.struct(i.alias("tree"), F.col("block").alias("block")))).otherwise(F.array().cast("array<struct<tree:bigint,block:bigint>>"))
    visits = own.select("shard", "class", "fp", "root", "asking", F.col("tree").alias("t"), F.col("block").alias("b"), F.explode(F.array_distinct(F.concat(row, column))).alias("at"))
    cells = visits.select("shard", "at.tree", "at.block", "class", "fp", "root", (F.col("at.tree") == F.col("t")).alias("node"), (F.col("asking") & (F.col("at.block") == F.col("b"))).alias("asks"))
    return cells.join(sets, "class").groupBy("shard", "tree", "block").applyInArrow(_cell_links(similarity), "u long, v long")


def _shards(classes: DataFrame) -> DataFrame:
    """(shard, class, fp, n): classes by the smallest class that they share a band with, each pair once; n: of the shard."""
    dealt, _ = store(classes.select("class", "fp", F.explode("bands").alias("band")), "dealt")
    hubs = dealt.groupBy("band").agg(F.count("*").alias("n"), F.min("class").alias("shard")).filter("n > 1")
    pairs = join_on_hot_keys(dealt, store(hubs, "hubs")[0], "band").select("shard", "class", "fp").distinct()
    pairs, _ = store(pairs, "pairs")
    sizes, _ = store(pairs.groupBy("shard").agg(F.count("*").alias("n")).withColumn("members", F.col("n")), "sizes")
    return store(join_on_hot_keys(pairs, sizes, "shard").withColumnRenamed("members", "n"), "members")[0]


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(class, body): the shingle sets of the wanted classes, from one text of each."""
    named = wanted.join(classes.select("class", "name", "least"), "class")
    ids = named.select(F.col("least").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    bodies = id_and_bytes(docs, id_col, text_col)
    # rows without an id can't be asked for by it, so they all come
    rows = bodies.join(ids, "doc_id", "left_semi").unionByName(bodies.filter("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(1):
                own = shingle_set(body.as_py(), width)
                yield pa.RecordBatch.from_arrays([pa.array([set_name(own)], pa.binary()), pa.array([own.tobytes()], pa.binary())], ["name", "body"])

    names = named.select("class", "name")
    names = F.broadcast(names) if names.count() <= BROADCAST_IDS // 4 else names  # 24 bytes each
    found = rows.mapInArrow(run, "name binary, body binary").join(names, "name").select("class", "body")
    return store(found.dropDuplicates(["class"]), "sets")[0]


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over pairs of at least this similarity."""
    found, _ = store(signatures(docs, width, id_col, text_col), "signatures")
    some = found.groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    classes, _ = store(some.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = _shards(classes)
    sets = _sets(docs, classes, members.select("class").distinct(), width, id_col, text_col)
    stars = components(_links(members, sets, similarity))
    rooted = classes.select("class", "name", "least", "rows").join(stars.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rooted, _ = store(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    of_name, _ = store(join_on_hot_keys(rooted, least, "root").select("name", "component_id", F.col("rows").alias("n")), "named")
    return join_on_hot_keys(found.select("doc_id", "name"), of_name, "name").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those whose id isn't its component's smallest.

    Rows without an id stay; rows that share an id stand and fall together.
    """
    gone, _ = store(near_copies(docs).filter("doc_id != component_id").select("doc_id").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
