"""Suffix-array dedup and SimHash against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import SF, words
from pyspark.sql import functions as F
from tessella.llm import _common, components, near_copies, simhash, suffix_dedup
from tessella.llm import queries as llm

HUGE = 1 << 62


def brute(rows, length=50):
    """{position: (removed, spans, kept)} by the definition."""
    owner: dict = {}
    for doc, body in rows:
        for k in range(len(body) - length + 1):
            s = body[k : k + length]
            owner[s] = min(owner.get(s, HUGE), doc)
    out = []
    for doc, body in rows:
        gone = np.zeros(len(body), bool)
        for k in range(len(body) - length + 1):
            if owner[body[k : k + length]] < doc:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out.append((doc, len(body), int(gone.sum()), spans, bytes(np.frombuffer(body, np.uint8)[~gone])))
    return sorted(out, key=repr)


def run(df):
    rows = suffix_dedup.remove_repeats(df).collect()
    return sorted(((HUGE if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.edges) // 2, bytes(r.kept)) for r in rows), key=repr)


def encoded(df):
    return [(HUGE if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]


def test_documents_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 40_000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 3_000)
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    assert run(df) == brute(encoded(df))


def test_adversarial_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1_500)
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", 64)
    rng = random.Random(3)
    base = "".join(rng.choice("abcde ") for _ in range(400))
    rows = [(10, "a" * 300), (11, "a" * 49), (12, "x" + "a" * 50 + "y"), (20, base), (19, base[100:149]), (18, base[100:150]), (17, "ab" * 80), (16, "b" + "ab" * 60), (21, base[:200] + "Q" + base[200:]), (22, "é" * 60), (23, "é" * 70), (20, base)]
    for i in range(40):
        a = rng.randrange(300)
        rows.append((30 + i, base[a : a + rng.randrange(20, 100)] + "".join(rng.choice("xyz") for _ in range(rng.randrange(60))) + base[:70][rng.randrange(30) :]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df) == brute(encoded(df))


def test_edge_cases(odd, none):
    assert run(odd) == brute(encoded(odd))
    assert run(none) == []


def test_hot_hashes_are_split(spark, monkeypatch):
    """Windows of one common passage with many neighbourhoods, dealt by all their bytes; shards by bytes."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "HOT_WINDOWS", 20)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 4_000)
    rng = random.Random(8)
    line = "a line that every one of the documents has got in it"
    rows = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(5, 90))) + line + "".join(rng.choice("xy ") for _ in range(rng.randrange(90)))) for i in range(120)]
    rows += [(200 + i, rows[i][1][10:]) for i in range(0, 100, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert run(df) == brute(encoded(df))


def test_ranks_order_windows_by_their_bytes():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 2, 600).astype(np.uint8)
    data[100:250] = data[300:450]
    at = np.array([i for i in range(551) if not 260 <= i < 290])
    windows = [bytes(data[i : i + 50]) for i in at]
    assert suffix_dedup.suffix_ranks(data, at).tolist() == [sorted(set(windows)).index(w) for w in windows]
    assert suffix_dedup.suffix_ranks(data, at[:0]).tolist() == []
    few = np.array([400, 20, 320, 520, 120])  # out of order, one text's bytes at both ends, gaps that aren't covered
    windows = [bytes(data[i : i + 50]) for i in few]
    assert suffix_dedup.suffix_ranks(data, few).tolist() == [sorted(set(windows)).index(w) for w in windows]


@pytest.mark.parametrize("bits", [3, 20, 31, 32])
def test_ranks_of_any_width(bits):
    """With and without room for the places beside the numbers."""
    rng = np.random.default_rng(bits)
    high, low = (rng.integers(0, 1 << bits, 4_000).astype(np.uint32) for _ in range(2))
    high[:2_000], low[:1_000] = high[2_000:], low[2_000:3_000]
    high[0], low[0] = (1 << bits) - 1, (1 << bits) - 1
    pairs = list(zip(high.tolist(), low.tolist()))
    place = {p: i for i, p in enumerate(sorted(set(pairs)))}
    assert suffix_dedup._ranks(high, low).tolist() == [place[p] for p in pairs]
    order, key = suffix_dedup._sorted(high)
    assert order.tolist() == sorted(range(len(high)), key=lambda i: high[i]) and key.tolist() == sorted(high.tolist())
    assert [len(x) for x in suffix_dedup._sorted(high[:0])] == [0, 0]
    assert suffix_dedup._ranks(high[:1], low[:1]).tolist() == [0]


def test_family_merges_levels_geometrically():
    family = suffix_dedup.SuffixFamily()
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(56)).encode() for _ in range(64)]
    for i, t in enumerate(texts):
        family.add(family.level(np.frombuffer(t, np.uint8), np.arange(7), np.full(7, 100 - i)))
    sizes = [len(x[0]) for x in family.levels]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes) and len(sizes) <= 7
    assert all(x[0].dtype.kind == "i" and sorted(family._windows(x[0]).tolist()) == family._windows(x[0]).tolist() for x in family.levels)
    owner: dict = {}
    windows = [(t[k : k + 50], 100 - i) for i, t in enumerate(texts) for k in range(7)]
    for w, o in windows:
        owner[w] = min(owner.get(w, HUGE), o)
    late = family.level(np.frombuffer(texts[0] + texts[5], np.uint8), np.array([0, 3, 56]), np.array([200, 1, 200]))
    found = dict(zip((late[0] - 64 * 56).tolist(), family.matches(late).tolist()))
    assert found == {0: owner[texts[0][:50]], 3: 1, 56: owner[texts[5][:50]]}
    assert family.owners()[1].tolist() == [owner[w] for w, _ in windows]


def test_a_later_batch_meets_the_stored_levels(spark, monkeypatch, tmp_path, odd):
    """Four batches through one index: each is cut by all documents so far, and levels merge geometrically."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 20_000)
    index = f"file://{tmp_path}/index"
    docs = [(r.doc_id, (r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    cuts = [docs[:100], docs[100:130], docs[130:160], docs[160:]]
    seen: list = []
    for some in cuts:
        rows = [(i, t) for i, t in some]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.edges) // 2, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, index=index, index_shards=8).collect()), key=repr)
        seen += [(i, t.encode()) for i, t in rows]
        want = [x for x in brute(seen) if x[0] in {i for i, _ in rows}]
        assert got == want
    assert suffix_dedup.stored_batches(spark, index) == [1, 2, 3, 4]
    levels = spark.read.schema(suffix_dedup._LEVELS).parquet(*(f"{index}/batch-{k:08d}" for k in range(1, 5)))
    assert levels.filter("size(absorbed) > 0").count() > 0


def test_carried_columns_and_pipeline_form(spark, odd):
    cut = suffix_dedup.without_repeats(odd)
    assert cut.columns == odd.columns
    rows = {(r.doc_id, r.text, r.lang, r.source) for r in cut.collect()}
    assert {(1, "", "en", "s"), (2, "", "en", "s"), (5, "one", "en", "s")} <= rows
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(odd.withColumnRenamed("body", "edges"), carry=["edges"])


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reachable(prints, ids, radius=2):
    f = np.array(prints, np.uint64)
    u, v = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= radius)
    root = components.forest(u, v, len(f))
    least: dict = {}
    for i, r in zip(ids, root):
        least[r] = min(least.get(r, HUGE), HUGE if i is None else i)
    return [least[r] for r in root]


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_simhash_equals_brute_force(which, spark, odd):
    df = odd if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    prints = [fingerprint(r.text) for r in rows]
    want = sorted(((str(r.doc_id), f"{p:016x}", c) for r, p, c in zip(rows, prints, reachable(prints, [r.doc_id for r in rows]))), key=str)
    got = sorted(((str(r.doc_id), r.fingerprint, HUGE if r.component_id is None else r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == want


@pytest.mark.parametrize(("shard", "tree", "hot"), [(8, 16, 1_000), (1_024, 16_384, 1_000), (64, 1_000, 2)])
def test_links_of_planted_fingerprints(spark, monkeypatch, shard, tree, hot):
    monkeypatch.setattr(simhash, "SHARD", shard)
    monkeypatch.setattr(simhash, "TREE", tree)  # 16: several trees a shard
    monkeypatch.setattr(simhash, "QUERIES", 50)
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    rng = random.Random(9)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        a, b = rng.sample(range(64), 2)
        prints |= {p ^ (1 << a), p ^ (1 << a) ^ (1 << b)}
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(0, 10) for b in range(40, 50)}  # a group in shared blocks
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(s,) for s in signed], "fp long")
    stars = {r.u: r.v for r in components.components(simhash.link_edges(classes)).collect()}
    u, v = np.nonzero(np.bitwise_count(np.array(prints, np.uint64)[:, None] ^ np.array(prints, np.uint64)[None, :]) <= 2)
    root = components.forest(u, v, len(prints))
    groups: dict = {}
    for i, r in enumerate(root):
        groups.setdefault(r, []).append(signed[i])
    for members in groups.values():
        assert {stars.get(m, m) for m in members} == {min(members)}


def test_bk_tree_follows_the_triangle():
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << 10, 400).astype(np.uint64))
    forest = simhash.BKForest(fps, np.zeros(len(fps), np.int64))
    q, n = forest.within(fps, np.zeros(len(fps), np.int64), 2)
    want = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2)
    assert sorted(zip(q.tolist(), n.tolist())) == sorted(map(tuple, want.tolist()))
    assert simhash.BKForest(np.empty(0, np.uint64), np.empty(0, np.int64)).within(fps, np.zeros(len(fps), np.int64), 2)[0].size == 0


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] * bool(w))


def similar_components(rows):
    """Smallest id of each row's component over pairs of sets with a Jaccard similarity of 0.8."""
    sets = [shingles(t) for _, t in rows]
    u, v = [], []
    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                u.append(i)
                v.append(j)
    root = components.forest(np.array(u, np.int64), np.array(v, np.int64), len(rows))
    least: dict = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, HUGE), HUGE if i is None else i)
    return [least[r] for r in root]


def planted(rng, n):
    """Texts, copies, and near copies of one another by a few changed words, one large family among them."""
    from helpers import words

    rows, at = [], 0
    for _ in range(n):
        base = [f"{w}{rng.randrange(50)}" for w in words(rng, rng.randrange(8, 160)).split()]
        for k in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(k * len(own) // 60):
                own[rng.randrange(len(own))] = f"changed{rng.randrange(9)}"
            rows.append((at, " ".join(own)))
            at += 1
    family = [f"word{i}" for i in range(100)]
    for i in range(60):
        own = list(family)
        own[i] = "other"
        rows.append((at + i, " ".join(own)))
    return rows


@pytest.mark.parametrize(("cell", "hot"), [(1_024, 1_000), (16, 5)])
def test_near_copies_equal_brute_force(spark, odd, monkeypatch, cell, hot):
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(_common, "HOT_ROWS", hot)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = docs + [(10**6 + i, t) for i, t in planted(random.Random(cell), 80)] + [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((str(r.doc_id), HUGE if r.component_id is None else r.component_id) for r in near_copies.near_copies(df).collect()))
    want = sorted((str(i), c) for (i, _), c in zip(rows, similar_components(rows)))
    assert got == want
    assert len({c for _, c in want}) < len(rows) - 100


def test_shards_stay_of_one_size():
    assert [simhash.block_bits(n) for n in (0, 1_024, 1_025, 1_024 << 10, 1 << 50)] == [0, 0, 1, 10, 21]
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 63, 1_000).astype(np.uint64))
    assert len(set((simhash.BKForest(fps, np.zeros(len(fps), np.int64)).edges // 65).tolist())) > 50  # trees have many inner nodes


def test_hot_keys_join_like_others(spark, monkeypatch):
    rows = spark.createDataFrame([(0, i) for i in range(50)] + [(i, i) for i in range(1, 20)], "k long, x long")
    of_key = rows.groupBy("k").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(of_key.drop("n"), "k").collect()))
    for least in (1_000, 10, 1):
        monkeypatch.setattr(_common, "HOT_ROWS", least)
        assert sorted(map(tuple, _common.join_on_hot_keys(rows, of_key, "k").collect())) == want


def test_long_chains_connect(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.u: r.v for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_empty_table(none):
    assert simhash.near_duplicates(none).count() == 0
    assert near_copies.near_copies(none).count() == 0
    assert near_copies.one_of_each(none).count() == 0


def test_queries_have_the_contract_columns(spark):
    cut = llm.op1_suffix_dedup(spark, SF)
    assert {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"} <= set(cut.columns)
    assert cut.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert dict(cut.dtypes)["n_spans"] == "bigint"


def test_messages_do_not_grow_with_blocks_times_shards(spark, monkeypatch):
    """120 times the bytes of a part: parts grow, each block sends one message a part, and the result is exact."""
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", 300)
    monkeypatch.setattr(suffix_dedup, "PARTS", 12, raising=False)
    monkeypatch.setattr(suffix_dedup, "HASH_PARTS", 4, raising=False)
    monkeypatch.setattr(suffix_dedup, "PART_GROWTH", 16, raising=False)
    monkeypatch.setattr(suffix_dedup, "HASH_GROWTH", 64, raising=False)
    rng = random.Random(21)
    stock = [words(rng, 12) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(stock) for _ in range(rng.randrange(1, 5))) + words(rng, 10)) for i in range(160)]
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", sum(len(t) for _, t in rows) // 120)
    written: dict = {}

    def store(df, name):
        out = _common.store(df, name)
        written[name] = out[0].count()
        return out

    monkeypatch.setattr(suffix_dedup, "store", store)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df) == brute(encoded(df))
    assert written["blocks"] > 10
    assert written["bits"] <= 4 * written["blocks"]
    assert written["owners"] <= 13 * written["blocks"]  # parts and what the block knows alone


def test_messages_give_each_shard_its_windows():
    """What a block sends of a part comes out by shard: all its distinct windows, with text, place and owner."""
    rng = random.Random(6)
    bodies = [words(rng, 60).encode() for _ in range(12)]
    ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
    block = suffix_dedup.Block(np.arange(12, 0, -1, dtype=np.int64).tobytes(), ends.tobytes(), suffix_dedup._squeeze(b"".join(bodies)))
    owner: dict = {}
    for doc, body in zip(range(12, 0, -1), bodies):
        for k in range(len(body) - 49):
            owner[body[k : k + 50]] = min(owner.get(body[k : k + 50], HUGE), doc)
    batch = suffix_dedup.Batch(block, None, 3, 5)
    seen: dict = {}
    for p in batch.parts:
        message = suffix_dedup.Message(batch.message(p), 5)
        for s in range(5):
            own = suffix_dedup.Windows([message, message], s)
            assert own.message.tolist() == sorted(own.message.tolist()) and len(own.at) % 2 == 0
            for at, place, who in zip(own.at[: len(own.at) // 2].tolist(), own.places.tolist(), own.owner.tolist()):
                w = own.data[at : at + 50].tobytes()
                assert w == block.raw[place : place + 50] and w not in seen
                seen[w] = who
    assert seen == owner


def test_a_cell_is_searched_from_its_arrow_rows():
    """Rows of one class say separately that it is held and that it asks; links connect what is similar."""
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    sets = {c: np.unique(np.concatenate([base[: 200 - c], rng.integers(0, 1 << 63, c).astype(np.uint64)])) for c in (3, 1, 9, 5)}
    sets[7] = np.unique(rng.integers(0, 1 << 63, 200).astype(np.uint64))
    row = lambda c, node, asks: {"shard": 1, "class": c, "fp": 77, "root": c, "node": node, "asks": asks, "body": sets[c].tobytes()}
    search = near_copies._cell_links(0.8)
    found = search(pa.Table.from_pylist([*(row(c, True, False) for c in (9, 3, 1, 7)), row(9, False, True), row(5, False, True)])).to_pydict()
    root = components.forest(np.array(found["u"]), np.array(found["v"]), 10)
    assert {c for c in sets if root[c] == root[9]} == {1, 3, 5, 9}
    assert search(pa.Table.from_pylist([row(7, True, True)])).num_rows == 0
