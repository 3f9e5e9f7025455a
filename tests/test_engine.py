"""Golden cases and properties of the engine's operators."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessella.functions import codecs
from tessella.functions import distance as D
from tessella.functions import metrics
from tessella.operators import ann, catalog, compaction, evaluation, hlc, merkle, prefix, replication, ring, vectors, versions, workload, writes
from tessella.plans import queries
from tessella.plans import tables as t
from tessella.sources import log_files, vectors_file

LOG = "key long, seq long, value string, tombstone boolean"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def as_set(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_newest_wins_and_tombstones_hide(spark):
    df = log(spark, (1, 1, "a", False), (1, 3, "b", False), (1, 5, "", True), (2, 2, "", False))
    assert as_set(versions.scan(df, 4), "key", "value") == {(1, "b"), (2, "")}
    assert as_set(versions.scan(df, 9), "key", "value") == {(2, "")}
    assert as_set(versions.newest(df, 9), "key", "tombstone") == {(1, True), (2, False)}
    assert versions.scan(df, 0).count() == 0


def test_point_states(spark):
    df = log(spark, (1, 1, "a", False), (2, 2, "", True))
    keys = spark.createDataFrame([(1,), (2,), (3,)], "key long")
    assert as_set(versions.point_states(df, keys, 5), "key", "state", "value") == {(1, "hit", "a"), (2, "tombstone", None), (3, "miss", None)}


def test_prefix_successors():
    assert codecs.prefix_successor(b"ab") == b"ac"
    assert codecs.prefix_successor(b"a\xff") == b"b"
    assert codecs.prefix_successor(b"\xff\xff") is None
    assert codecs.prefix_successor(b"") is None
    assert versions.text_successor("ab") == "ac"
    assert versions.text_successor("") is None


def test_batch_order_decides(spark):
    base = log(spark, (1, 1, "old", False))
    ops = spark.createDataFrame([(1, 1, "new", False), (2, 1, "", True), (3, 2, "", True), (4, 2, "back", False)], "op_ordinal long, key long, value string, tombstone boolean")
    after = writes.apply_batch(base, ops, 10)
    assert as_set(versions.scan(after), "key", "value") == {(2, "back")}
    assert sorted(r.seq for r in after.filter("seq > 1").collect()) == [11, 12, 13, 14]


def test_transaction_sees_its_own_writes(spark):
    base = log(spark, (1, 1, "db-a", False), (3, 2, "db-c", False))
    own = log(spark, (2, 1, "tx-b", False), (3, 2, "", True))
    seen = as_set(writes.overlay(base, 5, own), "key", "value", "tombstone", "own_write")
    assert seen == {(1, "db-a", False, False), (2, "tx-b", False, True), (3, "", True, True)}


def test_conflicts_are_write_write(spark):
    base = log(spark, (1, 1, "a", False), (1, 7, "b", False), (2, 2, "c", False))
    mine = spark.createDataFrame([(1, 1, "x", False)], "op_ordinal long, key long, value string, tombstone boolean")
    assert writes.commit(base, 5, mine, 7) is None
    assert writes.commit(base, 7, mine, 7).count() == 1


@pytest.mark.parametrize("mark", [0, 4, 9])
def test_collection_keeps_reads_from_the_watermark_on(spark, mark):
    rng = random.Random(mark)
    df = log(spark, *[(rng.randrange(6), s, f"v{s}", rng.random() < 0.3) for s in range(1, 16)])
    for bottom in (False, True):
        kept = compaction.collect_versions(df, mark, bottom)
        for at in range(mark, 17, 3):
            assert as_set(versions.scan(df, at), "key", "seq", "value") == as_set(versions.scan(kept, at), "key", "seq", "value")


def test_merge_prefers_the_first_run(spark):
    a, b = log(spark, (1, 1, "first", False)), log(spark, (1, 1, "second", False), (2, 2, "x", False))
    assert as_set(compaction.merge_runs([a, b]), "key", "value") == {(1, "first"), (2, "x")}


def test_overlaps_include_both_ends(spark):
    f = lambda *rows: spark.createDataFrame(list(rows), "file long, first_key long, last_key long")
    got = compaction.overlapping(f((1, 0, 10), (2, 11, 20)), f((7, 10, 11), (8, 21, 30), (9, 0, 500)), 7)
    assert as_set(got, "file_a", "file_b") == {(1, 7), (2, 7), (1, 9), (2, 9)}


def test_clock_steps():
    assert hlc.step((10, 3), 12, None) == ((12, 0), True)
    assert hlc.step((10, 3), 10, None) == ((10, 4), True)
    assert hlc.step((10, 3), 8, None) == ((10, 4), True)
    assert hlc.step((10, 3), 9, (10, 7)) == ((10, 8), True)
    assert hlc.step((10, 3), 9, (12, 7)) == ((12, 8), True)
    assert hlc.step((10, 3), 20, (12, 7)) == ((20, 0), True)
    assert hlc.step((10, 3), 0, (hlc.MAX_DRIFT_NS + 1, 0)) == ((10, 3), False)


def test_receive_folds_like_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(3)}", i, 10**18 + rng.randrange(1, 10**11), None if rng.random() < 0.3 else 10**18 + rng.randrange(1, 2 * 10**11), 0) for i in range(200)]
    rows = [(*r[:4], None if r[3] is None else rng.randrange(5)) for r in rows]
    got = {r.i: (r.wall, r.logical, r.accepted) for r in hlc.receive(spark.createDataFrame(rows, "node string, i long, physical long, remote_wall long, remote_logical long")).collect()}
    state: dict = {}
    for n, i, p, w, c in rows:
        state[n], ok = hlc.step(state.get(n, (0, 0)), p, None if w is None else (w, c))
        assert got[i] == (*state[n], ok)


COPY = "replica string, key long, value string, deleted boolean, wall long, logical long, node string"


def test_last_writer_and_repair(spark):
    rows = spark.createDataFrame([("a", 1, "x", False, 5, 0, "n1"), ("b", 1, "y", False, 5, 0, "n2"), ("b", 2, "", True, 1, 0, "n1")], COPY)
    names = ["a", "b", "c"]
    assert as_set(replication.last_writer(rows), "key", "value") == {(1, "y"), (2, "")}
    assert as_set(replication.repair_targets(rows, names), "key", "replica", "reason") == {(1, "a", "stale"), (1, "c", "missing"), (2, "a", "missing"), (2, "c", "missing")}
    healed = rows.unionByName(replication.repair_rows(rows, names))
    newest = healed.groupBy("replica", "key").agg(F.max_by(F.struct("value", "wall", "node"), F.struct("wall", "logical", "node")).alias("w"))
    assert newest.select("key", "w").distinct().count() == 2


def test_quorum_reads_the_first_replicas(spark):
    rows = spark.createDataFrame([("a", 1, "old", False, 1, 0, "n"), ("c", 1, "new", False, 9, 0, "n")], COPY)
    keys = spark.createDataFrame([(1,), (2,)], "key long")
    assert as_set(replication.quorum_read(rows, keys, ["a", "b", "c"], 2), "key", "state", "value") == {(1, "hit", "old"), (2, "miss", None)}
    assert as_set(replication.quorum_read(rows, keys, ["a", "b", "c"], 3), "key", "value") == {(1, "new"), (2, None)}


def test_gossip(spark):
    s = spark.createDataFrame([("x", "a", 2, 1), ("x", "a", 1, 1), ("x", "a", 0, 0), ("me", "b", 2, 4)], "node string, addr string, liveness int, incarnation long")
    assert as_set(replication.gossip(s, "me"), "node", "incarnation", "liveness") == {("x", 1, 2), ("me", 5, 0)}


def test_readable_members(spark):
    m = spark.createDataFrame([("a", 0, 2), ("b", 1, 2), ("c", 2, 2), ("d", 0, 1), ("e", 0, 0)], "node string, liveness int, ring int")
    assert as_set(replication.readable(m), "node") == {("a",), ("b",), ("e",)}


def test_ring_moves_little_and_restores(spark):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("key"))
    nodes = [f"n{i}" for i in range(4)]
    gone = ring.moved(keys, nodes, nodes[:3], 1)
    assert 0.15 < gone.count() / 4000 < 0.35
    assert {r.owners_before[0] for r in gone.collect()} == {"n3"}
    owned = ring.owner_rows(keys, nodes, 3).groupBy("key").agg(F.count_distinct("node").alias("n"))
    assert owned.filter("n != 3").count() == 0
    assert ring.owner_rows(keys, nodes[:2], 3).groupBy("key").count().filter("count != 2").count() == 0


def test_merkle_finds_exactly_what_differs(spark):
    a = spark.createDataFrame([("a", k, f"v{k}", False, 10 + k, 0, "n") for k in range(50)], COPY)
    b = a.filter("key != 7").withColumn("wall", F.when(F.col("key") == 9, 99).otherwise(F.col("wall")).cast("long"))
    assert as_set(merkle.plan(a, b), "key", "action") == {(7, "push"), (9, "pull")}
    assert merkle.divergent(merkle.leaves(a), merkle.leaves(a)).count() == 0
    shuffled = a.repartition(7).orderBy(F.rand(3))
    assert as_set(merkle.levels(merkle.leaves(a)), "*") == as_set(merkle.levels(merkle.leaves(shuffled)), "*")
    assert merkle.levels(merkle.leaves(a)).count() == 256 + 16 + 1
    # swapping the clocks of two keys shows, unlike with separate XORs
    swapped = a.withColumn("wall", F.when(F.col("key") == 1, 12).when(F.col("key") == 2, 11).otherwise(F.col("wall")).cast("long"))
    assert merkle.divergent(merkle.leaves(a, fanout=1), merkle.leaves(swapped, fanout=1)).count() == 1


def test_knn_goldens(spark):
    pts = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate([(1, 0), (0, 2), (3, 0), (0, 0.5), (-1, -1)])], "id long, vec array<float>")
    assert [r.id for r in vectors.knn(pts, [0.0, 0.0], 3).collect()] == [3, 0, 4]
    assert vectors.knn(pts, [0.0, 0.0], 9).count() == 5
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, vec array<float>")
    for metric in (D.L2, D.COSINE, D.INNER):
        one = [(r.id, r.distance) for r in vectors.knn(pts, [0.5, 1.0], 5, metric).collect()]
        many = [(r.id, r.distance) for r in vectors.knn_batch(pts, spark.createDataFrame([(0, [0.5, 1.0])], "qid long, vec array<float>"), 5, metric).orderBy("rank").collect()]
        assert one == many
    # a vector without length is at cosine distance 0 of everything
    assert {r.distance for r in vectors.knn_batch(pts, q, 5, D.COSINE).collect()} == {0.0}
    with pytest.raises(ValueError):
        D.by_metric(9)


def test_vectors_follow_versions(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 1, 0, False), (1, [5.0, 0.0], 2, 0, False), (2, [0.0, 1.0], 1, 0, False), (2, [0.0, 1.0], 3, 0, True), (3, [9.0, 9.0], 1, 0, False)], "id long, vec array<float>, wall long, logical long, deleted boolean")
    index = rows.filter("wall = 1").select("id", "vec")
    assert [r.id for r in vectors.search_verified(index, rows, [0.0, 0.0], 2, ef=3).collect()] == [1, 3]
    assert as_set(vectors.get_latest(rows, spark.createDataFrame([(1,), (2,), (8,)], "id long")), "id", "found", "deleted") == {(1, True, False), (2, True, True), (8, False, False)}
    with pytest.raises(Exception, match="components wanted"):
        vectors.check_dimension(rows, 3).collect()


def test_recall_goldens(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "qid long, neighbors array<long>")
    truth = rows((1, list(range(10))), (2, [1, 2, 3]), (3, [1]))
    got = {r.qid: r.recall for r in evaluation.recall(truth, rows((1, [0, 1, 2, 3, 4, 5, 6, 90, 91, 92]), (2, [1, 2, 9, 8, 7]), (3, [5])), 10).collect()}
    assert got == {1: 0.7, 2: 2 / 3, 3: 0.0}
    assert {r.recall for r in evaluation.recall(truth, truth, 0).collect()} == {0.0}


def test_graph_search_recall():
    rng = np.random.default_rng(0)
    base, qs = rng.normal(size=(1500, 24)), rng.normal(size=(30, 24))
    g = ann.Graph(24)
    g.add(list(range(1500)), base)
    truth = D.matrix(D.L2, qs, base).argsort(1)[:, :10]
    found = [[i for _, i in g.search(q, 10, 200)] for q in qs]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth, found)]) >= 0.95
    g.remove(set(truth[0].tolist()))
    assert not set(truth[0].tolist()) & {i for _, i in g.search(qs[0], 10, 200)}
    assert ann.Graph(4).search(np.zeros(4), 3, 10) == []
    with pytest.raises(ValueError):
        ann.Graph(0)


def test_ann_queries_find_most(spark, sf):
    v = t.vectors(spark, sf)
    asked = v.filter("id < 20").select(F.col("id").alias("qid"), "vec")
    truth = evaluation.neighbors(vectors.knn_batch(v, asked, 10))
    for found, least in ((ann.hnsw_search(v, asked, 10), 0.95), (ann.ivf_search(v, asked, 10, 16, 12), 0.9)):
        assert evaluation.recall(truth, evaluation.neighbors(found), 10).agg(F.avg("recall")).first()[0] >= least


def test_ann_queries_ask_a_fiftieth_of_all_rows(spark, sf, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BYTES", 4096)  # several blocks
    ids = {r.id for r in t.vectors(spark, sf).filter("id % 50 = 0").collect()}
    assert max(ids) >= 20
    for name in ("ann_ivf_search", "ann_hnsw_search", "ann_graph_snapshot"):
        rows = queries.QUERIES[name](spark, sf).collect()
        assert {r.qid for r in rows} == ids and len({(r.qid, r.rank) for r in rows}) == len(rows) == 10 * len(ids)
    assert {r.queries for r in queries.QUERIES["sweep_table"](spark, sf).collect()} == {len(ids)}


def test_vector_files(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 0.5, -1.0]) for i in range(100)], "id long, vec array<float>")
    vectors_file.write_vectors(df, str(tmp_path / "a.fvecs"))
    spark.dataSource.register(vectors_file.VectorsFile)
    back = spark.read.format("vecs").load(str(tmp_path / "a.fvecs"))
    assert as_set(back.select("id", F.col("vec")[0]), "*") == {(i, float(i)) for i in range(100)}
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "a.fvecs").glob("part-*")))
    assert len(raw) == 100 * 16 and not list((tmp_path / "a.fvecs").glob(".part-*"))
    for bad in (raw[:3], raw[:-1], b"\0\0\0\0" + raw[4:]):
        (tmp_path / "b.fvecs").write_bytes(bad)
        with pytest.raises(Exception, match="small|whole|dimension"):
            spark.read.format("vecs").load(str(tmp_path / "b.fvecs")).count()


def test_log_recovery_stops_at_the_first_bad_line(spark):
    rows = spark.createDataFrame([(f, p, p, p, float(p), False) for f in (1, 2) for p in range(5)], "file long, pos long, key long, seq long, value double, tombstone boolean")
    lines = log_files.encode_lines(rows)
    torn = lines.withColumn("line", F.when((F.col("file") == 1) & (F.col("pos") == 2), F.lit("12\tx")).otherwise(F.col("line")))
    assert as_set(log_files.recover(torn), "file", "pos") == {(1, 0), (1, 1)} | {(2, p) for p in range(5)}


def test_codecs_round_trip():
    for key, seq in ((b"", 0), (b"a\xff", 7), (b"k", codecs.MAX_SEQ)):
        assert codecs.decode_internal_key(codecs.encode_internal_key(key, seq)) == (key, seq)
    assert codecs.encode_internal_key(b"a", 9) < codecs.encode_internal_key(b"a", 8) < codecs.encode_internal_key(b"b", 9)
    clock = (5, 2, "node-é")
    assert codecs.decode_envelope(codecs.encode_envelope(clock, False, b"v")) == (clock, False, b"v")
    assert codecs.decode_envelope(codecs.encode_envelope(clock, True, b"v")) == (clock, True, b"")
    assert codecs.decode_collection(codecs.encode_collection(4, 1, 16, 200, 50, 9)) == (4, 1, 16, 200, 50, 9)
    meta = {"s": "x", "i": -3, "f": 0.5, "b": True, "raw": b"\0\1"}
    assert codecs.decode_vector(codecs.encode_vector([1.0, -2.5], meta, 8, 1)) == ([1.0, -2.5], meta, 8, 1)
    for bad in (b"", codecs.encode_vector([1.0], meta)[:-1], b"\x09" + codecs.encode_vector([1.0], {})[1:]):
        with pytest.raises(ValueError):
            codecs.decode_vector(bad)
    with pytest.raises(ValueError):
        codecs.decode_envelope(b"\x02\x00")
    with pytest.raises(ValueError):
        codecs.encode_vector([1.0], {"x": None})


def test_records_byte_for_byte():
    """Records worked out by hand from their layouts."""
    assert codecs.encode_collection(4, 1, 16, 200, 50, 9).hex() == "01" "0400" "01" "1000" "c800" "3200" "0900000000000000"
    record = codecs.encode_vector([1.0, -2.5], {"b": True, "a": "xy", "n": 7, "d": 0.5, "r": b"\x01"}, 8, 1)
    assert record.hex() == (
        "02" "0000000000000008" "00000001" "0200" "0000803f" "000020c0" "0500"
        "0100" "61" "01" "0200" "7879" "0100" "62" "04" "0100" "01" "0100" "64" "03" "0800" "000000000000e03f" "0100" "6e" "02" "0800" "0700000000000000" "0100" "72" "05" "0100" "01"
    )
    assert codecs.decode_vector(bytes.fromhex("01" "0100" "0000803f" "0000")) == ([1.0], {}, 0, 0)  # the first version has no clock
    assert codecs.encode_clock(5, 2, "ab").hex() == "0000000000000005" "00000002" "0002" "6162"
    assert codecs.encode_internal_key(b"k", 1).hex() == "6b" "fffffffffffffffe"
    assert codecs.vector_key("ab").hex() == "02" "0200" "6162" "00"
    assert codecs.vector_key("ab", bytes(16)).hex() == "02" "0200" "6162" "01" + "00" * 16
    assert [k.hex() for k in codecs.vector_key_bounds("ab")] == ["020200616201", "020200616202"]
    assert codecs.read_vector_key(codecs.vector_key("é", bytes(range(16)))) == ("é", bytes(range(16))) and codecs.read_vector_key(codecs.vector_key("x")) == ("x", None)
    assert codecs.hint_key("n1", 3, 4, b"k").hex() == "0002" "6e31" "0000000000000003" "00000004" "6b"
    assert codecs.read_hint_key(codecs.hint_key("n1", 3, 4, b"k")) == ("n1", 3, 4, b"k")
    assert codecs.read_hint_value(b"\xf1ab") == ("vector_write", b"ab") and codecs.read_hint_value(b"\x01ab") == ("write", b"\x01ab") and codecs.read_hint_value(b"") == ("write", b"")
    for bad in (lambda: codecs.encode_vector([1.0], {"a": "x" * 65_536}), lambda: codecs.read_vector_key(b"\x02\x09\x00a"), lambda: codecs.read_hint_key(b"\x00\x09a"), lambda: codecs.decode_collection(b"\x02" + bytes(17)), lambda: codecs.vector_key("a", b"short")):
        with pytest.raises(ValueError):
            bad()


def test_null_groups_stay(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, x long")
    got = prefix.running(rows, ["g"], ["x"], s=("sum", F.col("x"))).collect()
    assert sorted((str(r.g), r.x, r.s) for r in got) == [("None", 2, 2), ("None", 3, 5), ("a", 1, 1)]
    assert {r.g: r.p50 for r in evaluation.nearest_rank(rows, ["g"], "x", [0.5]).collect()} == {"a": 1, None: 3}
    hints = spark.createDataFrame([(None, 1, 0, "n", 1, 5, False), ("t", 1, 0, "n", 1, 5, False), (None, 2, 0, "n", 2, 9, False)], "target string, wall long, logical long, node string, key long, size long, tombstone boolean")
    assert replication.within_capacity(hints, 10).count() == 3 and replication.hint_batches(hints).count() == 3


def test_searches_over_nothing(spark):
    none = spark.createDataFrame([], "id long, vec array<float>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<float>")
    asked = some.withColumnRenamed("id", "qid")
    assert ann.ivf_search(none, asked, 3).count() == 0 and ann.ivf_search(some, asked.limit(0), 3).count() == 0
    assert vectors.knn_batch(none, asked, 3).count() == 0 and ann.hnsw_search(some, asked, 3).count() == 1


def test_search_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(300)], "id long, vec array<float>")  # many ties
    asked = base.filter("id % 7 = 0").withColumnRenamed("id", "qid")
    for metric in (D.L2, D.COSINE, D.INNER):
        whole = vectors.knn_batch(base, asked, 5, metric).orderBy("qid", "rank").collect()
        monkeypatch.setattr(vectors, "MATRIX_BYTES", 8 * vectors.ROWS * 4)
        monkeypatch.setattr(vectors, "ROWS", 16)
        assert vectors.knn_batch(base, asked, 5, metric).orderBy("qid", "rank").collect() == whole
        monkeypatch.undo()


def test_graph_limits():
    g = ann.Graph(2, m=4, max_bytes=4 * g_bytes(2, 4))
    g.add([1, 2], np.zeros((2, 2)))
    for ids in ([2], [3, 3]):
        with pytest.raises(ValueError):
            g.add(ids, np.zeros((len(ids), 2)))
    with pytest.raises(ValueError):
        g.add([9], np.zeros((1, 3)))
    with pytest.raises(MemoryError):
        g.add(list(range(10, 40)), np.zeros((30, 2)))
    assert g.ids == [1, 2] and g.stats()["bytes"] == g.bytes > 0


def g_bytes(dim, m):
    return 4 * dim + 8 * m * 4 + 64


def test_tombstones_lead_on_without_widening_the_beam():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8))
    g = ann.Graph(8, m=8, ef_construct=60)
    g.add(list(range(600)), x)
    g.remove(set(range(0, 600, 2)))
    hits = 0
    for q in x[:40]:
        want = [i for i in np.argsort(((x - q) ** 2).sum(1)) if i % 2][:5]
        got = [i for _, i in g.search(q, 5, 60)]
        assert all(i % 2 for i in got) and len(got) == 5
        hits += len(set(got) & set(want))
    assert hits / 200 >= 0.95


def test_percentile_rules(spark):
    df = spark.createDataFrame([("g", float(x)) for x in (5, 1, 4, 2, 3, 3)], "g string, x double")
    floor = evaluation.nearest_rank(df, ["g"], "x", [0.0, 0.5, 0.99]).first()
    linear = evaluation.nearest_rank(df, ["g"], "x", [0.5, 1.0], "linear").first()
    assert (floor.p0, floor.p50, floor.p99, linear.p50, linear.p100) == (1.0, 3.0, 5.0, 3.0, 5.0)


def test_workload_mixes(spark):
    ops = workload.operations(spark, 20000, 100, "B", 1.3)
    assert 0.94 < ops.filter("op = 'get'").count() / 20000 < 0.96
    top = ops.groupBy("key").count().orderBy(F.desc("count")).first()
    assert top.key == "key-" + "0" * 16 and top["count"] > 2000
    assert workload.operations(spark, 100, 10, "C").filter("op != 'get'").count() == 0


def test_catalog_and_ring_checks(spark):
    now = catalog.create_collection(spark.createDataFrame([], catalog.COLLECTION), "a", 4, D.L2)
    assert catalog.collection(now, "a").dim == 4 and catalog.collection(now, "b") is None
    with pytest.raises(catalog.Exists):
        catalog.create_collection(now, "a", 4, D.L2)
    for bad in ({"dim": 0, "metric": 1}, {"dim": 4, "metric": 9}, {"dim": 4, "metric": 1, "m": 1}):
        with pytest.raises(ValueError):
            catalog.create_collection(now, "c", **bad)
    r = spark.createDataFrame([(4, "x", "ax", replication.ACTIVE)], catalog.RING)
    for expected, node, action in ((3, "y", "join"), (4, "x", "join"), (4, "y", "activate"), (4, "x", "remove"), (4, "y", "remove")):
        with pytest.raises(catalog.Conflict):
            catalog.change_ring(r, expected, node, action)
    r = catalog.change_ring(catalog.change_ring(r, 4, "y", "join", "ay"), 5, "y", "activate")
    assert as_set(catalog.change_ring(r, 6, "x", "remove"), "version", "node", "ring") == {(7, "y", replication.ACTIVE)}
    assert catalog.retransmit_limit(1) == 4 and catalog.retransmit_limit(9) == 16
    assert catalog.show_bytes(1536) == "1.5 KB" and catalog.graph_bytes(1000, 128) > 512_000


def test_saved_graphs():
    rng = np.random.default_rng(2)
    g = ann.Graph(8)
    g.add(list(range(300)), rng.normal(size=(300, 8)))
    back = ann.Graph.load(g.rows())
    q = rng.normal(size=8)
    assert back.search(q, 5, 50) == g.search(q, 5, 50)
    g.remove({0, 1})
    assert g.stats()["deleted"] == 2 and g.cleanup().stats() == {**g.cleanup().stats(), "live": 298, "deleted": 0}
    with pytest.raises(ValueError):
        ann.Graph.load(g.rows()[1:])


def test_empty_keys_are_refused(spark):
    rows = spark.createDataFrame([("a", 1), ("", 2)], "key string, seq long")
    assert versions.check_keys(rows.filter("seq = 1")).count() == 1
    with pytest.raises(Exception, match="empty key"):
        versions.check_keys(rows).collect()


def test_metrics_come_with_the_write(spark):
    df, seen = metrics.states(spark.createDataFrame([("hit",), ("miss",), ("hit",)], "state string"))
    df.collect()
    assert seen.get == {"rows": 3, "hit": 2, "tombstone": 0, "miss": 1}


def test_command_line_lists_queries(capsys):
    from tessella.__main__ import main

    main([])
    assert "snapshot_scan" in capsys.readouterr().out


def test_running_values_cross_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(4)}", i, rng.randrange(-5, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i long, x long")
    got = {r.i: (r.s, r.m) for r in prefix.running(df, ["g"], ["i"], s=("sum", F.col("x")), m=("max", F.col("x"))).collect()}
    total: dict = {}
    most: dict = {}
    for g, i, x in rows:
        total[g] = total.get(g, 0) + x
        most[g] = max(most.get(g, x), x)
        assert got[i] == (total[g], most[g])
    assert prefix.running(df.limit(0), ["g"], ["i"], s=("sum", F.col("x"))).count() == 0
