"""The durable store, its manifest, files and the control tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from tessella import __main__ as cli
from tessella.operators import ann, cluster, evaluation, merkle
from tessella.operators.store import EVERY, Conflict, Stale, Store
from tessella.streaming import views
from tessella.workspace import file_system, folder

BATCH = "op_ordinal long, key long, value double, tombstone boolean"


def batch(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], BATCH)


def rows(df):
    return sorted((r.key, r.value) for r in df.collect())


@pytest.fixture
def store(spark):
    return Store(spark, folder(spark, "store-test"))


def test_commits_last_and_order_decides(spark, store):
    assert rows(store.scan()) == [] and store.state.next_seq == 1
    assert store.write(batch(spark, (1, 1.0, False), (2, 2.0, False), (1, None, True))) == 3
    assert store.write(batch(spark)) == 0 and store.state.record == 1  # nothing to commit
    again = Store(spark, store.root)
    assert rows(again.scan()) == [(2, 2.0)] and again.state.next_seq == 4
    again.delete(5)
    again.put(1, 9.0)
    assert rows(again.scan()) == [(1, 9.0), (2, 2.0)] and rows(again.scan(at=3)) == [(2, 2.0)]
    assert [(r.key, r.state) for r in again.get([1, 5, 7]).orderBy("key").collect()] == [(1, "hit"), (5, "tombstone"), (7, "miss")]
    assert rows(again.scan(2, 3)) == [(2, 2.0)]


def test_of_two_writers_one_is_stale(spark, store):
    other = Store(spark, store.root)
    store.put(1, 1.0)
    with pytest.raises(Stale):
        other.put(2, 2.0)
    assert len(other.obsolete()) == 2  # the one that is live elsewhere, and the run that no record names
    other.refresh()
    assert len(other.clean()) == 1 and rows(other.scan()) == [(1, 1.0)]


def test_transactions_conflict_on_their_keys(spark, store):
    store.put(1, 1.0)
    at = store.snapshot()
    store.put(1, 2.0)
    with pytest.raises(Conflict):
        store.commit(at, batch(spark, (1, 3.0, False)).withColumn("seq", F.lit(0)))
    assert store.commit(at, batch(spark, (4, 3.0, False)).withColumn("seq", F.lit(0))) == 1


def test_compaction_keeps_reads_and_reports(spark, store):
    seen = []
    store.compacted.append(lambda gone, made: seen.append((len(gone), len(made))))
    for k in range(3):
        store.write(batch(spark, *((i, float(k), k == 2 and i == 0) for i in range(4))))
    before, old = rows(store.scan()), rows(store.scan(at=5))
    store.compact(0)
    assert seen == [(3, 1)] and rows(store.scan()) == before and rows(store.scan(at=5)) == old
    assert [r["level"] for r in store.state.runs.values()] == [1] and store.obsolete() == []
    store.put(0, 7.0)
    store.compact(0, watermark=store.snapshot())  # nothing older than the newest is seen any more
    assert rows(store.scan()) == [(0, 7.0), (1, 2.0), (2, 2.0), (3, 2.0)] and store.log().count() == 4
    assert store.compact(0) == []


def test_a_whole_state_now_and_then(spark, store):
    for k in range(EVERY + 2):
        store.edit(add=[{"name": f"r{k}", "level": 0, "rows": 1, "first_key": k, "last_key": k, "last_seq": k}], graphs={"g": str(k)}, next_seq=k + 2)
    again = Store(spark, store.root)
    assert again.state == store.state and len(again.state.runs) == EVERY + 2 and again.state.graphs == {"g": str(EVERY + 1)}
    fs, at = file_system(spark, f"{store.root}/manifest/{1:012d}.json")
    fs.delete(at, False)  # records before the whole state aren't read
    assert Store(spark, store.root).state == store.state
    assert again.overlapping(3, 5) == ["r3", "r4", "r5"] and len(again.overlapping(None, None)) == EVERY + 2


def test_point_reads_reach_the_files(spark, store):
    store.write(batch(spark, *((i, 0.0, False) for i in range(10))))
    plan = store._logs(store.overlapping(3, 3)).filter(F.col("key").isin([3]))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "key" in plan.split("PushedFilters")[1][:80]


def test_requests_are_checked(spark):
    for bad in ((1, 2, 3, "a", "b"), (16, 0, 3, "a", "b"), (16, 2, 0, "a", "b"), (16, 2, 3, "", "b")):
        with pytest.raises(ValueError):
            merkle.check_digest(*bad)
    merkle.check_digest(16, 2, 3, "a", "b")
    tree = merkle.levels(merkle.leaves(spark.createDataFrame([(1, 1, 0, "n", False)], "key long, wall long, logical long, node string, deleted boolean")))
    with pytest.raises(ValueError):
        merkle.subtree(tree, [1, 2])
    assert merkle.subtree(tree, []).count() == 16
    assert [merkle.fitting_depth(n) for n in (10, 10_000, 20_000, 10**9)] == [1, 1, 2, 5]


def test_pairs_run_once_at_a_time(spark):
    asked = spark.createDataFrame([(0, 1, "a", "b"), (0, 2, "b", "a"), (0, 3, "a", "c"), (0, 4, "c", "d"), (1, 5, "a", "c")], "tick long, seq long, node string, peer string")
    assert sorted(tuple(r) for r in cluster.admitted_triggers(asked, 1).collect()) == [(0, 1, "a", "b"), (1, 5, "a", "c")]
    assert cluster.admitted_triggers(asked, 2).count() == 4
    members = spark.createDataFrame([("a", 2, 0, 10), ("b", 2, 2, 10), ("c", 0, 0, 10), ("d", 2, 0, 95)], "node string, liveness long, ring long, dead_since long")
    assert [r.node for r in cluster.reapable(members, 100, 50).collect()] == ["a"]


def test_snapshots_without_a_success_mark_dont_count(spark):
    root = folder(spark, "snapshots-test")
    graphs = ann.build_graphs(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, vec array<float>"))
    for k in (1, 2):
        ann.snapshot_all({"c": graphs}, root, k)
    fs, at = file_system(spark, f"{root}/c/snapshot-{2:08d}/_SUCCESS")
    fs.delete(at, False)
    assert [p[-1] for p in ann.snapshots(spark, root, "c")] == ["1"]
    assert ann.snapshots(spark, root, "other") == [] and ann.cleanup_snapshots(spark, root, "c") == []


def test_sweeps_report_as_they_go(spark, tmp_path):
    seen = []

    def run(s):
        if s["m"] < 2:
            raise ValueError("m")
        return {"recall": s["m"] / 10}

    found = evaluation.sweep([{"m": 1}, {"m": 2}, {"m": 4}], run, seen.append)
    assert found == seen == [{"m": 2, "recall": 0.2}, {"m": 4, "recall": 0.4}]
    evaluation.write_csv(spark.createDataFrame([(2, 0.2)], "m long, recall double"), f"file://{tmp_path}/csv")
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv"))
    assert text.splitlines() == ["m,recall", "2,0.2000"]
    table = evaluation.text_table(spark.createDataFrame([(1, 0.5), (20, None)], "n long, x double"))
    assert table.splitlines()[0].split() == ["n", "x"] and table.splitlines()[1].split() == ["1", "0.5000"]


def test_rows_stream_as_json(spark):
    lines = list(cli.stream_rows(spark.createDataFrame([(1, "é", [1.5])], "a long, b string, c array<double>")))
    assert [json.loads(x) for x in lines] == [{"a": 1, "b": "é", "c": [1.5]}]


def test_forgotten_members_return_alive_only(spark):
    path = folder(spark, "reaped-test")
    h = lambda n: f"2024-01-01 {n:02d}:00:00"
    reports = [("a", h(0), 2), ("a", h(1), 2), ("a", h(9), 2), ("a", h(10), 0), ("a", h(11), 2), ("b", h(0), 2), ("b", h(2), 0), ("c", h(23), 0)]
    df = spark.createDataFrame(reports, "node string, ts string, liveness int").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(path)
    out = views.drain(views.reaped(views.events_stream(spark, path), 6 * 3600, "1 minute"), "append", "reaped-test")
    assert sorted((r.node, r.reaped_at.hour) for r in out.collect()) == [("a", 6), ("a", 17)]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="checkpoint.dir"):
        folder(Session(), "x")
