"""Queries over the durable store, its files and codecs, and the saved and rebuilt vector indexes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import codecs
from ..operators import ann, evaluation, vectors, versions, writes
from ..operators.catalog import graph_bytes, retransmit_limit, show_bytes
from ..operators.store import Store
from ..sources import log_files, vectors_file
from ..workspace import folder, written
from . import tables as t
from .queries import BATCHED, BUFFER, NINE, PROBE, _asked, _l2_sql, _probe, query

# ---- the durable store ----------------------------------------------------------------------------


def _ops(spark, d, parts: int, k: int) -> DataFrame:
    """The k-th of some batches of events in order, as operations on the store."""
    e = t.table(spark, d, "events")
    return e.filter(F.floor(F.col("event_id") * parts / F.lit(t.last_event(spark, d) + 1)) == k).select(F.col("event_id").alias("op_ordinal"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("tombstone"))


def _filled(spark, d, parts: int = 3) -> Store:
    store = Store(spark, folder(spark, "store"))
    for k in range(parts):
        store.write(_ops(spark, d, parts, k))
    return store


#: The events in the order of their ids have the sequences 1, 2, ..
SEQ = "slog AS (SELECT user_id AS key, row_number() OVER (ORDER BY event_id) AS seq, value, event_type = 'error' AS tombstone FROM events)"


@query("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM slog GROUP BY key HAVING NOT arg_max(tombstone, seq)", SEQ)
def append_commit(spark, d):
    """Three batches committed one after the other, read by a store that is opened anew."""
    return Store(spark, _filled(spark, d).root).scan()


@query("SELECT key, seq, value, tombstone FROM slog", SEQ)
def compact_commit(spark, d):
    """All versions after level 0 was merged into one run of level 1."""
    store = _filled(spark, d)
    store.compact(0)
    return Store(spark, store.root).log()


@query("SELECT 1::BIGINT AS level, count(*) AS rows, min(key) AS first_key, max(key) AS last_key, max(seq) AS last_seq, 4::BIGINT AS records, 0::BIGINT AS obsolete FROM slog", SEQ)
def manifest_edit(spark, d):
    """The live runs of the manifest after three commits and a compaction, whose old runs are gone."""
    store = _filled(spark, d)
    store.compact(0)
    again = Store(spark, store.root)
    rows = [(r["level"], r["rows"], r["first_key"], r["last_key"], r["last_seq"], again.state.record, len(again.obsolete())) for r in again.state.runs.values()]
    return spark.createDataFrame(rows, "level long, rows long, first_key long, last_key long, last_seq long, records long, obsolete long")


RUNS = "runs AS (SELECT user_id * 4 // (SELECT max(user_id) + 1 FROM events) AS run, min(user_id) AS a, max(user_id) AS b FROM events GROUP BY 1), asked AS (SELECT unnest([0, 1, 2, 3]) * (SELECT max(user_id) FROM events) // 3 AS key)"


@query(
    "SELECT key, CASE WHEN tombstone IS NULL THEN 'miss' WHEN tombstone THEN 'tombstone' ELSE 'hit' END AS state, CASE WHEN NOT tombstone THEN value END AS value, (SELECT count(*) FROM runs WHERE a <= key AND key <= b) AS runs FROM asked LEFT JOIN (SELECT key, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM log GROUP BY key) USING (key)",
    t.LOG, RUNS,
)
def point_get_pruned(spark, d):
    """Point reads from a store of four runs by key range: each opens only runs that may hold its key."""
    store, e = Store(spark, folder(spark, "store")), t.table(spark, d, "events")
    last = e.agg(F.max("user_id")).first()[0]
    for k in range(4):
        part = e.filter(F.floor(F.col("user_id") * 4 / F.lit(last + 1)) == k)
        store.write(part.select(F.col("event_id").alias("op_ordinal"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("tombstone")))
    keys = [i * last // 3 for i in range(4)]
    runs = spark.createDataFrame([(k, len(store.overlapping(k, k))) for k in keys], "key long, runs long")
    return store.get(keys).join(runs, "key").select("key", "state", "value", "runs")


@query("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM slog WHERE key >= 100 AND key < 900 GROUP BY key HAVING NOT arg_max(tombstone, seq)", SEQ)
def range_get_pruned(spark, d):
    return _filled(spark, d).scan(100, 900)


@query("SELECT max(seq) + 3 AS next_seq, 5::BIGINT AS runs, 'hit' AS put_state, 'tombstone' AS delete_state, 2.5::DOUBLE AS put_value FROM slog", SEQ)
def put_delete(spark, d):
    """One key written and one deleted after the batches; the store is opened again in between."""
    root = _filled(spark, d).root
    Store(spark, root).put(-1, 2.5)
    Store(spark, root).delete(-2)
    store = Store(spark, root)
    state = {r.key: r for r in store.get([-1, -2]).collect()}
    return spark.createDataFrame([(store.state.next_seq, len(store.state.runs), state[-1].state, state[-2].state, state[-1].value)], "next_seq long, runs long, put_state string, delete_state string, put_value double")


@query(
    "SELECT key, CASE WHEN o.tombstone IS NOT NULL THEN CASE WHEN o.tombstone THEN 'tombstone' ELSE 'hit' END WHEN s.tombstone IS NULL THEN 'miss' WHEN s.tombstone THEN 'tombstone' ELSE 'hit' END AS state, "
    "CASE WHEN o.tombstone IS NOT NULL THEN CASE WHEN NOT o.tombstone THEN o.value END WHEN NOT s.tombstone THEN s.value END AS value, o.tombstone IS NOT NULL AS own_write FROM asked "
    f"LEFT JOIN (SELECT key, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM buffer GROUP BY key) o USING (key) LEFT JOIN (SELECT key, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM log WHERE seq <= {NINE} GROUP BY key) s USING (key)",
    t.LOG, BUFFER, "asked AS (SELECT range AS key FROM range(0, (SELECT 2 * max(user_id) FROM events), 5))",
)
def tx_point_get(spark, d):
    """Point reads inside a transaction: its own writes first, then the snapshot."""
    log, last = t.version_log(spark, d), t.last_event(spark, d)
    at = last * 9 // 10
    buffer = log.filter((F.col("seq") > at) & (F.col("seq") <= at + last // 100))
    users = t.table(spark, d, "events").agg(F.max("user_id")).first()[0]
    return writes.point_get(log, at, buffer, spark.range(0, 2 * users, 5).withColumnRenamed("id", "key"))


@query(f"SELECT count(*) AS rows, (SELECT max(event_id) FROM events) + 1 AS first_seq, (SELECT max(event_id) FROM events) + count(*) AS last_seq, true AS later_conflicts FROM buffer", t.LOG, BUFFER)
def tx_commit(spark, d):
    """A transaction on unwritten keys commits; the same keys written after its snapshot are a conflict."""
    log, last = t.version_log(spark, d), t.last_event(spark, d)
    at = last * 9 // 10
    buffer = log.filter((F.col("seq") > at) & (F.col("seq") <= at + last // 100)).select((F.col("key") + 10**9).alias("key"), "value", "tombstone", F.col("seq").alias("op_ordinal"), "seq")
    rows = writes.commit(log, last, buffer.select("op_ordinal", "key", "value", "tombstone", "seq"), last)
    again = writes.commit(log.unionByName(rows), at, buffer.select("op_ordinal", "key", "value", "tombstone", "seq"), last)
    return rows.agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).withColumn("later_conflicts", F.lit(again is None))


@query("SELECT file, pos, key, seq, value, tombstone FROM (SELECT event_id * 5 // (SELECT max(event_id) + 1 FROM events) AS file, event_id AS pos, user_id AS key, event_id AS seq, value, event_type = 'error' AS tombstone FROM events) WHERE file >= 2")
def wal_segments(spark, d):
    """A log in five segments, the flushed ones dropped, the rest replayed."""
    path, last = folder(spark, "wal"), t.last_event(spark, d)
    log = t.version_log(spark, d).select(F.floor(F.col("seq") * 5 / F.lit(last + 1)).alias("file"), F.col("seq").alias("pos"), "key", "seq", "value", "tombstone")
    log_files.write_segments(log, path)
    log_files.drop_segments(spark, path, 2)
    return log_files.recover(log_files.read_segments(spark, path))


# ---- codecs ---------------------------------------------------------------------------------------


@query(
    "SELECT id, 1 + 12 + 2 + 4 * len(vec) + 2 + (2 + 5 + 1 + 2 + 8) + (2 + 4 + 1 + 2 + length('v' || id)) AS n_bytes, wall, logical, label, 'v' || id AS name, round(vec[1]::DOUBLE, 6) AS first FROM (SELECT id, vec, label, id % 97 AS wall, id % 7 AS logical FROM vecs)",
    t.VECTORS,
)
def vector_codec(spark, d):
    """Vectors with metadata through their binary records and back."""

    def there_and_back(frames):
        for f in frames:
            out = []
            for id, vec, label in zip(f["id"], f["vec"], f["label"]):
                record = codecs.encode_vector([float(x) for x in vec], {"label": int(label), "name": f"v{id}"}, int(id % 97), int(id % 7))
                back, meta, wall, logical = codecs.decode_vector(record)
                out.append((id, len(record), wall, logical, meta["label"], meta["name"], back[0]))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "wall", "logical", "label", "name", "first"])

    rows = t.vectors(spark, d).select("id", "vec", "label").mapInPandas(there_and_back, "id long, n_bytes long, wall long, logical long, label long, name string, first double")
    return rows.withColumn("first", F.round("first", 6))


@query("SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rank FROM log", t.LOG)
def internal_keys(spark, d):
    """Versions ranked by the bytes of their internal keys, which sort newest first in a key."""
    from pyspark.sql import Window

    def encode(frames):
        for f in frames:
            yield f.assign(raw=[codecs.encode_internal_key(int(k).to_bytes(8, "big"), int(s)) for k, s in zip(f["key"], f["seq"])])

    raw = t.version_log(spark, d).select("key", "seq").mapInPandas(encode, "key long, seq long, raw binary")
    return raw.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("raw")).cast("long")).drop("raw")


@query("SELECT target, key, wall, logical, 2 + length(target) + 12 + 8 AS n_bytes, CASE WHEN key % 3 = 0 THEN 'vector_write' WHEN key % 3 = 1 THEN 'vector_delete' ELSE 'write' END AS kind FROM hints", t.HINTS)
def hint_codec(spark, d):
    """Hints through their keys and typed values and back."""

    def there_and_back(frames):
        for f in frames:
            out = []
            for target, wall, logical, key in zip(f["target"], f["wall"], f["logical"], f["key"]):
                raw = codecs.hint_key(target, int(wall), int(logical), int(key).to_bytes(8, "big"))
                value = [b"\xf1x", b"\xf2x", b"\x01x"][int(key) % 3]
                back = codecs.read_hint_key(raw)
                out.append((back[0], int.from_bytes(back[3], "big"), back[1], back[2], len(raw), codecs.read_hint_value(value)[0]))
            yield pd.DataFrame(out, columns=["target", "key", "wall", "logical", "n_bytes", "kind"])

    return t.hints(spark, d).select("target", "wall", "logical", "key").mapInPandas(there_and_back, "target string, key long, wall long, logical long, n_bytes long, kind string")


@query("SELECT key, wall, logical, node, deleted, 2 + 8 + 4 + 2 + length(node) + CASE WHEN deleted THEN 0 ELSE 8 END AS n_bytes FROM replica_rows WHERE replica = 'r0'", t.REPLICA_ROWS)
def envelope_codec(spark, d):
    """Replica rows through their envelopes, clocks included, and back."""
    import struct

    def there_and_back(frames):
        for f in frames:
            out = []
            for key, value, deleted, wall, logical, node in zip(f["key"], f["value"], f["deleted"], f["wall"], f["logical"], f["node"]):
                raw = codecs.encode_envelope((int(wall), int(logical), node), bool(deleted), struct.pack("<d", value))
                clock, gone, _ = codecs.decode_envelope(raw)
                out.append((key, *clock, gone, len(raw)))
            yield pd.DataFrame(out, columns=["key", "wall", "logical", "node", "deleted", "n_bytes"])

    rows = t.replica_rows(spark, d).filter("replica = 'r0'").select("key", "value", "deleted", "wall", "logical", "node")
    return rows.mapInPandas(there_and_back, "key long, wall long, logical long, node string, deleted boolean, n_bytes long")


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS id, len(vec) AS dim, round(vec[1]::DOUBLE)::BIGINT AS first FROM vecs", t.VECTORS)
def ivecs_roundtrip(spark, d):
    """Rounded components as whole numbers, written by the format and read back."""
    path = folder(spark, "vectors") + ".ivecs"
    # Spark's and DuckDB's rounding of halves agree: away from zero
    rows = t.vectors(spark, d).select("id", F.transform("vec", lambda x: F.round(x.cast("double")).cast("int")).alias("vec"))
    vectors_file.write_vectors(rows, path, "i")
    spark.dataSource.register(vectors_file.VectorsFile)
    back = spark.read.format("vecs").option("kind", "i").load(path)
    return back.select("id", F.size("vec").cast("long").alias("dim"), F.col("vec")[0].cast("long").alias("first"))


# ---- vectors --------------------------------------------------------------------------------------


def _with_meta(spark, d) -> DataFrame:
    v = t.vectors(spark, d)
    fields = F.map_from_arrays(F.array(F.lit("label"), F.lit("even"), F.lit("name")), F.array(vectors.meta_value(F.col("label"), "i"), vectors.meta_value(F.col("id") % 2 == 0, "b"), vectors.meta_value(F.concat(F.lit("v"), F.col("id").cast("string")), "s")))
    return v.withColumn("meta", fields)


@query(f"SELECT id, round({_l2_sql('vec', PROBE)}, 6) AS distance FROM vecs WHERE label = 3 AND id % 2 = 0 ORDER BY {_l2_sql('vec', PROBE)}, id LIMIT 10", t.VECTORS)
def knn_meta_filtered(spark, d):
    """Search among vectors whose typed metadata match: a whole number and a truth value."""
    rows = vectors.with_meta(vectors.with_meta(_with_meta(spark, d), "label", 3), "even", True)
    return vectors.knn(rows, _probe(spark, d), 10).withColumn("distance", F.round("distance", 6))


@query("SELECT id, label::VARCHAR AS label, CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS even, 'v' || id AS name FROM vecs", t.VECTORS)
def meta_projection(spark, d):
    shown = vectors.shown_meta(_with_meta(spark, d))
    return shown.select("id", *(F.col("meta")[n].alias(n) for n in ("label", "even", "name")))


@query(
    "SELECT t.replica, l.id, l.wall, 'v' || l.id AS name FROM (SELECT w.id, n.replica FROM (SELECT id, max(wall * 10 + logical) AS v FROM vreps GROUP BY id) w CROSS JOIN (SELECT unnest(['r0', 'r1', 'r2']) AS replica) n LEFT JOIN (SELECT replica, id, max(wall * 10 + logical) AS v FROM vreps GROUP BY ALL) o ON o.id = w.id AND o.replica = n.replica WHERE o.id IS NULL OR o.v < w.v) t "
    "JOIN (SELECT id, w.* FROM (SELECT id, arg_max({'wall': wall, 'logical': logical}, wall * 10 + logical) AS w FROM vreps GROUP BY id)) l USING (id)",
    t.VECTOR_REPLICAS,
)
def vector_repair_meta(spark, d):
    """Repair rows keep the metadata of the newest copy."""
    rows = t.vector_replicas(spark, d).withColumn("meta", F.create_map(F.lit("name"), vectors.meta_value(F.concat(F.lit("v"), F.col("id").cast("string")), "s")))
    return vectors.repair_rows(rows, t.REPLICAS).select("replica", "id", "wall", F.col("meta")["name"]["s"].alias("name"))


@query("SELECT id, count(*) AS sources, string_agg(replica || ':' || wall || '.' || logical, ',' ORDER BY replica, wall, logical) AS listed FROM (SELECT DISTINCT replica, id, wall, logical FROM vreps) GROUP BY id", t.VECTOR_REPLICAS)
def vector_provenance(spark, d):
    p = vectors.provenance(t.vector_replicas(spark, d))
    return p.select("id", F.size("sources").cast("long").alias("sources"), F.array_join(F.transform("sources", lambda s: F.format_string("%s:%d.%d", s["replica"], s["wall"], s["logical"])), ",").alias("listed"))


@query("SELECT len(vec) = 64 AS ok, count(*) AS n FROM (SELECT CASE WHEN id % 10 = 0 THEN vec[1:60] ELSE vec END AS vec FROM vecs) GROUP BY 1", t.VECTORS)
def vector_dimensions(spark, d):
    """How many vectors fit a collection of 64 components; a tenth were cut."""
    v = t.vectors(spark, d).withColumn("vec", F.when(F.col("id") % 10 == 0, F.slice("vec", 1, 60)).otherwise(F.col("vec")))
    return vectors.dimension_report(v, 64)


@query("SELECT id FROM vlatest WHERE NOT deleted", t.VECTOR_ROWS)
def index_rebuild(spark, d):
    """The ids of an index that was rebuilt from the stored rows and saved."""
    path = folder(spark, "rebuilt")
    ann.rebuild(t.vector_rows(spark, d)).write.parquet(path)
    return spark.read.parquet(path).filter("not deleted").select("id")


@query("SELECT count(*) AS nodes, 0::BIGINT AS deleted, true AS levels_ok, true AS bytes_ok FROM vlatest WHERE NOT deleted", t.VECTOR_ROWS)
def graph_stats(spark, d):
    """Size of a rebuilt index; bytes are those of the vectors and of room for links of each level."""
    s = ann.graph_stats(ann.rebuild(t.vector_rows(spark, d)))
    dim = len(t.vectors(spark, d).first().vec)
    least = F.col("nodes") * (4 * dim + 8 * 16 * 2 + 64)
    return s.agg(F.sum("nodes").alias("nodes"), F.sum("deleted").alias("deleted"), (F.max("levels") >= 1).alias("levels_ok"), F.min((F.col("bytes") >= least) & (F.col("bytes") <= 2 * least)).alias("bytes_ok"))


@query("SELECT 2::BIGINT AS kept, 1::BIGINT AS cleaned, count(*) AS nodes FROM vecs", t.VECTORS)
def graph_snapshots(spark, d):
    """Three snapshots of all collections, one cleaned away, the newest read back."""
    root, v = folder(spark, "snapshots"), t.vectors(spark, d)
    graphs = written(ann.build_graphs(v.select("id", "vec")), "graphs")  # built once for the three
    for k in (1, 2, 3):
        ann.snapshot_all({"all": graphs}, root, k)
    gone = ann.cleanup_snapshots(spark, root, "all", keep=2)
    left = ann.snapshots(spark, root, "all")
    n = spark.read.parquet(left[0]).count()
    return spark.createDataFrame([(len(left), len(gone), n)], "kept long, cleaned long, nodes long")


@query("SELECT qid, rank, id, round(distance, 6) AS distance FROM near WHERE rank <= 10", t.VECTORS, BATCHED)
def ann_ivf_all_cells(spark, d):
    """With all cells probed the inverted file is exact."""
    v = t.vectors(spark, d)
    return ann.ivf_search(v, _asked(v), 10, cells=16, probes=16).withColumn("distance", F.round("distance", 6))


@query("SELECT qid, rank, id, round(distance, 6) AS distance FROM near WHERE rank <= 10", t.VECTORS, BATCHED)
def ann_hnsw_full_beam(spark, d):
    """With a beam as wide as the graph its search is exact."""
    v = t.vectors(spark, d)
    return ann.hnsw_search(v, _asked(v), 10, ef_search=v.count()).withColumn("distance", F.round("distance", 6))


@query("SELECT method, (SELECT count(*) FROM vecs WHERE id % 50 = 0) AS queries, true AS at_least_90 FROM (SELECT unnest(['ivf', 'hnsw', 'snapshot']) AS method)", t.VECTORS)
def ann_recall(spark, d):
    """Mean recall at 10 of the approximate searches at their queries' own settings, against the exact answers."""
    v, out = t.vectors(spark, d), []
    asked, path = _asked(v), folder(spark, "graphs")
    exact = written(evaluation.neighbors(vectors.knn_batch(v, asked, 10)), "truth")
    left = v.filter("id % 13 != 0")
    exact_left = evaluation.neighbors(vectors.knn_batch(left, asked, 10))
    ann.build_graphs(v).write.parquet(path)
    found = {
        "ivf": (exact, ann.ivf_search(v, asked, 10, cells=16, probes=12)),
        "hnsw": (exact, ann.search_graphs(spark.read.parquet(path), asked, 10)),
        "snapshot": (exact_left, ann.search_graphs(spark.read.parquet(path), asked, 10, removed=v.filter("id % 13 = 0").select("id"))),
    }
    for name, (truth, got) in found.items():
        r = evaluation.recall(truth, evaluation.neighbors(got), 10).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("at_least_90"))
        out.append(r.withColumn("method", F.lit(name)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT unnest([10, 40, 160])::BIGINT AS ef_search, 16::BIGINT AS m, 200::BIGINT AS ef_construct, (SELECT count(*) FROM vecs WHERE id % 50 = 0) AS queries, true AS measured", t.VECTORS)
def sweep_csv(spark, d):
    """A sweep over beam widths as a CSV report that is read back: recall, build and search time, rate, memory."""
    import time

    v, path = t.vectors(spark, d), folder(spark, "sweep")
    asked = _asked(v)
    truth, saved = written(evaluation.neighbors(vectors.knn_batch(v, asked, 10)), "truth"), f"{path}-graphs"
    began = time.perf_counter()
    ann.build_graphs(v).write.parquet(saved)
    build, size = time.perf_counter() - began, v.count()
    queries, seen = asked.count(), []

    def run(s: dict) -> dict:
        began = time.perf_counter()
        r = evaluation.recall(truth, evaluation.neighbors(ann.search_graphs(spark.read.parquet(saved), asked, 10, s["ef_search"])), 10).agg(F.avg("recall")).first()[0]
        took = time.perf_counter() - began
        return {"recall": float(r), "build_s": build, "search_s": took, "qps": queries / took, "memory_bytes": graph_bytes(size, 64)}

    rows = evaluation.sweep([{"m": 16, "ef_construct": 200, "ef_search": e} for e in (10, 40, 160)], run, seen.append)
    evaluation.write_csv(spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0])), f"{path}-csv")
    back = spark.read.option("header", True).option("inferSchema", True).csv(f"{path}-csv")
    ok = (F.col("recall") > 0.5) & (F.col("qps") > 0) & (F.col("build_s") > 0) & (F.col("memory_bytes") > 0) & F.lit(len(seen) == 3)
    return back.select(*(F.col(c).cast("long").alias(c) for c in ("ef_search", "m", "ef_construct")), F.lit(queries).cast("long").alias("queries"), ok.alias("measured"))


@query(
    "SELECT n, 4 * greatest(1, ceil(log2(greatest(2, n))))::BIGINT AS sends, (n * (4 * 64 + 8 * (32 + 16 / 15.0::DOUBLE) + 64))::DOUBLE AS bytes, CASE WHEN n * 400 < 1024 THEN format('{:.1f} B', (n * 400)::DOUBLE) WHEN n * 400 < 1048576 THEN format('{:.1f} KB', n * 400 / 1024.0::DOUBLE) ELSE format('{:.1f} MB', n * 400 / 1048576.0::DOUBLE) END AS shown FROM (SELECT label + 1 AS n FROM vecs GROUP BY label UNION SELECT 5000)",
    t.VECTORS,
)
def sizing_table(spark, d):
    """Gossip sends, estimated index bytes and a size as text, for some cluster and index sizes."""
    sizes = sorted({r.label + 1 for r in t.vectors(spark, d).select("label").distinct().collect()} | {5000})
    rows = [(n, retransmit_limit(n), n * (4 * 64 + 8 * (32 + 16 / 15) + 64), show_bytes(n * 400)) for n in sizes]
    assert all(graph_bytes(n, 64) == int(b) for n, _, b, _ in rows)
    return spark.createDataFrame(rows, "n long, sends long, bytes double, shown string")


@query(f"SELECT key, count(*) AS n FROM events, (SELECT 1) CROSS JOIN LATERAL (SELECT 'key-' || lpad(user_id::VARCHAR, 16, '0') AS key) GROUP BY key")
def checked_keys(spark, d):
    """Keys that pass validation: none is empty."""
    e = t.table(spark, d, "events").select(F.concat(F.lit("key-"), F.lpad(F.col("user_id").cast("string"), 16, "0")).alias("key"))
    return versions.check_keys(e).groupBy("key").agg(F.count("*").alias("n"))


