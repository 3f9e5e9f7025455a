"""Queries over cluster control: replication of vectors, anti-entropy rounds, hints, broadcasts, and their streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import catalog, cluster, merkle, replication, ring, vectors
from ..streaming import views
from ..workspace import folder
from . import tables as t
from .queries import FOLD, WIN, _leaf_sql, _ring_sql, _side, query

# ---- writes to replicas ---------------------------------------------------------------------------

STATES = "states AS (SELECT 'node-' || i AS node, CASE i WHEN 4 THEN 2 ELSE 0 END AS liveness FROM range(5) r(i))"
VKEYS = "keys AS (SELECT vec_id::VARCHAR AS key FROM embeddings)"


def _states(spark) -> DataFrame:
    return spark.createDataFrame([(n, 2 if n == "node-4" else 0, 2) for n in t.NODES], "node string, liveness long, ring long")


def _vector_owners(spark, d) -> DataFrame:
    keys = t.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"))
    return ring.owner_rows(keys, t.NODES, 3).select(F.col("key").cast("long").alias("id"), "node", "rank")


@query("SELECT key::BIGINT AS id, count(*) AS voters, count(*) FILTER (liveness = 0) AS acks, count(*) FILTER (liveness = 2) AS hints, count(*) FILTER (liveness = 0) >= 2 AS ok FROM owners JOIN states USING (node) GROUP BY key", VKEYS, _ring_sql(t.NODES, 3), STATES)
def vector_write_quorum(spark, d):
    """Vector writes to three owners, one node dead: acknowledgements, hints and the quorum of two."""
    owners = _vector_owners(spark, d).select(F.col("id").alias("key"), "node")
    return replication.write_status(owners.select("key").distinct(), owners, _states(spark), 2).withColumnRenamed("key", "id")


@query("SELECT v.id, o.node AS replica, v.wall, v.deleted, s.liveness = 2 AS hinted FROM vrows v JOIN owners o ON o.key = v.id::VARCHAR JOIN states s USING (node)", VKEYS, _ring_sql(t.NODES, 3), STATES, t.VECTOR_ROWS)
def vector_replicate(spark, d):
    """Every vector write and delete at each of its owners; what a dead owner gets is hinted."""
    sent = vectors.replicate(t.vector_rows(spark, d), _vector_owners(spark, d), _states(spark))
    return sent.select("id", "replica", "wall", "deleted", "hinted")


@query("SELECT replica, id, w.wall AS wall, w.logical AS logical, w.deleted AS deleted FROM (SELECT replica, id, arg_max({'wall': wall, 'logical': logical, 'deleted': deleted}, wall * 10 + logical) AS w FROM (SELECT * FROM vreps UNION ALL SELECT r, vrows.* FROM vrows, (SELECT unnest(['r0', 'r1']) AS r) WHERE wall > 1) GROUP BY replica, id)", t.VECTOR_REPLICAS)
def vector_apply(spark, d):
    """Two replicas after all updates and deletes arrived once more, in any order."""
    rows = t.vector_rows(spark, d)
    late = rows.filter("wall > 1").withColumn("replica", F.explode(F.array(F.lit("r0"), F.lit("r1"))))
    return vectors.applied(t.vector_replicas(spark, d), late).select("replica", "id", "wall", "logical", "deleted")


@query("SELECT replica, key, w.value AS value, w.deleted AS deleted, w.wall AS wall FROM (SELECT replica, key, arg_max({'value': value, 'deleted': deleted, 'wall': wall}, {'wall': wall, 'logical': logical, 'node': node}) AS w FROM (SELECT * FROM replica_rows UNION ALL SELECT 'r2', key, value, deleted, wall, logical, node FROM replica_rows WHERE replica = 'r0') GROUP BY replica, key)", t.REPLICA_ROWS)
def replicate_batch(spark, d):
    """A replica takes another one's whole state as a batch; newer rows of its own stay."""
    rows = t.replica_rows(spark, d)
    return cluster.replicate(rows, rows.filter("replica = 'r0'").withColumn("replica", F.lit("r2"))).select("replica", "key", "value", "deleted", "wall")


@query("SELECT node FROM members GROUP BY node HAVING arg_max(liveness, incarnation * 10 + liveness) != 2 AND max(incarnation) % 3 != 1", t.MEMBERS)
def readable_members(spark, d):
    best = replication.gossip(t.members(spark, d)).select("node", "liveness", (F.col("incarnation") % 3).alias("ring"))
    return replication.readable(best).select("node")


# ---- anti-entropy ---------------------------------------------------------------------------------


@query("SELECT replica, key, value, deleted, wall, logical, node FROM win CROSS JOIN (SELECT unnest(['r0', 'r1', 'r2']) AS replica)", t.REPLICA_ROWS, WIN % "replica_rows")
def anti_entropy_rounds(spark, d):
    """Three replicas after the meetings r0-r1, r1-r2, r0-r1: all hold the newest rows."""
    return cluster.anti_entropy(t.replica_rows(spark, d), [("r0", "r1"), ("r1", "r2"), ("r0", "r1")])


@query("SELECT tick, node, peer FROM (SELECT a.node, b.node AS peer, row_number() OVER (PARTITION BY a.node ORDER BY b.node) - 1 AS turn FROM (SELECT 'node-' || range AS node FROM range(5)) a JOIN (SELECT 'node-' || range AS node FROM range(5)) b ON a.node != b.node) JOIN (SELECT range AS tick FROM range(12)) ON tick % 4 = turn")
def anti_entropy_ticks(spark, d):
    """Which peer each of five nodes reconciles with at each tick, in turn."""
    nodes = spark.createDataFrame([(a, b) for a in t.NODES for b in t.NODES if a != b], "node string, peer string")
    return cluster.ticks(nodes, 12)


@query("SELECT 'r1' AS peer, (SELECT count(*) FROM replica_rows WHERE replica IN ('r0', 'r1')) AS keys_scanned, (SELECT count(*) FROM la FULL JOIN lb USING (idx) WHERE coalesce(la.hash, 0) != coalesce(lb.hash, 0)) AS divergent_leaves, (SELECT count(*) FROM (SELECT key FROM (SELECT DISTINCT key, wall, logical, node FROM replica_rows WHERE replica IN ('r0', 'r1') UNION ALL SELECT DISTINCT key, NULL, NULL, NULL FROM replica_rows WHERE replica = 'r0' AND key NOT IN (SELECT key FROM replica_rows WHERE replica = 'r1') UNION ALL SELECT DISTINCT key, NULL, NULL, NULL FROM replica_rows WHERE replica = 'r1' AND key NOT IN (SELECT key FROM replica_rows WHERE replica = 'r0')) GROUP BY key HAVING count(*) > 1)) AS keys_repaired", t.REPLICA_ROWS, _leaf_sql("r0", "la"), _leaf_sql("r1", "lb"))
def anti_entropy_trigger(spark, d):
    """What a reconciliation on demand reports."""
    return cluster.trigger(t.replica_rows(spark, d), "r0", "r1")[1]


@query("SELECT tick, count(*) AS started, true AS within_limit FROM (SELECT a, b, seq // 8 AS tick FROM (SELECT event_id AS seq, 2 * (event_id % 8 // 2) AS a, 2 * (event_id % 8 // 2) + 1 AS b FROM events) GROUP BY ALL) GROUP BY tick")
def anti_entropy_limit(spark, d):
    """Each tick four pairs of nodes ask twice; every pair runs once, and no node takes part in more than one."""
    e = t.table(spark, d, "events")
    a = 2 * F.floor(F.col("event_id") % 8 / 2)
    asked = e.select(F.floor(F.col("event_id") / 8).alias("tick"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, a).otherwise(a + 1).alias("node"), F.when(F.col("event_id") % 2 == 0, a + 1).otherwise(a).alias("peer"))
    runs = cluster.admitted_triggers(asked, 1)
    busy = runs.select("tick", F.explode(F.array("node", "peer")).alias("node")).groupBy("tick").agg((F.count("*") == F.count_distinct("node")).alias("within_limit"))
    return runs.groupBy("tick").agg(F.count("*").alias("started")).join(busy, "tick")


@query(
    "SELECT idx % 16 AS child, hash FROM (SELECT idx, hash FROM la UNION ALL SELECT range, 0 FROM range(256) WHERE range NOT IN (SELECT idx FROM la)) WHERE idx // 16 = 3",
    t.REPLICA_ROWS, _leaf_sql("r0", "la"),
)
def merkle_subtree(spark, d):
    """The children of the tree's node at path [3]: here the leaves 48 to 63."""
    rows = _side(spark, d, "r0")
    return merkle.subtree(merkle.levels(merkle.leaves(rows)), [3])


LEAF = "('0x' || substr(md5(key::VARCHAR), 1, 15))::BIGINT % 256"


@query(f"SELECT {LEAF} AS idx, key, wall, logical, node, deleted FROM replica_rows WHERE replica = 'r0' AND {LEAF} IN (7, 8)", t.REPLICA_ROWS)
def merkle_leaf_keys(spark, d):
    """The entries of two leaves, as they are compared key by key."""
    rows = _side(spark, d, "r0")
    return merkle.leaf_keys(rows, 7).unionByName(merkle.leaf_keys(rows, 8))


# ---- membership and hints -------------------------------------------------------------------------


def _reports(spark, d) -> DataFrame:
    return replication.gossip(t.members(spark, d))


@query("SELECT node, addr, liveness, incarnation, CASE WHEN node IN ('node-0', 'node-1') THEN 2 WHEN node = 'node-2' THEN 1 ELSE 0 END AS ring, CASE WHEN node IN ('node-0', 'node-1', 'node-2') THEN 7::BIGINT END AS version FROM (SELECT node, max(addr) AS addr, arg_max(liveness, incarnation * 10 + liveness) AS liveness, max(incarnation) AS incarnation FROM members GROUP BY node)", t.MEMBERS)
def cluster_status(spark, d):
    placed = spark.createDataFrame([(7, "node-0", "a", 2), (7, "node-1", "b", 2), (7, "node-2", "c", 1)], catalog.RING)
    return cluster.status(_reports(spark, d), placed)


@query("SELECT node, max(addr) AS addr, arg_max(liveness, incarnation * 10 + liveness) AS liveness, 1 AS ring FROM members WHERE node = 'node-2' GROUP BY node", t.MEMBERS)
def node_info(spark, d):
    placed = spark.createDataFrame([(7, "node-0", "a", 2), (7, "node-2", "c", 1)], catalog.RING)
    return cluster.node_info(_reports(spark, d), placed, "node-2")


@query("SELECT event_id AS seq, node, incarnation, liveness FROM (SELECT event_id, 'node-' || (user_id % 5) AS node, event_id // 1000 AS incarnation, event_id % 3 AS liveness FROM events ORDER BY event_id DESC LIMIT 128) ORDER BY event_id DESC LIMIT 10")
def freshest_updates(spark, d):
    """What the next gossip message carries of a buffer of 128 updates."""
    e = t.table(spark, d, "events")
    updates = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"), F.floor(F.col("event_id") / 1000).alias("incarnation"), (F.col("event_id") % 3).alias("liveness"))
    return cluster.carried(cluster.broadcasts(updates, 5))[0].select("seq", "node", "incarnation", "liveness")


@query("SELECT event_id AS seq, CASE WHEN n < 2 THEN 10::BIGINT ELSE 11::BIGINT END AS remaining FROM (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) - 1 AS n FROM events ORDER BY event_id DESC LIMIT 128)")
def retransmit_rounds(spark, d):
    """The buffer after thirteen messages: each carried the ten with the most sends left, 130 of 128 updates: the newest two went twice."""
    e = t.table(spark, d, "events")
    buffer = cluster.broadcasts(e.select(F.col("event_id").alias("seq")), 5)
    for _ in range(13):
        _, buffer = cluster.carried(buffer)
    return buffer.select("seq", F.col("remaining").cast("long").alias("remaining"))


@query("SELECT batch, attempt, start_ns + attempt * 1000000000 AS at, attempt > fails AS ok FROM (SELECT event_id AS batch, epoch_us(ts) * 1000 AS start_ns, event_id % 5 AS fails FROM events) JOIN (SELECT range + 1 AS attempt FROM range(3)) ON attempt <= least(fails + 1, 3)")
def hint_retries(spark, d):
    """Replays of batches that fail some times: a try a second, three at most."""
    e = t.table(spark, d, "events")
    return cluster.retries(e.select(F.col("event_id").alias("batch"), (t.micros() * 1000).alias("start_ns"), (F.col("event_id") % 5).alias("fails")), 3, 10**9)


# ---- metrics --------------------------------------------------------------------------------------


@query(
    "SELECT 'kv_writes_total' AS name, concat_ws(',', 'op=' || op, 'status=' || CASE WHEN ok THEN 'ok' ELSE 'error' END) AS labels, count(*)::DOUBLE AS value FROM ops WHERE op != 'get' GROUP BY ALL UNION ALL SELECT 'kv_reads_total', 'status=ok', count(*)::DOUBLE FROM ops WHERE op = 'get' "
    "UNION ALL SELECT 'run_count', 'level=' || level, count(*)::DOUBLE FROM files GROUP BY level UNION ALL SELECT 'hint_drain_batches_total', 'status=ok', count(DISTINCT (target, key // 500))::DOUBLE FROM hints "
    "UNION ALL SELECT 'ae_keys_scanned_total', '', count(*)::DOUBLE FROM replica_rows WHERE replica IN ('r0', 'r1') UNION ALL SELECT 'compactions_total', '', 1.0::DOUBLE "
    "UNION ALL SELECT 'kv_read_latency_seconds_bucket', 'le=' || CASE WHEN i = 16 THEN '+Inf' ELSE le END, count(*) FILTER (i = 16 OR latency_ns / 1e9::DOUBLE <= b)::DOUBLE FROM ops, (SELECT unnest(range(17)) AS i) CROSS JOIN LATERAL (SELECT 0.0001::DOUBLE * pow(2::DOUBLE, i) AS b, ['0.0001','0.0002','0.0004','0.0008','0.0016','0.0032','0.0064','0.0128','0.0256','0.0512','0.1024','0.2048','0.4096','0.8192','1.6384','3.2768','+Inf'][i + 1] AS le) WHERE op = 'get' GROUP BY i, le",
    t.OPS, t.FILES, t.HINTS, t.REPLICA_ROWS,
)
def metric_series(spark, d):
    """Samples of some series with their labels, counters and gauges and one histogram."""
    ops = t.op_log(spark, d)
    status = F.when(F.col("ok"), "ok").otherwise("error")
    gets, hints = ops.filter("op = 'get'"), t.hints(spark, d).select("target", F.floor(F.col("key") / 500).alias("b")).distinct()
    return cluster.union(
        [
            metrics.samples(ops.filter("op != 'get'"), "kv_writes_total", {"op": F.col("op"), "status": status}),
            metrics.samples(gets, "kv_reads_total", {"status": F.lit("ok")}),
            metrics.samples(t.files(spark, d), "run_count", {"level": F.col("level")}),
            metrics.samples(hints, "hint_drain_batches_total", {"status": F.lit("ok")}),
            metrics.samples(t.replica_rows(spark, d).filter("replica in ('r0', 'r1')"), "ae_keys_scanned_total", {}),
            metrics.samples(spark.range(1), "compactions_total", {}),
            metrics.histogram_samples(gets, "kv_read_latency_seconds", {}, F.col("latency_ns") / F.lit(1e9)),
        ]
    )


# ---- streams --------------------------------------------------------------------------------------


def _hint_events(spark, d) -> str:
    """Hints as a stream's files: (target, key, ts, done), every third taken back an hour later, in the order of time."""
    rows = t.hints(spark, d).select("target", "key", F.timestamp_micros(F.expr("wall div 1000")).alias("ts"), F.lit(False).alias("done"))
    back = rows.filter("key % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")).withColumn("done", F.lit(True))
    path = folder(spark, "hint-events")
    views.write_in_order(rows.unionByName(back), "ts", path)
    return path


@query(
    "SELECT target, key, make_timestamp(wall // 1000) + INTERVAL 24 HOUR AS expired_at FROM hints WHERE key % 3 != 0 AND make_timestamp(wall // 1000) + INTERVAL 24 HOUR <= (SELECT max(make_timestamp(wall // 1000) + CASE WHEN key % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) - INTERVAL 10 MINUTE FROM hints)",
    t.HINTS,
)
def stream_hint_expiry(spark, d):
    """Hints that nobody took back within a day, purged as the watermark passes."""
    stream = views.events_stream(spark, _hint_events(spark, d), 1)
    out = views.drain(views.hint_expiry(stream, 24 * 3600, "10 minutes"), "append", "expiry")
    return out.select("target", "key", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))


@query("SELECT target, key, wall FROM hints WHERE target IN ('r0', 'r2') AND wall <= (SELECT max(epoch_us(ts)) * 1000 // 2 + min(epoch_us(ts)) * 1000 // 2 FROM events)", t.HINTS)
def stream_drain(spark, d):
    """Two members come back half way: their hints up to then are replayed."""
    e = t.table(spark, d, "events")
    path, out = folder(spark, "recoveries"), folder(spark, "drained")
    half = e.agg((F.floor(F.max(t.micros()) * 1000 / 2000) + F.floor(F.min(t.micros()) * 1000 / 2000)).alias("us"))
    half.select(F.explode(F.array(F.lit("r0"), F.lit("r2"))).alias("target"), F.timestamp_micros("us").alias("ts")).coalesce(1).write.parquet(path)
    views.drain_on_recovery(views.events_stream(spark, path), t.hints(spark, d), out, folder(spark, "drain-check"), lambda due: due.select("target", "key", "wall"))
    return spark.read.option("recursiveFileLookup", "true").schema("target string, key long, wall long").parquet(out)


DEADS = "reports AS (SELECT 'user-' || user_id AS node, ts, event_id, CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS liveness FROM events), marked AS (SELECT *, sum(CASE WHEN liveness = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY ts, event_id) AS run, lead(ts) OVER (PARTITION BY node ORDER BY ts, event_id) AS next FROM reports), spans AS (SELECT node, run, min(ts) FILTER (liveness = 2) AS since, max(next) FILTER (liveness = 2) AS until, bool_or(next IS NULL AND liveness = 2) AS open FROM marked GROUP BY node, run)"


@query("SELECT node, since + INTERVAL 6 HOUR AS reaped_at FROM spans WHERE since IS NOT NULL AND ((NOT open AND until - since >= INTERVAL 6 HOUR) OR (open AND since + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)))", DEADS)
def stream_reaped(spark, d):
    """Members that were dead and silent otherwise for six hours."""
    path = folder(spark, "reports")
    e = t.table(spark, d, "events")
    e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("node"), "ts", F.when(F.col("event_type") == "error", 2).otherwise(0).alias("liveness")).coalesce(1).write.parquet(path)
    out = views.drain(views.reaped(views.events_stream(spark, path), 6 * 3600, "1 minute"), "append", "reaped")
    return out.select("node", F.col("reaped_at").cast("timestamp_ntz").alias("reaped_at"))


@query("SELECT node, i, wall, logical, accepted FROM folded WHERE rn > 0", FOLD)
def stream_hlc_receive(spark, d):
    """The receive rule with a node's clock as stream state."""
    e, path = t.table(spark, d, "events"), folder(spark, "clocks")
    ns = t.micros() * 1000
    remote = F.when(F.col("event_id") % 3 != 0, ns + (F.col("event_id") % 11 - 5) * F.lit(20 * 10**9))
    rows = e.select(F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"), F.col("event_id").alias("i"), ns.alias("physical"), remote.alias("remote_wall"), F.when(remote.isNotNull(), F.col("event_id") % 4).alias("remote_logical"), "ts")
    views.write_in_order(rows, "i", path)
    return views.drain(views.received(views.events_stream(spark, path, 1).drop("ts")), "append", "clocks").drop("batch")


@query(f"SELECT {LEAF} AS idx, key, ('0x' || substr(md5(concat_ws('|', key::VARCHAR, wall::VARCHAR, logical::VARCHAR, node, (deleted::INT)::VARCHAR)), 1, 15))::BIGINT AS hash FROM replica_rows WHERE replica = 'r1'", t.REPLICA_ROWS)
def stream_leaf_keys(spark, d):
    """A replica's rows streamed as tree entries."""
    path = folder(spark, "rows")
    _side(spark, d, "r1").withColumn("ts", F.timestamp_micros("wall")).write.parquet(path)
    return views.drain(views.leaf_entries(views.events_stream(spark, path)), "append", "entries").drop("batch")


@query("SELECT second, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT date_trunc('second', ts) AS second, event_type FROM events) WHERE second + INTERVAL 1 SECOND <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY second")
def stream_per_second(spark, d):
    ops = views.events_stream(spark, f"{d}/events.parquet").select("ts", (F.col("event_type") != "error").alias("ok"))
    out = views.drain(views.per_second(ops, "10 minutes"), "append", "seconds")
    return out.select(F.col("second").cast("timestamp_ntz").alias("second"), "n", "errors")


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS nodes FROM events")
def stream_changes(spark, d):
    """A callback sees every reported change of liveness once."""
    out = folder(spark, "changes")
    stream = views.events_stream(spark, f"{d}/events.parquet").select("user_id", "event_type")
    views.on_change(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/b={n}"), folder(spark, "changes-check"))
    return spark.read.option("recursiveFileLookup", "true").schema("user_id long, event_type string").parquet(out).agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("nodes"))
