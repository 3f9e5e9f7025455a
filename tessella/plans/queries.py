"""Named queries over the driver's tables, and the DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..functions.hashing import bucket_path, config_digest, hash60
from ..operators import ann, catalog, compaction, evaluation, hlc, merkle, replication, ring, vectors, versions, workload, writes
from ..sources import log_files, vectors_file
from ..streaming import views
from ..workspace import folder, written
from . import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *common: str):
    """Register a function under its name; ``common`` are the table expressions its SQL starts with."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ("WITH " + ", ".join(common) + " " if common else "") + sql
        return f

    return add


# ---- versions -------------------------------------------------------------------------------------

NEWEST = f"snap AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM log WHERE seq <= {t.HALF} GROUP BY key)"


@query("SELECT key, seq, value FROM snap WHERE NOT tombstone", t.LOG, NEWEST)
def snapshot_scan(spark, d):
    return versions.scan(t.version_log(spark, d), t.last_event(spark, d) // 2)


@query("SELECT key, seq, value, tombstone FROM snap", t.LOG, NEWEST)
def snapshot_scan_raw(spark, d):
    return versions.newest(t.version_log(spark, d), t.last_event(spark, d) // 2)


@query("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM log GROUP BY key HAVING NOT arg_max(tombstone, seq)", t.LOG)
def latest_scan(spark, d):
    return versions.scan(t.version_log(spark, d))


ASKED = "asked AS (SELECT range AS key FROM range(0, (SELECT 2 * max(user_id) FROM events), 7))"


def _asked_keys(spark, d):
    """A seventh of the keys, and as many that aren't there."""
    last = t.table(spark, d, "events").agg(F.max("user_id")).first()[0]
    return spark.range(0, 2 * last, 7).withColumnRenamed("id", "key")


STATE = "CASE WHEN tombstone IS NULL THEN 'miss' WHEN tombstone THEN 'tombstone' ELSE 'hit' END"


@query(f"SELECT key, {STATE} AS state, CASE WHEN NOT tombstone THEN seq END AS seq, CASE WHEN NOT tombstone THEN value END AS value FROM asked LEFT JOIN snap USING (key)", t.LOG, NEWEST, ASKED)
def point_get_states(spark, d):
    return versions.point_states(t.version_log(spark, d), _asked_keys(spark, d), t.last_event(spark, d) // 2)


@query(f"SELECT key, {STATE} AS state, CASE WHEN NOT tombstone THEN seq END AS seq, CASE WHEN NOT tombstone THEN value END AS value FROM (SELECT 42::BIGINT AS key) LEFT JOIN snap USING (key)", t.LOG, NEWEST)
def point_get(spark, d):
    return versions.point_states(t.version_log(spark, d), spark.createDataFrame([(42,)], "key long"), t.last_event(spark, d) // 2)


@query("SELECT key, seq, value FROM snap WHERE NOT tombstone AND key >= 20 AND key < 100", t.LOG, NEWEST)
def range_scan(spark, d):
    return versions.scan(versions.in_range(t.version_log(spark, d), 20, 100), t.last_event(spark, d) // 2)


def _order_log(spark, d):
    o = t.table(spark, d, "orders")
    return o.select(F.concat_ws("#", "o_orderpriority", F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"), (F.col("o_orderstatus") == "P").alias("tombstone"))


ORDER_LOG = "olog AS (SELECT concat_ws('#', o_orderpriority, o_custkey::VARCHAR) AS key, o_orderkey AS seq, o_totalprice AS value, o_orderstatus = 'P' AS tombstone FROM orders)"


@query("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM olog WHERE starts_with(key, '1-') GROUP BY key HAVING NOT arg_max(tombstone, seq)", ORDER_LOG)
def prefix_scan(spark, d):
    return versions.scan(versions.with_prefix(_order_log(spark, d), "1-"))


@query("SELECT key, seq, value, tombstone, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rank FROM log", t.LOG)
def raw_versions(spark, d):
    return versions.ranked(t.version_log(spark, d))


@query(
    "SELECT mark, count(*) AS live, max(seq) AS newest, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM (SELECT mark, key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS dead "
    "FROM log JOIN (SELECT unnest([max(event_id) // 4, max(event_id) // 2, max(event_id)]) AS mark FROM events) ON seq <= mark GROUP BY mark, key) WHERE NOT dead GROUP BY mark",
    t.LOG,
)
def snapshot_multi(spark, d):
    last = t.last_event(spark, d)
    log = t.version_log(spark, d)
    marks = F.array(*(F.lit(s).cast("long") for s in (last // 4, last // 2, last)))
    seen = log.select("key", "seq", "value", "tombstone", F.explode(marks).alias("mark")).filter("seq <= mark")
    newest = seen.groupBy("mark", "key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), F.max_by("tombstone", "seq").alias("dead"))
    return newest.filter("not dead").groupBy("mark").agg(F.count("*").alias("live"), F.max("seq").alias("newest"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


@query("SELECT min(event_id) AS watermark, count(*) AS open_snapshots FROM events WHERE event_type = 'signup' AND event_id > 100")
def snapshot_watermark(spark, d):
    e = t.table(spark, d, "events").filter(F.col("event_id") > 100)
    return versions.watermark(e.select(F.col("event_id").alias("seq"), (F.col("event_type") != "signup").alias("closed")))


# ---- writes ---------------------------------------------------------------------------------------


def _batch(spark, d):
    e = t.table(spark, d, "events").filter(F.col("event_id") <= 200)
    return e.select(F.col("event_id").alias("op_ordinal"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("tombstone"))


BATCH = "batch AS (SELECT event_id AS op_ordinal, user_id AS key, value, event_type = 'error' AS tombstone FROM events WHERE event_id <= 200)"


@query("SELECT op_ordinal, key, value, tombstone, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY op_ordinal) AS seq FROM batch", BATCH)
def seq_assign(spark, d):
    return writes.assign_sequences(_batch(spark, d), t.last_event(spark, d))


@query(
    "SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM (SELECT * FROM log UNION ALL SELECT key, (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY op_ordinal) AS seq, value, tombstone FROM batch) GROUP BY key HAVING NOT arg_max(tombstone, seq)",
    t.LOG, BATCH,
)
def batch_apply(spark, d):
    return versions.scan(writes.apply_batch(t.version_log(spark, d), _batch(spark, d), t.last_event(spark, d)))


NINE = "(SELECT max(event_id) * 9 // 10 FROM events)"
BUFFER = f"buffer AS (SELECT * FROM log WHERE seq > {NINE} AND seq <= {NINE} + (SELECT max(event_id) // 100 FROM events))"


def _tx(spark, d):
    last = t.last_event(spark, d)
    at = last * 9 // 10
    log = t.version_log(spark, d)
    return log, at, log.filter((F.col("seq") > at) & (F.col("seq") <= at + last // 100))


@query(
    f"SELECT key, arg_max(seq, own) AS seq, arg_max(value, own) AS value, arg_max(tombstone, own) AS tombstone, max(own) = 1 AS own_write FROM (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone, 0 AS own FROM log WHERE seq <= {NINE} GROUP BY key UNION ALL SELECT key, max(seq), arg_max(value, seq), arg_max(tombstone, seq), 1 FROM buffer GROUP BY key) GROUP BY key",
    t.LOG, BUFFER,
)
def tx_overlay_scan(spark, d):
    log, at, buffer = _tx(spark, d)
    return writes.overlay(log, at, buffer)


@query(f"SELECT key, max(seq) AS seq FROM log WHERE seq > {NINE} AND key IN (SELECT key FROM buffer) GROUP BY key", t.LOG, BUFFER)
def tx_conflicts(spark, d):
    return writes.conflicts(*_tx(spark, d))


# ---- compaction -----------------------------------------------------------------------------------


def _runs(spark, d):
    log = t.version_log(spark, d)
    return [log.filter(F.col("seq") % 4 == r) for r in range(4)]


@query("SELECT key, seq, value, tombstone FROM log", t.LOG)
def merge_runs(spark, d):
    runs = _runs(spark, d)
    return compaction.merge_runs([*runs, runs[0]])  # a run that is there twice adds nothing


@query("SELECT key, seq, value, tombstone FROM log", t.LOG)
def compact_all_versions(spark, d):
    path = folder(spark, "compacted")
    compaction.write_runs(t.version_log(spark, d), path, 4)
    return spark.read.parquet(path)


LINES = (
    "lines AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag = 'R' AS tombstone, "
    "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS seq FROM lineitem)"
)


@query("SELECT l_orderkey, l_linenumber, max(seq) AS versions, arg_max(l_quantity, seq) AS quantity FROM lines GROUP BY ALL HAVING NOT arg_max(tombstone, seq)", LINES)
def compact_lineitem(spark, d):
    """Newest row of each line of an order, by a total order of all columns."""
    li = t.table(spark, d, "lineitem")
    order = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    newest = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("versions"), F.max(order).alias("w"))
    return newest.filter("w.l_returnflag != 'R'").select("l_orderkey", "l_linenumber", "versions", F.col("w.l_quantity").alias("quantity"))


GC = f"kept AS (SELECT * FROM log WHERE seq > {t.HALF} OR (key, seq) IN (SELECT (key, max(seq)) FROM log WHERE seq <= {t.HALF} GROUP BY key))"


@query("SELECT key, seq, value, tombstone FROM kept", t.LOG, GC)
def compact_gc(spark, d):
    return compaction.collect_versions(t.version_log(spark, d), t.last_event(spark, d) // 2)


@query(f"SELECT key, seq, value, tombstone FROM kept WHERE NOT (tombstone AND seq <= {t.HALF})", t.LOG, GC)
def compact_gc_bottom(spark, d):
    return compaction.collect_versions(t.version_log(spark, d), t.last_event(spark, d) // 2, bottom=True)


@query("SELECT level, count(*) AS files, sum(bytes)::BIGINT AS bytes, min(first_key) AS first_key, max(last_key) AS last_key FROM files GROUP BY level", t.FILES)
def level_stats(spark, d):
    return compaction.level_stats(t.files(spark, d))


@query(
    "SELECT level, files, bytes, first_key, last_key, score, score >= 1 AND row_number() OVER (ORDER BY score DESC, level) = 1 AS picked FROM (SELECT level, count(*) AS files, sum(bytes)::BIGINT AS bytes, min(first_key) AS first_key, max(last_key) AS last_key, CASE WHEN level = 0 THEN count(*) / 4 ELSE sum(bytes) / (268435456.0::DOUBLE * pow(10.0, level - 1)) END AS score FROM files GROUP BY level)",
    t.FILES,
)
def compaction_pick(spark, d):
    return compaction.pick_level(t.files(spark, d))


@query("SELECT a.file AS file_a, b.file AS file_b FROM files a, files b WHERE a.level = 0 AND b.level = 1 AND a.first_key <= b.last_key AND b.first_key <= a.last_key", t.FILES)
def overlap_pick(spark, d):
    f = t.files(spark, d)
    return compaction.overlapping(f.filter("level = 0"), f.filter("level = 1"), 64)


# ---- clocks, replicas, members --------------------------------------------------------------------


@query(
    "SELECT node, i, physical, wall, row_number() OVER (PARTITION BY node, wall ORDER BY i) - 1 AS logical FROM (SELECT *, max(physical) OVER (PARTITION BY node ORDER BY i ROWS UNBOUNDED PRECEDING) AS wall FROM (SELECT 'node-' || (user_id % 5) AS node, event_id AS i, (epoch_us(ts) // 3600000000 + (event_id % 7) * 2) AS physical FROM events))"
)
def hlc_now(spark, d):
    e = t.table(spark, d, "events")
    physical = F.floor(t.micros() / F.lit(3600000000)) + (F.col("event_id") % 7) * 2
    return hlc.now(e.select(F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"), F.col("event_id").alias("i"), physical.cast("long").alias("physical")))


FOLD = """RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY i) AS rn FROM (SELECT 'node-' || (user_id % 5) AS node, event_id AS i, epoch_us(ts) * 1000 AS physical,
  CASE WHEN event_id % 3 != 0 THEN epoch_us(ts) * 1000 + (event_id % 11 - 5) * 20000000000 END AS remote_wall, CASE WHEN event_id % 3 != 0 THEN event_id % 4 END AS remote_logical FROM events)),
folded AS (SELECT DISTINCT node, 0::BIGINT AS i, 0::BIGINT AS physical, NULL::BIGINT AS remote_wall, NULL::BIGINT AS remote_logical, 0::BIGINT AS wall, 0::BIGINT AS logical, true AS accepted, 0::BIGINT AS rn FROM ev
  UNION ALL SELECT e.node, e.i, e.physical, e.remote_wall, e.remote_logical,
    CASE WHEN e.remote_wall - e.physical > 60000000000 THEN f.wall ELSE greatest(f.wall, e.physical, coalesce(e.remote_wall, 0)) END,
    CASE WHEN e.remote_wall - e.physical > 60000000000 THEN f.logical
      WHEN greatest(f.wall, coalesce(e.remote_wall, 0)) < e.physical THEN 0
      WHEN e.remote_wall IS NULL OR f.wall > e.remote_wall THEN f.logical + 1
      WHEN f.wall < e.remote_wall THEN e.remote_logical + 1 ELSE greatest(f.logical, e.remote_logical) + 1 END,
    NOT coalesce(e.remote_wall - e.physical > 60000000000, false), e.rn
  FROM folded f JOIN ev e ON e.node = f.node AND e.rn = f.rn + 1)"""


@query("SELECT node, i, physical, remote_wall, remote_logical, wall, logical, accepted FROM folded WHERE rn > 0", FOLD)
def hlc_update_fold(spark, d):
    """Receive events folded in order; every third is local, some remote clocks are too far ahead."""
    e = t.table(spark, d, "events")
    ns = t.micros() * 1000
    remote = F.when(F.col("event_id") % 3 != 0, ns + (F.col("event_id") % 11 - 5) * F.lit(20 * 10**9))
    rows = e.select(
        F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"), F.col("event_id").alias("i"), ns.alias("physical"), remote.alias("remote_wall"), F.when(remote.isNotNull(), F.col("event_id") % 4).alias("remote_logical")
    )
    return hlc.receive(rows)


WIN = "win AS (SELECT key, w.* FROM (SELECT key, arg_max({'value': value, 'deleted': deleted, 'wall': wall, 'logical': logical, 'node': node}, {'wall': wall, 'logical': logical, 'node': node}) AS w FROM %s GROUP BY key))"


@query("SELECT key, value, deleted, wall, logical, node FROM win", t.REPLICA_ROWS, WIN % "replica_rows")
def lww_merge(spark, d):
    return replication.last_writer(t.replica_rows(spark, d))


@query(
    "SELECT key, CASE WHEN deleted IS NULL THEN 'miss' WHEN deleted THEN 'tombstone' ELSE 'hit' END AS state, CASE WHEN NOT deleted THEN value END AS value, wall, logical, node FROM asked LEFT JOIN win USING (key)",
    t.REPLICA_ROWS, "two AS (SELECT * FROM replica_rows WHERE replica IN ('r0', 'r1'))", WIN % "two", ASKED,
)
def quorum_read(spark, d):
    return replication.quorum_read(t.replica_rows(spark, d), _asked_keys(spark, d), t.REPLICAS, 2)


TARGETS = "targets AS (SELECT w.key, n.replica, CASE WHEN r.key IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM win w CROSS JOIN (SELECT unnest(['r0', 'r1', 'r2']) AS replica) n LEFT JOIN replica_rows r ON r.key = w.key AND r.replica = n.replica WHERE r.key IS NULL OR (r.wall, r.logical, r.node) < (w.wall, w.logical, w.node))"


@query("SELECT key, replica, reason FROM targets", t.REPLICA_ROWS, WIN % "replica_rows", TARGETS)
def read_repair_targets(spark, d):
    return replication.repair_targets(t.replica_rows(spark, d), t.REPLICAS)


@query("SELECT t.replica, t.key, w.value, w.deleted, w.wall, w.logical, w.node FROM targets t JOIN win w USING (key)", t.REPLICA_ROWS, WIN % "replica_rows", TARGETS)
def repair_apply(spark, d):
    return replication.repair_rows(t.replica_rows(spark, d), t.REPLICAS)


BEST = "best AS (SELECT node, arg_max(addr, incarnation) AS addr, max(incarnation) AS incarnation, arg_max(liveness, incarnation * 10 + liveness) AS liveness FROM members GROUP BY node)"


@query(
    "SELECT node, addr, CASE WHEN node = 'node-1' AND liveness != 0 THEN incarnation + 1 ELSE incarnation END AS incarnation, CASE WHEN node = 'node-1' AND liveness != 0 THEN 0 ELSE liveness END AS liveness FROM best",
    t.MEMBERS, BEST,
)
def gossip_merge(spark, d):
    return replication.gossip(t.members(spark, d), "node-1")


# ---- the ring -------------------------------------------------------------------------------------


def _ring_sql(nodes: list[str], n: int, name: str = "owners") -> str:
    """Owners by definition: per key and node the nearest virtual node clockwise, the n nearest nodes.

    Distances along the ring are compared as (wrapped, hash).
    """
    vn = "SELECT n AS node, ('0x' || substr(md5(n || '#' || i), 1, 15))::BIGINT AS h FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in nodes) + "]) AS n) CROSS JOIN (SELECT range AS i FROM range(150))"
    return (
        f"{name} AS (SELECT key, rank, node FROM (SELECT key, node, row_number() OVER (PARTITION BY key ORDER BY near) AS rank FROM (SELECT k.key, v.node, min((CASE WHEN v.h < k.h THEN 2000000000000000000 ELSE 0 END) + v.h) AS near "
        f"FROM (SELECT key, ('0x' || substr(md5(key), 1, 15))::BIGINT AS h FROM keys) k CROSS JOIN ({vn}) v GROUP BY k.key, v.node)) WHERE rank <= {n})"
    )


KEYS = "keys AS (SELECT DISTINCT user_id::VARCHAR AS key FROM events)"


def _keys(spark, d):
    return t.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key")).distinct()


@query("SELECT key, rank, node FROM owners", KEYS, _ring_sql(t.NODES, 3))
def ring_owners(spark, d):
    return ring.owner_rows(_keys(spark, d), t.NODES, 3)


@query("SELECT node, count(*) AS keys, count(*) FILTER (rank = 1) AS primary_keys FROM owners GROUP BY node", KEYS, _ring_sql(t.NODES, 3))
def ring_balance(spark, d):
    return ring.owner_rows(_keys(spark, d), t.NODES, 3).groupBy("node").agg(F.count("*").alias("keys"), F.count_if(F.col("rank") == 1).alias("primary_keys"))


@query("SELECT a.key, a.node AS before, b.node AS after FROM one a JOIN two b USING (key) WHERE a.node != b.node", KEYS, _ring_sql(t.NODES, 1, "one"), _ring_sql([*t.NODES, "node-5"], 1, "two"))
def ring_moved_keys(spark, d):
    m = ring.moved(_keys(spark, d), t.NODES, [*t.NODES, "node-5"], 1)
    return m.select("key", F.col("owners_before")[0].alias("before"), F.col("owners_after")[0].alias("after"))


@query(
    "SELECT DISTINCT a.node AS node, b.node AS peer FROM owners a JOIN owners b USING (key) WHERE a.node != b.node", "keys AS (SELECT DISTINCT event_id::VARCHAR AS key FROM events WHERE event_id < 1000)", _ring_sql(t.NODES[:4], 2)
)
def co_replicas(spark, d):
    """Peers of each node: those that share owners of some interval of the ring."""
    return ring.co_replicas(spark, t.NODES[:4], 2)


@query("SELECT key FROM owners GROUP BY key HAVING count(*) FILTER (node IN ('node-0', 'node-3')) = 2", KEYS, _ring_sql(t.NODES, 3))
def shared_keys(spark, d):
    return ring.shared_keys(_keys(spark, d), t.NODES, 3, "node-0", "node-3")


@query(
    "SELECT key, count(*) FILTER (node != 'node-4') AS voters, count(*) FILTER (node NOT IN ('node-4', 'node-2', 'node-1')) AS acks, count(*) FILTER (node = 'node-2') AS hints, count(*) FILTER (node NOT IN ('node-4', 'node-2', 'node-1')) >= 2 AS ok FROM owners GROUP BY key",
    KEYS, _ring_sql(t.NODES, 3),
)
def write_quorum(spark, d):
    state = [(n, {"node-1": 1, "node-2": 2}.get(n, 0), 1 if n == "node-4" else 2) for n in t.NODES]
    keys = _keys(spark, d)
    return replication.write_status(keys, ring.owner_rows(keys, t.NODES, 3), spark.createDataFrame(state, "node string, liveness int, ring int"), 2)


# ---- Merkle trees ---------------------------------------------------------------------------------

CUT = "(SELECT max(epoch_us(ts)) - 86400000000 FROM events)"


def _leaf_sql(replica: str, name: str, cut: bool = False) -> str:
    grace = f" AND wall < {CUT}" if cut else ""
    return (
        f"{name} AS (SELECT ('0x' || substr(md5(key::VARCHAR), 1, 15))::BIGINT % 256 AS idx, bit_xor(('0x' || substr(md5(concat_ws('|', key::VARCHAR, wall::VARCHAR, logical::VARCHAR, node, deleted::INT::VARCHAR)), 1, 15))::BIGINT) AS hash, count(*) AS n "
        f"FROM replica_rows WHERE replica = '{replica}'{grace} GROUP BY 1)"
    )


def _side(spark, d, replica):
    return t.replica_rows(spark, d).filter(F.col("replica") == replica)


@query("SELECT idx, hash, n FROM la", t.REPLICA_ROWS, _leaf_sql("r0", "la", cut=True))
def merkle_leaves(spark, d):
    last = t.table(spark, d, "events").agg(F.max(t.micros())).first()[0]
    return merkle.leaves(_side(spark, d, "r0"), last - 86400000000)


LEVEL = "SELECT idx // 16 AS idx, ('0x' || substr(md5(string_agg(hash::VARCHAR, ',' ORDER BY idx)), 1, 15))::BIGINT AS hash FROM %s GROUP BY 1"
TREE = ("l2 AS (SELECT range AS idx, coalesce(hash, 0) AS hash FROM range(256) LEFT JOIN la ON idx = range)", f"l1 AS ({LEVEL % 'l2'})", f"l0 AS ({LEVEL % 'l1'})")


@query("SELECT 2::BIGINT AS level, idx, hash FROM l2 UNION ALL SELECT 1, idx, hash FROM l1 UNION ALL SELECT 0, idx, hash FROM l0", t.REPLICA_ROWS, _leaf_sql("r0", "la"), *TREE)
def merkle_levels(spark, d):
    return merkle.levels(merkle.leaves(_side(spark, d, "r0")))


@query("SELECT hash FROM l0", t.REPLICA_ROWS, _leaf_sql("r0", "la"), *TREE)
def merkle_root(spark, d):
    return merkle.levels(merkle.leaves(_side(spark, d, "r0"))).filter("level = 0").select("hash")


@query(
    "SELECT idx, coalesce(la.hash, 0) AS hash_a, coalesce(lb.hash, 0) AS hash_b FROM la FULL JOIN lb USING (idx) WHERE coalesce(la.hash, 0) != coalesce(lb.hash, 0)", t.REPLICA_ROWS, _leaf_sql("r0", "la"), _leaf_sql("r1", "lb")
)
def merkle_divergent(spark, d):
    return merkle.divergent(merkle.leaves(_side(spark, d, "r0")), merkle.leaves(_side(spark, d, "r1")))


PLAN = (
    "plan AS (SELECT key, CASE WHEN a.wall IS NULL OR (a.wall, a.logical, a.node) < (b.wall, b.logical, b.node) THEN 'pull' WHEN b.wall IS NULL OR (b.wall, b.logical, b.node) < (a.wall, a.logical, a.node) THEN 'push' "
    "WHEN a.value IS DISTINCT FROM b.value OR a.deleted != b.deleted THEN 'conflict' END AS action FROM (SELECT * FROM replica_rows WHERE replica = 'r0') a FULL JOIN (SELECT * FROM replica_rows WHERE replica = 'r1') b USING (key))"
)


@query("SELECT key, action FROM plan WHERE action IS NOT NULL", t.REPLICA_ROWS, PLAN)
def reconcile_plan(spark, d):
    return merkle.plan(_side(spark, d, "r0"), _side(spark, d, "r1"))


@query("SELECT key, action FROM plan WHERE action IS NOT NULL ORDER BY key LIMIT 20", t.REPLICA_ROWS, PLAN)
def reconcile_budget(spark, d):
    return merkle.budgeted(merkle.plan(_side(spark, d, "r0"), _side(spark, d, "r1")), 20)


@query("SELECT key, value, deleted, wall, logical, node FROM win", t.REPLICA_ROWS, "two AS (SELECT * FROM replica_rows WHERE replica IN ('r0', 'r1'))", WIN % "two")
def reconcile_result(spark, d):
    return merkle.reconciled(_side(spark, d, "r0"), _side(spark, d, "r1"))


@query(
    "SELECT (SELECT count(*) FROM replica_rows WHERE replica IN ('r0', 'r1')) AS scanned, (SELECT count(*) FROM la FULL JOIN lb USING (idx) WHERE coalesce(la.hash, 0) != coalesce(lb.hash, 0)) AS divergent, (SELECT count(*) FROM plan WHERE action = 'pull') AS pulls, (SELECT count(*) FROM plan WHERE action = 'push') AS pushes",
    t.REPLICA_ROWS, _leaf_sql("r0", "la"), _leaf_sql("r1", "lb"), PLAN,
)
def reconcile_stats(spark, d):
    return merkle.stats(_side(spark, d, "r0"), _side(spark, d, "r1"))


@query("SELECT key, h % 256 AS leaf, [h % 256 // 16, h % 16] AS path FROM (SELECT key, ('0x' || substr(md5(key), 1, 15))::BIGINT AS h FROM keys)", KEYS)
def merkle_paths(spark, d):
    leaf = F.pmod(hash60("key"), F.lit(256))
    return _keys(spark, d).select("key", leaf.alias("leaf"), bucket_path(leaf, 16, 2).alias("path"))


# ---- hints ----------------------------------------------------------------------------------------

NOW = "(SELECT max(epoch_us(ts)) * 1000 FROM events)"
TTL = 10 * 86400 * 10**9


def _now(spark, d):
    return t.table(spark, d, "events").agg(F.max(t.micros())).first()[0] * 1000


@query("SELECT target, count(*) AS hints, sum(size)::BIGINT AS bytes, min(wall) AS oldest FROM hints WHERE NOT tombstone GROUP BY target", t.HINTS)
def hint_pending(spark, d):
    return replication.pending_hints(t.hints(spark, d)).groupBy("target").agg(F.count("*").alias("hints"), F.sum("size").alias("bytes"), F.min("wall").alias("oldest"))


@query(f"SELECT target, key, wall, {NOW} - wall > {TTL} AS expired FROM hints WHERE NOT tombstone", t.HINTS)
def hint_ttl_purge(spark, d):
    return replication.split_expired(replication.pending_hints(t.hints(spark, d)), _now(spark, d), TTL).select("target", "key", "wall", "expired")


@query("SELECT target, key, used, used <= 2000 AS accepted FROM (SELECT *, sum(size) OVER (PARTITION BY target ORDER BY wall, logical, key ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM hints)", t.HINTS)
def hint_capacity(spark, d):
    return replication.within_capacity(t.hints(spark, d), 2000).select("target", "key", "used", "accepted")


@query(
    "SELECT target, key, greatest((row_number() OVER w - 1) // 50, coalesce(sum(size) OVER (PARTITION BY target ORDER BY wall, logical, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 400) AS batch FROM hints WHERE NOT tombstone WINDOW w AS (PARTITION BY target ORDER BY wall, logical, key)",
    t.HINTS,
)
def hint_batches(spark, d):
    return replication.hint_batches(replication.pending_hints(t.hints(spark, d)), 50, 400).select("target", "key", "batch")


@query(f"SELECT target, key, wall, logical, node, size, tombstone, 'host-' || target AS addr FROM hints WHERE NOT tombstone AND {NOW} - wall <= {TTL} AND target != 'r2'", t.HINTS)
def hint_drain(spark, d):
    members = spark.createDataFrame([(r, f"host-{r}", 2 if r == "r2" else 0) for r in t.REPLICAS], "node string, addr string, liveness int")
    return replication.drainable(t.hints(spark, d), members, _now(spark, d), TTL)


# ---- vectors --------------------------------------------------------------------------------------



def _sum_sql(terms: str) -> str:
    """Left-to-right sum, as Spark's fold adds."""
    return f"list_reduce({terms}, lambda s, x: s + x, 0.0::DOUBLE)"


def _l2_sql(a: str, b: str) -> str:
    return _sum_sql(f"list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))")


def _prod_sql(a: str, b: str) -> str:
    return _sum_sql(f"list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)")


def _cos_sql(a: str, b: str) -> str:
    norm = f"(sqrt({_prod_sql(a, a)}) * sqrt({_prod_sql(b, b)}))"
    return f"CASE WHEN {norm} = 0 THEN 0.0 ELSE 1 - {_prod_sql(a, b)} / {norm} END"


PROBE = "(SELECT vec FROM vecs WHERE id = 5)"


def _probe(spark, d):
    return list(t.vectors(spark, d).filter("id = 5").first().vec)


@query(f"SELECT id, round({_l2_sql('vec', PROBE)}, 6) AS distance FROM vecs ORDER BY {_l2_sql('vec', PROBE)}, id LIMIT 10", t.VECTORS)
def knn_l2(spark, d):
    return vectors.knn(t.vectors(spark, d), _probe(spark, d), 10, D.L2).withColumn("distance", F.round("distance", 6))


@query(f"SELECT id, round({_cos_sql('vec', PROBE)}, 6) AS distance FROM vecs ORDER BY 2, id LIMIT 10", t.VECTORS)
def knn_cosine(spark, d):
    q = F.array(*(F.lit(float(x)) for x in _probe(spark, d)))
    far = t.vectors(spark, d).select("id", F.round(D.cosine(F.col("vec"), q), 6).alias("distance"))
    return far.orderBy("distance", "id").limit(10)


@query(f"SELECT id, round(-{_prod_sql('vec', PROBE)}, 6) AS distance FROM vecs ORDER BY -{_prod_sql('vec', PROBE)}, id LIMIT 10", t.VECTORS)
def knn_ip(spark, d):
    return vectors.knn(t.vectors(spark, d), _probe(spark, d), 10, D.INNER).withColumn("distance", F.round("distance", 6))


@query(f"SELECT id, round({_l2_sql('vec', PROBE)}, 6) AS distance FROM vecs WHERE label = 3 ORDER BY {_l2_sql('vec', PROBE)}, id LIMIT 10", t.VECTORS)
def knn_filtered(spark, d):
    return vectors.knn(t.vectors(spark, d).filter("label = 3"), _probe(spark, d), 10).withColumn("distance", F.round("distance", 6))


BATCHED = f"near AS (SELECT q.id AS qid, row_number() OVER (PARTITION BY q.id ORDER BY {_l2_sql('b.vec', 'q.vec')}, b.id) AS rank, b.id AS id, {_l2_sql('b.vec', 'q.vec')} AS distance FROM vecs b CROSS JOIN (SELECT * FROM vecs WHERE id % 50 = 0) q)"


@query("SELECT qid, rank, id, round(distance, 6) AS distance FROM near WHERE rank <= 10", t.VECTORS, BATCHED)
def knn_batch(spark, d):
    v = t.vectors(spark, d)
    return vectors.knn_batch(v, _asked(v), 10).withColumn("distance", F.round("distance", 6))


@query("SELECT id, wall, logical, deleted, list_sum(list_transform(vec, lambda x: x::DOUBLE)) IS NOT NULL AS has_vec, round(vec[1]::DOUBLE, 6) AS first FROM vlatest", t.VECTOR_ROWS)
def vector_put_resolve(spark, d):
    return vectors.latest(t.vector_rows(spark, d)).select("id", "wall", "logical", "deleted", F.col("vec").isNotNull().alias("has_vec"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("SELECT range AS id, id IS NOT NULL AS found, coalesce(deleted, false) AS deleted, wall, logical FROM range(0, (SELECT 2 * max(vec_id) FROM embeddings), 13) LEFT JOIN vlatest ON id = range", t.VECTOR_ROWS)
def vector_get_latest(spark, d):
    last = t.table(spark, d, "embeddings").agg(F.max("vec_id")).first()[0]
    return vectors.get_latest(t.vector_rows(spark, d), spark.range(0, 2 * last, 13))


@query(
    f"SELECT id, round({_l2_sql('vec', PROBE)}, 6) AS distance FROM vlatest WHERE NOT deleted AND id IN (SELECT id FROM vecs ORDER BY {_l2_sql('vec', PROBE)}, id LIMIT 20) ORDER BY {_l2_sql('vec', PROBE)}, id LIMIT 10", t.VECTOR_ROWS
)
def vector_search_verified(spark, d):
    found = vectors.search_verified(t.vectors(spark, d), t.vector_rows(spark, d), _probe(spark, d), 10)
    return found.withColumn("distance", F.round("distance", 6))


DIST = (
    "own AS (SELECT replica, id, w.* FROM (SELECT replica, id, arg_max({'vec': vec, 'wall': wall, 'logical': logical, 'deleted': deleted}, wall * 10 + logical) AS w FROM vreps GROUP BY replica, id))",
    f"picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY {_l2_sql('vec', PROBE)}, id) AS n FROM own WHERE NOT deleted) WHERE n <= 40)",
    "merged AS (SELECT id, w.* FROM (SELECT id, arg_max({'vec': vec, 'wall': wall, 'logical': logical}, wall * 10 + logical) AS w FROM picked GROUP BY id))",
    "known AS (SELECT id, w.* FROM (SELECT id, arg_max({'vec': vec, 'wall': wall, 'logical': logical, 'deleted': deleted}, wall * 10 + logical) AS w FROM vreps GROUP BY id))",
    "checked AS (SELECT m.id, CASE WHEN (k.wall, k.logical) > (m.wall, m.logical) THEN k.vec ELSE m.vec END AS vec FROM merged m JOIN known k USING (id) WHERE NOT ((k.wall, k.logical) > (m.wall, m.logical) AND k.deleted))",
)


@query(f"SELECT id, round({_l2_sql('vec', PROBE)}, 6) AS distance FROM checked ORDER BY {_l2_sql('vec', PROBE)}, id LIMIT 10", t.VECTOR_REPLICAS, *DIST)
def distributed_vector_search(spark, d):
    return vectors.distributed_search(t.vector_replicas(spark, d), _probe(spark, d), 10).withColumn("distance", F.round("distance", 6))


@query(
    "SELECT w.id, n.replica, CASE WHEN o.id IS NULL THEN 'missing' ELSE 'stale' END AS reason FROM (SELECT id, max(wall * 10 + logical) AS v FROM vreps GROUP BY id) w CROSS JOIN (SELECT unnest(['r0', 'r1', 'r2']) AS replica) n LEFT JOIN (SELECT replica, id, max(wall * 10 + logical) AS v FROM vreps GROUP BY ALL) o ON o.id = w.id AND o.replica = n.replica WHERE o.id IS NULL OR o.v < w.v",
    t.VECTOR_REPLICAS,
)
def vector_repair_targets(spark, d):
    return vectors.stale_copies(t.vector_replicas(spark, d), t.REPLICAS)


@query(
    "SELECT id, CASE WHEN h.wall IS NOT NULL AND coalesce(l.deleted, true) THEN 'remove' WHEN h.wall IS NULL AND NOT l.deleted THEN 'insert' WHEN NOT l.deleted AND (l.wall, l.logical) > (h.wall, h.logical) THEN 'update' END AS action FROM vlatest l FULL JOIN (SELECT id, wall, logical FROM vrows WHERE wall = 1 AND id % 4 != 0 UNION ALL SELECT 1000000, 1, 0) h USING (id) WHERE action IS NOT NULL",
    t.VECTOR_ROWS,
)
def vector_index_reconcile(spark, d):
    rows = t.vector_rows(spark, d)
    index = rows.filter("wall = 1 and id % 4 != 0").select("id", "wall", "logical").unionByName(spark.createDataFrame([(1000000, 1, 0)], "id long, wall long, logical long"))
    return vectors.reconcile_index(index, rows)


@query(
    "SELECT id FROM incoming WHERE id IN (SELECT id FROM vlatest WHERE NOT deleted) OR id IN (SELECT id FROM incoming WHERE id NOT IN (SELECT id FROM vlatest WHERE NOT deleted) ORDER BY id LIMIT (SELECT greatest((SELECT count(*) FROM embeddings) - count(*), 0) FROM vlatest WHERE NOT deleted))",
    t.VECTOR_ROWS, "incoming AS (SELECT unnest(range((max(vec_id) * 9) // 10, max(vec_id) * 2)) AS id FROM embeddings)",
)
def vector_limit(spark, d):
    """Which of some writes, a tenth of them updates, a collection takes that may hold as many vectors as there ever were."""
    size, last = t.table(spark, d, "embeddings").agg(F.count("*"), F.max("vec_id")).first()
    return vectors.admitted(t.vector_rows(spark, d), spark.range(last * 9 // 10, 2 * last), size)


@query(
    "SELECT label, dim, ('0x' || substr(md5(concat_ws('|', dim::VARCHAR, '1', '16', '200')), 1, 15))::BIGINT AS digest, n FROM (SELECT label, len(vec) AS dim, count(*) AS n FROM vecs GROUP BY ALL)", t.VECTORS
)
def collection_digest(spark, d):
    g = t.vectors(spark, d).groupBy("label", F.size("vec").cast("long").alias("dim")).agg(F.count("*").alias("n"))
    return g.select("label", "dim", config_digest(F.col("dim"), F.lit(1), F.lit(16), F.lit(200)).alias("digest"), "n")


# ---- evaluation -----------------------------------------------------------------------------------


def _asked(v):
    """The query set of approximate searches: a fiftieth of all rows, at every size."""
    return v.filter("id % 50 = 0").select(F.col("id").alias("qid"), "vec")


def _truth(v, asked, k=10):
    return evaluation.neighbors(vectors.knn_batch(v, asked, k))


@query(
    "SELECT a.qid, len(list_intersect(a.ids, b.ids)) / 10 AS recall FROM (SELECT qid, list(id) AS ids FROM near WHERE rank <= 10 GROUP BY qid) a JOIN (SELECT qid, list(id) AS ids FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS r FROM near WHERE id % 3 != 0) WHERE r <= 10 GROUP BY qid) b USING (qid)",
    t.VECTORS, BATCHED,
)
def recall_at_k(spark, d):
    v = t.vectors(spark, d)
    asked = _asked(v)
    found = evaluation.neighbors(vectors.knn_batch(v.filter("id % 3 != 0"), asked, 10))
    return evaluation.recall(_truth(v, asked), found, 10)


@query()
def sweep_table(spark, d):
    """Mean recall of IVF for some numbers of probed cells."""
    v = t.vectors(spark, d)
    asked = _asked(v)
    truth, out = written(_truth(v, asked), "truth"), None
    for probes in (1, 4, 16):
        found = evaluation.neighbors(ann.ivf_search(v, asked, 10, cells=16, probes=probes))
        row = evaluation.recall(truth, found, 10).agg(F.round(F.avg("recall"), 6).alias("mean_recall"), F.count("*").alias("queries")).withColumn("probes", F.lit(probes))
        out = row if out is None else out.unionByName(row)
    return out


def _rank_sql(p: float, rule: str) -> str:
    index = f"least(floor({p} * count(*))::BIGINT, count(*) - 1)" if rule == "floor" else f"floor((count(*) - 1) * {p})::BIGINT"
    return f"list_sort(list(latency_ns))[{index} + 1]"


@query("SELECT op, " + ", ".join(f"{_rank_sql(p, 'floor')} AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99))) + " FROM ops GROUP BY op", t.OPS)
def latency_percentiles(spark, d):
    return evaluation.nearest_rank(t.op_log(spark, d), ["op"], "latency_ns", [0.5, 0.95, 0.99])


@query("SELECT op, " + ", ".join(f"{_rank_sql(p, 'linear')} AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99))) + " FROM ops GROUP BY op", t.OPS)
def latency_percentiles_linear(spark, d):
    return evaluation.nearest_rank(t.op_log(spark, d), ["op"], "latency_ns", [0.5, 0.95, 0.99], "linear")


@query("SELECT op, count(*) AS n, count(*) FILTER (NOT ok) AS errors, round((max(start_ns + latency_ns) - min(start_ns)) / 1e9, 3) AS seconds, round(count(*) / ((max(start_ns + latency_ns) - min(start_ns)) / 1e9), 6) AS per_second FROM ops GROUP BY op", t.OPS)
def op_throughput(spark, d):
    return evaluation.throughput(t.op_log(spark, d)).withColumn("seconds", F.round("seconds", 3)).withColumn("per_second", F.round("per_second", 6))


DAY = 86400 * 10**9


@query(
    f"SELECT bucket, n, errors, CASE WHEN bucket * {DAY} < lo + 10 * {DAY} THEN 'before' WHEN bucket * {DAY} < lo + 20 * {DAY} THEN 'outage' ELSE 'after' END AS phase FROM (SELECT start_ns // {DAY} AS bucket, count(*) AS n, count(*) FILTER (NOT ok) AS errors FROM ops GROUP BY 1) CROSS JOIN (SELECT min(start_ns) AS lo FROM ops)",
    t.OPS,
)
def throughput_timeline(spark, d):
    ops = t.op_log(spark, d)
    first = ops.agg(F.min("start_ns")).first()[0]
    return evaluation.timeline(ops, DAY, first + 10 * DAY, first + 20 * DAY)


@query(
    "SELECT bucket, CASE WHEN bucket < 12 THEN 1000000.0::DOUBLE * pow(2.0, bucket) END AS upto, count(*) AS n FROM (SELECT len(list_filter([1000000.0 * pow(2.0, i) for i in range(12)], lambda b: latency_ns > b)) AS bucket FROM ops) GROUP BY bucket",
    t.OPS,
)
def latency_histogram(spark, d):
    return evaluation.histogram(t.op_log(spark, d), "latency_ns", 1e6, 2.0, 12)


UNIT = "((('0x' || substr(md5(concat_ws('|', i::VARCHAR, '1', '%s')), 1, 15))::BIGINT >> 8) / 4503599627370496.0::DOUBLE)"


@query(
    "SELECT mix, zipf_s, op, count(*) AS n, count(DISTINCT least(idx, 999)) AS keys FROM (SELECT mix, zipf_s, CASE WHEN uo < reads THEN 'get' ELSE 'put' END AS op, (CASE WHEN zipf_s > 1 THEN floor(pow(1 + uk * (pow(1000.0::DOUBLE, 1.0 - zipf_s) - 1), 1 / (1.0 - zipf_s))) - 1 ELSE floor(uk * 1000) END)::BIGINT AS idx "
    f"FROM (SELECT i, {UNIT % 'key'} AS uk, {UNIT % 'op'} AS uo FROM (SELECT range AS i FROM range((SELECT count(*) FROM events)))) CROSS JOIN (VALUES ('A', 0.5), ('B', 0.95), ('C', 1.0)) m(mix, reads) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 1.2::DOUBLE]) AS zipf_s)) GROUP BY mix, zipf_s, op"
)
def ycsb_operations(spark, d):
    """Operations and distinct keys of the three mixes, as many as there are events, uniform and Zipf."""
    n, out = t.table(spark, d, "events").count(), None
    for mix in workload.MIXES:
        for s in (0.0, 1.2):
            ops = workload.operations(spark, n, 1000, mix, s).groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))
            ops = ops.select(F.lit(mix).alias("mix"), F.lit(s).alias("zipf_s"), "op", "n", "keys")
            out = ops if out is None else out.unionByName(ops)
    return out


@query("SELECT 'key-' || lpad(user_id::VARCHAR, 16, '0') AS key, count(*) AS n FROM events GROUP BY 1")
def workload_keys(spark, d):
    return t.table(spark, d, "events").groupBy(workload.make_key(F.col("user_id")).alias("key")).agg(F.count("*").alias("n"))


# ---- approximate search, files, streams -----------------------------------------------------------


@query()
def ann_ivf_search(spark, d):
    v = t.vectors(spark, d)
    return ann.ivf_search(v, _asked(v), 10, cells=16, probes=12)


@query()
def ann_hnsw_search(spark, d):
    v = t.vectors(spark, d)
    return ann.hnsw_search(v, _asked(v), 10)


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS id, len(vec) AS dim, round(vec[1]::DOUBLE, 6) AS first FROM vecs", t.VECTORS)
def fvecs_roundtrip(spark, d):
    path = folder(spark, "vectors") + ".fvecs"
    vectors_file.write_vectors(t.vectors(spark, d), path)
    spark.dataSource.register(vectors_file.VectorsFile)
    back = spark.read.format("vecs").option("kind", "f").load(path)
    return back.select("id", F.size("vec").cast("long").alias("dim"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query(
    "SELECT file, pos, key, seq, value, tombstone FROM (SELECT *, event_id // 100 AS file, event_id % 100 AS pos FROM (SELECT event_id, user_id AS key, event_id AS seq, value, event_type = 'error' AS tombstone FROM events)) WHERE pos < 50 + file % 50"
)
def log_recover(spark, d):
    """Log lines, each file damaged at one line: what replay recovers."""
    log = t.version_log(spark, d).withColumn("file", F.floor(F.col("seq") / 100)).withColumn("pos", F.col("seq") % 100)
    lines = log_files.encode_lines(log)
    torn = lines.withColumn("line", F.when(F.col("pos") == 50 + F.col("file") % 50, F.expr("substring(line, 1, length(line) - 3)")).otherwise(F.col("line")))
    return log_files.recover(torn)


@query("SELECT file, level, first_key FROM (SELECT file, arg_max({'action': action, 'level': level, 'first_key': first_key}, pos) AS r FROM (SELECT event_id AS pos, user_id AS file, CASE event_type WHEN 'error' THEN 'remove' ELSE 'add' END AS action, event_id % 4 AS level, value AS first_key FROM events) GROUP BY file) CROSS JOIN LATERAL (SELECT r.level, r.first_key) WHERE r.action = 'add'")
def manifest_state(spark, d):
    e = t.table(spark, d, "events")
    return log_files.last_state(e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("file"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), (F.col("event_id") % 4).alias("level"), F.col("value").alias("first_key")))


@query("SELECT key, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone FROM log GROUP BY key", t.LOG)
def stream_latest(spark, d):
    e = views.events_stream(spark, f"{d}/events.parquet")
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("tombstone"))
    changes = views.drain(views.latest_values(log), "update", "latest")
    return versions.newest(changes.drop("batch"))


@query("SELECT start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start, event_type FROM events) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) GROUP BY start, event_type")
def stream_tumbling(spark, d):
    """Windows that the watermark closed; the last ones stay open."""
    out = views.drain(views.tumbling_counts(views.events_stream(spark, f"{d}/events.parquet"), "1 hour", "10 minutes"), "append", "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "SELECT start, event_type, count(*) AS n FROM (SELECT date_trunc('hour', ts) AS start, event_type FROM events WHERE event_id % 10 != 0) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_id % 10 != 0) GROUP BY start, event_type"
)
def stream_late_drop(spark, d):
    """Every tenth event comes last: in windows closed by then it is dropped.

    Lateness is judged by the watermark of the batch before the last, so the rest comes in two files.
    """
    path = folder(spark, "late")
    e = t.table(spark, d, "events")
    last = e.agg(F.max("ts").alias("m"))
    # of the last file, only events long before the end, so that all of their windows are closed
    late = e.filter("event_id % 10 = 0").join(F.broadcast(last), F.col("ts") < F.col("m") - F.expr("INTERVAL 3 HOURS")).drop("m")
    for part in (e.filter("event_id % 10 > 1"), e.filter("event_id % 10 = 1"), late):
        part.coalesce(1).write.mode("append").parquet(path)
    out = views.drain(views.tumbling_counts(views.events_stream(spark, path, 1), "1 hour", "10 minutes"), "append", "late")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT node, ts + INTERVAL 6 HOUR AS suspect_at FROM (SELECT 'user-' || user_id AS node, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM events) WHERE next - ts > INTERVAL 6 HOUR OR (next IS NULL AND ts + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events))")
def suspect_timeout(spark, d):
    """When users' heartbeats stayed away for six hours."""
    e = views.events_stream(spark, f"{d}/events.parquet")
    beats = e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("node"), "ts")
    out = views.drain(views.suspects(beats, 6 * 3600, "1 minute"), "append", "suspects")
    return out.select("node", F.col("suspect_at").cast("timestamp_ntz").alias("suspect_at"))


@query()
def ann_graph_snapshot(spark, d):
    """Graphs written, read back, and searched without the ids that were deleted since."""
    v = t.vectors(spark, d)
    path = folder(spark, "graphs")
    ann.build_graphs(v).write.parquet(path)
    return ann.search_graphs(spark.read.parquet(path), _asked(v), 10, removed=v.filter("id % 13 = 0").select("id"))


@query(
    "SELECT t.replica, l.id, l.wall, l.logical, l.deleted, round(l.vec[1]::DOUBLE, 6) AS first FROM (SELECT w.id, n.replica FROM (SELECT id, max(wall * 10 + logical) AS v FROM vreps GROUP BY id) w CROSS JOIN (SELECT unnest(['r0', 'r1', 'r2']) AS replica) n LEFT JOIN (SELECT replica, id, max(wall * 10 + logical) AS v FROM vreps GROUP BY ALL) o ON o.id = w.id AND o.replica = n.replica WHERE o.id IS NULL OR o.v < w.v) t "
    "JOIN (SELECT id, w.* FROM (SELECT id, arg_max({'vec': vec, 'wall': wall, 'logical': logical, 'deleted': deleted}, wall * 10 + logical) AS w FROM vreps GROUP BY id)) l USING (id)",
    t.VECTOR_REPLICAS,
)
def vector_repair_rows(spark, d):
    rows = vectors.repair_rows(t.vector_replicas(spark, d), t.REPLICAS)
    return rows.select("replica", "id", "wall", "logical", "deleted", F.round(F.col("vec")[0].cast("double"), 6).alias("first"))


@query("SELECT 3::BIGINT AS version, 'node-' || i AS node, 'addr-' || i AS addr, 2 AS ring FROM (SELECT unnest(generate_series(0, (SELECT min(user_id) FROM events) + 1)) AS i)")
def ring_admin(spark, d):
    """A ring of one node that a second joins and is activated in, each step checked against its version."""
    first = t.table(spark, d, "events").agg(F.min("user_id")).first()[0]
    ring_now = spark.createDataFrame([(1, f"node-{first}", f"addr-{first}", replication.ACTIVE)], catalog.RING)
    joined = catalog.change_ring(ring_now, 1, f"node-{first + 1}", "join", f"addr-{first + 1}")
    return catalog.change_ring(joined, 2, f"node-{first + 1}", "activate")


@query("SELECT label AS name, max(len(vec)) AS dim, 1 AS metric, 16 AS m, 200 AS ef_construct, 50 AS ef_search, 0::BIGINT AS max_vectors FROM (SELECT 'label-' || label AS label, vec FROM vecs) GROUP BY label", t.VECTORS)
def collection_catalog(spark, d):
    now = spark.createDataFrame([], catalog.COLLECTION)
    rows = t.vectors(spark, d).groupBy("label").agg(F.max(F.size("vec")).alias("dim")).orderBy("label").collect()  # one row a collection
    for r in rows:
        now = catalog.create_collection(now, f"label-{r.label}", r.dim, D.L2)
    return now


@query(
    "SELECT node, liveness, ring, CASE ring WHEN 1 THEN 'learner' ELSE 'voter' END AS role, liveness != 2 AS routable, liveness = 0 AS alive FROM (SELECT node, arg_max(liveness, incarnation * 10 + liveness) AS liveness, (max(incarnation) % 3)::BIGINT AS ring FROM members GROUP BY node)",
    t.MEMBERS,
)
def member_roles(spark, d):
    best = replication.gossip(t.members(spark, d)).select("node", "liveness", (F.col("incarnation") % 3).alias("ring"))
    return catalog.roles(best)


@query("SELECT max(event_id) + 1 AS next_seq FROM events")
def next_sequence(spark, d):
    return spark.createDataFrame([(versions.next_sequence(t.version_log(spark, d)),)], "next_seq long")


@query(
    "SELECT op, day, ops FROM (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ops, day) AS n, count(*) OVER (PARTITION BY op) AS c FROM (SELECT op, start_ns // 86400000000000 AS day, count(*) * 1000 + (start_ns // 86400000000000) % 1000 AS ops FROM ops GROUP BY op, day)) WHERE n = (c + 1) // 2",
    t.OPS,
)
def median_of_runs(spark, d):
    """Of each operation's days, the one with the median count (made unique by the day)."""
    daily = t.op_log(spark, d).groupBy("op", F.floor(F.col("start_ns") / F.lit(DAY)).alias("day")).agg(F.count("*").alias("n"))
    return evaluation.median_run(daily.select("op", "day", (F.col("n") * 1000 + F.col("day") % 1000).alias("ops")), ["op"], "ops")


@query("SELECT w.wall, w.logical, w.node FROM (SELECT max({'wall': wall, 'logical': logical, 'node': node}) AS w FROM replica_rows)", t.REPLICA_ROWS)
def batch_stamp(spark, d):
    return replication.newest_stamp(t.replica_rows(spark, d))


@query("SELECT target, key, wall FROM hints QUALIFY row_number() OVER (PARTITION BY target, key ORDER BY wall) = 1", t.HINTS)
def stream_hints(spark, d):
    """Hints from a stream, each (target, key) once."""
    path = folder(spark, "hints")
    t.hints(spark, d).withColumn("ts", F.timestamp_micros(F.expr("wall div 1000"))).write.parquet(path)
    out = views.drain(views.unexpired(views.events_stream(spark, path), "1 day").select("target", "key", "wall"), "append", "hints")
    return out.drop("batch")

from . import cluster_queries, storage_queries  # noqa: E402, F401  they register their queries
