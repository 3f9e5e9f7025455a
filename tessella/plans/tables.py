"""The derived tables that queries run on, each as a DataFrame and as the SQL of a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = [f"node-{i}" for i in range(5)]
REPLICAS = ["r0", "r1", "r2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def last_event(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a version log: a user's values, deleted by error events."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("tombstone"))


LOG = "log AS (SELECT user_id AS key, event_id AS seq, value, event_type = 'error' AS tombstone FROM events)"
HALF = "(SELECT max(event_id) // 2 FROM events)"


def micros(c: str = "ts"):
    return F.unix_micros(F.col(c).cast("timestamp"))


def replica_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of the events; copy r lost every event whose id is a multiple of 11 + r."""
    e = table(spark, sf_dir, "events")
    parts = None
    for r, name in enumerate(REPLICAS):
        own = e.filter(F.col("event_id") % (11 + r) != 0).select(
            F.lit(name).alias("replica"), F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("deleted"),
            micros().alias("wall"), (F.col("event_id") % 4).alias("logical"), F.concat(F.lit("node-"), (F.col("event_id") % 5).cast("string")).alias("node"),
        )
        newest = own.groupBy("replica", "key").agg(F.max_by(F.struct("value", "deleted", "wall", "logical", "node"), F.struct("wall", "logical", "node")).alias("w")).select("replica", "key", "w.*")
        parts = newest if parts is None else parts.unionByName(newest)
    return parts


REPLICA_ROWS = "copies AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS replica, user_id AS key, value, event_type = 'error' AS deleted, epoch_us(ts) AS wall, event_id % 4 AS logical, 'node-' || (event_id % 5) AS node FROM events WHERE event_id % {11 + r} != 0"
    for r, name in enumerate(REPLICAS)
) + "), replica_rows AS (SELECT replica, key, w.* FROM (SELECT replica, key, arg_max({'value': value, 'deleted': deleted, 'wall': wall, 'logical': logical, 'node': node}, {'wall': wall, 'logical': logical, 'node': node}) AS w FROM copies GROUP BY replica, key))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with lengths that differ, so that metrics rank differently, and one zero vector."""
    e = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: (x * (1 + F.col("vec_id") % 7).cast("float")).cast("float"))
    zero = F.transform("embedding", lambda x: F.lit(0.0).cast("float"))
    return e.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") == 3, zero).otherwise(scaled).alias("vec"), F.col("label").cast("long").alias("label"))


VECTORS = "vecs AS (SELECT vec_id AS id, CASE WHEN vec_id = 3 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE list_transform(embedding, lambda x: (x * (1 + vec_id % 7)::FLOAT)::FLOAT) END AS vec, label::BIGINT AS label FROM embeddings)"


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of the vectors: each once, every fifth updated (reversed), every thirteenth deleted."""
    v = vectors(spark, sf_dir).select("id", "vec")
    at = lambda wall, deleted, vec: (vec, F.lit(wall).cast("long").alias("wall"), (F.col("id") % 3).alias("logical"), F.lit(deleted).alias("deleted"))
    return (
        v.select("id", *at(1, False, F.col("vec")))
        .unionByName(v.filter("id % 5 = 0").select("id", *at(2, False, F.reverse("vec").alias("vec"))))
        .unionByName(v.filter("id % 13 = 0").select("id", *at(3, True, F.col("vec"))))
    )


VECTOR_ROWS = VECTORS + """, vrows AS (
  SELECT id, vec, 1::BIGINT AS wall, id % 3 AS logical, false AS deleted FROM vecs
  UNION ALL SELECT id, list_reverse(vec), 2, id % 3, false FROM vecs WHERE id % 5 = 0
  UNION ALL SELECT id, vec, 3, id % 3, true FROM vecs WHERE id % 13 = 0),
vlatest AS (SELECT id, w.* FROM (SELECT id, arg_max({'vec': vec, 'wall': wall, 'logical': logical, 'deleted': deleted}, wall * 10 + logical) AS w FROM vrows GROUP BY id))"""


def vector_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector rows on three replicas; replica r lacks rows with (id + wall) a multiple of 5 + r."""
    rows = vector_rows(spark, sf_dir)
    out = None
    for r, name in enumerate(REPLICAS):
        own = rows.filter((F.col("id") + F.col("wall")) % (5 + r) != 0).withColumn("replica", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


VECTOR_REPLICAS = VECTOR_ROWS + ", vreps AS (" + " UNION ALL ".join(f"SELECT '{n}' AS replica, * FROM vrows WHERE (id + wall) % {5 + r} != 0" for r, n in enumerate(REPLICAS)) + ")"


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the replicas lost, as hints for them; ``wall`` in nanoseconds."""
    e = table(spark, sf_dir, "events")
    out = None
    for r, name in enumerate(REPLICAS):
        own = e.filter(F.col("event_id") % (11 + r) == 0).select(
            F.lit(name).alias("target"), (micros() * 1000).alias("wall"), (F.col("event_id") % 4).alias("logical"), F.concat(F.lit("node-"), (F.col("event_id") % 5).cast("string")).alias("node"),
            F.col("event_id").alias("key"), F.length("props").cast("long").alias("size"), (F.col("event_type") == "error").alias("tombstone"),
        )
        out = own if out is None else out.unionByName(own)
    return out


HINTS = "hints AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS target, epoch_us(ts) * 1000 AS wall, event_id % 4 AS logical, 'node-' || (event_id % 5) AS node, event_id AS key, length(props) AS size, event_type = 'error' AS tombstone FROM events WHERE event_id % {11 + r} = 0"
    for r, n in enumerate(REPLICAS)
) + ")"


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").otherwise("put")
    return e.select((F.col("user_id") % 8).alias("worker"), op.alias("op"), (micros() * 1000).alias("start_ns"), F.floor(F.col("value") * 1e6).alias("latency_ns"), (F.col("event_type") != "error").alias("ok"))


OPS = "ops AS (SELECT user_id % 8 AS worker, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'get' ELSE 'put' END AS op, epoch_us(ts) * 1000 AS start_ns, floor(value * 1e6)::BIGINT AS latency_ns, event_type != 'error' AS ok FROM events)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member reports as gossip would carry them."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("node-"), (F.col("user_id") % 5).cast("string")).alias("node"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 5).cast("string")).alias("addr"), F.floor(F.col("event_id") / 1000).alias("incarnation"), (F.col("event_id") % 3).alias("liveness"))


MEMBERS = "members AS (SELECT 'node-' || (user_id % 5) AS node, '10.0.0.' || (user_id % 5) AS addr, event_id // 1000 AS incarnation, event_id % 3 AS liveness FROM events)"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log cut into files of four levels, with their key ranges and sizes."""
    e = table(spark, sf_dir, "events")
    level = F.col("event_id") % 4
    span = F.when(level == 0, F.floor(F.col("event_id") / 500)).otherwise(F.floor(F.col("user_id") / (60 / F.pow(F.lit(2), level))))
    return e.groupBy(level.alias("level"), span.cast("long").alias("part")).agg(F.min("user_id").alias("first_key"), F.max("user_id").alias("last_key"), F.sum(F.length("props")).cast("long").alias("bytes")).select(
        "level", (F.col("level") * 100000 + F.col("part")).alias("file"), "first_key", "last_key", "bytes"
    )


FILES = "files AS (SELECT level, level * 100000 + part AS file, first_key, last_key, bytes FROM (SELECT event_id % 4 AS level, (CASE WHEN event_id % 4 = 0 THEN event_id // 500 ELSE floor(user_id / (60 / pow(2, event_id % 4))) END)::BIGINT AS part, min(user_id) AS first_key, max(user_id) AS last_key, sum(length(props))::BIGINT AS bytes FROM events GROUP BY ALL))"
