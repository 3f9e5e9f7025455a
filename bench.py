"""Headline queries, timed on the tables in $BENCH_SF_DIR; prints one JSON line.

Each query is run to a full materialisation (Spark's no-op sink); the first run warms up, the best of two
more counts. The "scaled" section times some of them on copies of the tables under new keys (``EVENTS``
times the events, ``VECTORS`` times the embeddings), so that work and not job overhead is measured;
set-oriented equivalents of published rates come from there.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import functions as F
from tessella.plans import queries as plans
from tessella.plans import tables
from tessella.session import session

HEADLINE = [
    "snapshot_scan", "point_get_states", "range_scan", "prefix_scan", "snapshot_multi", "tx_overlay_scan", "tx_conflicts", "merge_runs", "compact_gc", "compact_lineitem", "overlap_pick", "hlc_now", "lww_merge",
    "quorum_read", "read_repair_targets", "ring_owners", "ring_moved_keys", "merkle_leaves", "merkle_levels", "reconcile_plan", "hint_batches", "knn_l2", "knn_batch", "vector_search_verified",
    "distributed_vector_search", "recall_at_k", "latency_percentiles", "ann_ivf_search",
]
SCALED = ["snapshot_scan", "point_get_states", "compact_gc", "lww_merge", "quorum_read", "merkle_leaves", "reconcile_plan", "knn_batch"]
EVENTS, VECTORS = 100, 25


def timed(spark, name: str, sf_dir: str) -> float:
    began = time.perf_counter()
    plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def scaled(spark, sf_dir: str, to: str) -> None:
    """The tables of ``sf_dir`` with many times the events and embeddings, each copy under keys of its own."""
    for name in os.listdir(sf_dir):
        os.symlink(os.path.join(os.path.abspath(sf_dir), name), os.path.join(to, name))
    for name, times, keys in (("events", EVENTS, ["event_id", "user_id"]), ("embeddings", VECTORS, ["vec_id"])):
        os.unlink(f"{to}/{name}.parquet")
        rows = tables.table(spark, sf_dir, name)
        spans = rows.agg(*(F.max(k).alias(k) for k in keys)).first()
        copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))
        copies.withColumns({k: F.col(k) + F.col("copy") * (spans[k] + 1) for k in keys}).drop("copy").write.parquet(f"{to}/{name}.parquet")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    work = tempfile.mkdtemp(prefix="tessella-bench-")
    spark = session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{work}/shared"})
    spark.sparkContext.setLogLevel("ERROR")
    try:
        took = {}
        for name in HEADLINE:
            timed(spark, name, sf_dir)
            took[name] = round(min(timed(spark, name, sf_dir) for _ in range(2)), 3)
        large = f"{work}/tables"
        os.makedirs(large)
        scaled(spark, sf_dir, large)
        more = {name: round(min(timed(spark, name, large) for _ in range(2)), 3) for name in SCALED}
        events, vectors = (tables.table(spark, large, name).count() for name in ("events", "embeddings"))
        asked = plans._asked_keys(spark, large).count()
        rates = {
            "snapshot_scan_rows_per_s": round(events / more["snapshot_scan"]),
            "point_keys_per_s": round(asked / more["point_get_states"]),
            "knn_pairs_per_s": round(-(-vectors // 50) * vectors / more["knn_batch"]),
            "quorum_rows_per_s": round(3 * events / more["quorum_read"]),
            "reconcile_rows_per_s": round(2 * events / more["reconcile_plan"]),
        }
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)
    out = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "scaled": more, "scaled_rows": {"events": events, "embeddings": vectors, "asked_keys": asked}, "rates": rates}
    print(json.dumps(out | {"sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
