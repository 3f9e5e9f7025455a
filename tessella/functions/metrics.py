"""Metrics of a DataFrame that is being written, without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation whose ``get`` holds the metrics (and rows) after the first action."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())), seen


def states(df: DataFrame, column: str = "state") -> tuple[DataFrame, Observation]:
    """Counts of hit, tombstone and miss of a point read."""
    return observed(df, **{s: F.count_if(F.col(column) == s) for s in ("hit", "tombstone", "miss")})


#: The series of a running cluster: name, kind and what it counts.
SERIES = {
    "kv_writes_total": ("counter", "writes by operation and status"),
    "kv_reads_total": ("counter", "reads by status"),
    "kv_write_latency_seconds": ("histogram", "latency of writes by operation"),
    "kv_read_latency_seconds": ("histogram", "latency of reads"),
    "compactions_total": ("counter", "finished compactions"),
    "run_count": ("gauge", "live runs by level"),
    "hint_drain_batches_total": ("counter", "replayed batches of hints by status"),
    "rpc_duration_seconds": ("histogram", "duration of replica requests by method"),
    "ae_reconciles_started_total": ("counter", "reconciliations by cause"),
    "ae_reconciles_completed_total": ("counter", "reconciliations by outcome"),
    "ae_divergent_leaves_total": ("counter", "leaves that differed"),
    "ae_keys_repaired_total": ("counter", "keys repaired by direction"),
    "ae_keys_scanned_total": ("counter", "keys read for trees"),
    "ae_reconcile_duration_seconds": ("histogram", "duration of reconciliations"),
    "ae_in_flight": ("gauge", "reconciliations that run"),
}
#: Upper bounds of the latency buckets in seconds: doubling from 0.1 ms.
BOUNDS = [0.0001 * 2**i for i in range(16)]


def samples(rows: DataFrame, name: str, labels: dict[str, Column], value: Column | None = None) -> DataFrame:
    """(name, labels, value) of a counter or gauge: ``value`` summed, or rows counted, for each set of labels."""
    if SERIES[name][0] == "histogram":
        raise ValueError(f"{name} is a histogram")
    text = F.concat_ws(",", *(F.concat(F.lit(k + "="), c.cast("string")) for k, c in labels.items()))
    total = F.count("*") if value is None else F.sum(value)
    return rows.groupBy(text.alias("labels")).agg(total.cast("double").alias("value")).select(F.lit(name).alias("name"), "labels", "value")


def histogram_samples(rows: DataFrame, name: str, labels: dict[str, Column], seconds: Column) -> DataFrame:
    """(name_bucket, labels with le, value): cumulative counts up to each bound, and all rows under +Inf."""
    if SERIES[name][0] != "histogram":
        raise ValueError(f"{name} is no histogram")
    text = F.concat_ws(",", *(F.concat(F.lit(k + "="), c.cast("string")) for k, c in labels.items()))
    counts = rows.groupBy(text.alias("labels")).agg(*(F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)), F.count("*").alias("all"))
    cells = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)), F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    flat = counts.select("labels", F.explode(cells).alias("c"))
    return flat.select(F.lit(f"{name}_bucket").alias("name"), F.concat_ws(",", F.when(F.col("labels") != "", F.col("labels")), F.concat(F.lit("le="), F.col("c.le"))).alias("labels"), F.col("c.n").cast("double").alias("value"))
