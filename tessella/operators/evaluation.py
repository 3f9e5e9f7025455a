"""Recall of approximate results, latency percentiles, throughput, and sweeps over settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prefix import running


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(qid, recall): shared ids of the first k over min(k, true neighbours); 0 where k is 0."""
    t = truth.select("qid", F.slice("neighbors", 1, max(k, 1)).alias("t"))
    joined = t.join(found.select("qid", F.slice("neighbors", 1, max(k, 1)).alias("f")), "qid", "left")
    hits = F.size(F.array_intersect("t", F.coalesce("f", F.array().cast("array<bigint>"))))
    size = F.least(F.lit(k), F.size("t"))
    return joined.select("qid", F.when(size > 0, hits / size).otherwise(0.0).alias("recall"))


def neighbors(ranked: DataFrame) -> DataFrame:
    """(qid, neighbors in order) from (qid, rank, id): k entries a query."""
    return ranked.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("long")).alias("neighbors"))


def nearest_rank(values: DataFrame, by: list[str], column: str, fractions: list[float], definition: str = "floor") -> DataFrame:
    """Exact percentiles by one of two nearest-rank rules: index floor(p * n), or int((n - 1) * p).

    Values are counted first (map-side) and percentiles read off the running counts, which are spread
    over ranges of values, so no task holds a group's.
    """
    counts = values.groupBy(*by, column).agg(F.count("*").alias("c"))
    sizes = values.groupBy(*by).agg(F.count("*").alias("n")).withColumnsRenamed({c: f"_of_{c}" for c in by})
    run = running(counts, by, [column], upto=("sum", F.col("c"))).join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by])

    def at(p: float) -> Column:
        index = F.floor(F.lit(p) * F.col("n")) if definition == "floor" else F.floor((F.col("n") - 1) * F.lit(p))
        return F.min(F.when(F.col("upto") > F.least(index, F.col("n") - 1), F.col(column))).alias(f"p{p * 100:g}".replace(".", "_"))

    return run.groupBy(*by).agg(*(at(p) for p in fractions))


def throughput(ops: DataFrame) -> DataFrame:
    """Operations a second over the run, and errors, by operation: ops (op, start_ns, latency_ns, ok)."""
    span = (F.max(F.col("start_ns") + F.col("latency_ns")) - F.min("start_ns")) / F.lit(1e9)
    return ops.groupBy("op").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), span.alias("seconds")).withColumn("per_second", F.when(F.col("seconds") > 0, F.col("n") / F.col("seconds")).otherwise(0.0))


def timeline(ops: DataFrame, bucket_ns: int, kill_ns: int, restart_ns: int) -> DataFrame:
    """Operations and errors in each time bucket, and the phase of the fault it fell into."""
    start = ops.withColumn("bucket", F.floor(F.col("start_ns") / F.lit(bucket_ns)))
    phase = F.when(F.col("at") < kill_ns, "before").when(F.col("at") < restart_ns, "outage").otherwise("after")
    return start.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors")).withColumn("at", F.col("bucket") * F.lit(bucket_ns)).withColumn("phase", phase).drop("at")


def histogram(values: DataFrame, column: str, first: float, factor: float, buckets: int) -> DataFrame:
    """(bucket, upto, n) of exponential buckets; the last has no upper bound."""
    bounds = [first * factor**i for i in range(buckets)]
    index = sum((F.when(F.col(column) > b, 1).otherwise(0) for b in bounds), F.lit(0))
    upto = F.when(F.col("bucket") < buckets, F.lit(first) * F.pow(F.lit(factor), F.col("bucket")))
    return values.groupBy(index.cast("long").alias("bucket")).agg(F.count("*").alias("n")).select("bucket", upto.alias("upto"), "n")


def median_run(runs: DataFrame, by: list[str], column: str) -> DataFrame:
    """Of repeated runs, the one in the middle by ``column`` (the lower of two)."""
    w = Window.partitionBy(*by)
    ranked = runs.withColumn("n", F.row_number().over(w.orderBy(column))).withColumn("of", F.count("*").over(w))
    return ranked.filter(F.col("n") == F.floor((F.col("of") + 1) / 2)).drop("n", "of")


def text_table(rows: DataFrame) -> str:
    """All rows of a small result, a report, as aligned text."""
    cells = [list(rows.columns), *([f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows.toLocalIterator())]
    widths = [max(len(r[i]) for r in cells) for i in range(len(cells[0]))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, widths)) for r in cells)


def sweep(settings: list[dict], run: Callable[[dict], dict], progress: Callable[[dict], None] | None = None) -> list[dict]:
    """Results of each setting in turn, reported as they come; settings that can't be built are left out."""
    out = []
    for s in settings:  # each a distributed job
        try:
            out.append(s | run(s))
        except ValueError:
            continue
        if progress:
            progress(out[-1])
    return out


def write_csv(rows: DataFrame, path: str) -> None:
    """A report as CSV with a header, doubles with four decimals."""
    shown = [F.format_string("%.4f", c).alias(c) if kind == "double" else F.col(c) for c, kind in rows.dtypes]
    rows.select(*shown).coalesce(1).write.option("header", True).csv(path)  # a report of a few rows
