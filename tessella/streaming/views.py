"""Streaming forms: latest-value view, windowed counts behind a watermark, and failure suspicion.

Each function turns a streaming DataFrame into another; ``drain`` runs one over what is there now and
returns what it wrote, for tests and for batch callers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.hlc import MAX_DRIFT_NS, steps
from ..operators.merkle import DEPTH, FANOUT, entry_hash, leaf_of
from ..workspace import file_system, folder


def events_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream, with ts as an instant (UTC) to carry watermarks."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, the path may be a folder of files or one file
    return reader.parquet(f"{path[:-1]}[{path[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows of a file that ``write_in_order`` makes, about.
SLICE = 2_000_000


def write_in_order(rows: DataFrame, order: str, path: str) -> None:
    """Rows as files of about ``SLICE`` rows, in the order of a column, to be streamed one file a batch.

    A stream takes files in the order of their times, so these are set a second apart.
    """
    rows.repartitionByRange(max(1, math.ceil(rows.count() / SLICE)), order).write.parquet(path)
    fs, at = file_system(rows.sparkSession, path)
    files = sorted((f for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    for n, f in enumerate(files):
        fs.setTimes(f.getPath(), files[0].getModificationTime() + 1000 * n, -1)


def latest_values(log: DataFrame) -> DataFrame:
    """Each key's newest version so far; state is one row a key. For update mode."""
    return log.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("value", "seq").alias("value"), F.max_by("tombstone", "seq").alias("tombstone"))


def tumbling_counts(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Events of each type in windows, emitted when the watermark closes them; later rows are dropped."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n")


def unexpired(hints: DataFrame, delay: str) -> DataFrame:
    """Hints (ts, target, key) once each within the time to live; state older than that is purged."""
    return hints.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["target", "key"])


#: State of a member that was reaped.
FORGOTTEN = -1


def _micros(t: pd.Timestamp) -> int:
    return (t - pd.Timestamp(0)) // pd.Timedelta(microseconds=1)


def hint_expiry(hints: DataFrame, ttl_s: int, delay: str) -> DataFrame:
    """(target, key, expired_at) of pending hints (target, key, ts, done) whose time to live passed by the watermark.

    A hint is a session of its rows, which ends a time to live after the newest. A row with ``done`` takes it back;
    the watermark purges the state when the session ends, so it never outlives the time to live.
    """
    sessions = hints.withWatermark("ts", delay).groupBy("target", "key", F.session_window("ts", f"{ttl_s} seconds").alias("w"))
    newest = sessions.agg(F.max_by("done", F.struct("ts", "done")).alias("done"))
    return newest.filter(~F.col("done")).select("target", "key", F.col("w.end").alias("expired_at"))


def reaped(reports: DataFrame, timeout_s: int, delay: str) -> DataFrame:
    """(node, reaped_at) of members reported dead (node, ts, liveness) and nothing else for the timeout.

    A forgotten member comes back when it is reported alive, not by another report of its death.
    """
    span = pd.Timedelta(seconds=timeout_s)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = pd.Timestamp(state.get[0], unit="us") + span
            state.update((FORGOTTEN,))
            yield pd.DataFrame({"node": [key[0]], "reaped_at": [at]})
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        had = state.get[0] if state.exists else None
        forgotten = had == FORGOTTEN
        since = None if had is None or forgotten else pd.Timestamp(had, unit="us")
        found = []
        for ts, liveness in zip(rows["ts"], rows["liveness"]):
            if since is not None and ts - since >= span:
                found.append(since + span)
                since, forgotten = None, True
            if liveness != 2:
                since, forgotten = None, False
            elif since is None and not forgotten:
                since = ts
        if since is not None:
            state.update((_micros(since),))
            state.setTimeoutTimestamp(max(_micros(since + span) // 1000, state.getCurrentWatermarkMs() + 1))
        elif forgotten:
            state.update((FORGOTTEN,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"node": [key[0]] * len(found), "reaped_at": pd.Series(found, dtype="datetime64[ns]")})

    return reports.withWatermark("ts", delay).groupBy("node").applyInPandasWithState(watch, "node string, reaped_at timestamp", "since long", "append", GroupStateTimeout.EventTimeTimeout)


def received(events: DataFrame, max_drift: int = MAX_DRIFT_NS) -> DataFrame:
    """The clock's receive rule over a stream of (node, i, physical, remote_wall, remote_logical), in order of i a batch.

    State is a node's clock alone: two numbers. A batch's rows of a node are in memory, so batches should be bounded.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (0, 0)
        rows = pd.concat([f for f in frames if len(f)]).sort_values("i")
        wall, logical, ok = steps(now, *(rows[c].to_numpy() for c in ("physical", "remote", "remote_wall", "remote_logical")), max_drift)
        state.update((int(wall[-1]), int(logical[-1])))
        yield pd.DataFrame({"node": key[0], "i": rows["i"].to_numpy(), "wall": wall, "logical": logical, "accepted": ok})

    # without nulls: a column that has some would come as doubles, which can't hold nanoseconds
    whole = events.withColumn("remote", F.col("remote_wall").isNotNull()).fillna(0, ["remote_wall", "remote_logical"])
    return whole.groupBy("node").applyInPandasWithState(fold, "node string, i long, wall long, logical long, accepted boolean", "wall long, logical long", "append", GroupStateTimeout.NoTimeout)


def leaf_entries(rows: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """Rows of a stream as Merkle entries (idx, key, hash): each row by itself, without state."""
    return rows.select(leaf_of(fanout, depth).alias("idx"), "key", entry_hash().alias("hash"))


def per_second(ops: DataFrame, delay: str) -> DataFrame:
    """Operations and errors (ts, ok) of each second that the watermark closed."""
    w = ops.withWatermark("ts", delay).groupBy(F.window("ts", "1 second").alias("w")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"))
    return w.select(F.col("w.start").alias("second"), "n", "errors")


def on_change(stream: DataFrame, fn: Callable[[DataFrame, int], None], check: str) -> None:
    """Run a callback on each batch of changes of liveness or ring state that is there now."""
    stream.writeStream.foreachBatch(fn).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def drain_on_recovery(recoveries: DataFrame, hints: DataFrame, out: str, check: str, replay: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Whenever members come back (target, ts), write their pending hints up to then to ``out``.

    Hints are a table that each batch reads anew, so what came meanwhile goes along; a batch that is run
    again writes the same folder again. ``replay`` turns hints into what the target gets.
    """

    def send(batch: DataFrame, number: int) -> None:
        back = batch.groupBy("target").agg(F.max(F.unix_micros("ts")).alias("upto"))  # a row a member
        due = hints.join(F.broadcast(back), "target").filter(F.col("wall") <= F.col("upto") * 1000).drop("upto")
        (replay(due) if replay else due).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/b={number}")

    on_change(recoveries, send, check)


def suspects(beats: DataFrame, timeout_s: int, delay: str) -> DataFrame:
    """(node, suspect_at) whenever a node's heartbeats (node, ts) stay away for the timeout.

    State is the last heartbeat; an event-time timer fires when the watermark passes its deadline.
    Heartbeats of one micro-batch are taken in time order.
    """
    span, epoch = pd.Timedelta(seconds=timeout_s), pd.Timestamp(0)

    def watch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0], unit="us")
            state.remove()
            yield pd.DataFrame({"node": [key[0]], "suspect_at": [last + span]})
            return
        times = pd.concat([f["ts"] for f in frames]).sort_values().tolist()
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        found = []
        for t in times:
            if last is not None and t - last > span:
                found.append(last + span)
            last = t if last is None or t > last else last
        state.update(((last - epoch) // pd.Timedelta(microseconds=1),))
        deadline = (last + span - epoch) // pd.Timedelta(milliseconds=1)
        state.setTimeoutTimestamp(max(deadline, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"node": [key[0]] * len(found), "suspect_at": pd.Series(found, dtype="datetime64[ns]")})

    return (
        beats.withWatermark("ts", delay)
        .groupBy("node")
        .applyInPandasWithState(watch, "node string, suspect_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def drain(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is available, then read what it wrote, with its batch number."""
    spark = stream.sparkSession
    out, check = folder(spark, f"{name}-out"), folder(spark, f"{name}-check")
    schema = stream.schema.add("batch", "long")

    def sink(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/b={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
