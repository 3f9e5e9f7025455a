"""Shared plumbing of the training-data operators: work folders, Arrow helpers, worker caches.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the driver and all
executors share, so that a lost executor only costs a re-read. Nothing is kept in executor-local
storage.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, newline, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


#: Folders of applications on one machine whose session names none.
_OWN_ROOTS: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates: ``spark.checkpoint.dir``.

    Where it isn't set, a session on one machine gets a temporary folder; on a cluster, where executors
    would each write to a disk of their own, it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN_ROOTS:
        _OWN_ROOTS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return _OWN_ROOTS[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the work folder; what is there goes when the application ends."""
    path = f"{work_root(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; return the table read back and its path."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written intermediates through Hadoop's file system, whatever store they are in."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: A key is hot from a share of 1 / ``HOT_KEYS`` of all rows; so there are ``HOT_KEYS`` hot ones at most, whatever the input.
HOT_KEYS, HOT_ROWS = 2_000, 1_000


def join_on_hot_keys(rows: DataFrame, of_key: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``of_key``, which has each key once and the number ``n`` of its rows.

    Hot keys are looked up in a broadcast of at most ``HOT_KEYS`` rows, so that no task gets all rows of
    one; the others are joined by a shuffle. Column ``n`` is dropped.
    """
    total = of_key.agg(F.sum("n")).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = of_key.filter(F.col("n") >= least).drop("n")
    if hot.isEmpty():
        return rows.join(of_key.drop("n"), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(of_key.filter(F.col("n") < least).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


#: Bytes of a record batch that a function of ``map_arrow`` gets at once, unless one row is larger.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_BYTES``: whole texts make Spark's default row count large."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").lower().rstrip("b")
    size = int(now.rstrip("kmg") or 0) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1:], 1)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def trim() -> None:
    """Give what finished work left free in this worker back to the system: workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees as it likes
        pass


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema) -> DataFrame:
    """``mapInArrow`` for functions that turn one record batch into one, in batches of bounded size."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield fn(batch.slice(at, step))
        trim()

    return df.mapInArrow(run, schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text (null: empty), under fixed names."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``id_and_text``, the text as UTF-8 bytes in column ``body``."""
    t = id_and_text(docs, id_col, text_col)
    return t.select("doc_id", F.col("text").cast("binary").alias("body"))


class BoundedCache(dict):
    """A dict that computes missing values and holds about ``limit`` of them at most.

    It has two generations: when the young one is full it becomes the old one, and what is used again
    moves back. ``base`` entries stay. Lookups of young keys run at C speed through ``__getitem__``.
    """

    def __init__(self, compute: Callable, base: dict | None = None, limit: int = 300_000):
        super().__init__(base or {})
        self._compute, self._base, self._half, self._old = compute, base or {}, limit // 2 + len(base or {}), {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self._compute(key)
        if len(self) >= self._half:
            self._old = dict(self)
            self.clear()
            self.update(self._base)
        self[key] = value
        return value


#: What a Python worker keeps between tasks: the last operator's tables and cache, and no others.
_KEPT: dict[tuple[str, object], object] = {}


def kept(name: str, key: object, make: Callable[[], object]) -> object:
    """The worker's value of operator ``name`` if it was the last one kept and made for ``key``, else a new one."""
    if (name, key) not in _KEPT:
        _KEPT.clear()
        trim()
        _KEPT[name, key] = make()
    return _KEPT[name, key]
