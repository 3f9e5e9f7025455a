"""Folders for written intermediates, under the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of applications on one machine whose session names none.
_OWN_ROOTS: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share; it goes when the application ends.

    Without ``spark.checkpoint.dir`` a session on one machine gets a temporary folder; a cluster is refused.
    """
    root, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN_ROOTS:
            _OWN_ROOTS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tessella-")
        root = _OWN_ROOTS[context.applicationId]
    path = f"{root.rstrip('/')}/tessella-{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later uses don't compute it again."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
