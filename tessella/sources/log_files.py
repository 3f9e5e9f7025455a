"""Recovery of log records from line files: the valid prefix of each file counts.

A record is a JSON line with a CRC of its body. A file is read up to its first damaged or incomplete
line; what follows is ignored, in that file only. Files are replayed in the order of their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import file_system


def _crc(body: Column) -> Column:
    return F.crc32(body.cast("binary"))


def encode_lines(log: DataFrame) -> DataFrame:
    """(file, pos, line) from rows (file, pos, key, seq, value, tombstone)."""
    body = F.to_json(F.struct("key", "seq", "value", "tombstone"))
    return log.select("file", "pos", F.concat_ws("\t", _crc(body).cast("string"), body).alias("line"))


def write_segments(log: DataFrame, path: str) -> None:
    """Append rows (file, pos, key, seq, value, tombstone) as line files, one folder a segment."""
    lines = encode_lines(log).repartition("file").sortWithinPartitions("file", "pos")
    lines.select("file", F.concat_ws(" ", "pos", "line").alias("value")).write.mode("append").partitionBy("file").text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The lines (file, pos, line) of all segments of a folder."""
    rows = spark.read.schema("value string, file long").text(path)
    return rows.select("file", F.substring_index("value", " ", 1).cast("long").alias("pos"), F.expr("substring(value, length(substring_index(value, ' ', 1)) + 2)").alias("line"))


def drop_segments(spark: SparkSession, path: str, before: int) -> list[int]:
    """Delete the segments that were flushed, all before one; their numbers."""
    fs, at = file_system(spark, path)
    found = sorted(int(s.getPath().getName().removeprefix("file=")) for s in fs.listStatus(at) if s.getPath().getName().startswith("file="))
    gone = [n for n in found if n < before]
    for n in gone:
        fs.delete(file_system(spark, f"{path}/file={n}")[1], True)
    return gone


def recover(lines: DataFrame, value_type: str = "double", key_type: str = "long") -> DataFrame:
    """(file, pos, key, seq, value, tombstone) of the lines before each file's first bad one."""
    split = lines.withColumn("crc", F.substring_index("line", "\t", 1)).withColumn("body", F.expr("substring(line, length(crc) + 2)"))
    ok = split.withColumn("ok", F.coalesce(F.col("crc") == _crc(F.col("body")).cast("string"), F.lit(False)))
    bad = ok.filter(~F.col("ok")).groupBy("file").agg(F.min("pos").alias("bad"))
    good = ok.join(bad, "file", "left").filter(F.col("bad").isNull() | (F.col("pos") < F.col("bad")))
    row = F.from_json("body", f"key {key_type}, seq long, value {value_type}, tombstone boolean")
    return good.select("file", "pos", row.alias("r")).select("file", "pos", "r.*")


def last_state(records: DataFrame) -> DataFrame:
    """Live files of a manifest: records (pos, file, action add/remove, level, first_key); newest action wins."""
    return records.groupBy("file").agg(F.max_by(F.struct("action", "level", "first_key"), "pos").alias("r")).filter("r.action = 'add'").select("file", "r.level", "r.first_key")
