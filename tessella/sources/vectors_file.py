"""fvecs and ivecs files as a Spark data source: records of a dimension and so many 4-byte numbers.

``spark.dataSource.register(VectorsFile)``, then ``spark.read.format("vecs").option("kind", "f")``
(or "i") ``.load(path)``. A file is split into ranges of records; its size must be a multiple of the
record's, and every record must have the first one's dimension. Paths are local or any URI that
pyarrow's file systems open; a folder that the format wrote is read as one table, in the order of its
files. Writing goes by tasks: each writes a file of its own, and the commit names them in task order.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RECORDS = 65_536


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, at


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, dim: int, base: int):
        self.path, self.first, self.count, self.dim, self.base = path, first, count, dim, base


class Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        if kind not in ("f", "i"):
            raise ValueError("kind must be f or i")
        self.path, self.kind = path, kind

    def partitions(self) -> list[Range]:
        fs, at = _open(self.path)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("part-"))
        else:
            files = [at]
        out: list[Range] = []
        base = 0
        for path in files:
            n, dim = self._shape(fs, path)
            out += [Range(path, i, min(RECORDS, n - i), dim, base) for i in range(0, n, RECORDS)]
            base += n
        return out

    @staticmethod
    def _shape(fs, path: str) -> tuple[int, int]:
        """Records and components of a file."""
        size = fs.get_file_info(path).size or 0
        if size < 4:
            raise ValueError("file too small")
        with fs.open_input_file(path) as f:
            dim = struct.unpack("<i", f.read(4))[0]
        if dim <= 0:
            raise ValueError(f"dimension {dim}")
        record = 4 + 4 * dim
        if size % record:
            raise ValueError(f"{size} bytes are not whole records of {record}")
        return size // record, dim

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = _open(self.path)
        record = 4 + 4 * part.dim
        with fs.open_input_file(part.path) as f:
            raw = f.read_at(record * part.count, record * part.first)
        words = np.frombuffer(raw, "<i4").reshape(part.count, part.dim + 1)
        if (words[:, 0] != part.dim).any():
            raise ValueError("records of several dimensions")
        body = np.ascontiguousarray(words[:, 1:])
        flat = pa.array(body.view("<f4").ravel() if self.kind == "f" else body.ravel())
        offsets = pa.array(np.arange(part.count + 1, dtype=np.int32) * part.dim)
        ids = pa.array(part.base + np.arange(part.first, part.first + part.count))
        yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, flat)], ["id", "vec"])


class VectorsFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        return "id long, vec array<float>" if self.options.get("kind", "f") == "f" else "id long, vec array<int>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("kind", "f"))

    def writer(self, schema, overwrite: bool) -> "Writer":
        return Writer(self.options["path"], self.options.get("kind", "f"))


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int


class Writer(DataSourceArrowWriter):
    """Each task writes its rows in their order to a file of its own; the commit names the files in task order."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path.rstrip("/"), kind

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, root = _open(self.path)
        task = TaskContext.get()
        name = f"{root}/.part-{task.partitionId():08d}-{task.taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        rows = 0
        with fs.open_output_stream(name) as out:
            for b in batches:
                vecs = b.column(b.schema.get_field_index("vec"))
                for v in vecs:
                    body = np.asarray(v.values, "<f4" if self.kind == "f" else "<i4")
                    out.write(struct.pack("<i", len(body)) + body.tobytes())
                rows += b.num_rows
        return Part(name, rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = _open(self.path)
        for i, m in enumerate(m for m in messages if m and m.rows):
            fs.move(m.path, f"{root}/part-{i:08d}.{self.kind}vecs")

    def abort(self, messages: list[Part | None]) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m:
                fs.delete_file(m.path)


def write_vectors(df: DataFrame, path: str, kind: str = "f") -> None:
    """Write (id, vec) in id order as a folder of files; read the folder back with the same format."""
    df.sparkSession.dataSource.register(VectorsFile)
    df.select("id", "vec").repartitionByRange("id").sortWithinPartitions("id").write.format("vecs").option("kind", kind).mode("append").save(path)
