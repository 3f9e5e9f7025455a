"""Media columns: payloads as lossless 8-bit images in tar shards, addressed by content.

A text becomes a payload (UTF-8, zero bytes appended to a positive multiple of ``WIDTH``) and is
stored as an 8-bit grey PNG of that width, one sample a byte. Each task appends its images to tar
shards under names ``<sha256 of the image>.png``; rows only carry (shard, digest, offset, length).
Equal payloads are stored once over all tasks: a first pass over the payloads' digests finds those that
several rows have, the row with the smallest id stores the image and the others take its place in the
store. After a shard is closed, the metadata columns (width, height, bit depth) come from range reads of
the image headers alone, and the features from reading whole stored images back.

Scale and recovery: digests are shuffled, texts aren't, unless more than ``BROADCAST_COPIES`` different
payloads repeat; then texts meet their digests by a join. Digests of a large share of all rows are looked
up in a broadcast of bounded size. A task holds one open shard buffer of ``SHARD_BYTES`` at most plus one
text. Shards lie under the shared work folder, in any store pyarrow knows by URI, and have names of their
own for every attempt: only rows of the successful attempt refer to them, so retries and speculative
copies do no harm. The index is written once; reading it again stores nothing.

Edge cases: null and empty texts become one row of 64 zero samples; equal texts get equal values; rows
that share id and text, or copies without any id, may be stored once a shard; very long texts are one
tall image; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_bytes, join_on_hot_keys, new_folder, store

WIDTH, SHARD_BYTES, LEVEL = 64, 16 << 20, 4
#: Digests of repeated payloads are broadcast up to this many (48 bytes each).
BROADCAST_COPIES = 100_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of an image that its metadata needs: signature and IHDR chunk.
HEADER = 33

INDEX = (
    "doc_id long, n_bytes long, digest string, shard string, offset long, length long, width int, height long, bit_depth int, "
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def payload(body: bytes) -> bytes:
    return body + bytes(-len(body) % WIDTH or (0 if body else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_image(samples: bytes) -> bytes:
    """A PNG (8-bit grey, ``WIDTH`` wide, no row filters) holding exactly these samples."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(rows), WIDTH + 1), np.uint8)
    filtered[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(start: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first ``HEADER`` bytes of an image."""
    if start[:8] != SIGNATURE or start[12:16] != b"IHDR" or zlib.crc32(start[12:29]) != struct.unpack(">I", start[29:33])[0]:
        raise ValueError("not an image header")
    return struct.unpack(">IIB", start[16:25])


def decode_image(image: bytes) -> bytes:
    """The samples of an image that ``encode_image`` made, with its checksums verified."""
    width, height, depth = read_header(image[:HEADER])
    if (width, depth) != (WIDTH, 8):
        raise ValueError("unexpected image layout")
    at, data = HEADER, b""
    while at < len(image):
        n = struct.unpack(">I", image[at : at + 4])[0]
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged image")
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, WIDTH + 1)
    return rows[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Shape, mean, deviation and the 8-bin grey histogram of the samples, as text."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 5, minlength=8)
    return f"{WIDTH}x{len(a) // WIDTH};mean={a.mean():.4f};std={a.std():.4f};hist=" + ",".join(map(str, bins.tolist()))


class TarShard:
    """A tar file in memory that stores each image once and knows where its bytes start."""

    def __init__(self) -> None:
        self._buffer = io.BytesIO()
        self._tar = tarfile.open(fileobj=self._buffer, mode="w", format=tarfile.USTAR_FORMAT)
        self.members: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, image: bytes) -> None:
        if digest not in self.members:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(image)
            self.members[digest] = (self._tar.offset + tarfile.BLOCKSIZE, len(image))
            self._tar.addfile(info, io.BytesIO(image))

    def size(self) -> int:
        return self._buffer.tell()

    def close(self) -> bytes:
        self._tar.close()
        return self._buffer.getvalue()


def media_index(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text's payload and return one row a document (columns of ``INDEX``)."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)

        def flush(shard: TarShard, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            name = f"shard-{uuid.uuid4().hex}.tar"
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(shard.close())
            with fs.open_input_file(f"{root}/{name}") as f:
                headers = {d: read_header(f.read_at(HEADER, at)) for d, (at, _) in shard.members.items()}
                facts = {}
                for d, (at, n) in shard.members.items():
                    image = f.read_at(n, at)
                    p = decode_image(image)
                    facts[d] = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), n, hashlib.sha256(image).hexdigest(), feature(p))
            table = [(doc, n, d, name, *shard.members[d], *headers[d], *facts[d]) for doc, n, d in rows]
            return pa.RecordBatch.from_pylist([dict(zip(fields.names, r, strict=True)) for r in table], schema=fields)

        shard, rows = TarShard(), []
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                image = encode_image(payload(body))
                digest = hashlib.sha256(image).hexdigest()
                shard.add(digest, image)
                rows.append((doc, len(body), digest))
                if shard.size() >= SHARD_BYTES:
                    yield flush(shard, rows)
                    shard, rows = TarShard(), []
        if rows:
            yield flush(shard, rows)

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in INDEX.split(", ")])
    body, size = F.col("body"), F.octet_length("body")
    padding = F.unhex(F.repeat(F.lit("00"), F.when(size == 0, WIDTH).otherwise(F.pmod(-size, F.lit(WIDTH))).cast("int")))
    rows = id_and_bytes(docs).withColumn("key", F.unhex(F.sha2(F.concat(body, padding), 256)))
    keys, _ = store(rows.select("doc_id", size.cast("long").alias("n_bytes"), "key"), "media-keys")
    copies, _ = store(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).filter("n > 1"), "media-copies")
    of_key = copies.select("key", "owner", F.lit(True).alias("repeated"))
    owned = rows.join(F.broadcast(of_key) if of_key.count() <= BROADCAST_COPIES else of_key, "key", "left").filter(F.col("repeated").isNull() | F.col("doc_id").eqNullSafe(F.col("owner")))
    stored, _ = store(owned.select("doc_id", "body").mapInArrow(run, INDEX), "media-stored")
    # the other rows take the place of their owner's image
    others = join_on_hot_keys(keys, copies, "key").filter(~F.col("doc_id").eqNullSafe(F.col("owner"))).drop("owner")
    places = stored.drop("doc_id", "n_bytes").withColumn("key", F.unhex("payload_sha256")).join(copies.select("key", "n"), "key").dropDuplicates(["key"])
    shared = join_on_hot_keys(others, store(places, "media-places")[0], "key")
    return store(stored.unionByName(shared.select(stored.columns)), "media-index")[0]
