"""Best-fit packing of tokenized documents into fixed sequences by the sum-of-squares rule.

A document longer than a sequence is cut into whole sequences, its first piece taking the remainder.
The other pieces are bin-packed: N(g) counts the open sequences with gap g, and a piece goes where
the sum of N(g)^2 over all gaps becomes smallest; a new sequence opens only when nothing fits. Pieces
come in falling length, which keeps the rule's result within a fraction of a percent of the bound.

Distribution: only piece sizes are shuffled, never ids. Pieces are dealt by hash into buckets of about
``BUCKET`` pieces, each packed alone; what stands in sequences that stayed under ``KEEP`` full is dealt
again into as many buckets as it fills, until one bucket holds it or a round closes less than ``GAIN`` of
what it got: lengths that nothing completes stay as they are packed. So no task ever holds more than
about ``BUCKET`` pieces, whatever the lengths. There is no key, so nothing can be hot. A sequence is named
by the key of its first piece, so two buckets never share a name.

Edge cases: a null or empty text is one piece holding only the end id; repeated rows are packed each
by itself; an empty table gives an empty result; other columns are ignored; null ids pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, kept, map_arrow, store
from .tokenizer import ByteBPE

BUCKET, KEEP, GAIN = 8_192, 0.97, 0.25
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 (and the ids)."""
    with open(tokenizer_file, "rb") as f:
        source = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(source)
    end = np.array([end_id], "<u4")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = kept("packing", zlib.crc32(shared.value), lambda: ByteBPE(shared.value))
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.concatenate([bpe.ids(text).astype("<u4", copy=False), end])
            at, n = 0, len(ids)
            stop = n % capacity or min(n, capacity)
            k = 0
            while at < n:
                part = ids[at:stop].tobytes()
                out.append((doc, k, at, stop - at, zlib.crc32(part), part if with_ids else None))
                at, stop, k = stop, stop + capacity, k + 1
        cols = list(zip(*out, strict=True))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return map_arrow(id_and_text(docs), cut, PIECE + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length. Falling lengths; see the module's rule."""
    count = np.zeros(capacity + 1, np.int64)
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        fits = np.flatnonzero(count[s:capacity]) + s
        if fits.size:
            # N(g) falls by one and N(g - s) grows by one, but full sequences (gap 0) aren't open
            change = np.where(fits == s, 1, 2 * count[fits - s] + 2) - 2 * count[fits]
            gap = int(fits[change.argmin()])
            b = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            b, gap = made, capacity
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_by_gap[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack_round(items: DataFrame, buckets: int, round_no: int, capacity: int) -> DataFrame:
    """Pack each bucket of (key, length) alone; ``closed`` is false where the sequence stays too empty."""
    keep = capacity * KEEP

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        seq, offset = sum_of_squares(pdf["length"].to_numpy(), capacity)
        level = np.bincount(seq, weights=pdf["length"].to_numpy())
        name = np.empty(len(level), np.int64)
        name[seq[offset == 0]] = pdf["key"].to_numpy()[offset == 0]
        return pd.DataFrame({"key": pdf["key"], "length": pdf["length"], "seq": name[seq], "offset": offset, "closed": level[seq] >= keep})

    dealt = items.select("key", "length", F.pmod(F.xxhash64("key", F.lit(round_no)), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(pack, "key long, length long, seq long, offset long, closed boolean")


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (with length at most ``capacity``) plus sequence_id and offset, gapless in each."""
    kept_pieces, _ = store(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")
    placed = kept_pieces.filter(F.col("length") == capacity).select("key", F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = kept_pieces.filter(F.col("length") < capacity).select("key", "length")
    left, round_no = items.count(), 0
    while left:
        buckets = -(-left // BUCKET)
        done, _ = store(pack_round(items, buckets, round_no, capacity), "packed")
        still = done.filter("not closed").count()
        last = buckets == 1 or still > (1 - GAIN) * left
        final = done if last else done.filter("closed")
        placed = placed.unionByName(final.select("key", F.col("seq").alias("sequence_id"), "offset"))
        items, left, round_no = done.filter("not closed").select("key", "length"), 0 if last else still, round_no + 1
    return kept_pieces.join(placed, "key").drop("key")


def pack_documents(docs: DataFrame, tokenizer_file: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack: one row a piece, with the sequence and the place in it."""
    return pack(token_pieces(docs, tokenizer_file, end_id, capacity, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids (little-endian unsigned 32 bit)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "length")))
    joined = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return joined.select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
    )
