"""Token counts by a two-tier lookup on the map side, without shuffling pre-tokens.

Tier one is a compact hash table of the most frequent words' pre-token lengths: open addressing over one
string of keys, ``TABLE`` entries at most whatever the input, broadcast. Tier two is a bounded cache in
each Python worker: a pre-token outside the table is encoded once and remembered. The counts never leave
their task, so the plan has no exchange on the path of the texts.

The table's words come from a sketch over all texts: a task keeps ``SKETCH`` words at most and sends the
``SENT`` most frequent, packed in one row; rows are merged in two steps into one. Only these sketches
move, one a task. They decide how fast a pre-token is found, never its count.

Edge cases: null and empty texts have 0 bytes and 0 tokens; very long texts are read whole; repeated
rows and ties each keep their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BoundedCache, id_and_text, kept, map_arrow
from .tokenizer import ByteBPE

#: Bounds of the sketch: words kept in a task, words sent by a task, entries of the broadcast table.
SKETCH, SENT, TABLE = 150_000, 4_096, 32_768
#: Groups of tasks whose sketches are merged first.
FAN = 256


class LengthTable:
    """A compact hash table from strings to small positive numbers, for broadcasts."""

    def __init__(self, entries: dict[str, int]):
        keys = [k.encode() for k in entries]
        self.keys, self.ends = b"".join(keys), np.cumsum([0, *map(len, keys)]).astype(np.uint32)
        self.values = np.fromiter(entries.values(), np.uint16, len(entries))
        self.mask = (1 << max(1, (2 * len(keys)).bit_length())) - 1  # at most half full: probes end
        self.slots = np.zeros(self.mask + 1, np.uint32)
        for i, k in enumerate(keys, 1):
            at = zlib.crc32(k) & self.mask
            while self.slots[at]:
                at = (at + 1) & self.mask
            self.slots[at] = i

    def get(self, key: str) -> int:
        """The key's number, or 0."""
        own = key.encode()
        at = zlib.crc32(own) & self.mask
        while i := int(self.slots[at]):
            if self.keys[self.ends[i - 1] : self.ends[i]] == own:
                return int(self.values[i - 1])
            at = (at + 1) & self.mask
        return 0

    def nbytes(self) -> int:
        return len(self.keys) + self.ends.nbytes + self.values.nbytes + self.slots.nbytes


def _top(seen: Counter, n: int) -> list[tuple[str, int]]:
    return sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:n]


def frequent_words(docs: DataFrame, entries: int = TABLE) -> list[str]:
    """The most frequent white-space words of all texts, at most ``entries``, by merged sketches."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(text.split())
                if len(seen) > SKETCH:
                    seen = Counter(dict(seen.most_common(SKETCH // 4)))
        top = [(w, n) for w, n in _top(seen, SENT) if n > 1 and len(w) <= 64]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pickle.dumps(top)], pa.binary())], ["part", "words"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for words in pdf["words"]:
            total.update(dict(pickle.loads(words)))
        return pd.DataFrame({"part": [0], "words": [pickle.dumps(_top(total, entries))]})

    schema = "part long, words binary"
    sent = id_and_text(docs).select("text").mapInArrow(sketch, schema)
    some = sent.groupBy(F.pmod("part", F.lit(FAN))).applyInPandas(merge, schema)
    whole = some.groupBy("part").applyInPandas(merge, schema).first()
    return [w for w, _ in pickle.loads(whole.words)] if whole else []


def length_table(bpe: ByteBPE, words: list[str]) -> dict[str, int]:
    """Pre-token lengths of the words as they stand in running text (after a space)."""
    return {p: bpe.piece_length(p) for w in words for p in bpe.pre_tokens(" " + w) if p not in bpe.special}


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""
    spark = docs.sparkSession
    with open(tokenizer_file, "rb") as f:  # an installed file of the driver; executors get its bytes
        source = f.read()
    table = LengthTable(length_table(ByteBPE(source), frequent_words(docs)))
    shared, call = spark.sparkContext.broadcast((source, table)), uuid.uuid4().hex

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        def make():
            bpe, known = ByteBPE(shared.value[0]), shared.value[1]
            return bpe, BoundedCache(lambda p: known.get(p) or bpe.piece_length(p))

        bpe, lengths = kept("token_counts", call, make)
        pre, split, look, special = bpe.pre_tokens, bpe.split_special, lengths.__getitem__, tuple(bpe.special)
        sizes, counts = [], []
        for text in batch.column(1).to_pylist():
            sizes.append(len(text.encode()))
            if any(s in text for s in special):
                parts = split(text)
                counts.append(len(parts) - 1 + sum(sum(map(look, pre(p))) for p in parts))
            else:
                counts.append(sum(map(look, pre(text))))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts])],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_arrow(id_and_text(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
