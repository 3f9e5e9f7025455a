"""Exact removal of repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts in a document with a
smaller id, judged on the input; matches never cross documents.

How it is spread. Every window belongs to the smallest hash among its ``GRAM``-byte strings, so equal
windows meet in the shard of that hash wherever they stand, and neighbouring windows mostly travel as one
piece of text. A hash that stands for more than ``HOT_WINDOWS`` windows is split: its windows are dealt by
the hash of all their bytes. The number of shards follows from the bytes written, so a shard is of one
size whatever the input. What goes from a block to a task is one message whatever the number of shards in
it, and the parts that tasks hold grow with the input (``PARTS``, ``HASH_PARTS``) before their number does:
else blocks times shards, a square of the input, would be the number of messages.

1. Documents are written as compressed blocks of about ``BLOCK_BYTES`` in the shared folder.
2. Each block sends its distinct hashes (32 bits each) to the tasks that hold them, which answer with a bit
   for each: does the hash stand in another document? The rest of the text is done: it can't repeat.
3. The other windows of a block are a batch with a suffix array: positions in the block's text, ranked by
   8-byte words up to ``LENGTH`` bytes. The block sends the text of each distinct window once, with the
   smallest id of its documents and its place there, and what it knows already: which windows have a
   smaller owner in the block itself, and which say the same twice in one document.
4. In a shard a ``SuffixFamily`` takes the batches: each gets its suffix array (positions in the shard's
   text), levels of equal size merge geometrically, and the merge-scan of neighbouring suffixes finds
   matches of full length and the smallest document of each. Every candidate window goes this way.
5. Blocks get back which of these windows a smaller document owns elsewhere and cut all such windows out.

With a folder for ``index``, the family is kept: a later call's documents send every window (anything may
repeat something earlier), meet the stored levels of their shard by a merge-scan, and become a level of
their own, which takes up stored levels that aren't larger. Documents of earlier calls are not cut again.

Blocks deduplicate before they send, so a passage that stands in a third of all documents reaches its
shard once a block, not once a document; nothing is collected on the driver, and every phase is
written before the next reads it. Hash collisions only add candidates: matches compare whole bytes.

Edge cases: null and empty texts and texts shorter than ``LENGTH`` keep all bytes; a null id counts as
the largest number; rows with equal ids never remove from each other; very long texts make a block of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.ipc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches, store, trim

LENGTH, GRAM = 50, 20
BLOCK_BYTES, SLICE, BATCH_WINDOWS, HOT_WINDOWS = 4 << 20, 1 << 17, 1 << 18, 1 << 18
#: Bytes of documents for each part, the shards that a task holds, and shards in it.
PART_BYTES, SHARDS_A_PART = 8 << 20, 4
#: Beyond so many parts (of windows, of hashes) they grow instead, up to so many times.
PARTS, HASH_PARTS, PART_GROWTH, HASH_GROWTH = 256, 64, 4, 8
NO_ID = np.iinfo(np.int64).max
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64(0xFFFFFFFF)


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each string of 20 bytes, by doubling from 1 to 16 bytes and adding 4."""
    h, span, factor = data.astype(np.uint64) + np.uint64(1), 1, _ODD
    four = four_factor = None
    while span < 16:
        h = h[:-span] * np.uint64(factor) + h[span:]
        span, factor = span * 2, factor * factor % (1 << 64)
        if span == 4:
            four, four_factor = h, np.uint64(factor)
    h = h[:-4] * four_factor + four[16:]
    for _ in range(2):
        h ^= h >> np.uint64(32)
        h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def window_hashes(data: np.ndarray) -> np.ndarray:
    """The smallest hash among the grams of each window of ``LENGTH`` bytes."""
    if len(data) < LENGTH:
        return np.empty(0, np.uint64)
    m = _gram_hashes(data)
    for step in (1, 2, 4, 8, LENGTH - GRAM + 1 - 16):  # widths 2, 4, 8, 16, and the whole
        m = np.minimum(m[:-step], m[step:])
    return m


class Block:
    """Some whole documents, one after the other, and their segments."""

    def __init__(self, ids: bytes, ends: bytes, data: bytes):
        self.ids, self.ends = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.int64)
        self.raw = _expand(data)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, number of windows, hash and document (position) of each segment, in text order.

        Slices keep the arrays in cache; a segment that crosses one is joined again.
        """
        inside = np.ones(len(self.data), bool)
        for a, b in zip(self.begins.tolist(), self.ends.tolist()):
            inside[max(a, b - LENGTH + 1) : b] = False
        starts, hashes, stops = [], [], []
        for a in range(0, len(self.data) - LENGTH + 1, SLICE):
            m = window_hashes(self.data[a : a + SLICE + LENGTH - 1])
            at = np.flatnonzero(inside[a : a + len(m)])
            if not at.size:
                continue
            h = m[at]
            new = np.ones(len(at), bool)
            new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            starts.append(a + at[first])
            hashes.append(h[first])
            stops.append(a + at[np.append(first[1:], len(at)) - 1] + 1)
        if not starts:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, np.uint64), none
        start, h, stop = np.concatenate(starts), np.concatenate(hashes), np.concatenate(stops)
        doc = np.searchsorted(self.ends, start, side="right")
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != stop[:-1]) | (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        return start[first], stop[np.append(first[1:], len(start)) - 1] - start[first], h[first], doc[first]

    def distinct_hashes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The segments' distinct hashes, sorted, whether each stands in two documents here, and its windows."""
        _, count, h, doc = self.segments()
        names, first, of = np.unique(h, return_index=True, return_inverse=True)
        twice = np.zeros(len(names), bool)
        twice[of[self.ids[doc] != self.ids[doc[first]][of]]] = True
        return names, twice, np.bincount(of, weights=count, minlength=len(names)).astype(np.int64)


def blocks(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(block, size, ids, unnamed, ends, data, rest): documents in compressed blocks, numbered by task and order.

    ``unnamed`` has a bit for each null id; ``rest`` holds the columns of ``carry`` in Arrow's stream format.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), *(F.col(c) for c in carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        bodies: list[bytes] = []
        parts: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(b) for b in bodies], dtype=np.int64)
            rest = b""
            if carry:
                out = pa.BufferOutputStream()
                table = pa.Table.from_batches(parts)
                with pa.ipc.new_stream(out, table.schema) as stream:
                    stream.write_table(table)
                rest = _squeeze(out.getvalue().to_pybytes())
            unnamed = np.array([i is None for i in ids])
            row = [np.array([NO_ID if i is None else i for i in ids], np.int64).tobytes(), np.packbits(unnamed).tobytes(), ends.tobytes(), _squeeze(b"".join(bodies)), rest]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), *(pa.array([r], pa.binary()) for r in row)], names)

        for batch in batches:
            begin = 0
            others = pa.RecordBatch.from_arrays(batch.columns[2:], carry) if carry else None
            for i, (doc, body) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                ids.append(doc)
                bodies.append(body.as_py())
                size += len(bodies[-1])
                if size >= BLOCK_BYTES or i + 1 == batch.num_rows:
                    if carry:
                        parts.append(others.slice(begin, i + 1 - begin))
                        begin = i + 1
                if size >= BLOCK_BYTES:
                    yield close()
                    ids, bodies, parts, size, number = [], [], [], 0, number + 1
        if ids:
            yield close()

    names = ["block", "size", "ids", "unnamed", "ends", "data", "rest"]
    return rows.mapInArrow(run, "block long, size long, ids binary, unnamed binary, ends binary, data binary, rest binary")


def _by_shard(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts by shard and hash, the shards present and where each begins (and the end)."""
    shard = (hashes >> np.uint64(32)) % np.uint64(shards)
    order = np.lexsort((hashes, shard))
    names, first = np.unique(shard[order], return_index=True)
    return order, names.astype(np.int64), np.append(first, len(order))


def layout(total: int) -> tuple[int, int, int]:
    """Parts, shards in each and parts of hashes for so many bytes of documents."""

    def parts(most: int, growth: int) -> tuple[int, int]:
        larger = min(growth, max(1, -(-total // (PART_BYTES * most))))
        return max(1, -(-total // (PART_BYTES * larger))), larger

    (windows, larger), (hashes, _) = parts(PARTS, PART_GROWTH), parts(HASH_PARTS, HASH_GROWTH)
    return windows, SHARDS_A_PART * larger, hashes


def _send_hashes(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, twice, windows = Block(row["ids"], row["ends"], row["data"]).distinct_hashes()
                order, present, cut = _by_shard(names, shards)
                low, flag, count = (names[order] & _LOW).astype(np.uint32), twice[order], np.minimum(windows[order], 65_535).astype(np.uint16)
                parts = list(zip(present.tolist(), cut[:-1].tolist(), cut[1:].tolist()))
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([s for s, _, _ in parts], pa.int64()),
                            pa.array([row["block"]] * len(parts), pa.int64()),
                            pa.array([low[a:b].tobytes() for _, a, b in parts], pa.binary()),
                            pa.array([np.packbits(flag[a:b]).tobytes() for _, a, b in parts], pa.binary()),
                            pa.array([count[a:b].tobytes() for _, a, b in parts], pa.binary()),
                        ],
                        ["shard", "block", "low", "twice", "windows"],
                    )

    return run


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Which of each block's hashes stand in another document: bits in the order they were sent, and the hot ones."""
    lows = [np.frombuffer(b, np.uint32) for b in pdf["low"]]
    flags = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(n)).astype(bool) for t, n in zip(pdf["twice"], lows)]
    every, twice, windows = np.concatenate(lows), np.concatenate(flags), np.concatenate([np.frombuffer(w, np.uint16) for w in pdf["windows"]])
    names, of = np.unique(every, return_inverse=True)
    again = (np.bincount(of, minlength=len(names)) > 1) | (np.bincount(of, weights=twice, minlength=len(names)) > 0)
    hot = names[again & (np.bincount(of, weights=windows, minlength=len(names)) > HOT_WINDOWS)]
    bits = np.split(again[of], np.cumsum([len(n) for n in lows])[:-1])
    some = [b.any() for b in bits]
    out = pdf[["block", "shard"]].copy()
    out["bits"] = [np.packbits(b).tobytes() for b in bits]
    out["hot"] = hot.tobytes()
    return out[some]


def _told(table: pa.Table) -> dict[int, tuple[bytes, bytes]]:
    return {s: (b, h) for s, b, h in zip(table["shard"].to_pylist(), table["bits"].to_pylist(), table["hot"].to_pylist())}


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of numbers from 0 on, and the numbers in it; sorted with their places where 64 bits hold both."""
    key = key.astype(np.uint64)
    place = max(len(key) - 1, 0).bit_length()
    if not len(key) or int(key.max()).bit_length() + place > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    key <<= np.uint64(place)
    key |= np.arange(len(key), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << place) - 1)).view(np.int64)
    key >>= np.uint64(place)
    return order, key


def _ranks(high: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """Dense ranks of numbers or pairs of numbers."""
    key = high.astype(np.uint64)
    if low is not None:
        key <<= np.uint64(int(low.max()).bit_length())
        key |= low
    order, key = _sorted(key)
    new = np.zeros(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    out = np.empty(len(key), np.uint32)
    out[order] = np.cumsum(new, dtype=np.uint32)
    return out


def suffix_ranks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dense ranks of the windows that start at ``at`` in the order of their ``LENGTH`` bytes.

    Prefix doubling over the bytes that these windows cover: every place is ranked by 5 bytes, then by
    pairs of such ranks 5, 10 and 20 places apart, and the windows by two ranks of 40 bytes.
    """
    if not len(at):
        return np.empty(0, np.int64)
    begins = np.zeros(len(data), bool)
    begins[at] = True
    inside = np.cumsum(begins, dtype=np.int64)
    inside[LENGTH:] -= inside[:-LENGTH].copy()
    inside = inside > 0
    text = np.concatenate([data[inside], np.zeros(3, np.uint8)])
    if len(text) < len(data) + 3:
        at = (np.cumsum(inside) - 1)[at]
    del begins, inside
    span = 5
    rank = _ranks(np.ndarray((len(text) - 7,), ">u8", text, 0, (1,)) >> np.uint64(64 - 8 * span))
    while 2 * span <= LENGTH:
        rank = _ranks(rank[:-span], rank[span:])
        span *= 2
    return _ranks(rank[at], rank[at + LENGTH - span]).astype(np.int64)


def _ramps(count: np.ndarray) -> np.ndarray:
    """0, 1, .. of each count, one after the other."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def _whole_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of all bytes of some windows."""
    out = np.zeros(len(at), np.uint64)
    for k in range(LENGTH):
        out = (out ^ data[at + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


class Batch:
    """A block's candidate windows: where they stand, their shards and, by their suffix array, the distinct ones."""

    def __init__(self, block: Block, told: dict[int, tuple[bytes, bytes]] | None, parts: int, inner: int = 1, hash_parts: int = 1):
        shards = parts * inner
        start, count, h, doc = block.segments()
        names, of = np.unique(h, return_inverse=True)
        marked, hot = np.full(len(names), told is None), np.zeros(len(names), bool)
        if told:
            order, present, cut = _by_shard(names, hash_parts)
            place = {s: i for i, s in enumerate(present.tolist())}
            for s, (bits, lows) in told.items():
                own = order[cut[place[s]] : cut[place[s] + 1]]
                marked[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
                if lows:
                    hot[own] = np.isin((names[own] & _LOW).astype(np.uint32), np.frombuffer(lows, np.uint32))
        use = np.flatnonzero(marked[of])
        start, count, h, doc, split = start[use], count[use], h[use], doc[use], hot[of[use]]
        self.block = block
        at = np.repeat(start, count) + _ramps(count)
        ids = np.repeat(block.ids[doc], count)
        shard = np.repeat((h >> np.uint64(32)) % np.uint64(shards), count).astype(np.int64)
        alone = np.flatnonzero(np.repeat(split, count))
        shard[alone] = ((_whole_hashes(block.data, at[alone]) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        rank = suffix_ranks(block.data, at)
        classes = int(rank.max()) + 1 if len(rank) else 0
        order, held = _sorted(rank)
        least = np.minimum.reduceat(ids[order], np.flatnonzero(np.diff(held, prepend=np.uint64(1 << 63)))) if classes else np.empty(0, np.int64)
        del order, held
        owned = ids == least[rank]
        first = np.empty(classes, np.int64)
        own = np.flatnonzero(owned)
        first[rank[own[::-1]]] = own[::-1]  # the last that is written is the first in the text
        self.gone = at[~owned]  # the block itself has a smaller document
        again = own[first[rank[own]] != own]
        self.again = at[again], at[first[rank[again]]]  # the same window of the same document, and the first one
        sent = _sorted(shard[first] * len(block.data) + at[first])[0]  # classes, by shard and place
        places, least, shard = at[first][sent], least[sent], shard[first][sent]
        self.start, self.count, of = _runs_of(places, shard)
        self.run_cut = np.searchsorted(of, np.arange(shards + 1))
        self.owner, self.owned, of = _runs_of(least, shard, 0)
        self.owner_cut = np.searchsorted(of, np.arange(shards + 1))
        self.inner = inner
        self.parts = np.unique(shard // inner).tolist()

    def message(self, part: int) -> bytes:
        """A part's distinct windows by shard and place: numbers of runs a shard, runs of places, of owners, and the text of each run of places."""
        at = slice(part * self.inner, (part + 1) * self.inner + 1)
        runs, owners = self.run_cut[at], self.owner_cut[at]
        r, o = slice(runs[0], runs[-1]), slice(owners[0], owners[-1])
        raw, start, count = self.block.raw, self.start[r], self.count[r]
        texts = [raw[x : x + n + LENGTH - 1] for x, n in zip(start.tolist(), count.tolist())]
        head = [np.diff(runs).astype(np.int32), np.diff(owners).astype(np.int32), start, count, self.owned[o].astype(np.int32), self.owner[o]]
        return _squeeze(b"".join([*(c.tobytes() for c in head), *texts]))

    def known(self) -> bytes:
        """What the block knows alone: windows that go, and windows that go with another one."""
        there, here = self.again
        new = np.flatnonzero(np.concatenate([[True], (there[1:] != there[:-1] + 1) | (here[1:] != here[:-1] + 1)])) if len(there) else there
        return _squeeze(_pack(*_runs(self.gone)) + _pack(there[new], np.diff(np.append(new, len(there))), here[new]))


def _runs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of the runs of neighbouring places."""
    if not len(at):
        return at, at
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
    return at[new], np.diff(np.append(new, len(at)))


def _runs_of(at: np.ndarray, key: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First value, length and key of the runs of one key whose values rise by ``step``."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + step) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), key[first]


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join([np.int64(len(columns[0])).tobytes(), *(c.astype(np.int64).tobytes() for c in columns)])


def _unpack(raw: bytes, at: int, columns: int) -> tuple[list[np.ndarray], int]:
    n = int(np.frombuffer(raw, np.int64, 1, at)[0])
    return [np.frombuffer(raw, np.int64, n, at + 8 + 8 * n * k) for k in range(columns)], at + 8 + 8 * n * columns


class Message:
    """A block's windows of a part, as ``Batch.message`` packs them; ``shard`` gives those of one shard."""

    def __init__(self, body: bytes, inner: int = 1):
        self.raw = _expand(body)
        runs, owners = np.frombuffer(self.raw, np.int32, inner), np.frombuffer(self.raw, np.int32, inner, 4 * inner)
        r, o, at = int(runs.sum()), int(owners.sum()), 8 * inner
        self.start, self.count = np.frombuffer(self.raw, np.int64, r, at), np.frombuffer(self.raw, np.int64, r, at + 8 * r)
        self.owned, self.owner = np.frombuffer(self.raw, np.int32, o, at + 16 * r), np.frombuffer(self.raw, np.int64, o, at + 16 * r + 4 * o)
        text = np.concatenate([[0], np.cumsum(self.count + LENGTH - 1)]) + at + 16 * r + 12 * o
        cut = np.concatenate([[0], np.cumsum(runs)])
        self.runs, self.owners, self.texts = cut.tolist(), np.concatenate([[0], np.cumsum(owners)]).tolist(), text[cut].tolist()

    def shard(self, s: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, runs of places (begin, length) and runs of owners (length, owner)."""
        a, b, c, d = self.runs[s], self.runs[s + 1], self.owners[s], self.owners[s + 1]
        return self.raw[self.texts[s] : self.texts[s + 1]], self.start[a:b], self.count[a:b], self.owned[c:d], self.owner[c:d]


class Windows:
    """The windows of one shard in all messages: text, their starts in it, owners, places in the blocks and messages."""

    def __init__(self, messages: list[Message], s: int):
        texts, starts, counts, owned, owners = zip(*(m.shard(s) for m in messages))
        start, count = np.concatenate(starts), np.concatenate(counts)
        ramp, long = _ramps(count), count + LENGTH - 1
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.at = np.repeat(np.cumsum(long) - long, count) + ramp
        self.owner = np.repeat(np.concatenate(owners), np.concatenate(owned))
        self.places = np.repeat(start, count) + ramp
        self.message = np.repeat(np.repeat(np.arange(len(messages)), [len(x) for x in starts]), count)

    def taken(self, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Message, begin and length of the runs of places whose windows have a smaller owner elsewhere."""
        gone = np.flatnonzero(owner < self.owner)
        start, count, message = _runs_of(self.places[gone], self.message[gone])
        return message, start, count


def _send_windows(parts: int, inner: int, hash_parts: int, filtered: bool):
    """Distinct candidate windows, packed for their parts."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int64()), ("body", pa.binary())])

    def one(row: dict, told: dict | None) -> pa.Table:
        batch = Batch(Block(row["ids"], row["ends"], row["data"]), told, parts, inner, hash_parts)
        trim()
        out = [(row["block"], p, batch.message(p)) for p in batch.parts]
        if len(batch.gone) or len(batch.again[0]):
            out.append((row["block"], -1 - row["block"] % parts, batch.known()))  # passes through to the block
        cols = list(zip(*out)) if out else [()] * 3
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def cogrouped(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return one(left.to_pylist()[0], _told(right)) if left.num_rows and right.num_rows else schema.empty_table()

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from one(row, None).to_batches()

    return cogrouped if filtered else every


class SuffixFamily:
    """Suffix arrays over windows of ``LENGTH`` bytes, in levels that merge when sizes are equal.

    A level is (suffixes, owners, batches): window starts in ``data`` in the order of their bytes, the
    smallest owner among equal windows, and the numbers of the batches in it.
    """

    def __init__(self) -> None:
        self.data = np.empty(0, np.uint8)
        self.levels: list[tuple[np.ndarray, np.ndarray, tuple[int, ...]]] = []

    def _windows(self, suffixes: np.ndarray) -> np.ndarray:
        """The bytes that some suffixes start with, only while levels are compared."""
        if not len(suffixes):
            return np.empty(0, f"S{LENGTH}")
        view = np.lib.stride_tricks.sliding_window_view(self.data, LENGTH)[suffixes]
        return np.ascontiguousarray(view).view(f"S{LENGTH}").ravel()

    @staticmethod
    def _share(new: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The smallest owner of each run; ``new`` marks where runs begin."""
        first = np.flatnonzero(new)
        return np.repeat(np.minimum.reduceat(owner, first), np.diff(np.append(first, len(owner)))) if len(first) else owner

    def _merge(self, a: tuple, b: tuple) -> tuple:
        """Merge-scan of two levels: sorted neighbours that match in full length share an owner."""
        suffixes, owner = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        windows = np.concatenate([self._windows(a[0]), self._windows(b[0])])
        order = np.argsort(windows, kind="stable")  # two sorted runs: a linear merge
        windows = windows[order]
        new = np.ones(len(windows), bool)
        new[1:] = windows[1:] != windows[:-1]
        return suffixes[order], self._share(new, owner[order]), (*a[2], *b[2])

    def put(self, data: np.ndarray, suffixes: np.ndarray, owner: np.ndarray, batches: tuple[int, ...]) -> None:
        """A level as it is, over a text of its own."""
        self.levels.append((suffixes + len(self.data), owner, batches))
        self.data = np.concatenate([self.data, data])

    def level(self, data: np.ndarray, at: np.ndarray, owner: np.ndarray, number: int = 0) -> tuple:
        """A batch's suffix array: windows of ``data`` that start at ``at``, in text order, and their owners."""
        rank = suffix_ranks(data, at)
        order, rank = _sorted(rank)
        new = np.ones(len(order), bool)
        new[1:] = rank[1:] != rank[:-1]
        level = (at[order] + len(self.data), self._share(new, owner[order]), (number,))
        self.data = np.concatenate([self.data, data])
        return level

    def matches(self, level: tuple) -> np.ndarray:
        """The smallest owner of each of the level's windows, in it and in every level of the family."""
        least, windows = level[1].copy(), self._windows(level[0])
        for suffixes, owner, _ in self.levels:
            own = self._windows(suffixes)
            at = np.minimum(np.searchsorted(own, windows), len(own) - 1)
            same = own[at] == windows
            least[same] = np.minimum(least[same], owner[at[same]])
        return least

    def add(self, level: tuple) -> None:
        while self.levels and len(self.levels[-1][0]) <= len(level[0]):
            level = self._merge(self.levels.pop(), level)
        self.levels.append(level)

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """Every window's start, ascending, and the smallest owner among equal windows of all levels."""
        if not self.levels:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        while len(self.levels) > 1:
            a = self.levels.pop()
            self.levels.append(self._merge(self.levels.pop(), a))
        order = _sorted(self.levels[0][0])[0]
        return self.levels[0][0][order], self.levels[0][1][order]


_MESSAGES = "block long, part long, body binary"


def _answers(taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]], blocks: list[int], part: int) -> list[tuple[int, int, bytes]]:
    """For each block one message with the places of its windows that have a smaller owner elsewhere."""
    message, start, count = (np.concatenate(x) for x in zip(*taken))
    order = np.argsort(message, kind="stable")
    start, count = start[order], count[order]
    names, first = np.unique(message[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    return [(blocks[m], part, _squeeze(_pack(start[a:b], count[a:b]))) for m, a, b in zip(names.tolist(), cut, cut[1:])]


def _own(inner: int):
    """To each block that sent windows to a part, those that a smaller document owns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        if part < 0:
            return pdf[["block", "part", "body"]]
        pdf = pdf.sort_values("block")
        messages = [Message(body, inner) for body in pdf["body"]]
        taken = []
        for s in range(inner):
            own, family = Windows(messages, s), SuffixFamily()
            for a in range(0, len(own.at), BATCH_WINDOWS):
                b = min(a + BATCH_WINDOWS, len(own.at))
                begin = int(own.at[a])
                stop = int(own.at[b - 1]) + LENGTH
                family.add(family.level(own.data[begin:stop], own.at[a:b] - begin, own.owner[a:b]))
            taken.append(own.taken(family.owners()[1]))
            del own, family
        out = pd.DataFrame(_answers(taken, pdf["block"].tolist(), part), columns=["block", "part", "body"])
        del messages, taken
        trim()
        return out

    return run


_LEVELS = "shard long, batch long, absorbed array<long>, data binary, suffixes binary, owners binary"


def _meet(number: int):
    """A later batch in its shard: matches with the stored levels, its owners' answers and the new level."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("body", pa.binary()), ("batch", pa.int64()), ("absorbed", pa.list_(pa.int64())), ("data", pa.binary()), ("suffixes", pa.binary()), ("owners", pa.binary())])

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["block"])
        if not rows:
            return schema.empty_table()
        shard = rows[0]["shard"]
        if shard < 0:
            return pa.Table.from_pylist(rows, schema=schema)
        stored = right.to_pylist()
        gone = {b for r in stored for b in r["absorbed"]}
        live = [r for r in stored if r["batch"] not in gone]
        family = SuffixFamily()
        for r in sorted(live, key=lambda r: -len(r["suffixes"])):
            family.put(np.frombuffer(_expand(r["data"]), np.uint8), np.frombuffer(_expand(r["suffixes"]), np.int64), np.frombuffer(_expand(r["owners"]), np.int64), (r["batch"],))
        own = Windows([Message(r["body"]) for r in rows], 0)
        base = len(family.data)
        level = family.level(own.data, own.at, own.owner, number)
        owner = family.matches(level)[np.argsort(level[0] - base, kind="stable")]
        out = [(b, s, body, None, None, None, None, None) for b, s, body in _answers([own.taken(owner)], [r["block"] for r in rows], shard)]
        family.add(level)
        suffixes, owners, batches = family.levels[-1]
        covered = np.zeros(len(family.data) + 1, np.int32)
        np.add.at(covered, suffixes, 1)
        np.add.at(covered, suffixes + LENGTH, -1)
        inside = np.cumsum(covered[:-1]) > 0
        place = np.cumsum(inside) - 1
        blobs = [_squeeze(x.tobytes()) for x in (family.data[inside], place[suffixes].astype(np.int64), owners)]
        out.append((None, shard, None, number, [b for b in batches if b != number], *blobs))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _removed(size: int, known: bytes | None, answers: list[bytes]) -> np.ndarray:
    """A mask of a block's bytes that smaller documents own."""
    change = np.zeros(size + 1, np.int32)
    again = None
    runs = [_unpack(_expand(body), 0, 2)[0] for body in answers]
    if known is not None:
        raw = _expand(known)
        own, at = _unpack(raw, 0, 2)
        again, _ = _unpack(raw, at, 3)
        runs.append(own)
    if runs:
        start, count = (np.concatenate(x) for x in zip(*runs))
        np.add.at(change, start, 1)
        np.add.at(change, start + count, -1)
    gone = np.cumsum(change) > 0  # windows, by their starts
    if again and len(again[0]):
        there, count, here = again
        ramp = _ramps(count)
        gone[np.repeat(there, count) + ramp] |= gone[np.repeat(here, count) + ramp]
    start, count = _runs(np.flatnonzero(gone))
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + count + LENGTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _cut(carry: list[str], as_text: bool):
    names = ["doc_id", "n_bytes", "n_removed", "edges", "kept"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string() if as_text else pa.binary()]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row["ids"], row["ends"], row["data"])
        unnamed = np.unpackbits(np.frombuffer(row["unnamed"], np.uint8), count=len(block.ids)).tolist()
        told = list(zip(right["part"].to_pylist(), right["body"].to_pylist()))
        gone = _removed(len(block.data), next((b for s, b in told if s < 0), None), [b for s, b in told if s >= 0])
        out: list[tuple] = []
        for doc, no_id, a, b in zip(block.ids.tolist(), unnamed, block.begins.tolist(), block.ends.tolist()):
            mask = gone[a:b]
            n = int(mask.sum())
            spans: list[int] = []
            kept = block.raw[a:b]
            if n:
                spans = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
                kept = block.data[a:b][~mask].tobytes()
            out.append((None if no_id else doc, b - a, n, spans, kept.decode(errors="ignore") if as_text else kept))
        cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        del out, gone, block
        trim()
        rest = pa.ipc.open_stream(_expand(row["rest"])).read_all().combine_chunks() if carry else None
        return pa.Table.from_arrays([*cols, *(rest.columns if carry else [])], names + carry)

    return run


def stored_batches(spark: SparkSession, index: str) -> list[int]:
    """Numbers of the batches whose levels stand in an index folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n.removeprefix("batch-")) for n in names if n.startswith("batch-"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, as_text: bool = False, index: str | None = None, index_shards: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, edges (begin, end, begin, ... of the removed runs) and the kept bytes.

    The columns named in ``carry`` come along unchanged. ``as_text``: kept is a string, without the
    rests of characters that lost some of their bytes. ``index``: a folder with the levels of earlier
    calls, which these documents meet and join; it has ``index_shards`` shards from the first call on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    carry = list(carry or [])
    out = T.StructType.fromDDL(f"doc_id long, n_bytes long, n_removed long, edges array<long>, kept {'string' if as_text else 'binary'}")
    if set(carry) & set(out.names):
        raise ValueError(f"columns to carry must not be named like {out.names}")
    for c in carry:
        out.add(c, docs.schema[c].dataType)
    texts, _ = store(blocks(docs, id_col, text_col, carry), "blocks")
    parts, inner, hash_parts = layout(texts.agg(F.sum("size")).first()[0] or 0)
    bodies = texts.select("block", "ids", "ends", "data")
    by_block = lambda df: df.repartition(parts, "block").groupBy("block")
    if index:
        before = stored_batches(spark, index)
        number, shards = (before[-1] if before else 0) + 1, index_shards
        sent = bodies.mapInArrow(_send_windows(shards, 1, 1, False), _MESSAGES).withColumnRenamed("part", "shard")
        levels = spark.read.schema(_LEVELS).parquet(*(f"{index}/batch-{k:08d}" for k in before)) if before else spark.createDataFrame([], _LEVELS)
        met, _ = store(sent.groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(_meet(number), "block long, shard long, body binary, batch long, absorbed array<long>, data binary, suffixes binary, owners binary"), "met")
        met.filter("batch is not null").select("shard", "batch", "absorbed", "data", "suffixes", "owners").write.parquet(f"{index}/batch-{number:08d}")
        back = met.filter("batch is null").select("block", F.col("shard").alias("part"), "body")
    else:
        hashes = bodies.mapInArrow(_send_hashes(hash_parts), "shard long, block long, low binary, twice binary, windows binary")
        bits, _ = store(hashes.repartition(hash_parts, "shard").groupBy("shard").applyInPandas(_repeated, "block long, shard long, bits binary, hot binary"), "bits")
        _free(spark)
        sent = by_block(bodies).cogroup(by_block(bits)).applyInArrow(_send_windows(parts, inner, hash_parts, True), _MESSAGES)
        back, _ = store(sent.repartition(parts, "part").groupBy("part").applyInPandas(_own(inner), _MESSAGES), "owners")
        _free(spark)
    return by_block(texts.drop("size")).cogroup(by_block(back)).applyInArrow(_cut(carry, as_text), out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with repeated bytes cut out of ``text`` and ``n_chars`` counted again.

    A character that loses some of its bytes goes; so does a document that loses all of its text.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carry = [f"carried_{i}" for i in range(len(others))]  # names that can't clash with the operator's own
    rows = docs.select("doc_id", "text", *(F.col(c).alias(k) for c, k in zip(others, carry)))
    cut = remove_repeats(rows, carry=carry, as_text=True).filter("n_bytes = 0 or n_removed < n_bytes")
    made = dict(zip(others, carry)) | {"doc_id": "doc_id", "text": "kept"}
    return cut.select(*(F.length("kept").cast("long").alias(c) if c == "n_chars" else F.col(made[c]).alias(c) for c in docs.columns))


def _free(spark) -> None:
    """Let the context cleaner delete the shuffle files of finished phases now, not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
