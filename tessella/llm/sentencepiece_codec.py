"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The vocabulary's pieces are one automaton. It reads a text once; at each character the outputs of its
state, reached over the output links, are exactly the pieces that end there, and each relaxes the best
score of its end from the (already final) best score of its start. The result is the segmentation with
the largest sum of piece scores, the longest last piece on ties: the unigram model over the file's
pieces and scores. (The BPE merge order of a file of that type is another model; see the README.)
Characters in no piece become their bytes' pieces where the vocabulary has them, else the unknown id.

No piece spans from other characters into a space mark, which is checked, so texts fall apart before
each run of space marks without changing the optimum; each worker keeps a bounded cache of such parts.
Decoding joins the pieces, turns bytes back and takes off the dummy space.

Edge cases: null and empty texts have no ids; very long texts are encoded whole; repeated rows are
encoded each by itself; a literal space mark decodes to a space, as in the library; an empty table
gives an empty result; other columns are ignored. There is no shuffle.
"""

from __future__ import annotations

import re
import zlib
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from ._common import BoundedCache, id_and_text, kept, map_arrow

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: What an unknown character costs beyond the worst piece.
PENALTY = 10.0


class Codec:
    """The pieces of a SentencePiece model file under the unigram objective."""

    def __init__(self, source: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(source)
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a model without text normalization is needed")
        self.prefix = MARK if model.normalizer_spec.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.scores = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type in (NORMAL, USER)}
        if any(MARK in p.lstrip(MARK) or (p.startswith(MARK * 2) and p.strip(MARK)) for p in self.scores):
            raise ValueError("a piece spans over a space mark")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown_score = min(s for s, _ in self.scores.values()) - PENALTY
        self.single = frozenset(p for p in self.scores if len(p) == 1)
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece, (score, i) in self.scores.items():
            found.add_word(piece, (len(piece), score, i))
        found.make_automaton()
        return found

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text with space marks."""
        n = len(text)
        score = [0.0] + [-np.inf] * n
        start, ident = [0] * (n + 1), [0] * (n + 1)
        single, at = self.single, 0

        def unknowns(stop: int) -> None:
            """Settle the ends up to ``stop`` (exclusive): unknown characters come after all pieces."""
            nonlocal at
            while at < stop:
                if text[at] not in single and score[at] + self.unknown_score > score[at + 1]:
                    score[at + 1], start[at + 1], ident[at + 1] = score[at] + self.unknown_score, at, -1
                at += 1

        for last, (length, own, i) in self.automaton.iter(text):
            if at < last:
                unknowns(last)
            s = score[last + 1 - length] + own
            if s > score[last + 1]:
                score[last + 1], start[last + 1], ident[last + 1] = s, last + 1 - length, i
        unknowns(n)
        ids: list[int] = []
        end = n
        while end:
            if ident[end] >= 0:
                ids.append(ident[end])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in reversed(text[start[end] : end].encode())]
            else:
                ids.append(self.unknown)
            end = start[end]
        return ids[::-1]

    def pack(self, word: str) -> bytes:
        """The packed ids of a word that follows one space mark."""
        return np.array(self.best(MARK + word), "<u4").tobytes()

    def encode(self, text: str, look=None) -> bytes:
        """The ids of a whole text, little-endian unsigned 32 bit. ``look``: a cached ``pack``."""
        if not text:
            return b""
        if self.prefix and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return b"".join(map(look or self.pack, text.split(" ")))  # every space starts a part
        return b"".join(np.array(self.best(p), "<u4").tobytes() for p in self.parts(self.prefix + text.replace(" ", MARK)))

    @cached_property
    def texts(self) -> list[bytes]:
        """What each id decodes to."""
        kinds = {UNKNOWN: " ⁇ ", NORMAL: None, USER: None}
        return [bytes([int(p[1:-1], 16)]) if k == BYTE else (kinds[k] or p.replace(MARK, " ")).encode() if k in kinds else b"" for p, k in zip(self.pieces, self.kinds)]

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.texts.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix and raw.startswith(b" "):
            raw = raw[1:]
        return raw.decode(errors="replace")


def _codec(source: bytes) -> tuple[Codec, BoundedCache]:
    def make():
        codec = Codec(source)
        return codec, BoundedCache(codec.pack, limit=400_000)

    return kept("sentencepiece", zlib.crc32(source), make)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_ids and ids (little-endian unsigned 32 bit) of every whole text."""
    with open(model_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, cache = _codec(shared.value)
        texts = batch.column(1).to_pylist()
        ids = [codec.encode(t, cache.__getitem__) for t in texts]
        cols = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_ids", "ids"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_ids long, ids binary")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """The encoded rows with the text that their ids decode to."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, _ = _codec(shared.value)
        texts = [codec.decode(i) for i in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "n_bytes", "n_ids", "ids", "text"])

    return map_arrow(encoded.select("doc_id", "n_bytes", "n_ids", "ids"), run, "doc_id long, n_bytes long, n_ids long, ids binary, text string")
