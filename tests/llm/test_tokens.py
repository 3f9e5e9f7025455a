"""Token counts, packing and the SentencePiece codec."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF
from tessella.llm import packing, sentencepiece_codec, token_counts
from tessella.llm._common import BoundedCache
from tessella.llm.tokenizer import ByteBPE
from tokenizers import Tokenizer

FILE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(spark, odd, none, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (odd, docs):
        text = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, FILE).collect()), key=str)
        want = [(i, len((t or "").encode()), n := len(ids_of(library, t)), n > 1024) for i, t in text]
        assert got == sorted(want, key=str)
    assert token_counts.token_counts(none, FILE).count() == 0


def test_the_table_is_bounded_and_frequent(spark):
    df = spark.createDataFrame([(i, "common words here " + f"rare{i}") for i in range(50)], "doc_id long, text string")
    assert sorted(token_counts.frequent_words(df, 3)) == ["common", "here", "words"]


def test_the_compact_table_finds_what_it_holds():
    rng = random.Random(7)
    entries = {"".join(rng.choice("abé ▁") for _ in range(rng.randrange(0, 9))): rng.randrange(1, 300) for _ in range(5_000)}
    table = token_counts.LengthTable(entries)
    assert all(table.get(k) == v for k, v in entries.items())
    assert all(table.get(k + "!") == 0 for k in entries)
    assert table.nbytes() < 40 * len(entries) and token_counts.LengthTable({}).get("a") == 0


def test_files_that_rank_otherwise_are_refused():
    with open(FILE) as f:
        spec = json.load(f)
    ByteBPE(json.dumps(spec).encode())
    for change in (lambda s: s["model"]["merges"].reverse(), lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s["pre_tokenizer"].update(add_prefix_space=True)):
        other = json.loads(json.dumps(spec))
        change(other)
        with pytest.raises(ValueError):
            ByteBPE(json.dumps(other).encode())


def test_cache_keeps_what_is_used():
    made = []
    cache = BoundedCache(lambda k: made.append(k) or k * 2, {0: "base"}, limit=10)
    for k in range(1, 100):
        assert cache[1] == 2 and cache[k] == 2 * k and cache[0] == "base"
        assert len(cache) <= 8
    assert made.count(1) == 1


def check_packing(rows, library, texts, capacity=1024):
    """Every contract of the pieces and the sequences."""
    at: dict = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    own: dict = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = [*ids_of(library, text), 2]
        parts = sorted(own[doc], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert all(p.length == capacity for p in parts[1:])
        assert sum(p.length for p in parts) == len(ids) and len(parts) == -(-len(ids) // capacity)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    return len(at)


def test_packing_contract(spark, odd, none, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack_documents(docs, FILE).collect()
    assert check_packing(rows, library, texts) <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1
    rows = packing.pack_documents(odd, FILE).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert packing.pack_documents(none, FILE).count() == 0


def test_rounds_over_several_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 50)
    rng = random.Random(1)
    pieces = spark.createDataFrame([(i, 0, 0, rng.randrange(1, 101), 0) for i in range(3000)], packing.PIECE)
    rows = packing.pack(pieces, 100).collect()
    assert len(rows) == 3000
    levels: dict = {}
    for r in rows:
        levels[r.sequence_id] = levels.get(r.sequence_id, 0) + r.length
    assert max(levels.values()) <= 100
    assert len(levels) <= 1.06 * -(-sum(levels.values()) // 100)


def test_lengths_that_nothing_completes_stay_in_their_buckets(spark, monkeypatch):
    """All lengths over half: no round can close anything, and no task gets more than about a bucket."""
    monkeypatch.setattr(packing, "BUCKET", 50)
    sizes = []
    plain = packing.pack_round
    monkeypatch.setattr(packing, "pack_round", lambda items, buckets, *a: sizes.append((items.count(), buckets)) or plain(items, buckets, *a))
    rng = random.Random(4)
    pieces = spark.createDataFrame([(i, 0, 0, rng.randrange(520, 901), 0) for i in range(2000)], packing.PIECE)
    rows = packing.pack(pieces, 1024).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 2000 and {r.offset for r in rows} == {0}
    assert sizes == [(2000, 40)]


def test_rounds_use_buckets_of_what_is_left(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 40)
    sizes = []
    plain = packing.pack_round
    monkeypatch.setattr(packing, "pack_round", lambda items, buckets, *a: sizes.append((items.count(), buckets)) or plain(items, buckets, *a))
    rng = random.Random(6)
    pieces = spark.createDataFrame([(i, 0, 0, rng.randrange(1, 101), 0) for i in range(3000)], packing.PIECE)
    rows = packing.pack(pieces, 100).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    assert all((b[1] == a[1] + a[2] if a[0] == b[0] else b[1] == 0) for a, b in zip(places, places[1:])) and places[0][1] == 0
    assert len(sizes) > 1 and all(b == -(-n // 40) for n, b in sizes)


def test_sum_of_squares_by_hand():
    # 6 and 5 don't fit together; 4 may go to gap 4 (closing it) or gap 5: closing leaves the smaller sum
    seq, offset = packing.sum_of_squares(np.array([6, 5, 4]), 10)
    assert seq.tolist() == [0, 1, 0] and offset.tolist() == [0, 0, 6]


def test_sequences_hold_the_ids(spark, library):
    df = spark.createDataFrame([(1, "hello world"), (2, "more words"), (3, None)], "doc_id long, text string")
    whole = packing.sequences(packing.pack_documents(df, FILE, with_ids=True)).collect()
    assert len(whole) == 1
    want = {tuple([*ids_of(library, t), 2]) for t in ("hello world", "more words", "")}
    got = np.frombuffer(whole[0].ids, "<u4").tolist()
    parts, now = set(), []
    for i in got:
        now.append(i)
        if i == 2:
            parts.add(tuple(now))
            now = []
    assert parts == want and whole[0].n_tokens == len(got)


def best_score(codec, marked):
    """The largest sum over all segmentations, by the definition."""
    best = [0.0] + [float("-inf")] * len(marked)
    for j in range(1, len(marked) + 1):
        for i in range(max(0, j - 24), j):
            if marked[i:j] in codec.scores:
                best[j] = max(best[j], best[i] + codec.scores[marked[i:j]][0])
        if marked[j - 1] not in codec.single:
            best[j] = max(best[j], best[j - 1] + codec.unknown_score)
    return best[-1]


def test_viterbi_is_optimal_and_round_trips(spark, odd, none):
    with open(MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    rng = random.Random(2)
    for _ in range(400):
        w = "".join(rng.choice("theingandoreüß ") for _ in range(rng.randrange(1, 14)))
        marked = codec.prefix + w.replace(" ", "▁")
        ids = np.frombuffer(codec.encode(w), "<u4").tolist()
        assert sum(codec.scores[codec.pieces[i]][0] for i in ids) == best_score(codec, marked)
        assert codec.decode(codec.encode(w)) == w
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (docs, odd):
        back = sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL), MODEL)
        want = sorted(((r.doc_id, (r.text or "").replace("▁", " ")) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == want
    assert sentencepiece_codec.encode(none, MODEL).count() == 0
