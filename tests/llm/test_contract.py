"""Every opN_ query over the smallest tables: the contract's columns and rows, and the SQL of their parts."""

from __future__ import annotations

import zlib

import pytest
from helpers import SF
from oracle import connect, difference
from tessella.llm import queries as llm

CONTRACT = {
    "op1_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, shard string, digest string, offset bigint, length bigint",
    "op6_sentencepiece": "doc_id bigint, n_bytes bigint, n_ids bigint, ids_crc32 bigint, decoded_bytes bigint, decoded_sha256 string",
    "op7_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op9_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op10_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def same(rows, name):
    """What every row of a query keeps by itself."""
    for r in rows:
        if name == "op1_suffix_dedup":
            assert 0 <= r.n_removed <= r.n_bytes and (r.n_spans > 0) == (r.n_removed > 0) and len(r.kept_sha256) == 64
        elif name == "op4_toxicity":
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3)
        elif name == "op5_media_columns":
            assert r.digest == r.media_sha256 and r.length == r.media_bytes and r.payload_bytes % 64 == 0 and r.offset % 512 == 0
        elif name == "op7_language":
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        elif name == "op8_simhash":
            assert r.component_id <= r.doc_id and len(r.fingerprint) == 16
        elif name == "op9_html_text":
            assert r.n_chars == len(r.text) and r.text == " ".join(r.text.split())
        elif name == "op10_quality":
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)


@pytest.mark.parametrize("name", CONTRACT)
def test_contract(spark, con, name):
    df = llm.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    for column in CONTRACT[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind, column
    rows = df.collect()
    key = "page_id" if name == "op9_html_text" else "doc_id"
    want = [x for (x,) in con.sql(f"SELECT {key} FROM {'pages' if key == 'page_id' else 'documents'}").fetchall()]
    got = [r[key] for r in rows if name != "op2_packing" or r.piece == 0]
    assert sorted(got) == sorted(want)
    same(rows, name)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_parts_equal_sql(spark, con, name):
    assert difference(llm.QUERIES[name](spark, SF), con, llm.ORACLES[name]) is None
