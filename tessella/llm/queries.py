"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepiece_codec
from .html_extract import extract_text
from .language import identify_language
from .media import media_index
from .packing import pack_documents
from .quality import quality_rules, text_statistics
from .simhash import near_duplicates
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.floor(F.size("edges") / 2).alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = media_index(_table(spark, sf_dir, "documents"))
    return index.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "digest", "offset", "length", "width", "height", "bit_depth")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids as a digest, and whether they decode to the text again."""
    model = public_tokenizers.path(PIECES)
    docs = _table(spark, sf_dir, "documents")
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(docs, model), model)
    text_size = F.octet_length("text").cast("long")
    return back.select("doc_id", "n_bytes", "n_ids", F.crc32("ids").alias("ids_crc32"), text_size.alias("decoded_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of op10 alone, without its verdict."""
    return text_statistics(_table(spark, sf_dir, "documents")).drop("lang", "source")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5 stores, read back from the store: sizes and digests of the payloads."""
    return media_index(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def token_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes that op3 counts along with the tokens, and bounds that every count keeps."""
    counted = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))
    return counted.select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("at_most_bytes"), (F.col("over_limit") == (F.col("n_tokens") > 1024)).alias("limit_holds"))


def language_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts op7 gives a language at all."""
    found = identify_language(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.col("lang_pred") != "und").alias("has_language"), F.col("score").between(0, 1).alias("score_in_range"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_media_columns": op5_media_columns,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language": op7_language,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_quality": op10_quality,
    "quality_base": quality_base,
    "media_payloads": media_payloads,
    "token_sizes": token_sizes,
    "language_letters": language_letters,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '')"
_LINES = r"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
_PAYLOAD = "encode(coalesce(text, '')) || unhex(repeat('00', CASE WHEN coalesce(text, '') = '' THEN 64 ELSE ((64 - octet_length(encode(text)) % 64) % 64)::INT END))"

#: DuckDB SQL where it can express a query: parts of op3, op5, op7 and op10. The rest is held against plain versions.
ORACLES: dict[str, str] = {
    "quality_base": f"""
WITH t AS (SELECT doc_id, {_WORDS} AS w, {_LINES} AS l FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
s AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(array_to_string(w, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s""",
    "media_payloads": f"SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, octet_length({_PAYLOAD})::BIGINT AS payload_bytes, sha256({_PAYLOAD}) AS payload_sha256 FROM documents",
    "token_sizes": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, true AS at_most_bytes, true AS limit_holds FROM documents",
    "language_letters": r"SELECT doc_id, regexp_matches(coalesce(text, ''), '\p{L}') AS has_language, true AS score_in_range FROM documents",
}
