"""A training corpus from ``documents``: five stages, each one operator over what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared work folder and reads them
again for the next, so a stage is never computed twice and lost executors cost no more than a stage;
what a stage read is deleted once the next one is written.

Edge cases: a null or empty text is toxic only if the bias says so and goes with the language stage, for it
has no letters; a null id is never dropped as a copy; rows that share an id stand and fall together as copies
and never lose bytes to each other; very long texts pass whole; ties go to the smaller id; an empty table
passes every stage; other columns, whatever their names, come along until packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessella.llm._common import drop, store
from tessella.llm.language import with_language
from tessella.llm.near_copies import one_of_each
from tessella.llm.packing import pack_documents
from tessella.llm.suffix_dedup import without_repeats
from tessella.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that are predicted toxic."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no learned language."""
    return with_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that is 0.8 similar in shingles of five words."""
    return one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without byte strings that an earlier document has."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: No SQL: models, suffix arrays and packing are beyond it. Tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES:
        docs, path = store(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(spark, *before)
        before = [path]
    return docs
