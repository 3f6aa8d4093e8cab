"""Corpus pipeline: language ID, near-copy removal, removal of repeated passages, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its
predecessor kept; all but the last return the columns of documents. Between stages
the documents are written as Parquet and read again.

Defined results: documents without a letter (null and empty ones too) or without a
confident language leave in the first stage (without labels to learn from, all with a
letter stay); of near copies the smallest id stays;
the first occurrence of a repeated passage stays, texts are shortened by whole
characters, a document that loses all its text leaves; an empty table gives an empty
result. Columns beside doc_id, text, lang and n_chars are passed on; packing returns
its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.llm import langid, packing, simhash, suffix_dedup
from codestrata.sources.stores import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents in a known language."""
    return langid.drop_unknown(docs, langid.train(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group, by the shingle length and bit distance of its contract."""
    return simhash.drop_near_copies(docs, width=4, max_bits=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: later occurrences of strings of 200 bytes leave their texts."""
    shorter = suffix_dedup.drop_repeats(docs, length=200, keep="first")
    if "n_chars" not in docs.columns:
        return shorter
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sequences of 2048 tokens; its workers have run the stages before, so they keep fewer words."""
    return packing.pack(docs, capacity=2048, end=1, remembered=400_000).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("packing", pack),
]

#: SQL can't express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
