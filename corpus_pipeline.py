"""A corpus from raw documents to token ids in training order, in five stages; each is written as Parquet and read by the next.

Every stage takes documents with any further columns, and passes those through.  Null doc_ids, null texts and null
sources, repeated rows, ties and empty tables have a defined result, which each stage's docstring names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, language_id, mixing, sentencepieces, simhash
from textloom.llm.common import scratch, table


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents of no known language go; those of null or empty text, or without a letter, are such.

    Null ids, repeated rows and further columns stay as they are.
    """
    return language_id.known_language_only(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the document with the smallest doc_id stays; a null id only where no other has the text.

    Null text counts as empty; of rows that repeat an id and a text one stays.
    """
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each group the document with the smallest doc_id stays, a null id only in a group without others.

    Texts that are null or have no word are one group.  Rows that repeat an id stay or go together.
    """
    return simhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights by the curriculum: documents as often as the mix takes them, in training order.

    Documents without words have nothing to take and go.  Null sources are one source, the last; ties go by doc_id.
    """
    return mixing.mixed_documents(docs, phases=mixing.CURRICULUM)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding of each document of the mix, decoded again, with its place in training order.

    Columns: doc_id, n_tokens, ids_crc32, text_crc32, round_trip, ids, and position, which counts the mix's rows from 0
    as they were written.  Null text has no ids.
    """
    return sentencepieces.encode_documents(mixing.in_order(docs), with_ids=True, keep=["_order"]).withColumnRenamed("_order", "position")


STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL can express neither the n-gram profiles nor the model's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
