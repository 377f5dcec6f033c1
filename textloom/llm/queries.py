"""The registered queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, language_id, mixing, secrets, sentencepieces, simhash, token_output, toxicity, url_filter
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: fingerprint and component of every row.  Null, empty and wordless texts have fingerprint zero; see simhash.near_dedup()."""
    return simhash.near_dedup(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: secrets of every row, with the partners of linked ones.  Null text has none; see secrets.secret_spans()."""
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: the 5 nearest of every 50th id.  Unusable vectors take no part, fewer candidates give fewer rows; see ann.nearest()."""
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: place and checksum of every row's ids as read back from the files.  Null text has the end id alone; see token_output.write_tokens()."""
    return token_output.token_output(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, labels: a score for every row, null and empty texts too; see toxicity.toxicity()."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the language of every row, ``und`` without a letter; see language_id.predict()."""
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: ids of every row and whether they decode to its text.  Null text has no ids; see sentencepieces.encode_documents()."""
    return sentencepieces.encode_documents(table(spark, sf_dir, "documents"), with_ids=True)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: every row's part in the mix, and its training position by mixing.CURRICULUM.  Null text has size 0 and no position; see mixing.assign()."""
    return mixing.mix(table(spark, sf_dir, "documents"), phases=mixing.CURRICULUM).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages: rule and verdict of every row; a null url has an empty host and path; see url_filter.judge_urls()."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the group of equal texts of every row.  Null text counts as empty; see exact_dedup.exact_dedup()."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_secret_scan,
        op3_nearest_neighbours,
        op4_token_output,
        op5_toxicity,
        op6_language_id,
        op7_sentencepiece,
        op8_mixing,
        op9_url_filter,
        op10_exact_dedup,
    )
}
SQL = {"op8_mixing": mixing.SQL, "op9_url_filter": url_filter.SQL, "op10_exact_dedup": exact_dedup.SQL}
