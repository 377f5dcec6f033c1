"""Corpus tables as files: path, text, and what else a search carries."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as source/lang/id.txt."""
    d = read(spark, sf_dir, "documents")
    path = F.format_string("%s/%s/%08d.txt", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), "doc_id")
    return d.select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "pages")
    return d.select(F.format_string("pages/%08d.html", "page_id").alias("path"), F.coalesce("html", F.lit("")).alias("text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "conversations")
    return d.select(F.format_string("conv/%08d/%04d.txt", "conv_id", "turn").alias("path"), F.coalesce("text", F.lit("")).alias("text"))


def stamp(spark: SparkSession, sf_dir: str, name: str) -> dict:
    """What a table's files are: their names, sizes and times, without reading a row's columns."""
    files = read(spark, sf_dir, name).select("_metadata.file_name", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    row = files.agg(F.count(F.lit(1)), F.sum("file_size"), F.expr("bit_xor(xxhash64(file_name, file_size, file_modification_time))")).first()
    return {"files": row[0], "bytes": row[1], "hash": row[2]}


_FOLDERS: dict[str, str] = {}


def shared(spark: SparkSession, name: str) -> str:
    """A path in the folder that the cluster names in spark.checkpoint.dir; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        key = spark.sparkContext.applicationId
        folder = _FOLDERS.get(key) or _FOLDERS.setdefault(key, tempfile.mkdtemp(prefix="textloom-"))
    return f"{folder.rstrip('/')}/{name}"
