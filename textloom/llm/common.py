"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace in every contract of this package: space and the ASCII controls 9 to 13.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows, and most bytes of them, that are ever broadcast explicitly; above that a side is joined by shuffle.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, through Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the cluster names in spark.checkpoint.dir.

    Only a local session without that setting (a test) gets one of its own: on a cluster, where a temporary folder
    would be each machine's, it is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textloom-checkpoints-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """Path of a table to be written in the shared folder."""
    return f"{shared_folder(spark)}/{name}"


def reliable(df: DataFrame) -> DataFrame:
    """The rows of df written to the shared checkpoint folder, lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_of_order(df: DataFrame) -> DataFrame:
    """Aggregated rows dealt out anew, so that a join on their key shuffles both of its sides.

    A join that takes over an aggregate's partitions can't split the other side's hot keys; this one can.  It costs a
    shuffle of one row a key.
    """
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: strings, binaries and lists of simple values by their length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType):
        return F.greatest(F.size(value), F.lit(0)) * 16 + 24
    return F.lit(8)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows were counted and measured to be few and small, else unmarked (shuffle join).

    df should be cheap to count (checkpointed rows of some bytes each).
    """
    size = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16))
    n, total = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return F.broadcast(df) if n <= most and (total or 0) <= most_bytes else df


#: What a Python worker keeps for later tasks, by the operator whose tasks they are.
_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """Objects that a worker process keeps from one task of an operator to the next; see lean()."""
    return _CACHES.setdefault(owner, {})


def drop_caches(but: str = "") -> None:
    """Empties the caches of all operators but one."""
    for owner, cache in _CACHES.items():
        if owner != but:
            cache.clear()


@functools.cache
def _malloc_trim() -> Callable[[int], int]:
    """The C library's, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Returns to the system what Arrow's pool and malloc hold of freed memory."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def lean(work: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow, made to leave little memory with its worker process.

    Workers are used again, and idle ones count as their executor's memory in every later stage: freed memory is given
    back with each batch and at the end, and what the worker keeps for operators other than ``owner`` goes.  The rows
    are those of ``work``.
    """

    def run(batches):
        def each():
            for batch in batches:
                yield batch
                give_back()

        drop_caches(owner)
        try:
            yield from work(each())
        finally:
            give_back()

    return run


def hex64(value: Column) -> Column:
    """16 lowercase hex digits of a long, as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ids_hash_bucket(key: Column, digits: int = 3) -> Column:
    """First hex digits of md5 of a key as text: a bucket that every engine computes alike."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, digits)
