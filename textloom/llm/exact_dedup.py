"""Exact dedup by composable polynomial fingerprints, with a chunkwise comparison of what they call equal."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, lean, reliable, small_side, text_or_empty

#: Primes below 2^31 and their bases: four 31-bit hashes make the fingerprint (124 bits), next to the length.
PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], dtype=np.uint64)
BASES = np.array([1103515245, 1664525053, 1284865837, 1583458089], dtype=np.uint64)
CHUNK = 4096
#: Bytes of a chunk of the streaming comparison.
COMPARE = 16_384
#: Bytes of a text above which it is cut into parts of that size, hashed by many tasks.
HUGE = 8 << 20


def _powers(n: int) -> np.ndarray:
    out = np.ones((n + 1, 4), dtype=np.uint64)
    for i in range(1, n + 1):
        out[i] = out[i - 1] * BASES % PRIMES
    return out


POWERS = _powers(CHUNK)
#: POWERS in falling order, so that a row of bytes times them is its hash.
FALLING = np.ascontiguousarray(POWERS[:CHUNK][::-1])
SHIFT = [int(x) for x in POWERS[CHUNK]]
P = [int(x) for x in PRIMES]


def combine(left: tuple[list[int], int], right: tuple[list[int], int]) -> tuple[list[int], int]:
    """Hash and length of a concatenation from those of its parts: H(AB) = H(A) * base^len(B) + H(B)."""
    (a, n), (b, m) = left, right
    return [(x * pow(int(base), m, p) + y) % p for x, y, base, p in zip(a, b, BASES, P)], n + m


def poly_hash(body: np.ndarray) -> list[int]:
    """The four hashes of a text's bytes.

    All whole chunks are hashed at once (a matrix product in which they don't depend on each other), then combined by
    length-shifted arithmetic, so a huge text costs no more a byte than a short one.  A product is below 2^40 and a
    chunk's sum below 2^52: nothing overflows.
    """
    n = len(body)
    whole = n // CHUNK
    h = [0, 0, 0, 0]
    for at in range(0, whole, 256):  # 1 MB at a time, 8 MB as 64-bit numbers
        part = body[at * CHUNK : min(whole, at + 256) * CHUNK].reshape(-1, CHUNK).astype(np.uint64)
        for row in ((part + 1) @ FALLING % PRIMES).tolist():
            h = [(x * s + y) % p for x, s, y, p in zip(h, SHIFT, row, P)]
    if rest := n - whole * CHUNK:
        tail = ((body[whole * CHUNK :].astype(np.uint64) + 1) @ FALLING[CHUNK - rest :] % PRIMES).tolist()
        h = [(x * int(s) + y) % p for x, s, y, p in zip(h, POWERS[rest], tail, P)]
    return h


def _body() -> Column:
    """A text's bytes with each run of white space made one space."""
    return F.regexp_replace(text_or_empty(), WS, " ").cast("binary")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, f1, f2, text_sha256 of every row's normalised text; f1 and f2 are null for texts of over HUGE bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _body().alias("body")).select(
        "doc_id", F.when(F.octet_length("body") <= HUGE, F.col("body")).alias("body"), F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("text_sha256")
    )

    def hashed(batches):
        for batch in batches:
            out = [[], []]
            for value in batch.column(1):
                h = poly_hash(np.frombuffer(value.as_buffer(), dtype=np.uint8)) if value.is_valid else None
                out[0].append(h and h[0] << 31 | h[1])
                out[1].append(h and h[2] << 31 | h[3])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(f, pa.int64()) for f in out), batch.column(3)], names=["doc_id", "n_bytes", "f1", "f2", "text_sha256"])

    return rows.mapInArrow(lean(hashed), f"doc_id {kind}, n_bytes long, f1 long, f2 long, text_sha256 string")


def huge_fingerprints(docs: DataFrame) -> DataFrame:
    """The rows of fingerprints() for texts of over HUGE bytes, each hashed by many tasks.

    A text's parts are dealt out; each is hashed and shifted by the length of what follows it, and a text's shifted
    hashes are summed up, first within tasks.  Rows that repeat an id and a text are one row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.where(F.octet_length("text") > HUGE).select("doc_id", _body().alias("body")).select("doc_id", "body", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("text_sha256"))
    starts = F.sequence(F.lit(1).cast("long"), F.col("n_bytes"), F.lit(HUGE).cast("long"))
    parts = rows.where(F.col("n_bytes") > HUGE).select("doc_id", "text_sha256", "n_bytes", F.explode(starts).alias("at"), "body")
    parts = parts.withColumn("part", F.substring(F.col("body"), F.col("at").cast("int"), F.lit(HUGE))).drop("body").repartition(n, "text_sha256", "at")

    def hashed(batches):
        for batch in batches:
            shifted = [[], [], [], []]
            for whole, at, value in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                part = np.frombuffer(value.as_buffer(), dtype=np.uint8)
                h, _ = combine((poly_hash(part), len(part)), ([0, 0, 0, 0], whole - (at - 1) - len(part)))
                for out, x in zip(shifted, h):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array(x, pa.int64()) for x in shifted)], names=["doc_id", "text_sha256", "n_bytes", "at", "h0", "h1", "h2", "h3"])

    each = parts.mapInArrow(lean(hashed), f"doc_id {kind}, text_sha256 string, n_bytes long, at long, h0 long, h1 long, h2 long, h3 long")
    once = each.groupBy("doc_id", "text_sha256", "n_bytes", "at").agg(*[F.max(f"h{k}").alias(f"h{k}") for k in range(4)])
    sums = once.groupBy("doc_id", "text_sha256", "n_bytes").agg(*[(F.sum(f"h{k}") % P[k]).alias(f"h{k}") for k in range(4)])
    pair = lambda a, b: F.shiftleft(F.col(a), 31).bitwiseOR(F.col(b))
    return sums.select("doc_id", "n_bytes", pair("h0", "h1").alias("f1"), pair("h2", "h3").alias("f2"), "text_sha256")


def all_fingerprints(docs: DataFrame) -> DataFrame:
    """fingerprints() of every row, with those of huge texts filled in; written to the shared folder."""
    prints = reliable(fingerprints(docs))
    if prints.where("f1 is null").isEmpty():
        return prints
    huge = reliable(huge_fingerprints(docs)).select(F.struct("doc_id", "text_sha256", "f1", "f2").alias("_huge"))
    same = F.col("doc_id").eqNullSafe(F.col("_huge")["doc_id"]) & (F.col("text_sha256") == F.col("_huge")["text_sha256"])
    filled = prints.where("f1 is null").join(huge, same).select("doc_id", "n_bytes", F.col("_huge")["f1"].alias("f1"), F.col("_huge")["f2"].alias("f2"), "text_sha256")
    return reliable(prints.where("f1 is not null").unionAll(filled))


KEY = ["n_bytes", "f1", "f2"]


def _chunks(docs: DataFrame, members: DataFrame) -> DataFrame:
    """fingerprint, member, sha, chunk_no and chunk of the texts of some members (doc_id, fingerprint, text_sha256).

    Rows that repeat a doc_id may hold other texts: only those that the member stands for take part.
    """
    names = members.select(F.struct("doc_id", *KEY, "text_sha256").alias("_m"))
    texts = docs.select("doc_id", "text").join(small_side(names), F.col("doc_id").eqNullSafe(F.col("_m")["doc_id"])).select("doc_id", "_m", _body().alias("body"))
    texts = texts.where((F.octet_length("body") == F.col("_m")["n_bytes"]) & (F.sha2("body", 256) == F.col("_m")["text_sha256"]))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("n_bytes") - 1), F.lit(COMPARE).cast("long"))
    pieces = F.transform(starts, lambda at: F.substring(F.col("body"), (at + 1).cast("int"), F.lit(COMPARE)))
    return texts.select("_m.*", "body").select("doc_id", *KEY, "text_sha256", F.posexplode(pieces).alias("chunk_no", "chunk"))


def unequal_groups(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """Keys of fingerprint groups whose texts are not all the same, found by comparing them chunk by chunk.

    Only texts of groups of two or more are read.  A chunk's smallest and largest bytes over its group are kept, first
    within each task: a group of any size is reduced before it is shuffled, and no task gathers a group.
    """
    shared = groups.where(F.col("group_size") > 1).select(*KEY)
    members = reliable(prints.join(small_side(shared), KEY, "left_semi").select("doc_id", *KEY, "text_sha256").distinct())
    ends = _chunks(docs, members).groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return ends.where(F.col("least") != F.col("most")).select(*KEY).distinct()


def classes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, fingerprint, text_sha256 and class of the members of unequal groups: two have a class if all their chunks are equal.

    A chunk is named by the first member that has it; a member's names, one a chunk, are its class.
    """
    chunks = _chunks(docs, members)
    name = F.struct(F.col("doc_id"), F.col("text_sha256"))
    names = reliable(chunks.groupBy(*KEY, "chunk_no", "chunk").agg(F.min(name).alias("name")))
    named = chunks.join(names, [*KEY, "chunk_no", "chunk"]).select("doc_id", *KEY, "text_sha256", "chunk_no", "name").distinct()
    whole = named.groupBy("doc_id", *KEY, "text_sha256").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "name"))).alias("all"))
    return whole.select("doc_id", *KEY, "text_sha256", F.to_json("all").alias("class"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of whitespace became one space.  Of equal texts the row with the
    smallest doc_id stays.  Null text counts as empty; empty texts are equal to each other.  A null doc_id never wins
    against another id (keep_id is null only where all are).  Rows that repeat an id and a text are each in the result
    and in group_size, and all are kept or none.  An empty table gives no rows; extra columns are not read.

    Texts are read once for fingerprints and, for groups of two or more, once more for the comparison; what is shuffled
    between is some bytes a row.  Huge texts are hashed in parts, by many tasks.  A group that the comparison finds
    unequal is split by the chunks in which its texts differ.
    """
    prints = all_fingerprints(docs)
    groups = reliable(prints.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    unequal = reliable(unequal_groups(docs, prints, groups))
    if not unequal.isEmpty():
        members = reliable(prints.join(unequal, KEY, "left_semi").select("doc_id", *KEY, "text_sha256").distinct())
        split = reliable(classes(docs, members)).select(F.struct("doc_id", *KEY, "text_sha256", "class").alias("_c"))
        same = [F.col("doc_id").eqNullSafe(F.col("_c")["doc_id"]), *(F.col(k) == F.col("_c")[k] for k in [*KEY, "text_sha256"])]
        prints = prints.join(split, functools.reduce(Column.__and__, same), "left").select("doc_id", *KEY, "text_sha256", F.coalesce(F.col("_c")["class"], F.lit("")).alias("split"))
        groups = reliable(prints.groupBy(*KEY, "split").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    key = [c for c in groups.columns if c not in ("keep_id", "group_size")]
    # groups is one row a key and was written, so a hot key is split by the skew join
    return prints.join(groups, key).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those whose text another row of smaller doc_id has.

    Null text counts as empty, and of rows with a null id and one text that no other id has, one stays.  Of rows that
    repeat an id and a text one stays.  An empty table gives an empty one.  The ids that go are broadcast if they are few; else rows are dealt
    by id once.
    """
    found = reliable(exact_dedup(docs))
    names = docs.columns
    gone = small_side(found.where(~F.col("kept")).select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("_gone")))
    rows = docs.select(F.struct(*names).alias("_row"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("_row")["text"], F.lit("")), WS, " ").cast("binary"), 256)
    # not an equality, so that texts are hashed only where the id is one of those that go
    same = F.col("_row")["doc_id"].eqNullSafe(F.col("_gone")["id"]) & sha.contains(F.col("_gone")["sha"])
    left = rows.join(gone, same, "left_anti")
    again = reliable(found.where("kept").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_again")))
    if not again.isEmpty():
        on = F.col("_row")["doc_id"].eqNullSafe(F.col("_again"))
        some = left.join(again, on, "left_semi").withColumn("_sha", sha).withColumn("_id", F.col("_row")["doc_id"]).dropDuplicates(["_id", "_sha"]).select("_row")
        left = left.join(again, on, "left_anti").unionAll(some)
    return left.select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
