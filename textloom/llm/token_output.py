"""Token ids of documents in ascending doc_id order, written as directly addressable codes and read back.

A folder of segments holds rows of Parquet whose codes are neither compressed nor encoded, so that any token is read
from its segment's bytes as they lie there; ``base`` and ``n_tokens`` are the directory over segments.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import dac
from .common import scratch

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Tokens after which a segment is closed; a document is never cut, so a longer one is a segment of its own.
SEGMENT = 1 << 17
#: Bytes of input that a writing task is meant for.
SHARE = 256 << 20
#: Each segment is a page of its own, so that a reader skips the others; codes don't shrink under a second code.  A
#: writer holds one row group.
LAYOUT = {"compression": "uncompressed", "parquet.block.size": str(16 << 20), "parquet.enable.dictionary": "false", "parquet.page.size": "65536", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Units whose ids a worker keeps, twice (a young and an old generation).
CACHE = 400_000
GROUP = 64
#: Letters with signs behind them; the tokenizer always splits there (but for an apostrophe).
SIGNED = re.compile(r"([^\W\d_]+)([^\w\s']+)")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Whole texts to ids, through the tokenizer for each unit it has not met lately.

    The tokenizer's own split never crosses a single space or line feed between two other characters (a space goes to
    what follows, a lone line feed stands alone), so such texts are cut there and units are encoded apart; a text with
    any other white space, or with a string that the vocabulary adds as a token of its own, is encoded whole.  Ids are
    exactly those that the library gives for the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # byte-level vocabularies write a space before a word as this letter
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def units(self, text: str) -> list[str] | None:
        """Units of a text, the first one marked by two line feeds; None if it has to be encoded whole."""
        if any(t in text for t in self.added):
            return None
        words = text.split()
        gaps = len(words) - 1
        # as much white space as gaps, and all of it spaces and line feeds: one in each gap, none at the ends
        if text.count(" ") + text.count("\n") != gaps or len(text) - sum(map(len, words)) != gaps:
            return None
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\n\n" + parts[0]
        return parts

    def _fill(self, missing: list[str]) -> None:
        """Ids of units that no cache has; a word with signs behind it is put together from the two."""
        composed, plain = [], set()
        young, old = self.young, self.old
        for u in missing:
            m = SIGNED.fullmatch(u)
            if m is None:
                plain.add(u)
                continue
            parts = m[1], "\n\n" + m[2]
            composed.append((u, *parts))
            for part in parts:
                if part not in young:
                    if (ids := old.get(part)) is not None:
                        young[part] = ids
                    else:
                        plain.add(part)
        # words are a text of their own, whose ids are cut where one begins with a space; the rest goes one by one
        words = [u for u in plain if u[0] != "\n"]
        rest = [u for u in plain if u[0] == "\n"]
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(some):
                rest += some
                continue
            cuts, data = [*(starts * 4).tolist(), len(ids) * 4], ids.tobytes()
            for u, a, b in zip(some, cuts, cuts[1:]):
                young[u] = data[a:b]
        texts = [u[2:] if u.startswith("\n\n") else u if u[0] == "\n" else " " + u for u in rest]
        for at in range(0, len(texts), 5000):
            some = texts[at : at + 5000]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, numbers = np.array(e.ids, dtype="<u4"), np.array(e.word_ids, dtype=np.int64)
            cuts = (np.searchsorted(numbers, np.arange(len(some) + 1)) * 4).tolist()
            data = ids.tobytes()
            for u, a, b in zip(rest[at : at + 5000], cuts, cuts[1:]):
                young[u] = data[a:b]
        for u, word, signs in composed:
            young[u] = young[word] + young[signs]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(texts), GROUP):
            some = [self.units(t) if t else [] for t in texts[at : at + GROUP]]
            need = set().union(*[u for u in some if u])
            missing = []
            for u in need.difference(self.young):
                if (ids := self.old.get(u)) is not None:
                    self.young[u] = ids
                else:
                    missing.append(u)
            if missing:
                self._fill(missing)
            get = self.young.__getitem__
            for t, u in zip(texts[at : at + GROUP], some):
                if u is None:
                    e = self.tokenizer.encode(t, add_special_tokens=False)
                    out.append(np.array(e.ids, dtype="<u4").tobytes())
                else:
                    out.append(b"".join(map(get, u)))
            if len(self.young) > CACHE:
                self.old, self.young = self.young, {}
        return out


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One per worker process, so that later tasks meet a warm cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def _shards(docs: DataFrame, texts: DataFrame) -> int:
    """Tasks to write with: as many as the session deals to, and more if the input is large.

    The size is the plan's own statistic (that of the files), or a sum over the texts where there is none.
    """
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # text files shrink to about a third in Parquet; a table in memory makes a task too many at worst
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size * 3 // SHARE))


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, segment: int = SEGMENT) -> None:
    """Encodes whole texts and writes them to a folder of segments, in ascending doc_id order over shards and segments.

    Null text counts as empty (only the end id).  A null doc_id comes first.  Rows that repeat a doc_id are each
    written, in order of their text.  An empty table makes an empty folder; extra columns are not read.  Documents are
    dealt by ranges of doc_id, so each task writes one shard and holds one segment and one Arrow batch; segments are rows
    with a binary column that Spark's own writer commits, so a task that is run again leaves nothing twice.
    ``tokenizer`` is the path of the vocabulary, there on every node.
    """
    vocabulary = tokenizer or tokenizer_path()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = _shards(docs, texts)

    def encoded(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype="<u4").tobytes()
        base, number = 0, 0
        ids, lengths, parts, size = [], [], [], 0

        def row():
            nonlocal base, number, ids, lengths, parts, size
            blob = dac.pack(ids, lengths, np.frombuffer(b"".join(parts), dtype="<u4"))
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([base], pa.int64()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "segment", "base", "n_tokens", "blob"])
            base, number = base + size, number + 1
            ids, lengths, parts, size = [], [], [], 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                some = batch.slice(at, GROUP)
                for d, e in zip(some.column(0).to_pylist(), enc.encode([t or "" for t in some.column(1).to_pylist()])):
                    ids.append(d)
                    parts.append(e + end)
                    lengths.append(len(e) // 4 + 1)
                    size += lengths[-1]
                    if size >= segment:
                        yield row()
        if ids:
            yield row()

    rows = texts.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(encoded, "shard int, segment int, base long, n_tokens long, blob binary").write.options(**LAYOUT).parquet(path)


def _offsets(files: DataFrame) -> DataFrame:
    """of, offset: the tokens before each shard.  One row a shard, as many as the writer had tasks."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(F.col("shard").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))


def read_at(spark: SparkSession, path: str, positions: list[int]) -> list[int]:
    """The tokens at some positions of a folder of segments, counted over all documents; IndexError beyond the ends.

    The directory (two numbers a segment) is searched for the segments, and the scan reads the pages of those alone; a
    token then takes a byte of each of its levels and a rank between them.  Nothing is decompressed or decoded.
    """
    files = spark.read.parquet(path)
    if not positions:
        return []
    wanted = spark.createDataFrame([(int(p),) for p in sorted(set(positions))], "position long")
    place = files.select("shard", "segment", "base", "n_tokens").join(F.broadcast(_offsets(files)), F.col("shard") == F.col("of"))
    first = F.col("base") + F.col("offset")
    hits = place.join(F.broadcast(wanted), (F.col("position") >= first) & (F.col("position") < first + F.col("n_tokens")))
    at: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in hits.select("shard", "segment", "position", (F.col("position") - first).alias("i")).collect():  # a row a position asked for
        at.setdefault((r["shard"], r["segment"]), []).append((r["position"], r["i"]))
    if {p for some in at.values() for p, _ in some} != set(positions):
        raise IndexError("no such position")
    found = {}
    for (shard, segment), some in at.items():
        blob = files.where((F.col("shard") == shard) & (F.col("segment") == segment)).select("blob").first()["blob"]
        s = dac.Segment(blob)
        found |= {p: s.token(i) for p, i in some}
    return [found[p] for p in positions]


def read_token(spark: SparkSession, path: str, position: int) -> int:
    """One token of a folder of segments; see read_at()."""
    return read_at(spark, path, [position])[0]


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32 of every document in a folder of segments.

    Null doc_ids come first, repeated rows each have theirs; an empty folder of segments gives no rows.  Shards' totals are added up over shards (as many as the writer's tasks) and joined to the documents by broadcast.
    """
    files = spark.read.parquet(path)

    def decoded(batches):
        for batch in batches:
            for shard, base, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = dac.Segment(blob.as_buffer())
                crc = [zlib.crc32(s.document(k).astype("<u4", copy=False)) for k in range(s.n_docs)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, pa.int64()), pa.array([shard] * s.n_docs, pa.int32()), pa.array(s.starts[:-1] + base), pa.array(np.diff(s.starts)), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"],
                )

    docs = files.select("shard", "base", "blob").mapInArrow(decoded, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
    return docs.join(F.broadcast(_offsets(files)), F.col("shard") == F.col("of")).select("doc_id", (F.col("local_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' tokens (to a new folder in the shared one, if none is named) and returns what is read back."""
    path = path or scratch(docs.sparkSession, f"tokens-{uuid.uuid4().hex}")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
