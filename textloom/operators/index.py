"""A trigram index: a prefilter whose use never changes a result."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import dialect
from textloom.functions import text as T
from textloom.operators import segments, sides
from textloom.plans.spec import SearchSpec, Stage

VERSION = 2


def manifest(files: DataFrame) -> DataFrame:
    """path, size, mtime_ns, is_binary of every file."""
    mtime = F.unix_micros("mtime") * 1000 if "mtime" in files.columns else F.lit(None).cast("long")
    return files.select("path", F.octet_length("text").cast("long").alias("size"), mtime.alias("mtime_ns"), F.contains(F.substring("text", 1, 8192), F.lit("\0")).alias("is_binary"))


def postings(files: DataFrame) -> DataFrame:
    """(trigram, path), once each: trigrams are distinct within a file already, so there is no shuffle."""
    return files.select(F.explode(T.trigrams(F.col("text"))).alias("trigram"), "path")


def vocabulary(files: DataFrame) -> DataFrame:
    """token, files, occs of every token.  Distinct tokens of a file are marked in its row; the one shuffle is by token."""
    runs = T.counted(files.select(T.word_runs(F.col("text")).alias("runs")), "runs", "token").where(F.length("token").between(3, 32))
    return runs.groupBy("token").agg(F.count_if("once").alias("files"), F.count_if(~F.col("once")).alias("occs"))


def literal_trigrams(literal: str) -> list[str]:
    low = literal.lower()
    return sorted({low[i : i + 3] for i in range(len(low) - 2)})


def stage_literals(stage: Stage) -> list[str] | None:
    """Texts that every file with a match contains in some letter case, or None if there is no saying."""
    if stage.pcre:
        return None
    if stage.ident and (words := dialect.ident_words(stage.pattern)):
        found = [w for w in words if len(w) >= 3]
    elif stage.fixed or dialect.is_literal(stage.pattern):
        found = [stage.pattern] if len(stage.pattern) >= 3 else []
    else:
        found = dialect.required_literals(stage.pattern)
    # trigrams are folded by lower(); a pattern's other folds are not, so those don't constrain
    found = [f for f in found if f.isascii() or not (stage.ignore_case or stage.ident)]
    return found or None


def plan(spec: SearchSpec) -> list[list[str]] | None:
    """Trigrams that a candidate of each branch holds, or None if every file is one."""
    spec = spec.resolved()
    if spec.invert or spec.structural:
        return None
    out = []
    for branch in spec.branches:
        literals = stage_literals(branch[0])
        if not literals:
            return None
        out.append(sorted({t for text in literals for t in literal_trigrams(text)}))
    return out


def candidates(index: DataFrame, spec: SearchSpec) -> DataFrame | None:
    """Paths that may hold a match, from postings; None if the spec doesn't constrain them."""
    branches = plan(spec)
    if branches is None:
        return None
    every = sorted({t for b in branches for t in b})
    held = index.where(F.col("trigram").isin(every)).groupBy("path").agg(*[F.count_if(F.col("trigram").isin(b)).alias(f"b{i}") for i, b in enumerate(branches)])
    some = F.lit(False)
    for i, b in enumerate(branches):
        some = some | (F.col(f"b{i}") == len(b))
    return held.where(some).select("path")


#: Most hashes of paths that are sent to every task, and most bytes of them as text.
HASHES, HASH_BYTES = 2_000_000, 64 << 20


def _hashes(paths: DataFrame) -> DataFrame:
    return sides.small(paths.select(F.xxhash64("path").alias("_hash")).distinct(), HASHES, HASH_BYTES)


def among(files: DataFrame, paths: DataFrame) -> DataFrame:
    """The files with these paths, or (by chance) with the hash of one."""
    return files.join(_hashes(paths), F.xxhash64("path") == F.col("_hash"), "left_semi")


def pruned(files: DataFrame, index: DataFrame, spec: SearchSpec) -> DataFrame:
    """The files to be searched: those that the index can't rule out."""
    some = candidates(index, spec)
    return files if some is None else among(files, some)


def sweep(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state of every file that differs between two manifests: added, removed or changed (size or mtime)."""
    o = old.select(F.col("path").alias("old_path"), F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime"))
    both = new.join(o, F.col("path") == F.col("old_path"), "full_outer")
    state = (
        F.when(F.col("old_path").isNull(), "added")
        .when(F.col("path").isNull(), "removed")
        .when(~(F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime_ns").eqNullSafe(F.col("old_mtime"))), "changed")
    )
    return both.select(F.coalesce("path", "old_path").alias("path"), state.alias("state")).where("state is not null")


def option_key(options: dict) -> str:
    """What an index was built for; the order of globs doesn't matter."""
    return json.dumps({k: sorted(v) if isinstance(v, (list, tuple)) else v for k, v in sorted(options.items())}, sort_keys=True)


class Index:
    """An index in a folder: manifest, segments and vocabulary as Parquet under a numbered build, and a pointer to it.

    A build is written beside the old one and the pointer put last, so readers see one or the other.  A segment holds
    packed lists of files by trigram and by word (see ``segments``); texts are shuffled only if too many files have
    changed for a list of their paths' hashes to be sent to every task.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _builds(self) -> list[dict]:
        try:
            return [r.asDict() for r in self.spark.read.json(f"{self.folder}/meta").collect()]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return []
            raise

    def meta(self) -> dict | None:
        return max((r for r in self._builds() if r["version"] == VERSION), key=lambda r: r["build"], default=None)

    def _segments(self, meta: dict, *kinds: int) -> DataFrame:
        return self.spark.read.schema(segments.SCHEMA).parquet(f"{self.folder}/build={meta['build']}/segments").where(F.col("kind").isin(*kinds))

    def table(self, name: str, meta: dict | None = None) -> DataFrame:
        """manifest or vocabulary, or a row per file: postings (trigram, path) or digests (path, token, n)."""
        meta = meta or self.meta()
        if meta is None:
            raise FileNotFoundError(self.folder)
        if name not in ("postings", "digests"):
            return self.spark.read.parquet(f"{self.folder}/build={meta['build']}/{name}")
        numbers = F.udf(lambda ids: segments.unpacked(ids).tolist(), "array<int>")
        paths = self._segments(meta, segments.PATHS).select("segment", F.posexplode("paths").alias("id", "path"))
        if name == "postings":
            held = self._segments(meta, segments.TRIGRAM).select("segment", F.col("key").alias("trigram"), F.explode(numbers("ids")).alias("id"))
            return held.join(paths, ["segment", "id"]).select("trigram", "path")
        held = self._segments(meta, segments.WORD).select("segment", F.col("key").alias("token"), F.explode(F.arrays_zip(numbers("ids").alias("id"), F.col("counts").alias("n"))).alias("_x"))
        return held.select("segment", "token", "_x.*").join(paths, ["segment", "id"]).select("path", "token", F.col("n").cast("long").alias("n"))

    def candidates(self, spec: SearchSpec, meta: dict | None = None) -> DataFrame | None:
        """Paths that may hold a match; None if the spec doesn't constrain them.  Lists are intersected within segments."""
        branches = plan(spec)
        if branches is None:
            return None
        meta = meta or self.meta()
        every = sorted({t for b in branches for t in b})
        holding = F.udf(lambda lists: segments.holding(branches, lists), "array<int>")
        held = self._segments(meta, segments.TRIGRAM).where(F.col("key").isin(every)).groupBy("segment").agg(F.collect_list(F.struct("key", "ids")).alias("lists"))
        held = held.select("segment", holding("lists").alias("found")).where(F.size("found") > 0)
        both = held.join(self._segments(meta, segments.PATHS).select("segment", "paths"), "segment")
        return both.select(F.explode(F.transform("found", lambda i: F.element_at("paths", i + 1))).alias("path")).where("path is not null")

    def pruned(self, files: DataFrame, spec: SearchSpec, meta: dict | None = None) -> DataFrame:
        """The files to be searched: those that the index can't rule out."""
        some = self.candidates(spec, meta)
        return files if some is None else among(files, some)

    def _kept(self, old: dict, now: DataFrame, changed: DataFrame) -> DataFrame:
        """The rows of a build's segments, without files that changed (by their paths' hashes) or are gone."""
        paths = self._segments(old, segments.PATHS).select("segment", F.posexplode("paths").alias("id", "path"))
        same = now.select("path").join(changed, F.xxhash64("path") == F.col("_hash"), "left_anti").distinct().withColumn("same", F.lit(True))
        slots = paths.join(same, "path", "left").groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("id", F.when(F.col("same"), F.col("path")).alias("path")))).alias("slots"))
        slots = slots.select("segment", F.transform("slots", lambda s: s["path"]).alias("paths")).where(F.exists("paths", lambda p: p.isNotNull()))
        none = {c: F.lit(None).cast(t) for c, t in (("key", "string"), ("ids", "binary"), ("counts", "array<int>"))}
        rows = slots.select(F.lit(segments.PATHS).alias("kind"), none["key"].alias("key"), "segment", none["ids"].alias("ids"), none["counts"].alias("counts"), "paths")
        live = sides.small(slots.select("segment", F.udf(segments.bits, "binary")("paths").alias("live")))
        lists = self._segments(old, segments.TRIGRAM, segments.WORD).join(live, "segment").select("kind", "key", "segment", "ids", "counts", "live")
        return rows.unionAll(lists.mapInArrow(segments.living, segments.SCHEMA))

    def build(self, files: DataFrame, options: dict | None = None) -> dict:
        """Builds the index, reading only files that the last build doesn't have as they are."""
        old = self.meta()
        key = option_key(options or {})
        number = 1 + max((r["build"] for r in self._builds()), default=0)
        at = f"{self.folder}/build={number}"
        now = manifest(files)
        now.write.mode("overwrite").parquet(f"{at}/manifest")
        now = self.spark.read.parquet(f"{at}/manifest")
        fresh, kept = files, None
        if old and old["options"] == key:
            same = now.where("mtime_ns is not null").join(self.table("manifest", old), ["path", "size", "mtime_ns"], "left_semi")
            changed = _hashes(now.join(same.select("path"), "path", "left_anti"))
            fresh = files.join(changed, F.xxhash64("path") == F.col("_hash"), "left_semi")
            kept = self._kept(old, now, changed)
        texts = fresh.where(~F.contains(F.substring("text", 1, 8192), F.lit("\0"))).select("path", F.col("text").cast("binary").alias("data"))
        rows = texts.mapInArrow(segments.made(number), segments.SCHEMA)
        if kept is not None:
            rows = rows.unionAll(kept)
        rows.sortWithinPartitions("kind", "key").write.mode("overwrite").option("parquet.block.size", 16 << 20).partitionBy("kind").parquet(f"{at}/segments")
        words = self._segments({"build": number}, segments.WORD)
        counted = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
        words.groupBy(F.col("key").alias("token")).agg(F.sum(F.size("counts")).alias("files"), F.sum(counted).alias("occs")).write.mode("overwrite").parquet(f"{at}/vocabulary")
        meta = {"version": VERSION, "build": number, "options": key}
        self.spark.createDataFrame([(VERSION, number, key)], "version int, build int, options string").coalesce(1).write.mode("append").json(f"{self.folder}/meta")
        return meta

    def source(self, files: DataFrame, spec: SearchSpec, options: dict | None = None, reindex: bool = False) -> DataFrame:
        """The files to be searched, after a sweep: candidates that are as they were, and all files that changed.

        With ``reindex`` an index that some files have left behind is built anew first, from the digests of the others.
        """
        meta = self.meta()
        if meta is None or meta["options"] != option_key(options or {}):
            meta = self.build(files, options)
        some = self.candidates(spec, meta)
        if some is None:
            return files
        drift = sweep(self.table("manifest", meta), manifest(files))
        if reindex and not drift.isEmpty():
            meta = self.build(files, options)
            some, drift = self.candidates(spec, meta), sweep(self.table("manifest", meta), manifest(files))
        keep = some.join(drift, "path", "left_anti").unionByName(drift.where("state <> 'removed'").select("path"))
        return among(files, keep)

    def lookup(self, token: str) -> DataFrame:
        return self.table("vocabulary").where(F.col("token") == token.lower())

    def clear(self) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


class Registry:
    """The folders of all indexes that were built, so that those at or under a path can be cleared together.

    A log of JSON rows in a folder of its own: a folder is there if its last row says so.
    """

    SCHEMA = "folder string, number long, there boolean"

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def _rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).json(self.at)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def _note(self, folders: list[str], there: bool) -> None:
        number = (self._rows().agg(F.max("number")).first()[0] or 0) + 1
        self.spark.createDataFrame([(f, number, there) for f in folders], self.SCHEMA).coalesce(1).write.mode("append").json(self.at)

    def folders(self) -> list[str]:
        last = self._rows().groupBy("folder").agg(F.max_by("there", "number").alias("there"))
        return sorted(r["folder"] for r in last.where("there").collect())

    def add(self, folder: str) -> None:
        if folder.rstrip("/") not in self.folders():
            self._note([folder.rstrip("/")], True)

    def clear(self, path: str) -> list[str]:
        """Removes the indexes at or under a path, and says which."""
        path = path.rstrip("/")
        gone = [f for f in self.folders() if f == path or f.startswith(f"{path}/")]
        for f in gone:
            Index(self.spark, f).clear()
        if gone:
            self._note(gone, False)
        return gone
