"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Each source has a weight schedule over training time.  Integrating the shares gives the source's cumulative token
demand; inverting it at the tokens that come before a document gives that document's training position, and the mix is
range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ids_hash_bucket, reliable, small_side

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: A source gives at most so many times its own size.
MOST_REPEATS = 3
#: Phases of training: (end of the phase as a share of the run, factor on the weight of each of WEIGHTS).
CONSTANT = ((1.0, (1.0, 1.0, 1.0)),)
#: The schedule of op8 and of the pipeline: the first of the three weights falls from phase to phase, the third rises.
CURRICULUM = ((0.4, (2.0, 1.0, 0.5)), (0.8, (1.0, 1.0, 1.0)), (1.0, (0.5, 1.0, 2.0)))


def word_count(name: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(name), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Per source (source, source_size): rank, weight and target.

    Targets share the sum of all sizes by weight; those above ``most`` times their source's size stop there and the
    excess is shared again, until none is above.  That fixpoint is found at once: sources are put in order of
    cap/weight, and the capped ones are the longest prefix whose next cap is still under its share.  The windows have
    one row per *source*; sources were aggregated before.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    arr = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(arr, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy()
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    # the level of the first source that isn't capped is the level of all that follow
    s = s.withColumn("first_free", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")))).over(every))
    free = F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level")) >= F.col("first_free")
    target = F.when(free, F.least(F.col("first_free")["level"] * F.col("weight"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return s.select("source", "source_size", "rank", "weight", "total", target.alias("target"))


def demand(target: DataFrame, weights: Sequence[float], phases) -> DataFrame:
    """Per source the cumulative demand at the end of each phase, as shares of the source's own target.

    In a phase the share of a source is weight x factor / (that sum over all sources), held constant; the integral over
    the phase is share x length.  The array starts with 0 and ends with 1.
    """
    every = Window.partitionBy()
    ends = [0.0, *(float(e) for e, _ in phases)]
    if ends[-1] != 1.0 or any(b <= a for a, b in zip(ends, ends[1:])):
        raise ValueError("phases must end at increasing shares of the run, the last at 1.0")
    out, made = target, []
    for k, (_, factors) in enumerate(phases):
        arr = F.array(*[F.lit(float(f)) for f in factors])
        now = F.col("weight") * F.element_at(arr, (F.col("rank") % len(weights) + 1).cast("int"))
        out = out.withColumn(f"now{k}", now)
        out = out.withColumn(f"part{k}", F.col(f"now{k}") / F.sum(f"now{k}").over(every) * (ends[k + 1] - ends[k]))
        made.append(F.col(f"part{k}"))
    run, cum = F.lit(0.0), [F.lit(0.0)]
    for part in made:
        run = run + part
        cum.append(run)
    out = out.withColumn("curve", F.array(*cum))
    last = F.element_at("curve", -1)
    return out.withColumn("curve", F.transform("curve", lambda c: F.when(last > 0, c / last).otherwise(F.lit(0.0)))).drop(*[f"now{k}" for k in range(len(phases))], *[f"part{k}" for k in range(len(phases))])


def invert(curve: Column, ends: Sequence[float], share: Column) -> Column:
    """Time in 0..1 at which the piecewise linear demand reaches a share of the source's target."""
    grid = F.array(*[F.lit(float(e)) for e in ends])
    k = F.greatest(F.lit(1), F.least(F.size(F.filter(curve, lambda c: c <= share)), F.lit(len(ends) - 1))).cast("int")
    lo, hi = F.element_at(curve, k), F.element_at(curve, k + 1)
    a, b = F.element_at(grid, k), F.element_at(grid, k + 1)
    return a + F.when(hi > lo, (share - lo) / (hi - lo) * (b - a)).otherwise(F.lit(0.0))


def assign(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, phases=CONSTANT, digits: int = 3) -> DataFrame:
    """One row per document with its part in the mix.

    Columns: doc_id, source, size, source_size, target, taken, copies, position, positions.  ``taken`` is the number of words the
    mix takes from the document: as often as the source's target holds the whole source, plus a last pass that ends
    inside a document, so that a source's sum is its target rounded to a word.  ``copies`` is taken in whole documents
    (a last pass that reaches a document's middle takes it); ``position`` is the training time in words of its first
    word, null if nothing is taken; ``positions`` holds that of each copy.

    The order within a source is that of md5(doc_id), doc_id, size, so reruns agree at any partitioning.  A source may
    hold a third of all rows: it is dealt over 16^digits buckets of md5, bucket sums are added up in a window over
    buckets and documents only in a window within a bucket.  Null text: size 0.  Null source: a source of its own, the
    last.  Null doc_id: ordered as the empty text.  Repeated rows: each counts.  A source without words: target and
    taken 0.  Empty table: no rows.  Extra columns are not read.
    """
    sized = reliable(docs.select("doc_id", "source", word_count().alias("size"), ids_hash_bucket(F.col("doc_id"), digits).alias("bucket")))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    buckets = reliable(buckets)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = [0.0, *(float(e) for e, _ in phases)]
    plan = demand(targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, most), weights, phases)
    starts = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.join(F.broadcast(plan) if plan.count() <= 10_000 else plan, starts["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    starts = reliable(starts.drop("bucket_size"))
    b = starts.withColumnRenamed("source", "b_source").withColumnRenamed("bucket", "b_bucket")
    own = Window.partitionBy("source", "bucket").orderBy(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = sized.withColumn("own_start", F.coalesce(F.sum("size").over(own), F.lit(0)))
    d = d.join(b, d["source"].eqNullSafe(b["b_source"]) & (d["bucket"] == b["b_bucket"])).withColumn("start", F.col("own_start") + F.col("bucket_start"))
    words = F.round(F.col("target")).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(F.lit(0)).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), words - full * F.col("source_size") - F.col("start")))
    d = d.withColumn("full", full).withColumn("rest", rest)
    d = d.withColumn("taken", F.col("full") * F.col("size") + F.col("rest"))
    d = d.withColumn("copies", F.col("full") + ((F.col("rest") * 2 >= F.col("size")) & (F.col("rest") > 0)).cast("long"))
    # the words of the document's source that come before it, in each pass over the source
    share = lambda p: F.when(F.col("target") > 0, F.least((F.col("start") + p * F.col("source_size")) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    d = d.withColumn("position", F.when(F.col("taken") > 0, invert(F.col("curve"), ends, share(F.lit(0))) * F.col("total")))
    passes = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(most).cast("long")), lambda p: p < F.col("copies"))
    d = d.withColumn("positions", F.transform(passes, lambda p: invert(F.col("curve"), ends, share(p)) * F.col("total")))
    return d.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position", "positions")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS, phases=CONSTANT, digits: int = 3) -> DataFrame:
    """assign(), range-sorted by training position; rows of which nothing is taken come last."""
    return assign(docs, weights, most, phases, digits).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows and columns, each as often as it is taken in whole, range-sorted by position.

    A row with null text, or without words, has nothing to take and is left out, as is one that the mix doesn't reach.
    Null ids and null sources are ids and a source like others.  Rows that repeat a doc_id are taken alike, as often as
    the one of them that is taken most.  Equal positions go by doc_id.  An empty table gives an empty one.  Extra
    columns pass through.

    Positions are worked out from ids and sizes alone.  If the ids that are taken are few and small they are broadcast,
    and texts are shuffled once, to be sorted; else once more, to meet their positions.
    """
    taken = assign(docs, **options).groupBy("doc_id").agg(F.max("positions").alias("positions")).where(F.size("positions") > 0)
    taken = small_side(reliable(taken.select(F.struct("doc_id", "positions").alias("_mix"))))
    rows = docs.select(F.struct(*docs.columns).alias("_row")).join(taken, F.col("_row")["doc_id"].eqNullSafe(F.col("_mix")["doc_id"]))
    each = rows.select("_row", F.explode(F.col("_mix")["positions"]).alias("_position"))
    return each.orderBy("_position", F.col("_row")["doc_id"]).select("_row.*")


def in_order(mixed: DataFrame) -> DataFrame:
    """A written mix with its order: its columns, and ``_order``, each row's number from 0 in the order of writing.

    Files are put in order by the number of the task that wrote them, rows by their place in the file; files' row counts
    are added up in a window over files.  A table that isn't of files counts as one in the order of its partitions.
    """
    try:
        rows = mixed.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        number = lambda pattern: F.coalesce(F.try_to_number(F.regexp_extract(F.col("_file"), pattern, 1), F.lit("9999999999")).cast("long"), F.lit(0))
        rows = rows.withColumn("_part", F.struct(number(r"^part-(\d+)").alias("task"), number(r"-c(\d+)\.").alias("of_task"), F.col("_file").alias("name"))).drop("_file")
    except AnalysisException:
        made = F.monotonically_increasing_id()
        rows = mixed.withColumn("_part", F.struct(F.shiftright(made, 33).alias("task"), F.lit(0).cast("long").alias("of_task"), F.lit("").alias("name")))
        rows = rows.withColumn("_row", made.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = rows.groupBy("_part").agg((F.max("_row") + 1).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    return rows.join(F.broadcast(starts), F.col("_part") == F.col("_of")).withColumn("_order", F.col("_first") + F.col("_row")).select(*mixed.columns, "_order")


def _sql(phases=CURRICULUM) -> str:
    """DuckDB's SQL for op8: the same integral and inversion, from the same schedule."""
    ends = [0.0, *(float(e) for e, _ in phases)]
    now = [f"weight * [{', '.join(map(repr, map(float, f)))}][rank % 3 + 1]" for _, f in phases]
    parts = [f"({x}) / (sum({x}) OVER ()) * {ends[k + 1] - ends[k]!r}::DOUBLE" for k, x in enumerate(now)]
    curve = [" + ".join(["0.0::DOUBLE", *(f"part{m}" for m in range(k))]) for k in range(len(phases) + 1)]
    return SQL_TEMPLATE.replace("{PARTS}", ", ".join(f"{x} AS part{k}" for k, x in enumerate(parts))).replace("{CURVE}", ", ".join(curve)).replace("{ENDS}", ", ".join(f"{e!r}::DOUBLE" for e in ends)).replace("{PHASES}", str(len(phases)))


SQL_TEMPLATE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, (rank % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, ((SELECT sum(source_size) FROM w)::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
      row_number() OVER (ORDER BY cap / weight, rank) AS place FROM w
), f AS (
  SELECT min(place) AS place FROM l WHERE NOT cap < level * weight
), g AS (
  SELECT l.*, (SELECT l2.level FROM l l2, f WHERE l2.place = f.place) AS free_level, (SELECT place FROM f) AS free FROM l
), t AS (
  SELECT source, source_size, CASE WHEN place >= free THEN least(free_level * weight, cap::DOUBLE) ELSE cap::DOUBLE END AS target FROM g
), p AS (
  SELECT t.*, w.rank, w.weight, (SELECT sum(source_size) FROM w)::BIGINT AS total FROM t JOIN w ON t.source IS NOT DISTINCT FROM w.source
), q AS (
  SELECT *, {PARTS} FROM p
), r AS (
  SELECT * EXCLUDE (curve), [CASE WHEN curve[-1] > 0 THEN x / curve[-1] ELSE 0.0 END FOR x IN curve] AS curve FROM (SELECT *, [{CURVE}] AS curve FROM q)
), c AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), m AS (
  SELECT c.doc_id, c.size, c.start, r.*,
         (CASE WHEN r.source_size > 0 THEN round(r.target)::BIGINT // r.source_size ELSE 0 END)::BIGINT AS full_passes,
         greatest(0, least(c.size, (CASE WHEN r.source_size > 0 THEN round(r.target)::BIGINT % r.source_size ELSE 0 END) - c.start))::BIGINT AS rest,
         CASE WHEN r.target > 0 THEN least(c.start::DOUBLE / r.target, 1.0) ELSE 0.0 END AS share
  FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
), n AS (
  SELECT *, (full_passes * size + rest)::BIGINT AS taken,
         full_passes + CASE WHEN rest > 0 AND rest * 2 >= size THEN 1 ELSE 0 END AS copies,
         greatest(1, least(len([x FOR x IN curve IF x <= share]), {PHASES})) AS k, [{ENDS}] AS ends
  FROM m
)
SELECT doc_id, size, source_size, target, taken, copies::BIGINT AS copies,
       CASE WHEN taken > 0 THEN (ends[k] + CASE WHEN curve[k + 1] > curve[k] THEN (share - curve[k]) / (curve[k + 1] - curve[k]) * (ends[k + 1] - ends[k]) ELSE 0.0 END) * total END AS position
FROM n
"""
SQL = _sql()
