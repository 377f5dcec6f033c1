"""Shaping of matches: context, collapse, budget, outline, histogram, totals, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import dialect, lang
from textloom.functions import text as T
from textloom.operators import search as S
from textloom.plans.spec import SearchSpec, find

#: A line that is repeated more often is shown so many times; what its key and a histogram's or exemplar's text are cut at, in bytes.
SHOWN, KEY_BYTES, TEXT_BYTES = 3, 256, 120


def cut_bytes(text: Column, n: int) -> Column:
    """The first n bytes of a text, without a character that they'd break."""
    cut = F.substring(text.cast("binary"), 1, n)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(F.make_valid_utf8(cut), "\\x{FFFD}$", ""))


def context(files: DataFrame, spec: SearchSpec, before: int, after: int) -> DataFrame:
    """path, line_number, line, is_context, group_id: selected lines with those around them; groups are runs of lines.

    Worked out in the file's row, on its array of lines: no shuffle.
    """

    def shown(ls: Column) -> Column:
        hits = F.filter(F.transform(ls, lambda line, i: F.when(S.line_matches(spec, line), i + 1)), lambda i: i.isNotNull())
        near = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.sequence(F.greatest(F.lit(1), i - before), F.least(F.size(ls), i + after)))))
        return T.let(near, lambda at: T.let(F.transform(at, lambda n, k: ((k > 0) & (n - F.element_at(at, F.greatest(k, F.lit(1))) > 1)).cast("long")), lambda opens: rows(ls, at, opens)))

    def rows(ls: Column, at: Column, opens: Column) -> Column:
        groups = F.zip_with(T.sums_before(opens), opens, lambda a, b: a + b)
        return F.zip_with(at, groups, lambda n, g: F.struct(n.alias("line_number"), F.element_at(ls, n).alias("line"), g.alias("group_id")))

    found = S.candidates(files, spec).select("path", F.inline(T.let(T.line_array(F.col("text")), shown)))
    return found.select("path", "line_number", "line", (~S.line_matches(spec, F.col("line"))).alias("is_context"), "group_id")


def collapse_key(line: Column) -> Column:
    """What lines are compared by: the first bytes of the trimmed line, as hex digits."""
    return F.substring(F.hex(F.trim(line)), 1, 2 * KEY_BYTES)


def collapse(found: DataFrame) -> DataFrame:
    """The first rows of each distinct line, in output order.  (The limit also runs in each task before the shuffle.)"""
    first = Window.partitionBy(collapse_key(F.col("line"))).orderBy("path", "line_number")
    return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SHOWN).drop("_n")


def collapse_totals(found: DataFrame) -> DataFrame:
    """lines and texts that collapse() leaves out."""
    by_key = found.groupBy(collapse_key(F.col("line")).alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHOWN)
    return by_key.agg(F.coalesce(F.sum(F.col("n") - SHOWN), F.lit(0)).cast("long").alias("lines"), F.count(F.lit(1)).alias("texts"))


def record(found: DataFrame) -> Column:
    return F.format_string("%s:%d:%s", F.col("path"), F.col("line_number"), F.col("line"))


def budget(found: DataFrame, max_tokens: int) -> DataFrame:
    """Records (path, line_number, record) in order for as long as the bytes before them are under 4 x max_tokens.

    A record takes a byte at least, so 4 x max_tokens of them are enough: those are a top-k, whose running sum is over a
    frame of that bounded size.
    """
    limit = 4 * max_tokens
    first = found.select("path", "line_number", record(found).alias("record")).orderBy("path", "line_number").limit(limit)
    spent = Window.orderBy("path", "line_number").rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("spent", F.coalesce(F.sum(F.octet_length("record") + 1).over(spent), F.lit(0))).where(F.col("spent") < limit).select("path", "line_number", "record")


def budget_totals(found: DataFrame, max_tokens: int) -> DataFrame:
    """Totals of the search, exact whatever is shown: files, lines, shown_files, shown_lines, omitted_files, omitted_lines."""
    shown = budget(found, max_tokens).groupBy("path").agg(F.count(F.lit(1)).alias("shown"))
    every = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    both = every.join(F.broadcast(shown), "path", "left")
    return both.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("lines"),
        F.count("shown").alias("shown_files"),
        F.coalesce(F.sum("shown"), F.lit(0)).cast("long").alias("shown_lines"),
        F.count_if(F.col("shown").isNull()).alias("omitted_files"),
        F.coalesce(F.sum(F.col("n") - F.coalesce("shown", F.lit(0))), F.lit(0)).cast("long").alias("omitted_lines"),
    )


def outline(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """path, n, defs, size, exemplar, exemplar_line: a row per file with its matches' number and the one that says most.

    The exemplar is a definition before another line, then the line of most matches, then one that holds more than its
    matches, then the earliest.
    """
    fam = lang.family(F.col("path"))
    hits = S.in_row(S.candidates(files, spec), lambda line: S.line_matches(spec, line), ("path", F.octet_length("text").cast("long").alias("size")), offsets=False)

    def weighed(h: Column) -> Column:
        line, found = h["line"], S.line_fragments(spec, h["line"])
        occ = F.greatest(F.size(found), F.lit(1))
        hit_bytes = F.aggregate(found, F.lit(0), lambda a, f: a + F.octet_length(f))
        more = F.octet_length(F.trim(line)) > hit_bytes
        return F.struct(lang.is_definition(line, fam).cast("int").alias("is_def"), occ.alias("occ"), more.cast("int").alias("more"), (-h["line_number"]).alias("at"), line.alias("line"))

    # all of a file's hits are in its row: no shuffle
    out = hits.where(F.size("hits") > 0).select("path", "size", F.transform("hits", weighed).alias("all"))
    out = out.select("path", "size", F.size("all").cast("long").alias("n"), F.aggregate("all", F.lit(0).cast("long"), lambda a, h: a + h["is_def"]).alias("defs"), F.array_max("all").alias("best"))
    return out.select("path", "n", "defs", "size", F.trim(cut_bytes(F.trim(F.col("best")["line"]), TEXT_BYTES)).alias("exemplar"), (-F.col("best")["at"]).alias("exemplar_line"))


def density(n: Column, size: Column, path: Column) -> Column:
    """Matches per KB, a quarter of it for demoted paths."""
    return n / F.greatest(size / F.lit(1024.0), F.lit(1.0)) * F.when(T.demoted_path(path), F.lit(0.25)).otherwise(F.lit(1.0))


def ranked(rows: DataFrame, by: str = "count", top: int | None = None) -> DataFrame:
    """Outline rows in order of count, density or defs; the ``rank`` column numbers the rows that are shown."""
    path = F.col("path")
    rows = rows.withColumn("score", density(F.col("n"), F.col("size"), path))
    order = {
        "count": [F.desc("n"), F.asc("path")],
        "density": [F.desc("score"), F.desc("n"), F.asc("path")],
        "defs": [(T.demoted_path(path) | T.test_path(path)).asc(), F.desc("defs"), F.desc("n"), F.asc("path")],
    }[by]
    rows = rows.orderBy(*order)
    if top is None:
        return rows
    return rows.limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def histogram(found: DataFrame) -> DataFrame:
    """text, n, files of each distinct matched text.  found has path and fragments, in a row per line or per file."""
    texts = found.select("path", F.explode("fragments").alias("text")).withColumn("text", cut_bytes(F.col("text"), TEXT_BYTES))
    per_file = texts.groupBy("text", "path").agg(F.count(F.lit(1)).alias("n"))
    return per_file.groupBy("text").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("files"))


def file_histogram(found: DataFrame) -> DataFrame:
    """histogram() of a row per file.  Its distinct texts are marked beside all of them, so one shuffle counts both."""
    long = F.exists("fragments", lambda f: F.octet_length(f) > TEXT_BYTES)
    texts = found.select(F.when(long, F.transform("fragments", lambda f: cut_bytes(f, TEXT_BYTES))).otherwise(F.col("fragments")).alias("all"))
    return T.counted(texts, "all", "text").groupBy("text").agg(F.count_if(~F.col("once")).alias("n"), F.count_if("once").alias("files"))


def histogram_top(rows: DataFrame, top: int) -> DataFrame:
    order = [F.desc("n"), F.asc("text")]
    return rows.orderBy(*order).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def histogram_totals(rows: DataFrame, top: int | None = None) -> DataFrame:
    distinct = F.count(F.lit(1))
    return rows.agg(distinct.alias("distinct_texts"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), (F.least(distinct, F.lit(top)) if top else distinct).cast("long").alias("shown"))


def capture_fragments(found: DataFrame, name: str | None = None) -> DataFrame:
    """Structural matches (path, captures) as fragments of one hole, trimmed; matches without it are left out."""
    value = F.element_at("captures", name) if name else F.element_at(F.map_values(F.map_filter("captures", lambda k, v: k != "_")), 1)
    return found.withColumn("value", F.trim(value)).where("value is not null").select("path", F.array("value").alias("fragments"))


def summary(counts: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """files and lines with matches, and files that could not be read, from counts (path, n)."""
    out = counts.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("lines"))
    return out.crossJoin(errors.agg(F.count(F.lit(1)).alias("errors"))) if errors is not None else out.withColumn("errors", F.lit(0).cast("long"))


def batch_totals(files: DataFrame, queries: Sequence[tuple[str, SearchSpec]]) -> DataFrame:
    """query_index, query, files, lines of every query of a batch, those without a hit too."""
    asked = files.sparkSession.createDataFrame([(i, q) for i, (q, _) in enumerate(queries)], "query_index int, query string")
    hits = S.batch_matches(files, queries).groupBy("query_index").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("lines"))
    return F.broadcast(asked).join(hits, "query_index", "left").select("query_index", "query", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("lines", F.lit(0)).alias("lines"))


def suggest(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """variant, kind, files, lines, place of the probes for patterns that found nothing: rarest of those that occur first.

    All probes run in one pass.
    """
    kind_of: dict[str, str] = {}
    for p in patterns:
        for v, kind in dialect.suggest_variants(p):
            kind_of.setdefault(v, kind)
    variants = list(kind_of.items())
    queries = [(v, find(rf"\b{dialect.quote(v)}\b", ignore_case=True)) for v, _ in variants]
    if not variants:
        return files.sparkSession.createDataFrame([], "variant string, kind string, files long, lines long, place int")
    kinds = F.element_at(F.create_map(*[F.lit(x) for i, (_, k) in enumerate(variants) for x in (i, k)]), F.col("query_index"))
    rows = batch_totals(files, queries).withColumn("kind", kinds)
    order = Window.orderBy((F.col("lines") == 0).asc(), "lines", "query_index")
    return rows.select(F.col("query").alias("variant"), "kind", "files", "lines", F.row_number().over(order).alias("place"))
