"""Rendering of results: text lines and JSON-Lines records, in order, behind exact totals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RED, GREEN, PURPLE, OFF = "\x1b[1;31m", "\x1b[32m", "\x1b[35m", "\x1b[0m"


def region(path: Column, start: Column, length: Column) -> Column:
    return F.format_string("%s@%d-%d", path, start, start + length)


def json_matches(found: DataFrame, compact: bool = False) -> DataFrame:
    """path, line_number, json: a record for each match (with positions); fields that are null are left out."""
    n = F.octet_length("line")
    own = lambda name: [F.col(name).alias(name)] if name in found.columns else []
    fields = [F.lit("match").alias("type"), F.col("path").alias("file"), F.col("line_number"), F.col("line").alias("text")]
    if not compact:
        fields.insert(3, F.col("byte_offset"))
        fields.append(F.transform("positions", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("matches"))
        fields.append(F.array(F.col("byte_offset"), F.col("byte_offset") + n).alias("span"))
    fields += [region(F.col("path"), F.col("byte_offset"), n).alias("region"), *own("scope"), *own("page"), *own("kind"), *own("captures"), *own("query")]
    return found.select("path", "line_number", F.to_json(F.struct(*fields)).alias("json"))


def json_counts(counts: DataFrame) -> DataFrame:
    own = [F.col("query")] if "query" in counts.columns else []
    return counts.select("path", F.to_json(F.struct(F.lit("count").alias("type"), F.col("path").alias("file"), F.col("n").alias("count"), *own)).alias("json"))


def json_files(files: DataFrame) -> DataFrame:
    return files.select("path", F.to_json(F.struct(F.lit("file").alias("type"), F.col("path").alias("file"))).alias("json"))


def json_errors(files: DataFrame) -> DataFrame:
    return files.where("error is not null").select("path", F.to_json(F.struct(F.lit("error").alias("type"), F.col("path").alias("file"), "error")).alias("json"))


def json_summary(totals: DataFrame) -> DataFrame:
    """One record of a frame of totals (files, lines, errors, shown_*, omitted_*)."""
    return totals.select(F.to_json(F.struct(F.lit("summary").alias("type"), *totals.columns)).alias("json"))


def json_outline(rows: DataFrame, by: str = "count") -> DataFrame:
    extra = [F.round("score", 2).alias("score")] if by == "density" else [F.col("defs")] if by == "defs" else []
    return rows.select(F.to_json(F.struct(F.lit("outline").alias("type"), F.col("path").alias("file"), F.col("n").alias("count"), *extra, "exemplar")).alias("json"))


def json_histogram(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit("variant").alias("type"), "text", F.col("n").alias("count"), "files")).alias("json"))


def json_suggest(rows: DataFrame) -> DataFrame:
    return rows.select("place", F.to_json(F.struct(F.lit("suggest").alias("type"), "variant", "kind", "lines", "files")).alias("json"))


def json_collapsed(totals: DataFrame) -> DataFrame:
    return totals.select(F.to_json(F.struct(F.lit("collapsed").alias("type"), "lines", "texts")).alias("json"))


def text_lines(found: DataFrame, numbers: bool = True, names: bool = True) -> DataFrame:
    """path, line_number, rendered: path:line:text, with - before and behind the number of a context line."""
    sep = F.when(F.col("is_context"), F.lit("-")).otherwise(F.lit(":")) if "is_context" in found.columns else F.lit(":")
    parts = ([F.col("path"), sep] if names else []) + ([F.col("line_number").cast("string"), sep] if numbers else []) + [F.col("line")]
    return found.select("path", "line_number", F.concat(*parts).alias("rendered"))


def group_lines(found: DataFrame) -> DataFrame:
    """found (path, line_number, scope, page, ...) with ``group_line``: the line that is printed before a match whose scope is new.

    That is the scope, or else the page, behind a section sign; null where it is what was printed last, or there is
    neither.  The order is that of the output within a file.
    """
    mark = F.coalesce("scope", F.when(F.col("page") > 0, F.concat(F.lit("p."), F.col("page").cast("string"))))
    order = Window.partitionBy("path").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)
    out = found.withColumn("_mark", mark)
    last = F.last("_mark", ignorenulls=True).over(order)
    return out.withColumn("_last", last).withColumn("group_line", F.when(F.col("_mark").isNotNull() & ~F.col("_mark").eqNullSafe(F.col("_last")), F.concat(F.lit("\u00a7 "), F.col("_mark")))).drop("_mark", "_last")


def coloured_line(line: Column, positions: Column) -> Column:
    """A line with its matches (byte spans, in order) in colour."""
    data = line.cast("binary")
    part = lambda a, b: F.decode(F.substring(data, a + 1, b - a), "UTF-8")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, p: F.struct(p["end"].alias("at"), F.concat(acc["out"], part(acc["at"], p["start"]), F.lit(RED), part(p["start"], p["end"]), F.lit(OFF)).alias("out"))
    return F.aggregate(positions, zero, step, lambda acc: F.concat(acc["out"], part(acc["at"], F.octet_length(line))))


def column_window(line: str, positions: list[tuple[int, int]], width: int) -> tuple[str, list[tuple[int, int]], bool]:
    """A window of ``width`` bytes around the first match, snapped to spaces near its edges, with the positions in it."""
    data = line.encode()
    if width <= 0 or len(data) <= width:
        return line, positions, False
    first = positions[0] if positions else (0, 0)
    start = max(0, min((first[0] + first[1]) // 2 - width // 2, len(data) - width))
    end = start + width
    if start and (at := data.find(b" ", start, min(start + 16, first[0]))) >= 0:
        start = at + 1
    if end < len(data) and (at := data.rfind(b" ", max(end - 16, first[1]), end)) >= 0:
        end = at
    while start and data[start] & 0xC0 == 0x80:
        start -= 1
    while end < len(data) and data[end] & 0xC0 == 0x80:
        end += 1
    lead = b"..." if start else b""
    shift = len(lead) - start
    kept = [(max(a, start) + shift, min(b, end) + shift) for a, b in positions if a < end and b > start]
    return (lead + data[start:end] + (b"..." if end < len(data) else b"")).decode("utf-8", "replace"), kept, True


def coloured(line: str, positions: list[tuple[int, int]]) -> str:
    """coloured_line() of one line that is on the driver already."""
    data, out, at = line.encode(), [], 0
    for a, b in positions:
        out += [data[at:a], RED.encode(), data[a:b], OFF.encode()]
        at = b
    return b"".join([*out, data[at:]]).decode("utf-8", "replace")


def in_order(rows: DataFrame, *order: str) -> Iterator:
    """Rows one after another in order, a partition at a time on the driver: the sink of a terminal."""
    return rows.orderBy(*order).toLocalIterator()


def write_records(found: DataFrame, totals: DataFrame, path: str) -> None:
    """JSON-Lines of matches in order, and the summary in a file of its own behind them."""
    json_matches(found).orderBy("path", "line_number").select("json").write.text(f"{path}/matches")
    json_summary(totals).coalesce(1).write.text(f"{path}/summary")


def exit_code(matched: bool, errors: int) -> int:
    """0 if something matched, 1 if nothing did, 2 if something could not be read."""
    return 2 if errors else 0 if matched else 1
