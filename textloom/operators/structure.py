"""Operators that need a whole file in hand: multi-line blocks, structural templates, scopes, blocks, regions.

Texts pass through Arrow batches; only files that hold the search's fixed text get there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from textloom.functions import dialect, lang
from textloom.functions import text as T
from textloom.operators import search as S
from textloom.operators import sides
from textloom.plans.spec import SearchSpec


#: Rows, and about the bytes of them, that go back from Python at once: a batch for each file costs more than its rows.
ROWS, ROW_BYTES = 4096, 8 << 20


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows put together in batches of bounded size."""

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*held)), schema.types)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or size >= ROW_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def per_file(files: DataFrame, schema: str, rows: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    """Rows (after path) that a function makes of each file's path and bytes."""
    out_schema = StructType.fromDDL(f"path string, {schema}")
    arrow = to_arrow_schema(out_schema)

    def worked(batches):
        files = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield from in_batches(((path, *r) for path, data in files if data for r in rows(path, data)), arrow)

    return files.select("path", F.col("text").cast("binary").alias("data")).mapInArrow(worked, out_schema)


def line_starts(data: bytes) -> list[int]:
    starts = [0]
    at = data.find(b"\n")
    while at >= 0 and at + 1 < len(data):
        starts.append(at + 1)
        at = data.find(b"\n", at + 1)
    return starts


def number_of(starts: list[int], at: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, at)


def _multiline(spec: SearchSpec) -> str:
    """The pattern of a search over whole texts: its branches side by side."""
    spec = spec.resolved()
    joined = "|".join(f"(?:{dialect.quote(b[0].pattern) if b[0].fixed else b[0].pattern})" for b in spec.branches)
    return dialect.re2java(joined, any(b[0].ignore_case for b in spec.branches), multiline=True)


def multiline_blocks(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """path, line_number, byte_offset, block, hits: the whole lines that matches over several lines touch.

    Matches that begin on the same line are one record; ``hits`` is how many.  A match of nothing behind the last line is
    none.  All of it is worked out in the file's row: no shuffle.
    """
    java = _multiline(spec)
    feeds = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("long")

    def placed(p: Column) -> Column:
        before = T.sums_before(F.transform(p, lambda x: feeds(x["gap"]) + feeds(x["hit"])))
        first = lambda at, x: at + feeds(x["gap"]) + 1
        return F.zip_with(before, p, lambda at, x: F.struct(first(at, x).cast("int").alias("first"), (first(at, x) + feeds(x["hit"]) - F.endswith(x["hit"], F.lit("\n")).cast("int")).cast("int").alias("last")))

    spec = spec.resolved()
    some = S.candidates(files, SearchSpec(spec.branches)) if all(b[0].literal() and "\n" not in b[0].pattern for b in spec.branches) else files.where(F.octet_length("text") > 0)
    f = some.where(F.col("text").rlike(java)).select("path", "text", T.let(T.pieces(F.col("text"), java), placed).alias("_all"))
    f = f.select("path", T.line_array(F.col("text")).alias("_ls"), "_all").withColumn("_m", F.filter("_all", lambda m: m["first"] <= F.size("_ls")))
    opens = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_m"), F.lit(1))), lambda i: (i <= F.size("_m")) & ((i == 1) | (F.try_element_at("_m", F.greatest(i - 1, F.lit(1)))["first"] != F.try_element_at("_m", i)["first"])))
    f = f.withColumn("_at", T.sums_before(F.transform("_ls", lambda line: F.octet_length(line).cast("long") + 1))).withColumn("_b", opens)

    def record(i, k):
        group = F.slice("_m", i, F.coalesce(F.try_element_at("_b", k + 2), F.size("_m") + 1) - i)
        first = F.element_at("_m", i)["first"]
        last = F.array_max(F.transform(group, lambda m: m["last"]))
        return F.struct(first.alias("line_number"), F.element_at("_at", first).alias("byte_offset"), F.array_join(F.slice("_ls", first, last - first + 1), "\n").alias("block"), F.size(group).alias("hits"))

    return f.select("path", F.inline(F.transform("_b", record)))


def multiline_count(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """path, n: matches (not lines) over whole texts, in built-in functions."""
    return files.select("path", F.regexp_count("text", F.lit(_multiline(spec))).cast("long").alias("n")).where("n > 0")


def structural(files: DataFrame, template: str, family: str | None = None) -> DataFrame:
    """path, line_number, byte_offset, end_offset, block, captures of a template's matches.

    ``block`` is the whole lines from the match's first to its last; holes named _ are in no capture.  The family is each file's own, if none is given.
    """
    parts = lang.parse_template(template)
    anchor = re.split(r"[ \t\r\n]", parts[0][1])[0]

    def rows(path: str, data: bytes):
        starts = line_starts(data)
        for a, b, caps in lang.structural_matches(data, parts, family or lang.family_of(path)):
            number = number_of(starts, a)
            first = starts[number - 1]
            end = data.find(b"\n", max(a, b - 1))
            yield number, a, b, data[first : end if end >= 0 else len(data)].decode("utf-8", "replace"), [(n, data[s:e].decode("utf-8", "replace")) for n, s, e in caps if n != "_"]

    found = per_file(files.where(F.contains("text", F.lit(anchor))), "line_number int, byte_offset long, end_offset long, block string, captures map<string,string>", rows)
    return found


def enclosed(files: DataFrame, spec: SearchSpec, blocks: bool = False, positions: bool = False) -> DataFrame:
    """Selected lines with the scope and page each is in, and what kind of line it is.

    Columns: path, line_number, byte_offset, line, fragments, scope, page, kind, and with ``positions`` byte spans.  With
    ``blocks``: path, start, line_number, scope, page, hits, block: matches in one block are one record, at its first
    line, and a line that is in none is a block by itself.

    Lines are selected in the file's row and go through Arrow beside its text: nothing is joined or shuffled.
    """
    hits = S.in_row(S.candidates(files, spec), lambda line: S.line_matches(spec, line)).where(F.size("hits") > 0)
    hits = hits.select("path", F.col("text").cast("binary").alias("data"), F.transform("hits", lambda h: h["line_number"]).alias("numbers"), F.transform("hits", lambda h: h["byte_offset"]).alias("offsets"))
    schema = "path string, start long, line_number int, scope string, page int, hits int, block string" if blocks else "path string, line_number int, byte_offset long, line string, scope string, page int, kind string"
    out_schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out_schema)
    text = lambda b: b.decode("utf-8", "replace")

    def found(path: str, data: bytes, numbers: list[int], offsets: list[int]):
        # each line asks a table that begins as far before it as a scope may; lines close to one another share one
        table, low, high = None, 0, -1
        records: dict[int, list] = {}
        for number, at in zip(numbers, offsets):
            if table is None or at > high:
                low = data.rfind(b"\n", 0, max(0, at - lang.SCOPE_LIMIT)) + 1 if at > lang.SCOPE_LIMIT else 0
                high = at + 16 * lang.SCOPE_LIMIT
                stop = data.find(b"\n", high + 2 * lang.SCOPE_LIMIT)
                table = lang.FileTable(data[: stop if stop >= 0 else len(data)], path, None, low)
            end = data.find(b"\n", at)
            line = data[at : end if end >= 0 else len(data)]
            scope = table.scope(at)
            if not blocks:
                kind = "definition" if table.kind(at) == "definition" else None
                yield path, number, at, text(line), text(scope[0]) if scope else None, lang.page_at(data, at), kind
                continue
            block = table.block(at) or (at, at + len(line), False)
            if block[0] in records:
                records[block[0]][5] += 1
            else:
                records[block[0]] = [path, block[0], number, text(scope[0]) if scope else None, lang.page_at(data, at), 1, text(data[block[0] : block[1]])]
        yield from map(tuple, records.values())

    def worked(batches):
        files = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4))))
        yield from in_batches((r for row in files for r in found(*row)), arrow)

    out = hits.mapInArrow(worked, out_schema)
    if blocks:
        return out
    out = out.withColumn("fragments", S.line_fragments(spec, F.col("line")))
    return out.withColumn("positions", S.line_positions(spec, F.col("line"))) if positions else out


_REGION = re.compile(r"(?:(\d+)-(\d+)|:(\d+)-(\d+)|(func|section):(.+?)(?:#(\d+))?)", re.S)


def parse_region(region: str) -> tuple[str, tuple]:
    """(path, what) of a region id: path@start-end bytes, path@:first-last lines, path@func:name or path@section:name, #n for the n-th."""
    path, at, what = region.rpartition("@")
    m = _REGION.fullmatch(what) if at else None
    if not m or not path:
        raise ValueError(f"not a region: {region!r}")
    if m[1]:
        return path, ("bytes", int(m[1]), int(m[2]))
    if m[3]:
        return path, ("lines", int(m[3]), int(m[4]))
    return path, (m[5], m[6], int(m[7] or 1))


def cut_region(data: bytes, path: str, what: tuple, expand: int = 0) -> tuple[int, int]:
    """Bounds in bytes of a region, widened by lines; ValueError if it isn't all there."""
    kind, a, b = what
    starts = line_starts(data) if data else []
    if kind == "lines":
        if not 1 <= a <= b <= len(starts):
            raise ValueError(f"lines {a}-{b} of {len(starts)}")
        end = data.find(b"\n", starts[b - 1])
        a, b = starts[a - 1], end if end >= 0 else len(data)
    elif kind in ("func", "section"):
        found = lang.named_block(data, path, kind, a, b)
        if found is None:
            raise ValueError(f"no {kind} {a!r} #{b}")
        a, b = found[:2]
    elif not 0 <= a <= b <= len(data):
        raise ValueError(f"bytes {a}-{b} of {len(data)}")
    if expand:
        first, last = number_of(starts, a), number_of(starts, max(a, b - 1))
        a = starts[max(0, first - 1 - expand)]
        end = data.find(b"\n", starts[min(len(starts), last + expand) - 1])
        b = end if end >= 0 else len(data)
    return a, b


def fetch_region(files: DataFrame, region: str, expand: int = 0) -> dict:
    """The one region: path, span, line_number, region, page and text.  Raises if it isn't whole: never an empty success."""
    path, what = parse_region(region)
    rows = files.where(F.col("path") == path).select(F.col("text").cast("binary").alias("data")).limit(2).collect()
    if len(rows) != 1:
        raise FileNotFoundError(path)
    data = bytes(rows[0]["data"] or b"")
    a, b = cut_region(data, path, what, expand)
    return {"file": path, "line_number": number_of(line_starts(data), a), "span": [a, b], "region": f"{path}@{a}-{b}", "page": lang.page_at(data, a), "text": data[a:b].decode("utf-8", "replace")}


#: Regions of one file that a task cuts at once.
REGIONS = 1000


def fetch_regions(files: DataFrame, regions: DataFrame) -> DataFrame:
    """region, start, end, text, error of many regions (column region) at once; what isn't whole is an error, not a row less.

    The regions of a file are dealt in lists of bounded length, and each list meets the text once.  If the lists are few
    and short they are broadcast, so that texts stay where they are; regions of files that aren't there are found apart.
    """
    asked = regions.select("region", F.regexp_extract("region", r"^(?s:(.*))@", 1).alias("path"))
    sizes = asked.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / REGIONS).cast("int").alias("lists"))
    lists = asked.join(sizes, "path").groupBy("path", F.pmod(F.xxhash64("region"), F.col("lists")).alias("list")).agg(F.collect_list("region").alias("regions")).select("path", "regions")
    texts = files.select("path", F.col("text").cast("binary").alias("data"))
    both = texts.join(sides.small(lists), "path").select("path", "regions", "data")
    nowhere = lists.join(files.select("path"), "path", "left_anti").select("path", "regions", F.lit(None).cast("binary").alias("data"))

    def worked(batches):
        for batch in batches:
            rows = []
            for path, asked_for, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for region in asked_for:
                    try:
                        if data is None:
                            raise ValueError(f"no file {path}")
                        a, b = cut_region(data, path, parse_region(region)[1])
                        rows.append((region, a, b, data[a:b].decode("utf-8", "replace"), None))
                    except ValueError as e:
                        rows.append((region, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows)), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["region", "start", "end", "text", "error"])

    return both.unionAll(nowhere).mapInArrow(worked, "region string, start long, end long, text string, error string")


def _sections(files: DataFrame) -> DataFrame:
    """path, sections of each Markdown file: (heading, lines) from a heading to the line before the next; what is before the first has none."""
    md = S.in_row(files.where(lang.family(F.col("path")) == "markdown"), carry=("path",))
    heads = F.filter(F.transform("hits", lambda h: F.when(F.startswith(h["line"], F.lit("#")), h["line_number"])), lambda n: n.isNotNull())
    md = md.withColumn("_starts", F.concat(F.array(F.lit(1)), F.filter(heads, lambda n: n > 1)))
    until = lambda k: F.coalesce(F.try_element_at("_starts", k + 2), F.size("hits") + 1)
    return md.select("path", F.inline(F.transform("_starts", lambda n, k: F.struct(F.slice("hits", n, until(k) - n).alias("lines")))))


def _heading(lines: Column) -> Column:
    first = F.element_at(lines, 1)
    return F.when(F.startswith(first["line"], F.lit("#")), first)


def sections(files: DataFrame) -> DataFrame:
    """path, section_start, heading, n_lines, n_bytes of Markdown sections: a heading to the line before the next.

    Built-in functions, in the file's row: no shuffle.
    """
    found = _sections(files).withColumn("head", _heading(F.col("lines"))).where("head is not null")
    n_bytes = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + F.octet_length(x["line"]) + 1)
    return found.select("path", F.col("head.line_number").alias("section_start"), F.col("head.line").alias("heading"), F.size("lines").cast("long").alias("n_lines"), n_bytes.alias("n_bytes"))


def nearest_heading(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """path, line_number, line, heading of selected Markdown lines: the last heading at or above each, in the file's row."""
    found = _sections(S.candidates(files, spec)).withColumn("head", _heading(F.col("lines")))
    rows = found.select("path", "head", F.inline(F.filter("lines", lambda x: S.line_matches(spec, x["line"]))))
    heading = F.when(F.col("byte_offset") - F.col("head.byte_offset") <= lang.SCOPE_LIMIT, F.rtrim(F.col("head.line")))
    return rows.select("path", "line_number", "line", heading.alias("heading"))
