"""Line search over a frame of files (path, text): predicates, lines, matches, counts, batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import dialect
from textloom.functions import text as T
from textloom.plans.spec import SearchSpec, Stage, find

#: Lines that are looked at together; offsets are summed up within so many lines.
CHUNK = 128


def stage_matches(stage: Stage, line: Column) -> Column:
    literal = stage.literal()
    if literal is not None:
        return F.contains(line, F.lit(literal))
    hit = line.rlike(stage.java())
    if not (stage.ignore_case or stage.word or stage.ident or stage.pcre or stage.fixed):
        for need in dialect.required_literals(stage.pattern):
            hit = F.contains(line, F.lit(need)) & hit
    return hit


def stage_fragments(stage: Stage, text: Column) -> Column:
    return T.fragments(text, stage.java())


def branch_fragments(branch: Sequence[Stage], line: Column) -> Column:
    """Texts that the last stage matches: stage 1 looks at the whole line, later ones inside what the last matched."""
    if len(branch) == 1:
        return stage_fragments(branch[0], line)
    found = stage_fragments(branch[1], line)
    for stage in branch[2:]:
        found = _narrowed(stage, found)
    return found


def _narrowed(stage: Stage, found: Column) -> Column:
    return F.flatten(F.transform(found, lambda f: stage_fragments(stage, f)))


def branch_matches(branch: Sequence[Stage], line: Column) -> Column:
    hit = stage_matches(branch[0], line)
    if len(branch) == 2:
        return hit & stage_matches(branch[1], line)
    return hit if len(branch) == 1 else hit & (F.size(branch_fragments(branch, line)) > 0)


def line_matches(spec: SearchSpec, line: Column) -> Column:
    """Whether a line is selected: any branch matches, or with invert none does."""
    spec = spec.resolved()
    any_of = F.lit(False)
    for b in spec.branches:
        any_of = any_of | branch_matches(b, line)
    return ~any_of if spec.invert else any_of


def line_fragments(spec: SearchSpec, line: Column) -> Column:
    """The matched texts of the first branch that matches the line; none for inverted searches."""
    spec = spec.resolved()
    none = F.array().cast("array<string>")
    if spec.invert:
        return none
    if len(spec.branches) == 1 and len(spec.branches[0]) == 1:
        return branch_fragments(spec.branches[0], line)  # none where it doesn't match
    out = none
    for b in reversed(spec.branches):
        out = F.when(branch_matches(b, line), branch_fragments(b, line)).otherwise(out)
    return out


def line_positions(spec: SearchSpec, line: Column) -> Column:
    """Byte spans in the line of line_fragments, as array of (start, end, text)."""
    spec = spec.resolved()
    none = F.array().cast(T.SPAN)
    if spec.invert:
        return none

    def nested(found: Column, stage: Stage) -> Column:
        inner = lambda s: F.transform(T.spans(s["text"], stage.java()), lambda t: F.struct((s["start"] + t["start"]).alias("start"), (s["start"] + t["end"]).alias("end"), t["text"].alias("text")))
        return F.flatten(F.transform(found, inner))

    out = none
    for b in reversed(spec.branches):
        found = T.spans(line, (b[1] if len(b) > 1 else b[0]).java())
        for stage in b[2:]:
            found = nested(found, stage)
        out = F.when(branch_matches(b, line), found).otherwise(out)
    return out


def whole_text(spec: SearchSpec) -> str | None:
    """A pattern whose matches on a whole text are those on its lines, one after another; None if there is none.

    So it is for a single stage whose matches can't go over a line feed: there is no need to cut the text then.
    """
    spec = spec.resolved()
    if spec.invert or len(spec.branches) != 1 or len(spec.branches[0]) != 1:
        return None
    s = spec.branches[0][0]
    if s.pcre or s.ident or s.literal() is not None or "\n" in s.pattern or not (s.fixed or dialect.line_bound(s.pattern)):
        return None
    return s.java().replace("(?d", "(?dm", 1)


def line_counter(spec: SearchSpec) -> str | None:
    """A pattern that matches once on each selected line of a text, over the rest of the line; None if there is none.

    One that can match nothing would match again behind the rest of the line.
    """
    java = whole_text(spec)
    stage = spec.branches[0][0]
    if java is None or not (stage.pattern if stage.fixed else dialect.least_width(stage.pattern)):
        return None
    flags, rest = re.match(r"(\(\?[a-z]+\))(.*)", java, re.S).groups()
    return f"{flags}(?:{rest})[^\\n]*+"


def may_match(spec: SearchSpec, text: Column) -> Column | None:
    """A cheap test that every file with a selected line passes, or None: it runs before a text is cut in lines."""
    spec = spec.resolved()
    if spec.invert:
        return None
    out = None
    for b in spec.branches:
        s = b[0]
        literal = s.literal()
        folded = dialect.simple_literal(s.pattern) if s.ignore_case and not (s.fixed or s.pcre or s.ident) else s.pattern if s.ignore_case and s.fixed and s.pattern.isascii() else None
        if folded and "\n" not in folded:
            test = F.contains(F.lower(text), F.lit(folded.lower()))
            out = test if out is None else out | test
            continue
        if literal is not None:
            if "\n" in literal:
                return F.lit(False) if len(spec.branches) == 1 else None
            test = F.contains(text, F.lit(literal))
        elif not (s.ignore_case or s.word or s.ident or s.pcre or s.fixed) and (needs := dialect.required_literals(s.pattern, 1)):
            test = F.lit(True)
            for need in needs:
                test = test & F.contains(text, F.lit(need))
        elif s.pcre or "\\A" in s.pattern or "\\z" in s.pattern or "(?s" in s.pattern:
            return None
        else:
            test = text.rlike(s.java().replace("(?d", "(?dm", 1))
        out = test if out is None else out | test
    return out


def file_matches(spec: SearchSpec, text: Column) -> Column:
    """Whether a file has a selected line."""
    if java := whole_text(spec):
        hit = text.rlike(java)
        pre = may_match(spec, text)
        return hit if pre is None else pre & hit
    hit = F.exists(T.line_array(text), lambda line: line_matches(spec, line))
    pre = may_match(spec, text)
    return hit if pre is None else pre & hit


def kept_file(spec: SearchSpec, text: Column) -> Column:
    """The conditions on the whole file: it matches all of with_file and none of without_file."""
    case = all(s.ignore_case for b in spec.branches for s in b) and bool(spec.branches)
    out = F.lit(True)
    for p in spec.with_file:
        out = out & file_matches(find(p, ignore_case=case), text)
    for p in spec.without_file:
        out = out & ~file_matches(find(p, ignore_case=case), text)
    return out


def candidates(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """The files that have to be cut in lines."""
    out = files.where(F.octet_length("text") > 0)
    if (pre := may_match(spec, F.col("text"))) is not None:
        out = out.where(pre)
    if spec.with_file or spec.without_file:
        out = out.where(kept_file(spec, F.col("text")))
    return out


def lines(files: DataFrame, keep: Callable[[Column], Column] | None = None, carry: Sequence[str] = ("path",)) -> DataFrame:
    """carry, line_number, byte_offset, line of every line, or of those that keep() selects.

    No shuffle: a text is cut in runs of lines whose first offsets are summed up, and lines are selected before they
    become rows.
    """
    f = files.where(F.octet_length("text") > 0).select(*carry, T.line_array(F.col("text")).alias("_all"))
    last = ((F.size("_all") - 1) / CHUNK).cast("int")
    runs = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("_all", k * CHUNK + 1, F.lit(CHUNK)))
    f = f.select(*carry, runs.alias("_runs"))
    sizes = F.transform("_runs", lambda r: F.octet_length(F.array_join(r, "\n")).cast("long") + 1)
    f = f.withColumn("_sizes", sizes)
    base = F.transform(F.sequence(F.lit(0), F.size("_runs") - 1), lambda k: F.aggregate(F.slice("_sizes", F.lit(1), k), F.lit(0).cast("long"), lambda a, b: a + b))
    f = f.select(*carry, F.posexplode(F.arrays_zip(F.col("_runs").alias("run"), base.alias("base"))).alias("_k", "_r"))
    run = F.col("_r")["run"]
    rows = F.transform(run, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    if keep is not None:
        rows = F.filter(rows, lambda r: keep(r["line"]))
    shaped = F.transform(
        rows,
        lambda r: F.struct(
            (F.col("_k") * CHUNK + r["i"] + 1).alias("line_number"),
            (F.col("_r")["base"] + F.when(r["i"] > 0, F.octet_length(F.array_join(F.slice(run, F.lit(1), r["i"]), "\n")) + 1).otherwise(F.lit(0))).alias("byte_offset"),
            r["line"].alias("line"),
        ),
    )
    return f.select(*carry, F.inline(shaped))


def matches(files: DataFrame, spec: SearchSpec, carry: Sequence[str] = ("path",), positions: bool = False) -> DataFrame:
    """One row per selected line: carry, line_number, byte_offset, line, fragments, and with positions their byte spans."""
    out = lines(candidates(files, spec), lambda line: line_matches(spec, line), carry)
    out = out.withColumn("fragments", line_fragments(spec, F.col("line")))
    return out.withColumn("positions", line_positions(spec, F.col("line"))) if positions else out


def count_lines(files: DataFrame, spec: SearchSpec, carry: Sequence[str] = ("path",)) -> DataFrame:
    """Selected lines of each file that has one: a projection, without rows for lines and without a shuffle."""
    return candidates(files, spec).select(*carry, selected_lines(spec, F.col("text")).alias("n")).where("n > 0")


def selected_lines(spec: SearchSpec, text: Column) -> Column:
    """The number of selected lines of a text: by one pattern over the whole of it where that says the same."""
    if counter := line_counter(spec):
        return F.regexp_count(text, F.lit(counter)).cast("long")
    return F.size(F.filter(T.line_array(text), lambda line: line_matches(spec, line))).cast("long")


def file_fragments(files: DataFrame, spec: SearchSpec, carry: Sequence[str] = ("path",)) -> DataFrame:
    """carry, fragments of each file with a selected line: the matched texts of all its lines, one after another."""
    java = whole_text(spec)
    if java is None:
        found = F.flatten(F.transform(T.line_array(F.col("text")), lambda line: line_fragments(spec, line)))
        return candidates(files, spec).select(*carry, found.alias("fragments")).where(F.size("fragments") > 0)
    # what is extracted says whether there is a match: no test before
    some = files.where(kept_file(spec, F.col("text"))) if spec.with_file or spec.without_file else files
    return some.select(*carry, T.fragments(F.col("text"), java).alias("fragments")).where(F.size("fragments") > 0)


def in_row(files: DataFrame, keep: Callable[[Column], Column] | None = None, carry: Sequence[str | Column] = ("path", "text"), offsets: bool = True) -> DataFrame:
    """carry, hits: a row per file with an array of its lines, or those that keep() selects (line_number, byte_offset, line).

    For operators that need a file's text beside its lines: nothing is shuffled or joined.  Without ``offsets`` there is
    no byte_offset, and no sum over the lines.
    """

    def numbered(ls: Column) -> Column:
        if not offsets:
            rows = F.transform(ls, lambda line, i: F.struct((i + 1).alias("line_number"), line.alias("line")))
            return rows if keep is None else F.filter(rows, lambda r: keep(r["line"]))
        at = T.sums_before(F.transform(ls, lambda line: F.octet_length(line).cast("long") + 1))
        rows = F.transform(F.arrays_zip(at.alias("at"), ls.alias("line")), lambda r, i: F.struct((i + 1).alias("line_number"), r["at"].alias("byte_offset"), r["line"].alias("line")))
        return rows if keep is None else F.filter(rows, lambda r: keep(r["line"]))

    hits = T.let(T.line_array(F.col("text")), numbered)
    return files.where(F.octet_length("text") > 0).select(*carry, hits.alias("hits"))


def files_with_matches(files: DataFrame, spec: SearchSpec, carry: Sequence[str] = ("path",)) -> DataFrame:
    """The files that have a selected line; with invert, those with a line that doesn't match."""
    return candidates(files, spec).where(file_matches(spec, F.col("text"))).select(*carry)


def excluded_files(files: DataFrame, spec: SearchSpec) -> DataFrame:
    """How many files have a selected line but fail the conditions on the whole file."""
    hit = file_matches(spec, F.col("text"))
    return files.agg(F.count_if(hit & ~kept_file(spec, F.col("text"))).alias("excluded"))


def batch_matches(files: DataFrame, queries: Sequence[tuple[str, SearchSpec]], carry: Sequence[str] = ("path",)) -> DataFrame:
    """Selected lines by (file, query) in one pass over the texts: carry, query_index, query, n (only where n > 0)."""
    text = F.col("text")

    def counted(spec: SearchSpec) -> Column:
        n = selected_lines(spec, text)
        pre = may_match(spec, text)
        return n if pre is None else F.when(pre, n).otherwise(F.lit(0).cast("long"))

    every = F.array(*[F.struct(F.lit(i).alias("query_index"), F.lit(q).alias("query"), counted(s).alias("n")) for i, (q, s) in enumerate(queries)])
    return files.where(F.octet_length("text") > 0).select(*carry, F.inline(F.filter(every, lambda x: x["n"] > 0)))


def read_batch(text: str) -> list[str]:
    """Queries of a batch file: trimmed lines; blank ones and those that begin with # are left out."""
    return [q for q in (line.strip() for line in text.split("\n")) if q and not q.startswith("#")]
