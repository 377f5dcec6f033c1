"""A command line over the search operators: python -m textloom.cli PATTERN [PATH ...]"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom import __version__
from textloom.operators import index as I
from textloom.operators import render, shape, structure
from textloom.operators import search as S
from textloom.plans.spec import SearchSpec, Stage, find
from textloom.sources import files as sources
from textloom.streaming import tail


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    p.add_argument("args", nargs="*", metavar="PATTERN|PATH")
    p.add_argument("-e", "--regexp", action="append", default=[], help="an alternative pattern")
    p.add_argument("-t", "--pipe", action="append", default=[], help="a further stage of the (only) pattern")
    for flag, dest, text in (
        ("-F", "fixed", "patterns are plain texts"), ("-P", "pcre", "patterns may look around and refer back"), ("-i", "ignore_case", ""), ("-S", "smart_case", ""), ("-w", "word", ""),
        ("-v", "invert", ""), ("-n", "numbers", "line numbers"), ("-c", "count", ""), ("-l", "files", ""), ("-o", "only", ""), ("-U", "multiline", ""), ("-L", "follow", ""),
    ):
        p.add_argument(flag, dest=dest, action="store_true", help=text)
    for flag in ("json", "compact", "hidden", "no-ignore", "collapse", "outline", "histogram", "scope", "block", "suggest", "ident"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("-r", dest="recursive", action="store_true", help="directories are walked anyway")
    p.add_argument("-s", dest="case_sensitive", action="store_true", help="takes back -i and -S")
    for flag in ("-A", "-B", "-C", "-M"):
        p.add_argument(flag, type=int)
    p.add_argument("-g", "--glob", action="append", default=[])
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--top", type=int)
    p.add_argument("--rank", choices=("count", "density", "defs"), default="count")
    p.add_argument("--color", "--colour", choices=("auto", "always", "never"), default="auto")
    for flag in ("structural", "lang", "capture", "batch", "files-from", "changed-since", "use-index", "get-region"):
        p.add_argument(f"--{flag}")
    p.add_argument("--clear-index", metavar="FOLDER", help="removes the indexes at or under a folder")
    p.add_argument("--watch", action="store_true", help="searches what is appended to files until it is stopped")
    p.add_argument("--watch-seconds", type=float, help="stops watching after so long")
    p.add_argument("--skill", action="store_true", help="how a program should use this one")
    p.add_argument("-V", "--version", action="version", version=f"textloom {__version__}")
    p.add_argument("--with-file", action="append", default=[])
    p.add_argument("--without-file", action="append", default=[])
    p.add_argument("--expand", type=int, default=0)
    return p


SKILL = """textloom searches files by lines, and answers with citations that can be fetched again.

    textloom --json PATTERN PATH        one JSON object a match; the last one is a summary with exact totals
    textloom --outline --top 20 ...     a row a file, with its number of matches and the line that says most
    textloom --histogram PATTERN ...    the distinct texts that matched, with their numbers
    textloom --max-tokens 500 ...       output cut to a budget; totals stay exact
    textloom --scope / --block ...      the definition, section or page around each match
    textloom -t PATTERN ...             a further pattern that looks inside what the one before it matched
    textloom --suggest PATTERN ...      probes of related words when nothing was found
    textloom --batch FILE ...           many patterns in one pass
    textloom --structural 'f(:[args])'  balanced templates; --histogram --capture args counts what a hole held
    textloom --get-region ID            the text of a citation: path@start-end, path@:first-last, path@func:name
    textloom --use-index FOLDER ...     an index that is built or renewed first

Exit code: 0 if something matched, 1 if nothing did, 2 if something could not be read."""


def watch(spark: SparkSession, paths: list[str], spec: SearchSpec, a, say) -> int:
    """Prints selected lines as they are appended.  0 if there was one."""
    found = tail.search_stream(tail.tail(spark, paths), spec)
    hits = []

    def batch(rows, _):
        # a batch is what was appended since the last one and matched
        for r in rows.orderBy("path", "line_number").toLocalIterator():
            hits.append(r["line_number"])
            if a.json:
                end = r["byte_offset"] + len(r["line"].encode())
                say(json.dumps({"type": "match", "file": r["path"], "line_number": r["line_number"], "byte_offset": r["byte_offset"], "text": r["line"], "region": f"{r['path']}@{r['byte_offset']}-{end}"}, ensure_ascii=False))
            else:
                say(f"{r['path']}:" + (f"{r['line_number']}:" if a.numbers else "") + r["line"])

    query = found.writeStream.foreachBatch(batch).trigger(processingTime="500 milliseconds").start()
    try:
        query.awaitTermination(a.watch_seconds) if a.watch_seconds else query.awaitTermination()
    except KeyboardInterrupt:
        pass
    finally:
        query.stop()
    return 0 if hits else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    out = out or sys.stdout
    argv = [*sources.read_config_args(), *(sys.argv[1:] if argv is None else argv)]
    # -C1 and -rin are understood by argparse; a lone - is standard input
    a = parser().parse_args(argv)
    if a.skill:
        print(SKILL, file=out)
        return 0
    spark = spark or SparkSession.builder.appName("textloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    say = lambda *lines: print(*lines, sep="\n", file=out)
    if a.clear_index:
        I.Index(spark, a.clear_index).clear()
        I.Registry(spark, registry_folder()).clear(a.clear_index)
        return 0
    if a.get_region:
        path, _ = structure.parse_region(a.get_region)
        try:
            found = structure.fetch_region(sources.from_list(spark, [path]).withColumn("text", F.col("content")), a.get_region, a.expand)
        except (ValueError, FileNotFoundError) as e:
            print(f"textloom: {e}", file=sys.stderr)
            return 2
        say(json.dumps({"type": "region", **{k: v for k, v in found.items() if v is not None}}, ensure_ascii=False) if a.json else found["text"])
        return 0
    paths = list(a.args)
    patterns = list(a.regexp)
    if not patterns and not a.structural and not a.batch:
        if not paths:
            parser().print_usage(sys.stderr)
            return 2
        patterns, paths = paths[:1], paths[1:]
    ignore, smart = (a.ignore_case and not a.case_sensitive), (a.smart_case and not a.case_sensitive)
    stage = {"fixed": a.fixed, "pcre": a.pcre, "ignore_case": ignore, "word": a.word, "ident": a.ident, "only": a.only}
    before, after = (a.B if a.B is not None else a.C or 0), (a.A if a.A is not None else a.C or 0)
    try:
        branches = [(Stage(p, **stage),) for p in patterns]
        if a.pipe:
            branches = [(*branches[0], *(Stage(p, fixed=a.fixed, pcre=a.pcre, ignore_case=ignore) for p in a.pipe)), *branches[1:]]
        spec = None if a.batch else SearchSpec(
            tuple(branches), invert=a.invert, smart_case=smart, with_file=tuple(a.with_file), without_file=tuple(a.without_file), multiline=a.multiline, structural=a.structural,
            capture=a.capture, histogram=a.histogram, count=a.count, files=a.files, before=before, after=after, watch=a.watch, files_from=a.files_from, changed_since=a.changed_since,
        )
    except ValueError as e:
        print(f"textloom: {e}", file=sys.stderr)
        return 2
    if a.watch:
        return watch(spark, paths or ["."], spec, a, say)
    options = sources.WalkOptions(hidden=a.hidden, no_ignore=a.no_ignore, follow=a.follow, globs=tuple(a.glob))
    if a.files_from:
        text = sys.stdin.read() if a.files_from == "-" else open(a.files_from, encoding="utf-8").read()
        files = sources.from_list(spark, sources.path_list(text))
    elif a.changed_since:
        files = sources.from_changes(spark, a.changed_since, paths, a.glob)
    elif paths == ["-"] or not paths and not sys.stdin.isatty() and not a.recursive and not os.environ.get("TEXTLOOM_NO_STDIN"):
        files = sources.from_buffer(spark, sys.stdin.buffer.read())
    else:
        files = sources.from_tree(spark, paths or ["."], options)
    errors = files.where("error is not null").count()
    readable = files.where("text is not null")
    if spec and a.use_index:
        readable = I.Index(spark, a.use_index).source(readable, spec, {"hidden": a.hidden, "no_ignore": a.no_ignore, "follow": a.follow, "globs": a.glob}, reindex=True)
        I.Registry(spark, registry_folder()).add(a.use_index)
    if a.batch:
        queries = [(q, find(q, **stage, invert=a.invert, smart_case=smart)) for q in S.read_batch(open(a.batch, encoding="utf-8").read())]
        totals = shape.batch_totals(readable, queries).orderBy("query_index").collect()
        say(*(json.dumps({"type": "query", "query": r["query"], "files": r["files"], "lines": r["lines"]}) if a.json else f"{r['query']}\t{r['files']}\t{r['lines']}" for r in totals))
        return render.exit_code(any(r["lines"] for r in totals), errors)
    if a.structural:
        found = structure.structural(readable, a.structural, a.lang)
        if a.histogram:
            rows = shape.histogram(shape.capture_fragments(found, a.capture)).orderBy(F.desc("n"), "text")
            rows = (rows.limit(a.top) if a.top else rows).collect()
            say(*(f"{r['n']}\t{r['files']}\t{r['text']}" for r in rows))
            return render.exit_code(bool(rows), errors)
        found = found.withColumnRenamed("block", "line").orderBy("path", "line_number")
    elif a.multiline:
        found = structure.multiline_blocks(readable, spec).withColumnRenamed("block", "line")
    elif a.count or a.files:
        rows = (S.count_lines(readable, spec) if a.count else S.files_with_matches(readable, spec)).orderBy("path").collect()
        say(*((json.dumps({"type": "count", "file": r["path"], "count": r["n"]}) if a.json else f"{r['path']}:{r['n']}") if a.count else json.dumps({"type": "file", "file": r["path"]}) if a.json else r["path"] for r in rows))
        return render.exit_code(bool(rows), errors)
    elif a.outline:
        rows = shape.ranked(shape.outline(readable, spec), a.rank, a.top).collect()
        extra = lambda r: {"score": round(r["score"], 2)} if a.rank == "density" else {"defs": r["defs"]} if a.rank == "defs" else {}
        say(*(json.dumps({"type": "outline", "file": r["path"], "count": r["n"], **extra(r), "exemplar": r["exemplar"]}, ensure_ascii=False) if a.json else f"{r['path']}\t{r['n']}\t{r['exemplar']}" for r in rows))
        return render.exit_code(bool(rows), errors)
    elif a.histogram:
        rows = shape.histogram(S.matches(readable, spec)).orderBy(F.desc("n"), "text")
        rows = (rows.limit(a.top) if a.top else rows).collect()
        say(*(json.dumps({"type": "variant", "text": r["text"], "count": r["n"], "files": r["files"]}, ensure_ascii=False) if a.json else f"{r['n']}\t{r['files']}\t{r['text']}" for r in rows))
        return render.exit_code(bool(rows), errors)
    elif before or after:
        found = shape.context(readable, spec, before, after)
    else:
        found = structure.enclosed(readable, spec, a.block, positions=True) if a.scope or a.block else S.matches(readable, spec, positions=True)
        if a.block:
            found = found.withColumnRenamed("block", "line").withColumn("byte_offset", F.col("start")).withColumn("positions", F.array())
    total = shape.summary(found.where("not is_context").groupBy("path").agg(F.count(F.lit(1)).alias("n")) if "is_context" in found.columns else found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))).first()
    shown = found
    if a.collapse and "is_context" not in found.columns:
        shown = shape.collapse(shown)
    if a.max_tokens and "is_context" not in found.columns:
        keys = shape.budget(shown, a.max_tokens).select("path", "line_number")
        shown = shown.join(F.broadcast(keys), ["path", "line_number"], "left_semi")
    probes = shape.suggest(readable, patterns).orderBy("place").collect() if not total["lines"] and a.suggest else []
    if a.json:
        for r in render.in_order(_as_records(shown, a.compact), "path", "line_number"):
            say(r["json"])
        if a.collapse and "is_context" not in found.columns:
            cut = shape.collapse_totals(found).first()
            say(json.dumps({"type": "collapsed", "lines": cut["lines"], "texts": cut["texts"]}))
        say(*(json.dumps({"type": "suggest", "variant": r["variant"], "kind": r["kind"], "lines": r["lines"], "files": r["files"]}, ensure_ascii=False) for r in probes)) if probes else None
        totals = {"files": total["files"], "lines": total["lines"], "errors": errors}
        if a.max_tokens and "is_context" not in found.columns:
            spent = shape.budget_totals(found, a.max_tokens).first().asDict()
            totals |= {k: spent[k] for k in ("shown_files", "shown_lines", "omitted_files", "omitted_lines")}
        say(json.dumps({"type": "summary", **totals}))
    elif a.only and "fragments" in shown.columns:
        say(*(f"{r['path']}:{r['line_number']}:{f}" if a.numbers else f"{r['path']}:{f}" for r in render.in_order(shown, "path", "line_number") for f in r["fragments"]))
    else:
        _print_text(shown, a, out, say)
        if a.collapse and "is_context" not in found.columns and (cut := shape.collapse_totals(found).first())["lines"]:
            say(f"({cut['lines']} more lines of {cut['texts']} texts)")
        for r in probes:
            say(f"{r['variant']}\t{r['kind']}\t{r['files']}\t{r['lines']}")
    return render.exit_code(bool(total["lines"]), errors)


#: Bytes of a line that text output shows around its first match, unless -M says otherwise (-1: all).
WINDOW = 75


def _as_records(shown, compact: bool):
    """path, line_number, json of lines, context lines, blocks and templates."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    if "is_context" in shown.columns:
        kind = F.when(F.col("is_context"), "context").otherwise("match")
        return shown.select("path", "line_number", F.to_json(F.struct(kind.alias("type"), F.col("path").alias("file"), "line_number", F.col("line").alias("text"))).alias("json"))
    if "positions" not in shown.columns:
        shown = shown.withColumn("positions", none)
    return render.json_matches(shown.withColumn("positions", F.coalesce("positions", none)), compact)


def _print_text(shown, a, out, say) -> None:
    colour = a.color == "always" or a.color == "auto" and getattr(out, "isatty", bool)()
    width = WINDOW if not a.M else a.M
    if a.scope and "scope" in shown.columns:
        shown = render.group_lines(shown)
    last = None
    for r in render.in_order(shown, "path", "line_number"):
        context = "is_context" in shown.columns and r["is_context"]
        if "group_id" in shown.columns and last not in (None, (r["path"], r["group_id"])):
            say("--")
        last = (r["path"], r["group_id"]) if "group_id" in shown.columns else None
        if "group_line" in shown.columns and r["group_line"]:
            say(r["group_line"])
        spans = [(p["start"], p["end"]) for p in r["positions"]] if "positions" in shown.columns and r["positions"] else []
        line = r["line"]
        if width > 0 and "\n" not in line:
            line, spans, _ = render.column_window(line, spans, width)
        if colour:
            line = render.coloured(line, spans)
        sep = "-" if context else ":"
        say(f"{r['path']}{sep}" + (f"{r['line_number']}{sep}" if a.numbers else "") + line)


def registry_folder() -> str:
    return os.environ.get("TEXTLOOM_REGISTRY") or os.path.expanduser("~/.cache/textloom/indexes")


if __name__ == "__main__":
    sys.exit(main())
