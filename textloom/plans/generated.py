"""Registered queries over files made from the tables' rows, for operators on code, Markdown, books and trees.

Each row of a table gives a file of a known form, so that SQL can say what an operator has to find in it.
"""

from __future__ import annotations

import io
import os
import subprocess
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import dialect, lang, regex
from textloom.functions import text as T
from textloom.operators import index as I
from textloom.operators import render, shape, structure
from textloom.operators import search as S
from textloom.plans.catalogue import CUT, FILES, WITH, _docs, query
from textloom.plans.spec import find
from textloom.sources import extract, tables
from textloom.sources import files as sources
from textloom.streaming import tail

# --- code, a file per customer: @ stands for the customer's key

BODIES = [
    ("py", "# tool @\nclass Tool@:\n    def open_@(self):\n        note = '}'\n        return @\n\n    def close_@(self):\n        # return later\n        return -@\n"),
    ("go", 'package p@\n\n// Run@ returns.\nfunc Run@(n int) int {\n\tif n > @ { // }\n\t\treturn Call@("(", f(n, @))\n\t}\n\treturn n\n}\n\nfunc Stop@() {\n\treturn\n}\n'),
    ("md", "# Book @\n\n## Contents\nreturn list\n\n## Part @\nreturn to part @\n<!-- p.7 -->\nreturn again\n"),
    ("rs", "pub fn run_@() -> u32 {\n    /* { /* } */ */\n    return @;\n}\n"),
    ("txt", "return @\n"),
]
_BODIES = ", ".join("({}, '{}', '{}')".format(i, e, b.replace("'", "''").replace("\n", "¶").replace("\t", "→")) for i, (e, b) in enumerate(BODIES))
_CODE = f"""WITH files AS (SELECT printf('%s/%05d.%s', CASE WHEN c_custkey % 7 = 0 THEN 'vendor' WHEN c_custkey % 11 = 0 THEN 'tests' ELSE 'code' END, c_custkey, ext) AS path,
replace(replace(replace(body, '¶', chr(10)), '→', chr(9)), '@', c_custkey::VARCHAR) AS text, ext, c_custkey::VARCHAR AS k FROM customer JOIN (VALUES {_BODIES}) b(i, ext, body) ON c_custkey % 5 = i), {CUT}"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    pick = lambda at: F.element_at(F.array(*[F.lit(b[at]) for b in BODIES]), (key % 5 + 1).cast("int"))
    folder = F.when(key % 7 == 0, "vendor").when(key % 11 == 0, "tests").otherwise("code")
    # a key is some bytes in the table and its file a thousand times the work, so keys are dealt anew: a table of one row group isn't one task
    dealt = tables.read(spark, sf_dir, "customer").select("c_custkey").repartition("c_custkey")
    return dealt.select(F.format_string("%s/%05d.%s", folder, key, pick(0)).alias("path"), F.replace(pick(1), F.lit("@"), key.cast("string")).alias("text"))


_SCOPES = """(VALUES ('py', 5, 'def open_@(self):', NULL, NULL), ('py', 8, 'def close_@(self):', NULL, NULL), ('py', 9, 'def close_@(self):', NULL, NULL), ('go', 3, NULL, NULL, NULL),
('go', 6, 'func Run@(n int) int', NULL, NULL), ('go', 8, 'func Run@(n int) int', NULL, NULL), ('go', 12, 'func Stop@()', NULL, NULL), ('md', 4, '## Contents', NULL, NULL),
('md', 7, '## Part @', NULL, NULL), ('md', 9, '## Part @', 7, NULL), ('rs', 3, 'pub fn run_@() -> u32', NULL, NULL), ('txt', 1, NULL, NULL, NULL)) s(ext, line_number, scope, page, kind)"""


@query(f"""{_CODE} SELECT l.path, l.line_number, byte_offset, line, replace(scope, '@', k) AS scope, page::INTEGER AS page, kind::VARCHAR AS kind
FROM lines l JOIN files f ON l.path = f.path JOIN {_SCOPES} ON s.ext = f.ext AND s.line_number = l.line_number""")
def code_scope(spark, sf_dir):
    return structure.enclosed(_code(spark, sf_dir), find("return")).drop("fragments")


@query(f"""{_CODE} SELECT l.path, line_number, CASE WHEN starts_with(trim(line), '//') OR starts_with(trim(line), '#') THEN NULL ELSE 'definition' END AS kind
FROM lines l JOIN files f ON l.path = f.path WHERE ext IN ('py', 'go', 'rs') AND regexp_matches(line, '(def|func|fn|class) ') UNION ALL
SELECT l.path, line_number, NULL AS kind FROM lines l JOIN files f ON l.path = f.path WHERE ext NOT IN ('py', 'go', 'rs') AND regexp_matches(line, '(def|func|fn|class) ')""")
def code_kinds(spark, sf_dir):
    return structure.enclosed(_code(spark, sf_dir), find("(def|func|fn|class) ")).select("path", "line_number", "kind")


@query(f"""{_CODE}, b AS (SELECT * FROM (VALUES ('py', 3, 5, 5, 1, 'def open_@(self):'), ('py', 7, 9, 8, 2, 'def close_@(self):'), ('go', 3, 3, 3, 1, NULL), ('go', 4, 9, 6, 2, 'func Run@(n int) int'), ('go', 11, 13, 12, 1, 'func Stop@()'),
('md', 4, 4, 4, 1, '## Contents'), ('md', 6, 9, 7, 2, '## Part @'), ('rs', 1, 4, 3, 1, 'pub fn run_@() -> u32'), ('txt', 1, 1, 1, 1, NULL)) t(ext, first, last, line_number, hits, scope))
SELECT f.path, min(byte_offset) AS start, b.line_number, replace(any_value(b.scope), '@', any_value(k)) AS scope, NULL::INTEGER AS page, any_value(b.hits) AS hits, string_agg(line, chr(10) ORDER BY l.line_number) AS block
FROM files f JOIN b ON b.ext = f.ext JOIN lines l ON l.path = f.path AND l.line_number BETWEEN b.first AND b.last GROUP BY f.path, b.first, b.line_number""")
def code_blocks(spark, sf_dir):
    return structure.enclosed(_code(spark, sf_dir), find("return"), blocks=True)


@query(f"""{_CODE} SELECT f.path, line_number, byte_offset + strlen(line) - strlen('f(n, ' || k || '))') AS start, byte_offset + strlen(line) - 1 AS "end", line AS block, 'n, ' || k AS args
FROM files f JOIN lines l ON l.path = f.path WHERE ext = 'go' AND line_number = 6""")
def structural_calls(spark, sf_dir):
    found = structure.structural(_code(spark, sf_dir), "f(:[args])")
    return found.select("path", "line_number", F.col("byte_offset").alias("start"), F.col("end_offset").alias("end"), "block", F.element_at("captures", "args").alias("args"))


@query(f"""{_CODE} SELECT 'n int' AS text, count(*) AS n, count(*) AS files FROM files WHERE ext = 'go'""")
def structural_captures(spark, sf_dir):
    found = structure.structural(_code(spark, sf_dir), "func :[_](:[ args ]) int {".replace(" args ", "args"))
    return shape.histogram(shape.capture_fragments(found, "args"))


@query(f"""{_CODE}, d AS (SELECT f.path, ext, count(*) AS n, count(*) FILTER (NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '//') AND ext IN ('py', 'go', 'rs') AND regexp_matches(line, '^ *(def|class|func|pub fn) ')) AS defs
FROM files f JOIN lines l ON l.path = f.path WHERE regexp_matches(line, 'def|func|fn|Book') GROUP BY ALL)
SELECT path, n, defs, (row_number() OVER (ORDER BY NOT starts_with(path, 'code/'), defs DESC, n DESC, path))::INTEGER AS rank FROM d QUALIFY rank <= 100""")
def outline_defs(spark, sf_dir):
    return shape.ranked(shape.outline(_code(spark, sf_dir), find("def|func|fn|Book")), "defs", 100).select("path", "n", "defs", "rank")


@query(f"""{_CODE}, d AS (SELECT f.path, any_value(strlen(f.text)) AS size, count(*) AS n FROM files f JOIN lines l ON l.path = f.path WHERE contains(line, 'return') GROUP BY f.path),
s AS (SELECT path, n, n / greatest(size / 1024.0::DOUBLE, 1.0::DOUBLE) * CASE WHEN starts_with(path, 'vendor/') THEN 0.25 ELSE 1.0 END AS score FROM d)
SELECT path, n, score, (row_number() OVER (ORDER BY score DESC, n DESC, path))::INTEGER AS rank FROM s QUALIFY rank <= 1000""")
def outline_demoted(spark, sf_dir):
    return shape.ranked(shape.outline(_code(spark, sf_dir), find("return")), "density", 1000).select("path", "n", "score", "rank")


@query(f"""{_CODE} SELECT f.path, CASE ext WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'generic' ELSE ext END AS family, line_number,
ext = 'py' AND line_number IN (2, 3, 7) OR ext = 'go' AND line_number IN (4, 11) OR ext = 'rs' AND line_number = 1 AS is_definition FROM files f JOIN lines l ON l.path = f.path""")
def definition_lines(spark, sf_dir):
    found = S.lines(_code(spark, sf_dir)).withColumn("family", lang.family(F.col("path")))
    return found.select("path", "family", "line_number", lang.is_definition(F.col("line"), F.col("family")).alias("is_definition"))


@query(f"""{_CODE}, r AS (SELECT * FROM (VALUES ('py', '@func:close_@', 7, 9), ('go', '@func:Stop@', 11, 13), ('md', '@section:Part @', 6, 9), ('md', '@section:Book @/Contents', NULL, NULL), ('md', '@section:Book @/part', 6, 9),
('py', '@func:close_', NULL, NULL), ('rs', '@:2-3', 2, 3), ('rs', '@:4-9', NULL, NULL), ('py', '@func:open_@#2', NULL, NULL)) t(ext, what, first, last)),
a AS (SELECT f.path, f.path || replace(what[1:1], '@', '@') || replace(what[2:], '@', k) AS region, what, k, first, last FROM files f JOIN r ON r.ext = f.ext)
SELECT region, (SELECT byte_offset FROM lines l WHERE l.path = a.path AND l.line_number = CASE WHEN what LIKE '%Contents' THEN 3 ELSE a.first END) AS start,
(SELECT byte_offset + strlen(line) FROM lines l WHERE l.path = a.path AND l.line_number = CASE WHEN what LIKE '%Contents' THEN 3 ELSE a.last END) AS "end",
(SELECT string_agg(line, chr(10) ORDER BY line_number) FROM lines l WHERE l.path = a.path AND l.line_number BETWEEN CASE WHEN what LIKE '%Contents' THEN 3 ELSE a.first END AND CASE WHEN what LIKE '%Contents' THEN 3 ELSE a.last END) AS text,
CASE WHEN what LIKE '%close_' THEN 'no func ''close_'' #1' WHEN what LIKE '%#2' THEN 'no func ''open_' || k || ''' #2' WHEN what = '@:4-9' THEN 'lines 4-9 of 4' END AS error FROM a""")
def named_regions(spark, sf_dir):
    files = _code(spark, sf_dir)
    key = F.regexp_extract("path", r"/0*(\d+)\.", 1)
    asked = {"py": ["@func:close_@", "@func:close_", "@func:open_@#2"], "go": ["@func:Stop@"], "md": ["@section:Part @", "@section:Book @/Contents", "@section:Book @/part"], "rs": ["@:2-3", "@:4-9"]}
    ext = F.element_at(F.split("path", r"\."), -1)
    wanted = F.element_at(F.create_map(*[x for e, ws in asked.items() for x in (F.lit(e), F.array(*map(F.lit, ws)))]), ext)
    rows = files.select("path", key.alias("key"), F.explode(wanted).alias("what"))
    named = F.concat("path", F.lit("@"), F.replace(F.substring("what", 2, 1000), F.lit("@"), F.col("key")))
    return structure.fetch_regions(files, rows.select(named.alias("region")))


# --- Markdown, from documents: every fifth line is a heading, every seventh holds a page mark

_MD = f"""{WITH}, m0 AS (SELECT replace(path, '.txt', '.md') AS path, line_number, CASE WHEN line_number % 5 = 2 THEN '# ' || line WHEN line_number % 7 = 0 THEN '<!-- p.' || line_number || ' --> ' || line ELSE line END AS line FROM lines),
m1 AS (SELECT *, (coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS byte_offset, starts_with(line, '#') AS head FROM m0),
md AS (SELECT *, max(CASE WHEN head THEN line_number END) OVER w AS top, max(CASE WHEN head THEN byte_offset END) OVER w AS top_at,
  max(CASE WHEN regexp_matches(line, '<!-- p\\.\\d') THEN byte_offset END) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark_at,
  max(CASE WHEN regexp_matches(line, '<!-- p\\.\\d') THEN line_number END) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM m1 WINDOW w AS (PARTITION BY path ORDER BY line_number))"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    def marked(line, i):
        number = (i + 1).cast("string")
        return F.when((i + 1) % 5 == 2, F.concat(F.lit("# "), line)).when((i + 1) % 7 == 0, F.concat(F.lit("<!-- p."), number, F.lit(" --> "), line)).otherwise(line)

    docs = _docs(spark, sf_dir).where("text <> ''")
    return docs.select(F.replace("path", F.lit(".txt"), F.lit(".md")).alias("path"), F.concat(F.array_join(F.transform(T.line_array(F.col("text")), marked), "\n"), F.lit("\n")).alias("text"))


@query(f"{_MD} SELECT path, top AS section_start, any_value(line) FILTER (head AND line_number = top) AS heading, count(*) AS n_lines, sum(strlen(line) + 1)::BIGINT AS n_bytes FROM md WHERE top IS NOT NULL GROUP BY path, top")
def sections(spark, sf_dir):
    return structure.sections(_markdown(spark, sf_dir))


@query(f"""{_MD} SELECT m.path, m.line_number, m.line, CASE WHEN m.byte_offset - m.top_at <= 65536 THEN rtrim(h.line, ' ') END AS heading
FROM md m LEFT JOIN md h ON h.path = m.path AND h.line_number = m.top WHERE contains(m.line, 'the')""")
def section_scope(spark, sf_dir):
    return structure.nearest_heading(_markdown(spark, sf_dir), find("the", fixed=True))


_SCOPED = f"""{_MD}, sc AS (SELECT m.path, m.line_number, m.byte_offset, m.line, CASE WHEN m.byte_offset - m.top_at <= 65536 THEN rtrim(h.line, ' ' || chr(9) || chr(13)) END AS scope,
CASE WHEN m.byte_offset - m.mark_at <= 65536 THEN m.mark END::INTEGER AS page FROM md m LEFT JOIN md h ON h.path = m.path AND h.line_number = m.top WHERE contains(m.line, 'License'))"""


@query(f"{_SCOPED} SELECT path, line_number, scope, page FROM sc")
def section_pages(spark, sf_dir):
    return structure.enclosed(_markdown(spark, sf_dir), find("License", fixed=True)).select("path", "line_number", "scope", "page")


@query(f"""{_SCOPED}, s2 AS (SELECT *, coalesce(scope, 'p.' || page) AS mark FROM sc), s3 AS (SELECT *, lag(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_number) AS last FROM s2)
SELECT path, line_number, CASE WHEN mark IS NOT NULL AND mark IS DISTINCT FROM last THEN '§ ' || mark END AS group_line FROM s3""")
def section_lines(spark, sf_dir):
    return render.group_lines(structure.enclosed(_markdown(spark, sf_dir), find("License", fixed=True))).select("path", "line_number", "group_line")


@query(rf"""{_MD}, e AS (SELECT path, top, min(byte_offset) AS start, any_value(rtrim(line, ' ' || chr(9) || chr(13))) FILTER (head AND line_number = top) AS scope, rtrim(string_agg(line, chr(10) ORDER BY line_number), chr(10)) AS block,
min(line_number) FILTER (contains(line, 'License')) AS line_number, count(*) FILTER (contains(line, 'License')) AS hits FROM md WHERE top IS NOT NULL GROUP BY path, top)
SELECT path, start, line_number::INTEGER AS line_number, hits::INTEGER AS hits, block FROM e WHERE hits > 0 AND strlen(block) <= 32000
UNION ALL SELECT path, byte_offset, line_number::INTEGER, 1::INTEGER, line FROM md WHERE top IS NULL AND contains(line, 'License')""")
def section_blocks(spark, sf_dir):
    return structure.enclosed(_markdown(spark, sf_dir), find("License", fixed=True), blocks=True).where(F.octet_length("block") <= 32000).select("path", "start", "line_number", "hits", "block")


@query(f"{WITH} SELECT path, (line_number * 2)::INTEGER AS line_number, line_number::INTEGER AS page FROM lines WHERE contains(line, 'License')")
def page_lookup(spark, sf_dir):
    """Pages in a text whose form feeds became page marks: each line feed of a document starts a page here."""
    docs = _docs(spark, sf_dir).withColumn("text", extract.page_marks(F.regexp_replace("text", "\n", "\f")))
    return structure.enclosed(docs, find("License", fixed=True)).select("path", "line_number", "page")


@query(f"""{WITH} SELECT a.path, a.line_number, a.byte_offset, a.line || chr(10) || b.line AS block, 1::INTEGER AS hits FROM lines a JOIN lines b ON a.path = b.path AND b.line_number = a.line_number + 1
WHERE ends_with(a.line, '.') AND starts_with(b.line, 'The')""")
def multiline_blocks(spark, sf_dir):
    return structure.multiline_blocks(_docs(spark, sf_dir), find(r"\.$\n^The", multiline=True))


# --- records

_JSON = "json_object('type', 'match', 'file', path, 'line_number', line_number, 'byte_offset', byte_offset, 'text', line, 'matches', [{'start': strlen(split_part(line, 'License', 1)), 'end': strlen(split_part(line, 'License', 1)) + 7}], 'span', [byte_offset, byte_offset + strlen(line)], 'region', path || '@' || byte_offset || '-' || (byte_offset + strlen(line)))::VARCHAR"


@query(f"{WITH} SELECT path, line_number, {_JSON} AS json FROM lines WHERE contains(line, 'License') AND len(string_split(line, 'License')) = 2")
def json_matches(spark, sf_dir):
    found = S.matches(_docs(spark, sf_dir), find("License", fixed=True), positions=True).where(F.size("positions") == 1)
    return render.json_matches(found).select("path", "line_number", "json")


@query(f"{WITH} SELECT path, line_number, json_object('type', 'match', 'file', path, 'line_number', line_number, 'text', line, 'region', path || '@' || byte_offset || '-' || (byte_offset + strlen(line)))::VARCHAR AS json FROM lines WHERE contains(line, 'License')")
def json_compact(spark, sf_dir):
    found = S.matches(_docs(spark, sf_dir), find("License", fixed=True), positions=True)
    return render.json_matches(found, compact=True).select("path", "line_number", "json")


@query(f"""{WITH}, n AS (SELECT path, count(*) AS n FROM lines WHERE contains(line, 'License') GROUP BY path)
SELECT json_object('type', 'count', 'file', path, 'count', n)::VARCHAR AS json FROM n UNION ALL SELECT json_object('type', 'file', 'file', path)::VARCHAR FROM n
UNION ALL SELECT json_object('type', 'summary', 'files', count(*), 'lines', sum(n)::BIGINT, 'errors', 2)::VARCHAR FROM n UNION ALL SELECT '{{"type":"error","file":"gone/' || i || '","error":"no such file or directory"}}' FROM range(2) t(i)""")
def json_counts(spark, sf_dir):
    counts = S.count_lines(_docs(spark, sf_dir), find("License", fixed=True))
    errors = sources.from_list(spark, ["gone/0", "gone/1"])
    parts = [render.json_counts(counts), render.json_files(counts), render.json_errors(errors), render.json_summary(shape.summary(counts, errors.where("error is not null")))]
    out = parts[0].select("json")
    for p in parts[1:]:
        out = out.unionAll(p.select("json"))
    return out


@query(f"""{WITH}, hit AS (SELECT *, contains(line, 'License') AS h FROM lines), near AS (SELECT *, bool_or(h) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM hit)
SELECT path, line_number, CASE WHEN h THEN path || ':' || line_number || ':' || line ELSE path || '-' || line_number || '-' || line END AS rendered FROM near WHERE near""")
def text_lines(spark, sf_dir):
    return render.text_lines(shape.context(_docs(spark, sf_dir), find("License", fixed=True), 1, 1))


@query(f"{WITH} SELECT path, line_number, replace(line, 'License', chr(27) || '[1;31mLicense' || chr(27) || '[0m') AS rendered FROM lines WHERE contains(line, 'License')")
def coloured_lines(spark, sf_dir):
    found = S.matches(_docs(spark, sf_dir), find("License", fixed=True), positions=True)
    return found.select("path", "line_number", render.coloured_line(F.col("line"), F.col("positions")).alias("rendered"))


# --- patterns

@query(f"{WITH} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, 'token = \"\\w') GROUP BY path")
def count_pcre(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find(r'(?<=token) = "(?=\w)', pcre=True))


@query(f"{WITH} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, '(?i)É|ß') GROUP BY path")
def count_folded(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("É|ß", ignore_case=True))


@query(f"{WITH} SELECT path, count(*) AS n FROM lines WHERE regexp_matches(line, 'License|token|secret') GROUP BY path")
def count_alternation(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("License|token|secret"))


@query(r"""SELECT * FROM (VALUES ('abc', true, 3), ('a\nb', false, 3), ('[^x]y', false, 2), ('\s+', false, 1), ('a*', true, 0), ('\d{3}-\d{4}', true, 8), ('^a.c$', true, 3), ('(?s).', false, 1), ('x|yz', true, 1)) t(pattern, line_bound, least_width)""")
def pattern_facts(spark, sf_dir):
    patterns = ["abc", r"a\nb", "[^x]y", r"\s+", "a*", r"\d{3}-\d{4}", "^a.c$", "(?s).", "x|yz"]
    return spark.createDataFrame([(p, dialect.line_bound(p), dialect.least_width(p)) for p in patterns], "pattern string, line_bound boolean, least_width int")


@query(r"""SELECT * FROM (VALUES ('MitLicense_Token', 0, 'mitlicense_token', 'case-insensitive'), ('MitLicense_Token', 1, 'license', 'fragment'), ('MitLicense_Token', 2, 'token', 'fragment'), ('readHTTPResponse', 0, 'readhttpresponse', 'case-insensitive'),
('readHTTPResponse', 1, 'read', 'fragment'), ('readHTTPResponse', 2, 'httpresponse', 'fragment')) t(pattern, place, variant, kind)""")
def suggest_variants(spark, sf_dir):
    rows = [(p, i, v, k) for p in ("MitLicense_Token", "readHTTPResponse", "plain") for i, (v, k) in enumerate(dialect.suggest_variants(p))]
    return spark.createDataFrame(rows, "pattern string, place int, variant string, kind string")


@query(rf"""{WITH}, q AS (SELECT * FROM (VALUES (0, 'secretkey', 'case-insensitive'), (1, 'secret', 'fragment'), (2, 'the_token', 'case-insensitive'), (3, 'token', 'fragment')) t(i, variant, kind)),
c AS (SELECT i, variant, kind, count(DISTINCT path) AS files, count(path) AS lines FROM q LEFT JOIN lines ON regexp_matches(line, '(?i)\b' || variant || '\b') GROUP BY ALL)
SELECT variant, kind, files, lines, (row_number() OVER (ORDER BY lines = 0, lines, i))::INTEGER AS place FROM c""")
def suggest_merged(spark, sf_dir):
    return shape.suggest(_docs(spark, sf_dir), ["SecretKey", "The_Token", "secret_Key"]).where("variant <> 'secret_key'").withColumn("place", F.row_number().over(Window.orderBy("place")))


SPELLINGS = ["a = maxRetry + 1", "MAX_RETRY", "set max-retry here", "(maxretry)", "xmaxRetry", "max retry", "maxRetryNow"]


@query("SELECT printf('%d.txt', c_custkey) AS path, 1::BIGINT AS n FROM customer WHERE c_custkey % 7 < 4")
def ident_search(spark, sf_dir):
    """An identifier in every spelling, but not as a part of another."""
    key = F.col("c_custkey")
    files = tables.read(spark, sf_dir, "customer").select(F.format_string("%d.txt", key).alias("path"), F.element_at(F.array(*map(F.lit, SPELLINGS)), (key % 7 + 1).cast("int")).alias("text"))
    return S.count_lines(files, find("maxRetry", ident=True))


@query(r"WITH files AS (SELECT printf('conv/%08d/%04d.txt', conv_id, turn) AS path, coalesce(text, '') AS text FROM conversations), " + CUT + r" SELECT path, line_number, byte_offset, line FROM lines WHERE regexp_matches(line, '\bthe\b|\bque\b')")
def conversation_lines(spark, sf_dir):
    return S.matches(tables.conversations(spark, sf_dir), find(r"\bthe\b|\bque\b")).select("path", "line_number", "byte_offset", "line")


_TEXT = "coalesce(text, '')"
_NUMBER = r"regexp_extract_all(coalesce(text, ''), '\d+')"


@query(rf"""WITH d AS (SELECT doc_id, {_TEXT} AS text, {_NUMBER} AS hits FROM documents), s AS (SELECT *, strlen(split_part(text, hits[1], 1)) AS b_at, length(split_part(text, hits[1], 1)) AS char_at FROM d WHERE len(hits) > 0)
SELECT doc_id, hits[1] AS first, b_at::INTEGER AS byte_start, (b_at + strlen(hits[1]))::INTEGER AS byte_end, char_at::INTEGER AS char_start, array_to_string(hits[1:3], '|') AS three, len(hits)::BIGINT AS n FROM s""")
def regex_finds(spark, sf_dir):
    text, number = F.coalesce("text", F.lit("")), r"\d+"
    span, chars = regex.find_index(text, number), F.try_element_at(regex.find_all_char_index(text, number, 1), F.lit(1))
    found = tables.read(spark, sf_dir, "documents").where(regex.matches(text, number))
    return found.select("doc_id", regex.find(text, number).alias("first"), span["start"].alias("byte_start"), span["end"].alias("byte_end"), chars["start"].alias("char_start"), F.array_join(regex.find_all(text, number, 3), "|").alias("three"), F.size(regex.find_all_index(text, number)).cast("long").alias("n"))


@query(rf"""SELECT doc_id, sha256(array_to_string(string_split(regexp_replace({_TEXT}, '\d+', chr(1), 'g'), chr(1)), '$1\')) AS replaced, array_to_string(regexp_extract_all({_TEXT}, '(\w+)@(\w+)', 2), '|') AS hosts FROM documents""")
def regex_replace(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.sha2(regex.replace_all(text, r"\d+", "$1\\"), 256).alias("replaced"), F.array_join(regex.find_all(text, r"(\w+)@(\w+)", group=2), "|").alias("hosts"))


@query(rf"""WITH s AS (SELECT doc_id, {_TEXT} AS text, string_split_regex({_TEXT}, '[.!?]+ ') AS parts FROM documents)
SELECT doc_id, len(parts)::BIGINT AS n, parts[1] AS first, CASE WHEN len(parts) < 2 THEN 1 ELSE 2 END::BIGINT AS two FROM s""")
def regex_split(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    parts, two = regex.split(text, "[.!?]+ "), regex.split(text, "[.!?]+ ", 2)
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("long").alias("n"), F.element_at(parts, 1).alias("first"), F.size(two).cast("long").alias("two"))


# --- sources

def _scratch(spark: SparkSession, name: str) -> str:
    return tables.shared(spark, f"{name}-{uuid.uuid4().hex}")


@query(f"{WITH} SELECT path, count(*) AS n, min(line_number)::BIGINT AS first_line, max(byte_offset) AS last_offset FROM lines WHERE contains(line, 'the') GROUP BY path")
def split_texts(spark, sf_dir):
    """Files dealt in parts of some KB, searched part by part and put together."""
    parts = sources.split_large(_docs(spark, sf_dir), 2000)
    found = S.matches(parts, find("the", fixed=True), carry=("path", "first_line", "first_offset"))
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("line_number") + F.col("first_line")).alias("first_line"), F.max(F.col("byte_offset") + F.col("first_offset")).alias("last_offset"))


def _tree() -> str:
    """A small tree of files in a new folder on the driver."""
    root = tempfile.mkdtemp(prefix="textloom-tree-")
    made = {
        "b/two.txt": "needle 2\n", "a.txt": "needle\n", "b/deep/z.md": "# needle\n", "c.log": "needle\n", ".gitignore": "*.log\n/skip/\n", "skip/x.txt": "needle\n", "b/.gitignore": "!kept.log\n", "b/kept.log": "needle\n",
        ".hidden/h.txt": "needle\n", "pic.png": "needle", "lib.so.1": "needle", "node_modules/m.js": "needle\n", "bin.dat": "needle\0", "empty.txt": "", "b-1.txt": "needle\nneedle\n",
    }
    for name, text in made.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    os.symlink(f"{root}/a.txt", f"{root}/link.txt")
    return root


_CASES = {"plain": {}, "hidden": {"hidden": True}, "no_ignore": {"no_ignore": True}, "follow": {"follow": True}, "binary": {"binary": True}, "globs": {"globs": ("*.txt", "!b")}}
_PLAIN = ["a.txt", "b/deep/z.md", "b/two.txt", "b-1.txt", "bin.dat", "empty.txt"]
_LISTED = {
    "plain": _PLAIN, "hidden": [".gitignore", ".hidden/h.txt", "a.txt", "b/.gitignore", *_PLAIN[1:]], "no_ignore": ["a.txt", "b/deep/z.md", "b/kept.log", "b/two.txt", "b-1.txt", "bin.dat", "c.log", "empty.txt", "skip/x.txt"],
    "follow": [*_PLAIN, "link.txt"], "binary": [*_PLAIN, "lib.so.1", "pic.png"], "globs": ["a.txt", "b-1.txt", "empty.txt"],
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i + 1}, '{p}')" for c, names in _LISTED.items() for i, p in enumerate(names)) + ") t(options, seq, path)")
def tree_walk(spark, sf_dir):
    root = _tree()
    rows = [(case, seq, path.removeprefix(f"{root}/")) for case, options in _CASES.items() for path, seq in sources.walk([root], sources.WalkOptions(**options))]
    return spark.createDataFrame(rows, "options string, seq int, path string")


@query("SELECT * FROM (VALUES ('a.txt', 1), ('b/deep/z.md', 1), ('b/two.txt', 1), ('b-1.txt', 2)) t(path, n)")
def tree_search(spark, sf_dir):
    root = _tree()
    counts = S.count_lines(sources.from_tree(spark, [root]).where("text is not null"), find("needle"))
    return counts.select(F.substring("path", len(root) + 2, 1000).alias("path"), F.col("n").cast("int").alias("n"))


@query("""SELECT * FROM (VALUES ('.hidden/h.txt', 1, 7, false, NULL, 'needle' || chr(10)), ('bin.dat', 2, 7, true, NULL, NULL), ('none.txt', NULL, NULL, NULL, 'no such file or directory', NULL), ('pic.png', 3, 6, false, NULL, 'needle'))
t(path, seq, size, is_binary, error, text)""")
def listed_files(spark, sf_dir):
    """A list of paths is taken as it stands: no rule of a walk applies to it.  An empty file has nothing to search."""
    root = _tree()
    listed = sources.path_list(f" {root}/.hidden/h.txt \n\n{root}/bin.dat\n{root}/none.txt\n{root}/pic.png\n{root}/empty.txt\n")
    numbered = [(p, i + 1 if i < 2 else i) for i, p in enumerate(listed)]
    found = sources.from_list(spark, numbered)
    return found.select(F.substring("path", len(root) + 2, 1000).alias("path"), F.col("seq").cast("int").alias("seq"), F.col("size").cast("int").alias("size"), "is_binary", "error", "text")


@query("SELECT '' AS path, 2 AS line_number, 6 AS byte_offset, 'two' AS line")
def buffer_search(spark, sf_dir):
    found = S.matches(sources.from_buffer(spark, b"a one\ntwo\n"), find("two"))
    return found.select("path", F.col("line_number").cast("int").alias("line_number"), F.col("byte_offset").cast("int").alias("byte_offset"), "line")


@query("SELECT * FROM (VALUES ('changed.txt'), ('new/file.txt')) t(path)")
def changed_since(spark, sf_dir):
    """Files that differ from a commit, and new ones that no rule ignores, but none that are gone."""
    root = tempfile.mkdtemp(prefix="textloom-git-")
    git = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@localhost", *a], check=True, capture_output=True)
    put = lambda name, text: (os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True), open(f"{root}/{name}", "w").write(text))  # noqa: E731, SIM115
    git("init", "-q")
    for name in ("same.txt", "changed.txt", "gone.txt"):
        put(name, "old\n")
    put(".gitignore", "*.log\n")
    git("add", "-A")
    git("commit", "-qm", "first")
    put("changed.txt", "needle\n")
    put("new/file.txt", "needle\n")
    put("new/file.log", "needle\n")
    os.unlink(f"{root}/gone.txt")
    here = os.getcwd()
    try:
        os.chdir(root)
        found = [(p,) for p in sources.changed_paths("HEAD")]
        names = sources.from_list(spark, [f"{root}/{p}" for p, in found])
    finally:
        os.chdir(here)
    return S.files_with_matches(names, find("needle")).select(F.substring("path", len(root) + 2, 1000).alias("path"))


# --- extraction

def _html(key, name):
    return F.concat(F.lit("<html><head><title>no</title></head><body><h1>"), name, F.lit("</h1><p>one<b>two</b>three<br>four &amp; five</p><script>no</script><div>key "), key, F.lit("</div><h2>End</h2></body></html>"))


@query("SELECT printf('h/%d.md', c_custkey) AS path, '# ' || c_name || chr(10) || chr(10) || 'one two three four & five' || chr(10) || chr(10) || 'key ' || c_custkey || chr(10) || chr(10) || '## End' || chr(10) AS text FROM customer")
def html_text(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    return extract.html_files(c.select(F.format_string("h/%d.html", "c_custkey").alias("path"), _html(F.col("c_custkey").cast("string"), F.col("c_name")).alias("text")))


def _book(key: int, name: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/c.opf"/></rootfiles></container>')
        z.writestr("o/c.opf", '<package><manifest><item id="b" href="2.xhtml"/><item id="a" href="1.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("o/1.xhtml", f"<body><h1>{name}</h1></body>")
        z.writestr("o/2.xhtml", f"<body><p>nation {key}</p></body>")
    return out.getvalue()


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books by nation: an EPUB each, a PDF beside every third, a broken EPUB for every fourth, and a note."""
    n = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    book = F.udf(lambda key, name: bytearray(b"zip?" if key % 4 == 0 else _book(key, name)), "binary")
    epub = n.select(F.format_string("l/%02d.epub", "key").alias("path"), book("key", "name").alias("content"))
    pdf = n.where("key % 3 = 0").select(F.format_string("l/%02d.PDF", "key").alias("path"), F.lit(b"%PDF").alias("content"))
    note = n.select(F.format_string("l/%02d.txt", "key").alias("path"), F.lit(b"x").alias("content"))
    return epub.unionAll(pdf).unionAll(note)


@query("""SELECT printf('l/%02d.epub', n_nationkey) AS path, CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 4 <> 0 THEN '# ' || n_name || chr(10) || chr(10) || 'nation ' || n_nationkey || chr(10) END AS text FROM nation
UNION ALL SELECT printf('l/%02d.PDF', n_nationkey), CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'duplicate' END, NULL FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT printf('l/%02d.txt', n_nationkey), 'ignored', NULL FROM nation""")
def library(spark, sf_dir):
    return extract.extract_library(_library(spark, sf_dir)).select("path", "status", "text")


@query("""WITH s AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE strlen('# ' || n_name || '  nation ' || n_nationkey || ' ') END AS bytes FROM nation
UNION ALL SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'failed' ELSE 'duplicate' END, 0 FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'ignored', 0 FROM nation) SELECT status, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM s GROUP BY status""")
def library_counts(spark, sf_dir):
    return extract.status_counts(extract.extract_library(_library(spark, sf_dir)))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ignored' WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 2 = 0 AND n > 3 AND c / n < 100 THEN 'ocr' WHEN c = 0 THEN 'empty' ELSE 'ok' END AS status
FROM (SELECT doc_id, length(coalesce(text, '')) AS c, 1 + doc_id % 9 AS n FROM documents)""")
def extraction_status(spark, sf_dir):
    key, chars = F.col("doc_id"), F.length(F.coalesce("text", F.lit("")))
    kind = F.when(key % 5 == 0, "txt").when(key % 2 == 0, "pdf").otherwise("epub")
    return tables.read(spark, sf_dir, "documents").select("doc_id", extract.status(kind, chars, 1 + key % 9, key % 7 == 0).alias("status"))


@query("""SELECT printf('%d.epub', c_custkey) AS path FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 0)""")
def extraction_to_do(spark, sf_dir):
    """Outputs of every third, some of them older by a second or empty."""
    c = tables.read(spark, sf_dir, "customer").select(F.format_string("%d.epub", "c_custkey").alias("path"), F.col("c_custkey").alias("k"), F.timestamp_seconds(F.col("c_custkey") + 0.25).alias("mtime"))
    done = c.where("k % 3 = 0").select("path", F.timestamp_seconds(F.col("k") + F.when(F.col("k") % 4 == 1, 1).otherwise(0)).alias("mtime"), F.when(F.col("k") % 2 == 0, 10).otherwise(0).alias("out_bytes"))
    return extract.to_do(c, done).select("path")


@query("SELECT doc_id, '---' || chr(10) || 'source: ' || doc_id || '.pdf' || chr(10) || 'source_mtime: 7' || chr(10) || 'extractor: x' || chr(10) || '---' || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents")
def front_matter(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", extract.front_matter(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), F.lit("7"), F.lit("x"), F.coalesce("text", F.lit(""))).alias("text"))


# --- index

def _drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they were before: some have other texts, some are new since, some are gone by now."""
    docs, key = _docs(spark, sf_dir), F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    old = docs.where(key % 11 != 0).withColumn("text", F.when(key % 7 == 0, F.concat(F.lit("before "), "text")).otherwise(F.col("text")))
    gone = docs.where(key % 13 == 0).withColumn("path", F.concat(F.lit("gone/"), "path"))
    return old.unionByName(gone).withColumn("mtime", F.timestamp_seconds(F.when(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long") % 17 == 0, 1).otherwise(2)))


def _stamped(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mtime", F.timestamp_seconds(F.lit(2)))


@query(f"{WITH} SELECT path, count(*) AS n FROM lines WHERE contains(line, 'License') GROUP BY path")
def index_after_drift(spark, sf_dir):
    """A search by an index that was built before some files changed finds what a cold search finds."""
    folder, spec = _scratch(spark, "index"), find("License", fixed=True)
    ix = I.Index(spark, folder)
    ix.build(_drifted(spark, sf_dir))
    now = _stamped(_docs(spark, sf_dir))
    return S.count_lines(ix.source(now, spec), spec)


@query(f"""WITH {FILES}, t AS (SELECT path, lower(unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: length(x) BETWEEN 3 AND 32))) AS token FROM files)
SELECT token, count(DISTINCT path) AS files, count(*)::BIGINT AS occs FROM t WHERE token IN ('license', 'token') GROUP BY token""")
def index_rebuilt(spark, sf_dir):
    """The vocabulary of an index that was built anew, from the digests of files that are as they were."""
    ix = I.Index(spark, _scratch(spark, "index"))
    ix.build(_drifted(spark, sf_dir))
    ix.build(_stamped(_docs(spark, sf_dir)))
    return ix.lookup("License").unionAll(ix.lookup("TOKEN"))


# --- streams

def _finished(stream: DataFrame, folder: str) -> DataFrame:
    """The rows of a stream of files that are all there already."""
    out = f"{folder}/out"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/offsets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _streamed(lines: DataFrame, folder: str) -> DataFrame:
    """A stream of lines.  They are written where they are made, a file for each part of the table: a path's lines are in one part already."""
    lines.select("path", F.col("line_number").cast("long").alias("line_number"), "byte_offset", "line").write.parquet(folder)
    return lines.sparkSession.readStream.schema("path string, line_number long, byte_offset long, line string").parquet(folder)


@query(f"""{WITH}, hit AS (SELECT *, contains(line, 'License') AS h FROM lines), near AS (SELECT *, bool_or(h) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM hit)
SELECT path, line_number::BIGINT AS line_number, line, NOT h AS is_context FROM near WHERE near""")
def stream_context(spark, sf_dir):
    folder = _scratch(spark, "stream")
    lines = _streamed(S.lines(_docs(spark, sf_dir)), f"{folder}/in")
    return _finished(tail.context_stream(lines, find("License", fixed=True), 1, 2), folder)


@query("SELECT * FROM (VALUES ('a.log', 2, 8, 'ERROR one'), ('a.log', 3, 18, 'ERROR two'), ('b.log', 1, 0, 'ERROR new'), ('c.log', 1, 0, 'ERROR again')) t(path, line_number, byte_offset, line)")
def tail_stream(spark, sf_dir):
    """Appended lines of a log, of one that is new, and of one that was cut off and begins again."""
    folder = _scratch(spark, "tail")
    logs = tempfile.mkdtemp(prefix="textloom-logs-")
    put = lambda name, text, mode="a": open(f"{logs}/{name}", mode).write(text)  # noqa: E731, SIM115
    put("a.log", "ERROR 0\n")
    put("c.log", "ERROR before, and a long line\n")
    stream = tail.search_stream(tail.tail(spark, [logs]), find("ERROR")).drop("fragments")
    out = f"{folder}/out"
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/offsets").trigger(processingTime="100 milliseconds").start()
    try:
        for step in ([("a.log", "ERROR one\nERR", "a")], [("a.log", "OR two\nfine\n", "a"), ("b.log", "ERROR new\n", "w"), ("c.log", "ERROR again\n", "w")]):
            # a first batch says where files ended; each step waits until it was read
            end = time.time() + 60
            while q.lastProgress is None and time.time() < end:
                time.sleep(0.1)
            for name, text, mode in step:
                put(name, text, mode)
            q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema(stream.schema).parquet(out).select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("line_number").cast("int").alias("line_number"), F.col("byte_offset").cast("int").alias("byte_offset"), "line")
