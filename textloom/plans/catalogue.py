"""Registered queries of the search engine and their SQL for DuckDB."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import dialect
from textloom.functions import text as T
from textloom.operators import index as I
from textloom.operators import search as S
from textloom.operators import shape, structure
from textloom.plans.spec import SearchSpec, Stage, find, pipeline
from textloom.sources import extract, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

FILES = "files AS (SELECT printf('%s/%s/%08d.txt', source, lang, doc_id) AS path, coalesce(text, '') AS text FROM documents)"
CUT = """cut AS (SELECT path, text, CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS ls FROM files),
numbered AS (SELECT path, unnest(ls) AS line, unnest(range(1, len(ls) + 1))::INTEGER AS line_number FROM cut),
lines AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM numbered)"""
WITH = f"WITH {FILES}, {CUT}"


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL if it has an equivalent."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir)


def _count_sql(condition: str) -> str:
    return f"{WITH} SELECT path, count(*) AS n FROM lines WHERE {condition} GROUP BY path"


@query(_count_sql("contains(line, 'token')"))
def count_fixed(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("token", fixed=True))


@query(_count_sql(r"regexp_matches(line, '\d{3}-\d{4}')"))
def count_regex(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find(r"\d{3}-\d{4}"))


@query(_count_sql("regexp_matches(line, '(?i)license')"))
def count_ignore_case(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("license", ignore_case=True))


@query(_count_sql(r"regexp_matches(line, '\bo[a-z]*\b')"))
def count_word(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("o[a-z]*", word=True))


@query(_count_sql("NOT contains(line, 'the')"))
def count_invert(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("the", fixed=True, invert=True))


@query(f"{WITH} SELECT DISTINCT path FROM lines WHERE regexp_matches(line, '[a-z0-9.]+@[a-z0-9.]+')")
def files_with_matches(spark, sf_dir):
    return S.files_with_matches(_docs(spark, sf_dir), find("[a-z0-9.]+@[a-z0-9.]+"))


@query(f"{WITH} SELECT DISTINCT path FROM lines WHERE NOT contains(line, 'e')")
def files_without_nonmatching(spark, sf_dir):
    return S.files_with_matches(_docs(spark, sf_dir), find("e", fixed=True, invert=True))


@query(f"{WITH} SELECT path, line_number, byte_offset, byte_offset + strlen(line) AS end_offset, line, path || '@' || byte_offset || '-' || (byte_offset + strlen(line)) AS region FROM lines WHERE contains(line, 'License')")
def match_lines(spark, sf_dir):
    m = S.matches(_docs(spark, sf_dir), find("License", fixed=True))
    end = F.col("byte_offset") + F.octet_length("line")
    return m.select("path", "line_number", "byte_offset", end.alias("end_offset"), "line", F.format_string("%s@%d-%d", "path", "byte_offset", end).alias("region"))


@query(rf"{WITH}, hits AS (SELECT path, line_number, line, unnest(regexp_extract_all(line, '(?:\d+\.){{3}}\d+')) AS text FROM lines) SELECT path, line_number, text, count(*) AS n FROM hits GROUP BY ALL")
def only_matching(spark, sf_dir):
    m = S.matches(_docs(spark, sf_dir), find(r"(?:\d+\.){3}\d+", only=True))
    return m.select("path", "line_number", F.explode("fragments").alias("text")).groupBy("path", "line_number", "text").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""{WITH}, hits AS (SELECT path, line_number, line, regexp_extract(line, '(?:\d+\.){{3}}\d+') AS hit FROM lines WHERE regexp_matches(line, '(?:\d+\.){{3}}\d+'))
SELECT path, line_number, strlen(string_split(line, hit)[1])::INTEGER AS match_start, (strlen(string_split(line, hit)[1]) + strlen(hit))::INTEGER AS match_end, hit AS text FROM hits""")
def match_positions(spark, sf_dir):
    m = S.matches(_docs(spark, sf_dir), find(r"(?:\d+\.){3}\d+"), positions=True)
    first = F.element_at("positions", 1)
    return m.select("path", "line_number", first["start"].alias("match_start"), first["end"].alias("match_end"), first["text"].alias("text"))


@query(_count_sql("contains(line, 'License') OR contains(line, 'token') OR contains(line, 'secret')"))
def multi_literal_or(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("License", "token", "secret", fixed=True))


@query(rf"""{WITH}, hits AS (SELECT path, line_number, CASE
  WHEN regexp_matches(line, '555') AND len(regexp_extract_all(line, '555-\d+')) > 0 THEN regexp_extract_all(line, '555-\d+')
  WHEN regexp_matches(line, '@[a-z]+') THEN regexp_extract_all(line, '@[a-z]+') END AS found FROM lines)
SELECT path, line_number, array_to_string(found, '|') AS found FROM hits WHERE found IS NOT NULL""")
def or_of_pipelines(spark, sf_dir):
    spec = SearchSpec(branches=((Stage("555"), Stage(r"555-\d+")), (Stage("@[a-z]+"),)))
    m = S.matches(_docs(spark, sf_dir), spec)
    return m.select("path", "line_number", F.array_join("fragments", "|").alias("found"))


@query(_count_sql("NOT (contains(line, 'the') OR regexp_matches(line, '[äöüß]'))"))
def invert_of_or(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("the", "[äöüß]", invert=True))


@query(rf"{WITH} SELECT path, line_number, array_to_string(regexp_extract_all(line, '\d+-\d+'), '|') AS found FROM lines WHERE contains(line, '555') AND len(regexp_extract_all(line, '\d+-\d+')) > 0")
def pipeline_two_stage(spark, sf_dir):
    m = S.matches(_docs(spark, sf_dir), SearchSpec(branches=((Stage("555", fixed=True), Stage(r"\d+-\d+")),)))
    return m.select("path", "line_number", F.array_join("fragments", "|").alias("found"))


@query(rf"""{WITH}, f AS (SELECT path, line_number, flatten(list_transform(regexp_extract_all(line, '\d+-\d+'), lambda x: regexp_extract_all(x, '\d+'))) AS found FROM lines WHERE contains(line, '555'))
SELECT path, line_number, array_to_string(found, '|') AS found FROM f WHERE len(found) > 0""")
def pipeline_three_stage_only(spark, sf_dir):
    m = S.matches(_docs(spark, sf_dir), pipeline("555", r"\d+-\d+", r"\d+"))
    return m.select("path", "line_number", F.array_join("fragments", "|").alias("found"))


@query(_count_sql("regexp_matches(line, '(?i)keit')"))
def smart_case(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("keit", smart_case=True))


@query(_count_sql("contains(line, 'Keit')"))
def smart_case_upper(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("Keit", smart_case=True))


@query(f"{WITH}, w AS (SELECT DISTINCT path FROM lines WHERE contains(line, 'License')) SELECT path, count(*) AS n FROM lines SEMI JOIN w USING (path) WHERE contains(line, 'the') GROUP BY path")
def with_file(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("the", with_file=("License",)))


@query(f"{WITH}, w AS (SELECT DISTINCT path FROM lines WHERE contains(line, 'the')) SELECT path, count(*) AS n FROM lines ANTI JOIN w USING (path) WHERE contains(line, 'ion') GROUP BY path")
def without_file(spark, sf_dir):
    return S.count_lines(_docs(spark, sf_dir), find("ion", without_file=("the",)))


@query(f"{WITH}, w AS (SELECT DISTINCT path FROM lines WHERE contains(line, 'License')) SELECT count(DISTINCT path) AS excluded FROM lines ANTI JOIN w USING (path) WHERE contains(line, 'the')")
def excluded_files(spark, sf_dir):
    return S.excluded_files(_docs(spark, sf_dir), find("the", with_file=("License",)))


@query(f"""{WITH}, hit AS (SELECT *, contains(line, 'License') AS h FROM lines),
near AS (SELECT *, bool_or(h) OVER (PARTITION BY path ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM hit),
shown AS (SELECT *, coalesce(line_number - lag(line_number) OVER (PARTITION BY path ORDER BY line_number) > 1, false)::INTEGER AS opens FROM near WHERE near)
SELECT path, line_number, line, NOT h AS is_context, sum(opens) OVER (PARTITION BY path ORDER BY line_number)::BIGINT AS group_id FROM shown""")
def context_lines(spark, sf_dir):
    return shape.context(_docs(spark, sf_dir), find("License", fixed=True), before=1, after=2)


@query(f"""{WITH} SELECT path, line_number, line FROM lines WHERE contains(line, 'the')
QUALIFY row_number() OVER (PARTITION BY substr(hex(encode(trim(line, ' '))), 1, 512) ORDER BY path, line_number) <= 3""")
def collapse(spark, sf_dir):
    return shape.collapse(S.matches(_docs(spark, sf_dir), find("the", fixed=True))).select("path", "line_number", "line")


@query(f"""{WITH}, k AS (SELECT count(*) AS n FROM lines WHERE contains(line, 'the') GROUP BY substr(hex(encode(trim(line, ' '))), 1, 512))
SELECT coalesce(sum(n - 3), 0)::BIGINT AS lines, count(*) AS texts FROM k WHERE n > 3""")
def collapse_totals(spark, sf_dir):
    return shape.collapse_totals(S.matches(_docs(spark, sf_dir), find("the", fixed=True)))


_BUDGET = f"""{WITH}, r AS (SELECT path, line_number, path || ':' || line_number || ':' || line AS record FROM lines WHERE contains(line, 'License')),
s AS (SELECT *, coalesce(sum(strlen(record) + 1) OVER (ORDER BY path, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM r)"""


@query(f"{_BUDGET} SELECT path, line_number, record FROM s WHERE spent < 4000")
def budget(spark, sf_dir):
    return shape.budget(S.matches(_docs(spark, sf_dir), find("License", fixed=True)), 1000)


@query(f"""{_BUDGET}, f AS (SELECT path, count(*) AS n, count(*) FILTER (spent < 4000) AS shown FROM s GROUP BY path)
SELECT count(*) AS files, coalesce(sum(n), 0)::BIGINT AS lines, count(*) FILTER (shown > 0) AS shown_files, coalesce(sum(shown), 0)::BIGINT AS shown_lines,
count(*) FILTER (shown = 0) AS omitted_files, coalesce(sum(n - shown), 0)::BIGINT AS omitted_lines FROM f""")
def budget_totals(spark, sf_dir):
    return shape.budget_totals(S.matches(_docs(spark, sf_dir), find("License", fixed=True)), 1000)


_OUTLINE = f"""{WITH}, h AS (SELECT path, line, line_number, len(regexp_extract_all(line, '\\bthe\\b')) AS occ FROM lines WHERE regexp_matches(line, '\\bthe\\b')),
o AS (SELECT path, count(*) AS n, arg_max(line_number, {{'occ': greatest(occ, 1), 'more': (strlen(trim(line, ' ')) > 3 * occ)::INTEGER, 'at': -line_number}}) AS exemplar_line FROM h GROUP BY path),
outline AS (SELECT o.*, strlen(files.text)::BIGINT AS size FROM o JOIN files USING (path)),
scored AS (SELECT *, n / greatest(size / 1024.0::DOUBLE, 1.0::DOUBLE) AS score FROM outline)"""
_THE = find(r"\bthe\b")


@query(f"{_OUTLINE} SELECT path, n, size, exemplar_line FROM outline")
def outline_count(spark, sf_dir):
    return shape.outline(_docs(spark, sf_dir), _THE).select("path", "n", "size", "exemplar_line")


@query(f"{_OUTLINE} SELECT path, n, round(score, 2) AS score, (row_number() OVER (ORDER BY score DESC, n DESC, path))::INTEGER AS rank FROM scored QUALIFY rank <= 20")
def outline_density(spark, sf_dir):
    return shape.ranked(shape.outline(_docs(spark, sf_dir), _THE), "density", 20).select("path", "n", F.round("score", 2).alias("score"), "rank")


@query(f"{_OUTLINE} SELECT path, n, exemplar_line, (row_number() OVER (ORDER BY n DESC, path))::INTEGER AS rank FROM outline QUALIFY rank <= 10")
def outline_top_k(spark, sf_dir):
    return shape.ranked(shape.outline(_docs(spark, sf_dir), _THE), "count", 10).select("path", "n", "exemplar_line", "rank")


_HIST = rf"{WITH}, t AS (SELECT path, unnest(regexp_extract_all(line, '\b[A-Z][a-z]+\b')) AS text FROM lines), g AS (SELECT text, count(*) AS n, count(DISTINCT path) AS files FROM t GROUP BY text)"
_NAMES = find(r"\b[A-Z][a-z]+\b")


@query(f"{_HIST} SELECT text, n, files FROM g")
def histogram(spark, sf_dir):
    return shape.file_histogram(S.file_fragments(_docs(spark, sf_dir), _NAMES))


@query(f"{_HIST} SELECT text, n, files, (row_number() OVER (ORDER BY n DESC, text))::INTEGER AS rank FROM g QUALIFY rank <= 25")
def histogram_top_k(spark, sf_dir):
    return shape.histogram_top(shape.file_histogram(S.file_fragments(_docs(spark, sf_dir), _NAMES)), 25)


@query(f"{_HIST} SELECT count(*) AS distinct_texts, coalesce(sum(n), 0)::BIGINT AS total, least(count(*), 25)::BIGINT AS shown FROM g")
def histogram_totals(spark, sf_dir):
    return shape.histogram_totals(shape.file_histogram(S.file_fragments(_docs(spark, sf_dir), _NAMES)), 25)


_BATCH = [("license", find("license")), (r"\d{3}-\d{4}", find(r"\d{3}-\d{4}")), ("zzqxjvzz", find("zzqxjvzz")), ("secret", find("secret", ignore_case=True))]
_BATCH_SQL = rf"""{WITH}, q AS (SELECT * FROM (VALUES (0, 'license', 'license'), (1, '\d{{3}}-\d{{4}}', '\d{{3}}-\d{{4}}'), (2, 'zzqxjvzz', 'zzqxjvzz'), (3, 'secret', '(?i)secret')) t(query_index, query, rx)),
b AS (SELECT path, query_index, query, count(*) AS n FROM lines, q WHERE regexp_matches(line, rx) GROUP BY ALL)"""


@query(f"{_BATCH_SQL} SELECT path, query_index, query, n FROM b")
def batch_matches(spark, sf_dir):
    return S.batch_matches(_docs(spark, sf_dir), _BATCH)


@query(f"{_BATCH_SQL} SELECT q.query_index, q.query, count(path) AS files, coalesce(sum(n), 0)::BIGINT AS lines FROM q LEFT JOIN b ON q.query_index = b.query_index GROUP BY ALL")
def batch_totals(spark, sf_dir):
    return shape.batch_totals(_docs(spark, sf_dir), _BATCH)


@query(rf"""{WITH}, q AS (SELECT * FROM (VALUES (0, 'mitlicense_token', 'case-insensitive'), (1, 'license', 'fragment'), (2, 'token', 'fragment')) t(i, variant, kind)),
c AS (SELECT i, variant, kind, count(DISTINCT path) AS files, count(path) AS lines FROM q LEFT JOIN lines ON regexp_matches(line, '(?i)\b' || variant || '\b') GROUP BY ALL)
SELECT variant, kind, files, lines, (row_number() OVER (ORDER BY lines = 0, lines, i))::INTEGER AS place FROM c""")
def suggest(spark, sf_dir):
    return shape.suggest(_docs(spark, sf_dir), ["MitLicense_Token"])


@query(f"{WITH} SELECT count(DISTINCT path) AS files, count(*) AS lines, 0::BIGINT AS errors FROM lines WHERE contains(line, 'the')")
def summary(spark, sf_dir):
    return shape.summary(S.count_lines(_docs(spark, sf_dir), find("the", fixed=True)))


_TRI = f"WITH {FILES}, low AS (SELECT path, lower(text) AS text FROM files), tri AS (SELECT DISTINCT path, substr(text, i::BIGINT, 3) AS trigram FROM (SELECT path, text, unnest(range(1, length(text) - 1)) AS i FROM low WHERE length(text) >= 3))"


@query(f"{_TRI} SELECT trigram, count(*) AS files FROM tri GROUP BY trigram")
def index_postings(spark, sf_dir):
    return I.postings(_docs(spark, sf_dir)).groupBy("trigram").agg(F.count(F.lit(1)).alias("files"))


@query(f"{_TRI} SELECT path FROM tri WHERE trigram IN ('lic', 'ice', 'cen', 'ens', 'nse') GROUP BY path HAVING count(*) = 5")
def index_candidates(spark, sf_dir):
    return I.candidates(I.postings(_docs(spark, sf_dir)), find("License", fixed=True))


@query(_count_sql("contains(line, 'License')"))
def index_search_equals_cold(spark, sf_dir):
    """A search by an index that is kept in the shared folder, and is built only where the table has changed since."""
    files, spec = _docs(spark, sf_dir), find("License", fixed=True)
    stamp = tables.stamp(spark, sf_dir, "documents")
    ix = I.Index(spark, tables.shared(spark, f"index-{hashlib.md5(sf_dir.encode()).hexdigest()}"))
    meta = ix.meta()
    if meta is None or meta["options"] != I.option_key(stamp):
        meta = ix.build(files, stamp)
    return S.count_lines(ix.pruned(files, spec, meta), spec)


@query(f"""WITH {FILES}, t AS (SELECT path, lower(unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda x: length(x) BETWEEN 3 AND 32))) AS token FROM files),
g AS (SELECT token, count(DISTINCT path) AS files, count(*) AS occs FROM t GROUP BY token)
SELECT token, files, occs, (row_number() OVER (ORDER BY files DESC, occs DESC, token))::INTEGER AS rank FROM g QUALIFY rank <= 50""")
def vocab_top(spark, sf_dir):
    from pyspark.sql import Window

    order = [F.desc("files"), F.desc("occs"), F.asc("token")]
    return I.vocabulary(_docs(spark, sf_dir)).orderBy(*order).limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query("""WITH m AS (SELECT printf('%s/%s/%08d.txt', source, lang, doc_id) AS path, strlen(coalesce(text, '')) AS size, doc_id FROM documents),
o AS (SELECT path, size + (doc_id % 7 = 0)::INTEGER AS size FROM m WHERE doc_id % 11 <> 0 UNION ALL SELECT 'gone/' || path, size FROM m WHERE doc_id % 13 = 0)
SELECT coalesce(m.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM m FULL JOIN o ON m.path = o.path WHERE o.path IS NULL OR m.path IS NULL OR m.size <> o.size""")
def manifest_sweep(spark, sf_dir):
    now = I.manifest(_docs(spark, sf_dir))
    number = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long")
    kept = now.where(number % 11 != 0).withColumn("size", F.col("size") + (number % 7 == 0).cast("long"))
    gone = now.where(number % 13 == 0).withColumn("path", F.concat(F.lit("gone/"), "path"))
    return I.sweep(kept.unionByName(gone), now)


@query(f"{WITH}, r AS (SELECT path, line_number, byte_offset, line FROM lines WHERE contains(line, 'License')) SELECT path || '@' || byte_offset || '-' || (byte_offset + strlen(line)) AS region, byte_offset AS start, byte_offset + strlen(line) AS end, line AS text, NULL::VARCHAR AS error FROM r")
def region_fetch(spark, sf_dir):
    return structure.fetch_regions(_docs(spark, sf_dir), match_lines(spark, sf_dir).select("region"))


@query(f"""{WITH}, n AS (SELECT path, max(line_number) AS n FROM lines GROUP BY path HAVING max(line_number) >= 3)
SELECT path || '@:2-3' AS region, a.byte_offset AS start, b.byte_offset + strlen(b.line) AS end, a.line || chr(10) || b.line AS text, NULL::VARCHAR AS error
FROM n JOIN lines a USING (path) JOIN lines b USING (path) WHERE a.line_number = 2 AND b.line_number = 3""")
def line_region(spark, sf_dir):
    files = _docs(spark, sf_dir)
    long = files.where(F.size(T.line_array(F.col("text"))) >= 3)
    return structure.fetch_regions(files, long.select(F.concat("path", F.lit("@:2-3")).alias("region")))


@query(rf"WITH {FILES} SELECT path, len(regexp_extract_all(text, '(?m)\.$\n^[A-Z]')) AS n FROM files WHERE n > 0")
def multiline_count(spark, sf_dir):
    return structure.multiline_count(_docs(spark, sf_dir), find(r"\.$\n^[A-Z]", multiline=True))


@query(r"""SELECT doc_id, regexp_replace(coalesce(text, ''), '\d+', '#', 'g') AS text FROM documents""")
def replace_all(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(dialect.re2java(r"\d+")), F.lit("#")).alias("text"))


@query(r"""SELECT doc_id, len(regexp_split_to_array(coalesce(text, ''), '[.!?]+\s')) AS parts FROM documents""")
def split_regex(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), dialect.re2java(r"[.!?]+\s"), -1)).cast("long").alias("parts"))


@query(r"""SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\b[A-Z][a-z]+')[1] AS first_name, len(regexp_extract_all(coalesce(text, ''), '\b[A-Z][a-z]+')) AS names FROM documents""")
def find_all(spark, sf_dir):
    hits = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(dialect.re2java(r"\b[A-Z][a-z]+")), F.lit(0))
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.try_element_at(hits, F.lit(1)).alias("first_name"), F.size(hits).cast("long").alias("names"))


@query(f"SELECT path, strlen(text)::BIGINT AS size, string_split(path, '/')[2] AS lang FROM (WITH {FILES} SELECT * FROM files) WHERE regexp_matches(path, '^src1[0-9]?/(en|de)/[^/]*[05]\\.txt$')")
def glob_files(spark, sf_dir):
    files = _docs(spark, sf_dir).where(T.glob_filter(F.col("path"), ["src1*/{en,de}/*[05].txt", "!src2*"]))
    return files.where(F.col("path").rlike("^src1[0-9]?/")).select("path", F.octet_length("text").cast("long").alias("size"), F.element_at(F.split("path", "/"), 2).alias("lang"))
