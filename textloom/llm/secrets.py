"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong patterns are reported wherever they are.  Weak ones (a bare access name, an opaque string, an endpoint) say
little alone: they are reported only when the parts that complete a credential stand within a scope around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable, text_or_empty

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs too short to count are left out of the patterns where that can't change a longer match.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: who, what opens, and where.  Opaque runs hold a digit and letters of either case, wherever in the run.
IDENT = r"""\b(?i:access_key_id|client_id|user_?name|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"(?:https?|ftps?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|jdbc:[a-z]+|s3|ssh)://[A-Za-z0-9_.@:-]{3,}"
#: kinds in the order in which spans with one start are listed
KINDS = ("assign", "access", "hex", "ident", "opaque", "endpoint")
#: Code points between a weak part and the part that completes it.
SCOPE = 400
#: What each kind is a part of: an access identifier (a), a secret (s) or an endpoint (e).
PART = {"assign": "s", "access": "a", "hex": "s", "ident": "a", "opaque": "s", "endpoint": "e"}
#: The parts that complete each weak kind; all of them have to be near.
NEEDS = {"ident": "s", "opaque": "a", "endpoint": "as"}
#: Numbers that are added up one after another; more are added up in blocks of that many.
BLOCK = 512
SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def _with(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column, levels: int = 1) -> Column:
    """The sum of the numbers before each place of an array, and of all of them at its end.

    Adding one to a growing array copies it, so long arrays are cut in blocks, whose sums are added up the same way: the
    work is in proportion to the array as long as it has no more than some ten thousand blocks (five million places).
    """

    def plain(a: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    if not levels:
        return plain(sizes, F.lit(0))
    cut = lambda a: F.transform(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(a, i, F.lit(BLOCK)))
    total = lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n)
    return _with(_with(sizes, cut), lambda b: F.flatten(F.zip_with(b, running(F.transform(b, total), levels - 1), plain)))


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, rank, end, kind) of a pattern's leftmost, non-overlapping matches, in code points.

    The matches and the texts between them alternate, so their lengths add up to positions.  Matches whose group is
    shorter than least are dropped afterwards: they have used up their text.
    """
    none = F.array().cast(f"array<{SPAN}>")
    lengths = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda m: F.length(m))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pair = lambda gap, size: F.struct(gap.alias("gap"), size.alias("size"))
    # the last gap has no match behind it: its size is null, and it goes
    pairs = F.filter(F.zip_with(gaps, lengths(0), pair), lambda p: p["size"].isNotNull())
    if least:
        pairs = F.zip_with(pairs, lengths(group), lambda p, n: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), n.alias("part")))
    rank = F.lit(KINDS.index(kind))

    def placed(all_pairs: Column) -> Column:
        starts = running(F.transform(all_pairs, lambda p: p["gap"] + p["size"]))
        each = F.zip_with(starts, all_pairs, lambda at, p: F.struct((at + p["gap"]).alias("start"), rank.alias("rank"), (at + p["gap"] + p["size"]).alias("end"), F.lit(kind).alias("kind"), *([p["part"].alias("part")] if least else [])))
        kept = F.filter(each, lambda s: s["part"] >= least) if least else each
        return kept if not least else F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    return F.when(text.rlike(pattern), _with(pairs, placed)).otherwise(none)


def _name(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["start"].cast("string"), span["end"].cast("string"))


def _listed(array: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(array), _name), ",")


def linked(parts: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """Weak spans that complementary parts stand near: key, and an array of them with their partners.

    An interval join without pairs: every part is a point at its end and one at its start, in the order of the text, and
    a weak span looks back from its own start over the ends, and on from its own end over the starts, as far as the
    scope goes.  A window so wide holds a bounded number of parts, however many a text has.  What comes back of it is how
    many parts of each sort there are, and the nearest.

    ident: needs a secret.  opaque: needs an access identifier.  endpoint: needs both an identifier and a secret.
    Parts that only overlap the span itself don't complete it, and a weak span that overlaps a base one is that one's.
    """
    p = parts.withColumn("part", F.element_at(F.create_map(*[F.lit(x) for kv in PART.items() for x in kv]), F.col("kind")))
    weak = F.col("kind").isin(*NEEDS)
    span = F.struct("start", "rank", "end", "kind").alias("span")
    row = lambda at, asks: F.struct(F.col(at).alias("at"), F.lit(asks).alias("asks"))
    # as a candidate at one end, and a weak one as a question at the other
    back = p.select(*key, span, "part", F.explode(F.when(weak, F.array(row("end", False), row("start", True))).otherwise(F.array(row("end", False)))).alias("p")).select(*key, "span", "part", "p.*")
    on = p.select(*key, span, "part", F.explode(F.when(weak, F.array(row("start", False), row("end", True))).otherwise(F.array(row("start", False)))).alias("p")).select(*key, "span", "part", "p.*")
    found = []
    for points, frame, sign in ((back, (-scope, 0), -1), (on, (0, scope), 1)):
        around = Window.partitionBy(*key).orderBy("at").rangeBetween(*frame)
        sums = []
        for k in "as":
            mine = ~F.col("asks") & (F.col("part") == k)
            sums += [
                F.count(F.when(mine, F.lit(1))).over(around).alias(f"n_{k}"),
                F.min(F.when(mine, F.struct((F.col("at") * sign).alias("far"), "span"))).over(around).alias(f"near_{k}"),
            ]
        asked = points.select(*key, "span", "at", "asks", *sums).where("asks")
        gap = lambda k: F.when(F.col(f"n_{k}") > 0, F.struct((F.col(f"near_{k}")["far"] - F.col("at") * sign).alias("gap"), F.lit(sign).alias("side"), F.col(f"near_{k}")["span"].alias("of")))  # noqa: E731, B023
        found.append(asked.select(*key, "span", "n_a", "n_s", gap("a").alias("near_a"), gap("s").alias("near_s")))
    both = found[0].unionAll(found[1]).groupBy(*key, "span").agg(F.sum("n_a").alias("n_a"), F.sum("n_s").alias("n_s"), F.min("near_a").alias("near_a"), F.min("near_s").alias("near_s"))
    # base spans that begin at a weak one's start or before, and those that begin inside it
    base = ~weak
    upto = Window.partitionBy(*key).orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*key).orderBy(-F.col("start")).rangeBetween(Window.unboundedPreceding, -1)
    inside = p.select(*key, span, F.max(F.when(base, F.col("end"))).over(upto).alias("reach"), F.min(F.when(base, F.col("start"))).over(after).alias("next")).where(F.col("span.kind").isin(*NEEDS))
    free = inside.where(~(F.coalesce(F.col("reach"), F.lit(0)) > F.col("span.start")) & ~F.coalesce(F.col("next") < F.col("span.end"), F.lit(False))).select(*key, "span")
    need = {k: F.col("span.kind").isin(*[w for w, n in NEEDS.items() if k in n]) for k in "as"}
    kept = both.where(((F.col("n_a") > 0) | ~need["a"]) & ((F.col("n_s") > 0) | ~need["s"])).join(free, [*key, "span"], "left_semi")
    partner = [F.when(need[k], F.col(f"near_{k}")["of"]) for k in "as"]
    links = F.when(need["a"], F.col("n_a")).otherwise(F.lit(0)) + F.when(need["s"], F.col("n_s")).otherwise(F.lit(0))
    one = F.struct("span.*", F.filter(F.array(*partner), lambda x: x.isNotNull()).alias("partners"), links.alias("links"))
    return kept.groupBy(*key).agg(F.collect_list(one).alias("weak"))


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak, n_links, partners.

    Spans are code points, end exclusive.  ``spans`` lists base and weak ones; ``n_links`` is how many complementary
    parts stand within the scope of the weak ones, and ``partners`` lists each weak span with the nearest part of each
    sort that completes it (of two at one distance the one before it), as ``kind:start:end<kind:start:end``.

    Null text counts as empty: no spans, and base_sha256 is that of the empty string.  Null doc_ids and repeated rows
    give a row each.  Empty table: no rows.  Extra columns are not read.  Texts are read once, in time that is in
    proportion to their length; only rows that hold a weak part beside another part are exploded, to a row per part.
    """
    text = text_or_empty()
    # keyed by content too: rows that repeat a doc_id may hold different texts
    rows = docs.select("doc_id", text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.select(
        "doc_id",
        "text_hash",
        F.concat(spans(F.col("text"), ASSIGN, "assign", 2, 12), spans(F.col("text"), ACCESS, "access"), spans(F.col("text"), HEX, "hex")).alias("base"),
        F.concat(spans(F.col("text"), IDENT, "ident"), spans(F.col("text"), OPAQUE, "opaque"), spans(F.col("text"), ENDPOINT, "endpoint")).alias("maybe"),
    )
    rows = reliable(rows)
    parts = rows.where((F.size("maybe") > 0) & (F.size("base") + F.size("maybe") > 1)).select("doc_id", "text_hash", F.concat("base", "maybe").alias("all")).distinct()
    parts = parts.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    weak = linked(parts.select("no_id", "id", "text_hash", F.inline("all")), ["no_id", "id", "text_hash"], scope)
    left = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = left.join(weak, ["no_id", "id", "text_hash"], "left")
    none = F.array().cast(f"array<struct<start:int,rank:int,end:int,kind:string,partners:array<{SPAN}>,links:bigint>>")
    bare = F.transform("weak", lambda w: F.struct(w["start"].alias("start"), w["rank"].alias("rank"), w["end"].alias("end"), w["kind"].alias("kind")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    pairs = F.flatten(F.transform(F.array_sort("weak"), lambda w: F.transform(w["partners"], lambda o: F.concat(_name(w), F.lit("<"), _name(o)))))
    return out.withColumn("weak", F.coalesce("weak", none)).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(F.col("base"), bare)).alias("spans"),
        F.size("weak").cast("long").alias("n_weak"),
        F.aggregate("weak", F.lit(0).cast("long"), lambda acc, w: acc + w["links"]).alias("n_links"),
        F.array_join(pairs, ",").alias("partners"),
    )
