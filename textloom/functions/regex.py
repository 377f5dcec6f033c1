"""A pattern's finds in a column of texts: whether, what, where (bytes or characters), replaced and split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import dialect
from textloom.functions import text as T


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(dialect.re2java(pattern))


def find(text: Column, pattern: str) -> Column:
    """The first match, or null."""
    return F.regexp_substr(text, F.lit(dialect.re2java(pattern)))


def find_index(text: Column, pattern: str) -> Column:
    """Byte span (start, end) of the first match, or null."""
    first = F.try_element_at(T.spans(text, dialect.re2java(pattern), empty=True), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["start"].alias("start"), first["end"].alias("end")))


def _first(found: Column, limit: int) -> Column:
    return found if limit < 0 else F.slice(found, F.lit(1), F.lit(limit))


def find_all(text: Column, pattern: str, limit: int = -1, group: int = 0) -> Column:
    """The first ``limit`` matches (all, if negative), or what one of their groups holds."""
    return _first(F.regexp_extract_all(text, F.lit(dialect.re2java(pattern)), F.lit(group)), limit)


def find_all_index(text: Column, pattern: str, limit: int = -1) -> Column:
    """Byte spans (start, end) of matches."""
    return _first(F.transform(T.spans(text, dialect.re2java(pattern), empty=True), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), limit)


def find_all_char_index(text: Column, pattern: str, limit: int = -1) -> Column:
    """Spans (start, end) of matches, counted in characters."""

    def placed(p: Column) -> Column:
        at = T.sums_before(F.transform(p, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("long")))
        return F.zip_with(at, p, lambda a, x: F.struct((a + F.length(x["gap"])).cast("int").alias("start"), (a + F.length(x["gap"]) + F.length(x["hit"])).cast("int").alias("end")))

    return _first(T.let(T.pieces(text, dialect.re2java(pattern)), placed), limit)


def replace_all(text: Column, pattern: str, replacement: str) -> Column:
    """Every match replaced by a text that is taken as it stands: no $1, no escapes."""
    return F.regexp_replace(text, F.lit(dialect.re2java(pattern)), F.lit(replacement.replace("\\", "\\\\").replace("$", "\\$")))


def split(text: Column, pattern: str, limit: int = -1) -> Column:
    """The texts between matches: all of them, ``limit`` at most with the rest in the last, or none for 0."""
    return F.array().cast("array<string>") if limit == 0 else F.split(text, dialect.re2java(pattern), limit)
