"""What a search asks for."""

from __future__ import annotations

from dataclasses import dataclass, replace

from textloom.functions import dialect


@dataclass(frozen=True)
class Stage:
    """One pattern of a pipeline.  ``only`` emits the matched texts alone."""

    pattern: str
    fixed: bool = False
    pcre: bool = False
    ignore_case: bool = False
    word: bool = False
    ident: bool = False
    only: bool = False

    def java(self) -> str:
        """The pattern for java.util.regex, with all options in it."""
        pattern, fixed, ignore = self.pattern, self.fixed, self.ignore_case
        if self.ident and (p := dialect.ident_pattern(pattern)):
            return dialect.re2java(p)
        if self.word:
            return dialect.re2java(dialect.word_pattern(pattern, fixed), ignore)
        return dialect.re2java(dialect.quote(pattern) if fixed else pattern, ignore, pcre=self.pcre and not fixed)

    def literal(self) -> str | None:
        """The text that it looks for, if it is nothing but a text."""
        plain = self.fixed or not self.pcre and dialect.is_literal(self.pattern)
        return self.pattern if plain and not (self.ignore_case or self.word or self.ident) else None


@dataclass(frozen=True)
class SearchSpec:
    """branches are alternatives; the stages of a branch narrow one another."""

    branches: tuple[tuple[Stage, ...], ...]
    invert: bool = False
    smart_case: bool = False
    with_file: tuple[str, ...] = ()
    without_file: tuple[str, ...] = ()
    multiline: bool = False
    structural: str | None = None
    capture: str | None = None
    histogram: bool = False
    count: bool = False
    files: bool = False
    before: int = 0
    after: int = 0
    watch: bool = False
    files_from: str | None = None
    changed_since: str | None = None
    max_columns: int | None = None
    lang: str | None = None

    def __post_init__(self):
        self.validate()

    def validate(self) -> None:
        """Raises ValueError for options that can't go together."""
        stages = [s for b in self.branches for s in b]
        if not stages and not self.structural:
            raise ValueError("no pattern")
        if any(s.fixed and s.pcre for s in stages):
            raise ValueError("fixed and pcre")
        if self.count and self.files:
            raise ValueError("count and files")
        if self.multiline and (self.invert or self.watch or any(s.pcre for s in stages) or any(len(b) > 1 for b in self.branches)):
            raise ValueError("multiline with invert, watch, pcre or a pipeline")
        if self.multiline and (self.before or self.after):
            raise ValueError("multiline with context")
        if self.structural and (stages or self.invert or self.multiline or self.watch or self.before or self.after):
            raise ValueError("structural with another kind of search")
        if self.capture and not (self.structural and self.histogram):
            raise ValueError("capture asks for structural and histogram")
        if self.files_from and self.changed_since:
            raise ValueError("files_from and changed_since")
        if self.before < 0 or self.after < 0:
            raise ValueError("negative context")

    def resolved(self) -> "SearchSpec":
        """With smart case decided: case matters if any pattern of the whole query has an upper-case letter."""
        if not self.smart_case:
            return self
        plain = not any(dialect.has_upper(s.pattern) for b in self.branches for s in b)
        return replace(self, smart_case=False, branches=tuple(tuple(replace(s, ignore_case=plain) for s in b) for b in self.branches))


def find(*patterns: str, **options) -> SearchSpec:
    """A search for any of some patterns; options of a Stage apply to each of them, others to the search."""
    own = {k: options.pop(k) for k in ("fixed", "pcre", "ignore_case", "word", "ident", "only") if k in options}
    return SearchSpec(branches=tuple((Stage(p, **own),) for p in patterns), **options)


def pipeline(*patterns: str, **options) -> SearchSpec:
    """A search in which each pattern looks inside what the one before it matched; the first one selects the line."""
    own = {k: options.pop(k) for k in ("fixed", "pcre", "ignore_case", "word", "ident") if k in options}
    return SearchSpec(branches=(tuple(Stage(p, **own) for p in patterns),), **options)
