"""Linear-time regular expression dialect (RE2's) to java.util.regex, and the rewrites of search options."""

from __future__ import annotations

import re
import unicodedata

EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
NO_EDGE = r"(?:(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<![0-9A-Za-z_])(?![0-9A-Za-z_]))"
SPACES = r"\t\n\f\r\x20"
POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "ascii": r"\p{ASCII}", "blank": r"\x20\t", "cntrl": r"\p{Cntrl}", "digit": "0-9", "graph": r"\p{Graph}",
    "lower": r"\p{Lower}", "print": r"\p{Print}", "punct": r"\p{Punct}", "space": r"\t\n\x0B\f\r\x20", "upper": r"\p{Upper}", "word": r"\w", "xdigit": "0-9A-Fa-f",
}
META = re.compile(r"[\\.+*?()|\[\]{}^$]")


class DialectError(ValueError):
    """A construct that the dialect lacks (look-around, back-references, possessive or ungreedy matching)."""


def is_literal(pattern: str) -> bool:
    return not META.search(pattern)


def quote(literal: str) -> str:
    """A literal for java.util.regex."""
    return META.sub(lambda m: "\\" + m[0], literal)


def _property(p: str, at: int) -> tuple[str, int]:
    """\\pX or \\p{Name} at a backslash: the Java form and where it ends."""
    kind = p[at + 1]
    if at + 2 < len(p) and p[at + 2] == "{":
        end = p.index("}", at)
        name = p[at + 3 : end]
        if name.startswith("^"):
            kind, name = "Pp"[kind == "P"], name[1:]
        name = name if len(name) <= 2 else "Is" + name
        return f"\\{kind}{{{name}}}", end + 1
    return f"\\{kind}{{{p[at + 2]}}}", at + 3


def _class(p: str, at: int) -> tuple[str, int]:
    """A bracket expression at its opening bracket."""
    out, i = ["["], at + 1
    if i < len(p) and p[i] == "^":
        out.append("^")
        i += 1
    first = True
    while i < len(p):
        c = p[i]
        if c == "]" and not first:
            return "".join([*out, "]"]), i + 1
        if c == "[" and p.startswith("[:", i) and (end := p.find(":]", i)) > 0:
            name = p[i + 2 : end]
            inverted, name = name.startswith("^"), name.removeprefix("^")
            if name not in POSIX:
                raise DialectError(f"unknown class [:{name}:]")
            out.append(f"[^{POSIX[name]}]" if inverted else POSIX[name])
            i = end + 2
        elif c == "\\" and i + 1 < len(p):
            d = p[i + 1]
            if d in "pP":
                part, i = _property(p, i)
                out.append(part)
                first = False
                continue
            out.append({"s": SPACES, "S": f"[^{SPACES}]", "v": r"\x0B"}.get(d, "\\" + d))
            i += 2
        else:
            out.append("\\" + c if c in "[&]~#" or c == "^" and len(out) > 1 else c)
            i += 1
        first = False
    raise DialectError("missing ]")


def re2java(pattern: str, ignore_case: bool = False, multiline: bool = False, pcre: bool = False) -> str:
    """The pattern for rlike and the regexp functions, with the same matches on a line (or, multiline, on a whole text).

    ``.`` and ``$`` know only the line feed; word edges, \\s and classes are ASCII.  pcre passes the pattern as it is.
    """
    flags = "d" + "i" * ignore_case + "u" * (ignore_case and not pattern.isascii()) + "m" * multiline
    if pcre:
        return f"(?{flags}){pattern}"
    out, i, n = [], 0, len(pattern)
    quantified = False
    while i < n:
        c = pattern[i]
        was, quantified = quantified, False
        if c == "\\":
            if i + 1 >= n:
                raise DialectError("trailing backslash")
            d = pattern[i + 1]
            if d == "Q":
                end = pattern.find("\\E", i + 2)
                out.append(quote(pattern[i + 2 : end if end >= 0 else n]))
                i = end + 2 if end >= 0 else n
                continue
            if d in "pP":
                part, i = _property(pattern, i)
                out.append(part)
                continue
            if d in "123456789kgGCKRXhHVZ":
                raise DialectError(f"\\{d}")
            out.append({"b": EDGE, "B": NO_EDGE, "s": f"[{SPACES}]", "S": f"[^{SPACES}]", "v": r"\x0B"}.get(d, "\\" + d))
            i += 2
        elif c == "[":
            part, i = _class(pattern, i)
            out.append(part)
        elif c == "(" and pattern.startswith("(?", i):
            rest = pattern[i + 2 :]
            if m := re.match(r"P?<([A-Za-z_]\w*)>", rest):
                out.append(f"(?<g{re.sub('[^A-Za-z0-9]', '0', m[1])}>")
                i += 2 + m.end()
            elif m := re.match(r"([imsU]*)(-[imsU]+)?([:)])", rest):
                if "U" in m[0]:
                    raise DialectError("(?U)")
                on = m[1] + ("u" if "i" in m[1] and not pattern.isascii() else "")
                out.append(f"(?{on}{m[2] or ''}{m[3]}")
                i += 2 + m.end()
            else:
                raise DialectError(f"(?{rest[:2]}")
        elif c in "*+?" or c == "{" and re.match(r"\{\d+(,\d*)?\}", pattern[i:]):
            if was and c != "?":
                raise DialectError(f"bad repetition {pattern[i - 1 : i + 1]}")
            m = re.match(r"[*+?]\??|\{\d+(?:,\d*)?\}\??", pattern[i:])
            out.append(m[0])
            i += m.end()
            quantified = True
        else:
            out.append("\\{" if c == "{" else "\\}" if c == "}" else c)
            i += 1
    return f"(?{flags})" + "".join(out)


def word_pattern(pattern: str, fixed: bool) -> str:
    return rf"\b(?:{quote(pattern) if fixed else pattern})\b"


def has_upper(pattern: str) -> bool:
    return any(unicodedata.category(c) == "Lu" for c in pattern)


def ident_words(name: str) -> list[str]:
    """Lower-case words of an identifier: cut at signs, and where an upper-case letter follows a lower-case one or a digit."""
    out, word = [], ""
    for a in name:
        if not (a.isalpha() or unicodedata.category(a) == "Nd"):
            out.append(word)
            word = ""
            continue
        if word and a.isupper() and (word[-1].islower() or word[-1].isdigit()):
            out.append(word)
            word = ""
        word += a
    return [w.lower() for w in [*out, word] if w]


def ident_pattern(name: str) -> str | None:
    """A pattern for every spelling of an identifier, or None if it has no words."""
    words = ident_words(name)
    return r"(?i)\b" + "[_-]?".join(map(quote, words)) + r"\b" if words else None


def suggest_variants(pattern: str, most: int = 5) -> list[tuple[str, str]]:
    """(variant, kind) worth a probe when a pattern finds nothing: its lower-case form, then its longer words."""
    out: list[tuple[str, str]] = []
    low = pattern.lower()
    if low != pattern:
        out.append((low, "case-insensitive"))
    seen = {low, pattern}
    for w in ident_words(pattern):
        if len(w.encode()) >= 4 and w not in seen:
            seen.add(w)
            out.append((w, "fragment"))
    return out[:most]


def risky(pattern: str) -> bool:
    """Whether an unbounded repetition holds another one: java.util.regex may backtrack without end there."""
    try:
        tree = re._parser.parse(re.sub(r"\(\?P?<(\w+)>", r"(?P<\1>", pattern))
    except Exception:
        return False
    big = re._constants.MAXREPEAT

    def walk(node, inside) -> bool:
        for op, arg in node:
            name = str(op)
            if name in ("MAX_REPEAT", "MIN_REPEAT"):
                unbounded = arg[1] == big
                if unbounded and inside or walk(arg[2], inside or unbounded):
                    return True
            elif name == "SUBPATTERN" and walk(arg[3], inside) or name == "BRANCH" and any(walk(b, inside) for b in arg[1]):
                return True
        return False

    return walk(tree, False)


def required_literals(pattern: str, least: int = 3) -> list[str]:
    """Literals of ``least`` ASCII characters or more that every match contains; none if in doubt."""
    try:
        tree = re._parser.parse(re.sub(r"\\z", r"\\Z", pattern))
    except Exception:
        return []
    found: list[str] = []
    if tree.state.flags & re.IGNORECASE:
        return []

    def walk(node) -> None:
        run = ""

        def end():
            nonlocal run
            if len(run) >= least:
                found.append(run)
            run = ""

        for op, arg in node:
            name = str(op)
            if name == "LITERAL" and arg < 128:
                run += chr(arg)
                continue
            if name == "SUBPATTERN" and not arg[1] and not arg[2]:
                end()
                walk(arg[3])
                continue
            end()
            if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] >= 1:
                walk(arg[2])
        end()

    walk(tree)
    return list(dict.fromkeys(found))


def line_bound(pattern: str) -> bool:
    """Whether every match on a whole text (multi-line) is one on a line, and the other way round; False if in doubt.

    Such a pattern has nothing that a line feed fits, and nothing that looks at the ends of a text.
    """
    if re.search(r"\[\^|\\[^bdwtx.+*?()|\[\]{}$/@_-]|\(\?(?![:P<])|\[:|\\x|\\t-|[\x00-\x1f]", pattern):
        return False
    try:
        return not re.compile(pattern).fullmatch("\n") and not any(ord(a) <= 10 <= ord(b) for a, b in re.findall(r"(.)-(.)", pattern))
    except re.error:
        return False


def least_width(pattern: str) -> int:
    """Characters that a match has at least; 0 if in doubt."""
    try:
        return re._parser.parse(pattern).getwidth()[0]
    except Exception:
        return 0


def simple_literal(pattern: str) -> str | None:
    """The ASCII text that a pattern looks for, if there is no more to it than the edges of a word."""
    m = re.fullmatch(r"(?:\\b)?((?:[A-Za-z0-9_ ]|\\[^A-Za-z0-9])+)(?:\\b)?", pattern)
    return re.sub(r"\\(.)", r"\1", m[1]) if m and m[1].isascii() else None
