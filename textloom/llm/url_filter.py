"""URL filter: a trie over reversed host labels, then path segments, with longest match.

The rule list is compiled on the driver to a trie of nested dicts (its size is that of the rule list, which is
configuration: ``MAX_RULES`` bounds what is broadcast).  Every task walks it once per URL, so the cost of a URL is the
number of its labels and segments, whatever the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_RULES = 2_000_000
DEFAULT_VERDICT = "allow"


class UrlTrie:
    """Longest-match lookup.  A rule fits its host and all subdomains if the path starts with the rule's path.

    A longer host beats a shorter one; within a host the longer path wins; of equal rules the last one given counts.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules):
            if n >= MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r}")
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(("h", label), {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(("p", segment), {})
            # what follows the last slash is a prefix of a segment
            node.setdefault("ends", {})[rest] = (host + path, verdict)

    @staticmethod
    def _in_path(node: dict, segments: list[str]):
        best, depth = None, 0
        while node is not None:
            ends = node.get("ends")
            if ends and depth < len(segments):
                here = segments[depth]
                fit = max((e for e in ends if here.startswith(e)), key=len, default=None)
                if fit is not None:
                    best = ends[fit]
            if depth + 1 >= len(segments):
                break
            node = node.get(("p", segments[depth]))
            depth += 1
        return best

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits, or two nulls."""
        segments = path.split("/")
        node, best = self.root, self._in_path(self.root, segments)
        for label in reversed(host.split(".")):
            node = node.get(("h", label))
            if node is None:
                break
            best = self._in_path(node, segments) or best
        return best or (None, None)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the contract cuts them; two empty strings without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return (host.lower() if host.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in host)), path


def judge_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT_VERDICT, key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    Null url, empty url or one without ``://``: host and path are empty, no rule with a host fits and the verdict is
    the default.  Repeated rows and null keys give a row each; an empty table gives none; other columns are not read.
    Only the two named columns reach the scan, there is no shuffle, and a task holds one Arrow batch at a time.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    schema = f"`{key}` {pages.schema[key].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def walk(batches):
        find = trie.value.find
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for u in batch.column(1).to_pylist():
                host, path = host_and_path(u)
                rule, verdict = find(host, path)
                hosts.append(host)
                paths.append(path)
                found.append(rule)
                verdicts.append(verdict or default)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))],
                names=[key, "host", "path", "rule", "verdict"],
            )

    return pages.select(F.col(key), F.col(url)).mapInArrow(walk, schema)


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^?#]*', 0) AS rest FROM u
), w AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM v
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/' END AS rule FROM w
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
