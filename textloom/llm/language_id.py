"""Language ID by rank-order profiles: out-of-place distance of a text's most frequent n-grams to each language's."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean
from .toxicity import held_out

#: N-grams of 1 to 3 characters, within words; the most frequent TOP of them are a profile.
TOP = 400
#: Most texts of a language that its profile is counted over (a sample by hash of doc_id).
MOST_FIT = 3000
UNKNOWN = "und"
#: Characters of a text that are counted at once.
PIECE = 1 << 18
CHAR_BITS = 21


@cache
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)], dtype=bool)


@cache
def _lower() -> np.ndarray:
    """The lower-case letter of each code point (the first, where there are several), a space for all but letters."""
    low = np.array([ord(chr(c).lower()[0]) for c in range(sys.maxunicode + 1)], dtype=np.uint32)
    return np.where(_letters()[low], low, np.uint32(32))


def _grams(c: np.ndarray, old: int) -> np.ndarray:
    """Packed n-grams of letters and single spaces whose last character is not among the first ``old``, one or two.

    None holds a space inside.
    """
    c = c.astype(np.uint64)
    one = c[old:]
    two = (c[:-1] << np.uint64(CHAR_BITS) | c[1:])[old - 1 :]
    three = (c[:-2] << np.uint64(2 * CHAR_BITS) | c[1:-1] << np.uint64(CHAR_BITS) | c[2:])[c[1:-1] != 32]
    return np.concatenate((one[one != 32], two, three))


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text and their counts.  Everything but letters separates words.

    A long text is counted a piece at a time, wherever the pieces end: the last two characters of a piece stay for the
    n-grams that go on in the next, so the counts don't depend on the pieces.
    """
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = np.array([32], dtype=np.uint32)
    for at in range(0, len(text), PIECE):
        new = _lower()[np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "replace"), dtype=np.uint32)]
        if at + PIECE >= len(text):
            new = np.concatenate((new, [np.uint32(32)]))
        new = new[(new != 32) | (np.concatenate((kept[-1:], new[:-1])) != 32)]
        codes = np.concatenate((kept, new))
        if not len(new):
            continue
        g, n = np.unique(_grams(codes, len(kept)), return_counts=True)
        if len(found):
            g, back = np.unique(np.concatenate((found, g)), return_inverse=True)
            n = np.bincount(back, np.concatenate((counts, n))).astype(np.int64)
        found, counts = g, n
        kept = codes[-2:]
    return found, counts


def ranked(grams: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams, most frequent first, equal counts by code."""
    return grams[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Ranked n-grams of every language, as one table of ranks."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP):
        self.langs = sorted(profiles)
        self.top = top
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), dtype=np.uint64)
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.uint64)), k] = np.arange(len(profiles[lang]))

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language over the largest possible one; None without a letter."""
        grams = ranked(*count_grams(text or ""), self.top)
        if not len(grams) or not self.langs:
            return None
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        rows = np.where(self.grams[at] == grams, at, len(self.grams))
        ranks = self.ranks[rows]
        out = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(grams))[:, None]))
        return out.sum(axis=0) / (self.top * len(grams))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (how far ahead of the second it is) and likeness to its profile, all of 0 to 1."""
        d = self.distances(text)
        if d is None:
            return UNKNOWN, 0.0, 0.0
        best = int(d.argmin())
        others = np.delete(d, best)
        second = float(others.min()) if len(others) else 1.0
        return self.langs[best], (1 - float(d[best]) / second if second > 0 else 0.0), 1 - float(d[best])


def fit(docs: DataFrame, most: int = MOST_FIT, top: int = TOP) -> Profiles:
    """Profiles of all languages of rows that aren't held out, over at most about ``most`` texts of each by hash of doc_id.

    Counted in tasks, summed by (language, n-gram); a profile of ``top`` n-grams a language comes to the driver.
    """
    known = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null").where(~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Profiles({}, top)
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most / n))])
    share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1_000_000)) / 1_000_000.0
    sample = known.where(share < F.element_at(part, F.col("lang"))).select("lang", "text")

    def counted(batches):
        for batch in batches:
            texts: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                pairs = [count_grams(t) for t in some]
                g, back = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in pairs]), len(g)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    sums = sample.mapInArrow(lean(counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = sums.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(profiles, top)


def predict(docs: DataFrame, profiles: Profiles, columns: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, likeness.

    ``und`` with score 0 for a null text, one without a letter, and every text if no language could be learned.  A null
    doc_id hashes as the empty text.  Repeated rows each get their row; an empty table gives none; extra columns are
    not read.  Texts are read once, with no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(profiles)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def told(batches):
        for batch in batches:
            out = [model.value.predict(t.as_py()) for t in batch.column(2)]
            langs, scores, like = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(like, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score", "likeness"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(told, f"doc_id {kind}, held_out boolean, lang_pred string, score double, likeness double")


def language_id(docs: DataFrame, most: int = MOST_FIT, top: int = TOP) -> DataFrame:
    """Learns the profiles from docs and predicts the language of every row; see predict()."""
    return predict(docs, fit(docs, most, top))


#: A text that is so unlike every profile is in none of the languages.
LEAST_LIKENESS = 0.2


def known_language_only(docs: DataFrame, least: float = LEAST_LIKENESS, most: int = MOST_FIT, top: int = TOP) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the languages learned from docs itself.

    Rejected are texts of no language (null, no letter) and those whose likeness to the nearest profile is under
    ``least``.  Rows pass through where they are: no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, most, top))
    at = docs.columns.index("text")

    def passed(batches):
        for batch in batches:
            told = [model.value.predict(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != UNKNOWN and like >= least for lang, _, like in told], pa.bool_()))

    return docs.mapInArrow(lean(passed), docs.schema)
