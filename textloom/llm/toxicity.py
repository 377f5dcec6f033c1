"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, isotonic

#: Most labelled rows of each class that are fitted on (a sample by hash of doc_id); all rows are scored.
MOST_FIT = 4000
THRESHOLD = 0.7
#: Bytes of sampled texts that may come to the driver; the sample is thinned to keep under it.
MOST_BYTES = 80_000_000
#: Longest text that is fitted on, in bytes (all are scored), and steps in which a sample is thinned.
MOST_TEXT, STEPS = 1_000_000, 256
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
#: A word in which digits or signs stand for letters, or whose letters are set apart.
LEET = re.compile(r"[^\W_]*(?:[0-9@$!|*][^\W_]+)+|\b(?:[^\W\d_][ .\-_*]){3,}[^\W\d_]\b")
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "*": "", " ": "", ".": "", "-": "", "_": ""})
REPEAT = re.compile(r"(.)\1{2,}", re.S)
RUNS = re.compile(r"[!?]{2,}")
SECOND = frozenset("you your yours yourself yourselves u ur ya du dich dir dein deine deiner deinen deinem ihr euch euer tu te ti toi vous votre vos ton ta tes usted ustedes tú vosotros tuyo tuya".split())
#: Known insults, beside those that are learned.
SEED_LEXICON = frozenset("idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown disgusting dumb imbecile".split())
STEMS = (4, 5)
#: A learned entry counts in so many toxic texts at least, and is so many times as frequent among them as among others.
LEAST_TEXTS, LEAST_RATIO = 3, 12.0

FEATURES = (
    "words_rate", "words_log", "stems_rate", "stems_log", "distinct_hits", "hidden_rate", "hidden_log", "near_you", "you_rate",
    "capitals", "shouted", "marks", "mark_runs", "odd_signs", "leet_rate", "repeats", "length_log", "word_length", "densest",
)


def learn_lexicon(texts: list[str], toxic: np.ndarray) -> tuple[frozenset, frozenset]:
    """Words and word beginnings that mark toxic texts.

    An entry counts once a text; in toxic texts only behind a word that it wasn't met behind before, so what copies of
    one text repeat counts once.
    """
    n, s, met = [Counter(), Counter()], [Counter(), Counter()], set()
    for t, y in zip(texts, toxic.tolist()):
        words = WORD.findall(t.lower())
        if y:
            pairs = set(zip(["", *words], words)) - met
            met |= pairs
            fresh = {w for _, w in pairs}
            n[1].update(fresh)
            s[1].update({w[:k] for w in fresh for k in STEMS if len(w) > k})
        else:
            n[0].update(set(words))
            s[0].update({w[:k] for w in words for k in STEMS if len(w) > k})
    pos, neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    least = max(LEAST_TEXTS, pos // 100)

    def chosen(c):
        return frozenset(w for w, k in c[1].items() if k >= least and (k / pos) / ((c[0][w] + 0.5) / neg) >= LEAST_RATIO)

    return chosen(n) | SEED_LEXICON, chosen(s)


def features(text: str, lexicon: frozenset, stems: frozenset) -> list[float]:
    """Dense features of a whole text, in the order of FEATURES."""
    lower = text.lower()
    words = WORD.findall(lower)
    n = max(1, len(words))
    hits, by_stem, you = [], [], []
    for i, w in enumerate(words):
        if w in lexicon:
            hits.append(i)
        elif w[:4] in stems or w[:5] in stems:
            by_stem.append(i)
        if w in SECOND:
            you.append(i)
    hidden = leet = 0
    if not text.isascii() or any(c in text for c in "0134578@$!|*.-_"):
        for m in LEET.finditer(lower):
            leet += 1
            hidden += REPEAT.sub(r"\1", m[0].translate(LETTERS)) in lexicon
    long_runs = REPEAT.findall(lower)
    if long_runs:
        hidden += sum(REPEAT.sub(r"\1", w) in lexicon for w in words if REPEAT.search(w))
    every = sorted(hits + by_stem)
    near = 0.0
    if every and you:
        at = np.searchsorted(you, every)
        a, y = np.array(every), np.array(you)
        gap = np.minimum(np.abs(a - y[np.minimum(at, len(y) - 1)]), np.abs(a - y[np.maximum(at - 1, 0)]))
        near = float((1 / (1 + gap)).max())
    # the most hits that 50 words hold
    densest = 0
    j = 0
    for i, at in enumerate(every):
        while at - every[j] >= 50:
            j += 1
        densest = max(densest, i - j + 1)
    chars = max(1, len(text))
    up = sum(map(str.isupper, text)) if lower != text else 0
    shouted = sum(w.isupper() and len(w) > 2 for w in WORD.findall(text)) if up * 50 > chars else 0
    marks = text.count("!") + text.count("?")
    odd = sum(map(text.count, "*%$#&@~^"))
    return [
        len(hits) / n, np.log1p(len(hits)), len(by_stem) / n, np.log1p(len(by_stem)), len({words[i] for i in every}), hidden / n, np.log1p(hidden), near, len(you) / n,
        up / chars, shouted / n, marks / chars, len(RUNS.findall(text)) / n if marks else 0.0, odd / chars, leet / n, len(long_runs) / n, np.log1p(len(words)), sum(map(len, words)) / n, densest,
    ]


def matrix(texts: Iterable[str], lexicon: frozenset, stems: frozenset) -> np.ndarray:
    return np.array([features(t, lexicon, stems) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


class ToxicityModel:
    """Lexicon, trees and calibration.

    Training rows are scored by trees whose lexicon came from the other half of them, so an entry that only its own text
    holds is worth nothing, and the calibration is fitted on those scores.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray, weights: np.ndarray):
        toxic = toxic.astype(np.float64)
        self.constant = float(np.average(toxic, weights=weights)) if len(toxic) else 0.0
        self.trees = None
        self.lexicon, self.stems = SEED_LEXICON, frozenset()
        if len(toxic) < 20 or toxic.min() == toxic.max():
            return
        half = np.arange(len(toxic)) % 2
        x = np.zeros((len(toxic), len(FEATURES)))
        margins = np.zeros(len(toxic))
        for k in (0, 1):
            other = np.flatnonzero(half != k)
            own = np.flatnonzero(half == k)
            lexicon = learn_lexicon([texts[i] for i in other], toxic[other])
            x[own] = matrix((texts[i] for i in own), *lexicon)
        for k in (0, 1):
            other, own = half != k, half == k
            margins[own] = Boosted().fit(x[other], toxic[other], weights[other]).margin(x[own])
        self.trees = Boosted().fit(x, toxic, weights)
        self.knots = isotonic(margins, toxic, weights)
        self.lexicon, self.stems = learn_lexicon(texts, toxic)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        return np.clip(np.interp(self.trees.margin(matrix(texts, self.lexicon, self.stems)), *self.knots), 0.0, 1.0)


def held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, most_bytes: int = MOST_BYTES) -> ToxicityModel:
    """Fits on at most about ``most`` labelled rows of each class, chosen by hash of doc_id, none of them held out.

    An id with several labels is toxic if one of them is; null ids, labels and texts are left out, and so are texts of
    over MOST_TEXT bytes.  What comes to the driver holds at most ``most_bytes`` of text: the lengths of the rows to
    choose from are summed up in steps of the hash, and each class is cut at the step where its half of the bytes is used up.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out())
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two classes
    part = {y: min(1.0, most / n) for y, n in counts.items()}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    by_class = lambda of: F.element_at(F.create_map(*[F.lit(x) for kv in of.items() for x in kv]), F.col("toxic"))
    if not part:
        return ToxicityModel([], np.zeros(0), np.zeros(0))
    few = known.where(share < by_class(part)).select(F.col("doc_id").alias("id"), "toxic", F.floor(share / by_class(part) * STEPS).alias("step"))
    fits = docs.where(F.octet_length("text") <= MOST_TEXT)
    rows = fits.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("id"))
    used: dict[int, dict[int, int]] = {y: {} for y in part}
    for r in rows.groupBy("toxic", "step").agg(F.sum(F.octet_length("text")).alias("bytes")).collect():  # STEPS a class at most
        used[r["toxic"]][r["step"]] = r["bytes"]
    steps = {}
    for y, of in used.items():
        sums = np.cumsum([of.get(k, 0) for k in range(STEPS)])
        steps[y] = int(np.searchsorted(sums, most_bytes // len(used), "right"))
    sample = rows.where(F.col("step") < by_class(steps)).select("doc_id", "text", "toxic").toArrow()
    order = sorted(range(sample.num_rows), key=lambda i: (sample["doc_id"][i].as_py(), sample["text"][i].as_py()))
    sample = sample.take(pa.array(order, pa.int64()))
    toxic = np.array(sample["toxic"].to_pylist(), dtype=np.float64)
    weights = np.array([STEPS / (part[int(y)] * steps[int(y)]) for y in toxic.tolist()])
    return ToxicityModel(sample["text"].to_pylist(), toxic, weights)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_FIT) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null text counts as empty and gets a score like any other.  A null doc_id hashes as the empty text.  Without usable
    labels of both classes every score is the known share of toxic rows, or 0.  Repeated rows each get their row; an
    empty table gives none; extra columns are not read.  Texts are read once to be scored, with no shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, most))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches):
        for batch in batches:
            s = np.concatenate([model.value.score([t or "" for t in batch.column(2).slice(at, 256).to_pylist()]) for at in range(0, batch.num_rows, 256)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")
