"""Nearest neighbours by learned partitions: a balanced partitioning of a neighbour graph, learned by a small classifier.

The graph joins each vector of a bounded sample to its nearest ones; it is cut into parts of equal size, and a classifier
learns the part from the vector.  Every vector is indexed in its most probable part; a query goes to its several most
probable parts and is ranked there by exact cosine.  The number of parts grows with the root of the number of vectors.
Where one classifier would have too many parts to tell apart, each of its parts is divided again, by a graph and a
classifier of its own, fitted on a sample of that part.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import reliable

#: Vectors that the graph and the classifier are fitted on (a sample by hash of vec_id); all are indexed.
MOST_FIT = 6000
NEIGHBOURS = 10
#: A table of n vectors has about sqrt(n) / SPREAD parts, in powers of two; a classifier tells so many apart at most.
SPREAD, MOST_PARTS = 4, 256
#: Recall that the number of routed parts is chosen for, on sample vectors that the classifier was not fitted on.
AIM = 0.97
#: Least and most vectors of a block of a part, and most queries that meet it at once.
BLOCK, MOST_BLOCK, MOST_QUERIES = 512, 16_384, 4096
#: Cosines closer than this are told apart by exact sums.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbours(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k rows of x of largest cosine for each row of q, without row own[i] for query i."""
    out = []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[at : at + 256]] = -2
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def balanced_parts(near: np.ndarray, parts: int) -> np.ndarray:
    """Cuts a neighbour graph (rows of neighbours) in parts, a power of two, of equal size: halves again and again.

    A half comes from the second eigenvector of the walk on the piece's own edges, by power iteration from a fixed
    start, cut at its median; then pairs are exchanged as long as that leaves fewer edges cut.
    """
    n = len(near)
    a = np.repeat(np.arange(n), near.shape[1])
    b = near.ravel()
    a, b = np.concatenate((a, b)), np.concatenate((b, a))
    label = np.zeros(n, dtype=np.int64)
    rng = np.random.default_rng(7)
    for _ in range(int(math.log2(parts))):
        new = label * 2
        inside = label[a] == label[b]
        for k in np.unique(label):
            rows = np.flatnonzero(label == k)
            if len(rows) < 2:
                continue
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            keep = inside & (label[a] == k)
            u, v = place[a[keep]], place[b[keep]]
            degree = np.bincount(u, minlength=len(rows)) + 1.0
            f = rng.standard_normal(len(rows))
            for _ in range(60):
                f -= (f * degree).sum() / degree.sum()
                f = 0.5 * f + 0.5 * (np.bincount(u, f[v], len(rows)) + f) / degree
                f /= np.linalg.norm(f) + 1e-30
            side = np.zeros(len(rows), dtype=np.int64)
            side[np.argsort(f, kind="stable")[len(rows) // 2 :]] = 1
            for _ in range(20):
                other = np.bincount(u, side[u] != side[v], len(rows)) - np.bincount(u, side[u] == side[v], len(rows))
                left = np.flatnonzero(side == 0)
                right = np.flatnonzero(side == 1)
                left, right = left[np.argsort(-other[left], kind="stable")], right[np.argsort(-other[right], kind="stable")]
                m = min(len(left), len(right))
                gain = other[left[:m]] + other[right[:m]]
                move = max(1, int((gain > 2).sum()) // 2) if (gain > 2).any() else 0
                if not move:
                    break
                side[left[:move]], side[right[:move]] = 1, 0
            new[rows] += side
        label = new
    return label


class Router:
    """A classifier with one hidden layer: probabilities of the parts of a unit vector.  Deterministic."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, rounds: int = 40, rate: float = 3e-3):
        rng = np.random.default_rng(11)
        d, p = x.shape[1], target.shape[1]
        self.w = [rng.standard_normal((d, hidden)) * math.sqrt(2), np.zeros(hidden), rng.standard_normal((hidden, p)) / math.sqrt(hidden), np.zeros(p)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(x), 128):
                rows = order[at : at + 128]
                h0 = x[rows] @ self.w[0] + self.w[1]
                h = np.maximum(h0, 0)
                out = (self._soft(h @ self.w[2] + self.w[3]) - target[rows]) / len(rows)
                back = (out @ self.w[2].T) * (h0 > 0)
                grads = [x[rows].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ out + 1e-4 * self.w[2], out.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def parts_of(n: int) -> int:
    """The number of parts for n vectors, a power of two; two at least where there are vectors for two."""
    return 1 if n < 4 else 1 << max(1, round(math.log2(math.sqrt(n) / SPREAD)))


class Level:
    """A neighbour graph's parts and the classifier that tells them."""

    def __init__(self, x: np.ndarray, parts: int):
        """x: unit vectors of a sample, at least two."""
        near = neighbours(x, x, min(NEIGHBOURS, len(x) - 1), np.arange(len(x)))
        label = balanced_parts(near, parts)
        self.parts = parts
        self.soft = (np.eye(parts)[label] + np.eye(parts)[label[near]].sum(axis=1)) / (near.shape[1] + 1)
        self.router = Router(x, self.soft)

    def packed(self) -> bytes:
        """The classifier alone."""
        self.router.w = [w.astype(np.float32) for w in self.router.w]
        self.soft = None
        return pickle.dumps(self)


class Partitions:
    """Parts of one level or two, their classifiers, and the number of parts a query is sent to."""

    def __init__(self, x: np.ndarray, parts: int, aim: float = AIM):
        x = unit(x) if len(x) else x
        self.aim, self.top, self.below, self.first = aim, None, {}, None
        self.parts = self.probes = 1
        if parts < 2 or len(x) < 4:
            return
        self.parts = parts
        self.top = Level(x, parts)
        # a second classifier, which hasn't seen every eighth vector, is there to be tried on those
        self.held = np.arange(len(x)) % 8 == 0
        self.first = Router(x[~self.held], self.top.soft[~self.held])
        self.starts = np.arange(parts)
        self.calibrate(x)

    def divide(self, below: dict[int, "Level"], x: np.ndarray) -> None:
        """Divides parts by levels of their own; x is the sample again."""
        self.below = below
        sizes = np.array([below[p].parts if p in below else 1 for p in range(self.top.parts)])
        self.starts = np.cumsum(sizes) - sizes
        self.parts = int(sizes.sum())
        self.calibrate(unit(x))

    def calibrate(self, x: np.ndarray) -> None:
        """Chooses the number of parts a query goes to so that sample vectors find their neighbours among the others.

        The share found is estimated on vectors that the first classifier hasn't seen; it is asked to lie over ``aim``
        by as much as it is uncertain.
        """
        held = np.flatnonzero(self.held)
        home = self._home(x, self.first)
        k = min(5, len(x) - 1)
        true = neighbours(x, x[held], k, held)
        place = np.empty((len(held), k), dtype=np.int64)
        for at in range(0, len(held), 64):
            some = held[at : at + 64]
            p = self._all(x[some], self.first)
            mine = np.take_along_axis(p, home[true[at : at + 64]], axis=1)
            place[at : at + 64] = (p[:, None, :] > mine[:, :, None]).sum(axis=2) if self.parts <= 1024 else np.array([[np.count_nonzero(row > v) for v in vs] for row, vs in zip(p, mine)])
        found = np.cumsum(np.bincount(place.ravel(), minlength=self.parts)) / place.size
        sure = found - np.sqrt(found * (1 - found) / len(held))
        self.probes = min(self.parts, 1 + next((m for m, r in enumerate(sure, 1) if r >= self.aim), self.parts))

    def _all(self, x: np.ndarray, router: Router) -> np.ndarray:
        """Probabilities of all parts of unit vectors: of the upper part, times that within it."""
        p = router.probabilities(x)
        return p if not self.below else np.concatenate([p[:, [k]] * self.below[k].router.probabilities(x) if k in self.below else p[:, [k]] for k in range(self.top.parts)], axis=1)

    def _home(self, x: np.ndarray, router: Router) -> np.ndarray:
        upper = router.probabilities(x).argmax(axis=1)
        out = self.starts[upper]
        for k in np.intersect1d(upper, list(self.below)):
            rows = np.flatnonzero(upper == k)
            out[rows] += self.below[int(k)].router.probabilities(x[rows]).argmax(axis=1)
        return out

    def upper(self, x: np.ndarray) -> np.ndarray:
        """The part of the upper level that each row is in."""
        return np.zeros(len(x), dtype=np.int64) if self.top is None else self.top.router.probabilities(unit(x)).argmax(axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The part that each row is indexed in."""
        return np.zeros(len(x), dtype=np.int64) if self.top is None else self._home(unit(x), self.top.router)

    def order(self, x: np.ndarray) -> np.ndarray:
        """All parts for each row, the most probable first; a row's own is the first of all."""
        if self.top is None:
            return np.zeros((len(x), 1), dtype=np.int64)
        p = self._all(unit(x), self.top.router)
        p[np.arange(len(x)), self.home(x)] = 2
        return np.argsort(-p, axis=1, kind="stable")

    def slim(self) -> "Partitions":
        """What routing needs: the calibration's classifier and sample are left behind."""
        out = Partitions(np.zeros((0, 1)), 1)
        out.top, out.below, out.parts, out.probes = self.top, self.below, self.parts, self.probes
        if out.top is not None:
            out.starts, out.top.soft = self.starts, None
        return out


def _dense(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine from exactly rounded sums, so that equal vectors score equally wherever they are computed."""
    a, b = a.tolist(), b.tolist()
    s, t = max(map(abs, a)), max(map(abs, b))
    a, b = [v / s for v in a] if not 1e-100 < s < 1e100 else a, [v / t for v in b] if not 1e-100 < t < 1e100 else b
    dot, x, y = math.fsum(map(float.__mul__, a, b)), math.fsum(map(float.__mul__, a, a)), math.fsum(map(float.__mul__, b, b))
    return dot / (math.sqrt(x) * math.sqrt(y))


def best(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query, id, score) of the k nearest ids of x for each query, in a block: by matrix product, then exactly.

    An id that several rows of x have counts once, with the best of their scores, before the k are cut off.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    s = unit(q) @ unit(x).T
    s[query_ids[:, None] == ids[None, :]] = -3
    for i in range(len(q)):
        row = s[i]
        top = np.maximum.reduceat(row, first)
        able = int((top > -2).sum())
        if not able:
            continue
        floor = np.partition(top, len(top) - min(k, able))[len(top) - min(k, able)] - SLACK
        found: dict[int, float] = {}
        for j in np.flatnonzero(row >= max(floor, -2)):
            at = int(ids[j])
            found[at] = max(found.get(at, -2.0), cosine(q[i], x[j]))
        for score, at in sorted((-score, at) for at, score in found.items())[:k]:
            yield int(query_ids[i]), at, -score


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part.

    Left out: null ids and vectors, vectors with null or non-finite components, all zeros, and those that don't have the
    length that most have.  Rows that repeat both id and vector are one row.
    """
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok)
    length = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size("embedding") == (length["d"] if length else 0)).dropDuplicates(["vec_id", "embedding"])


def _sampled(most: float):
    """Whether a row is in a sample of about ``most`` of 1, by hash of its id."""
    return F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) / 1_000_000.0 < most


def fit(good: DataFrame, n: int, aim: float = AIM, most_fit: int = MOST_FIT) -> Partitions:
    """Parts for n usable vectors, fitted on about ``most_fit`` of them, and in two levels on so many of each upper part.

    The upper level comes to the driver as a sample, the lower ones (MOST_PARTS at most) as classifiers only, fitted each
    in a task: both have a bound that doesn't grow with the table.  No part is divided further than the root rule asks
    of the whole, so a part that is larger than the others has more parts below it.
    """
    aimed = parts_of(n)
    sample = good.where(_sampled(min(1.0, most_fit / max(1, n)))).toArrow().sort_by("vec_id")
    x = _dense(sample["embedding"])
    model = Partitions(x, min(MOST_PARTS, aimed), aim)
    if aimed <= MOST_PARTS or model.top is None:
        return model.slim()
    shared = good.sparkSession.sparkContext.broadcast(model.slim())

    def placed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.upper(_dense(batch.column(1))), pa.int64())], names=["vec_id", "embedding", "part"])

    upper = good.mapInArrow(placed, "vec_id long, embedding array<double>, part long")
    sizes = {r["part"]: r["n"] for r in upper.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_PARTS rows
    below = {p: min(MOST_PARTS, 1 << round(math.log2(max(1, size * aimed / n)))) for p, size in sizes.items()}
    below = {p: b for p, b in below.items() if b > 1}
    if not below:
        return model.slim()
    rate = F.create_map(*[F.lit(v) for p in below for v in (p, min(1.0, most_fit / sizes[p]))])

    def divided(key: tuple, part: pa.Table) -> pa.Table:
        p, rows = key[0].as_py(), part.sort_by("vec_id")
        x = _dense(rows["embedding"])
        able = len(x) >= 4
        return pa.table({"part": pa.array([p] * able, pa.int64()), "level": pa.array([Level(unit(x), below[p]).packed()] * able if able else [], pa.binary())})

    some = upper.where(F.col("part").isin(*below)).where(_sampled(F.element_at(rate, F.col("part"))))
    levels = some.groupBy("part").applyInArrow(divided, "part long, level binary").collect()
    model.divide({r["part"]: pickle.loads(r["level"]) for r in levels}, x)
    return model.slim()


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, aim: float = AIM, most_fit: int = MOST_FIT) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k nearest of all others.

    Nearness is the cosine in double precision on the original vectors; ties go to the smaller vec_id.  Rows of a
    repeated vec_id count once, with their best score, and never as their own neighbours.  Fewer rows than k: all of
    them.  Empty table, or one without usable vectors: no rows.  Extra columns are not read.

    A part may hold a third of all rows: it is dealt in blocks of bounded size that queries are copied to, and so are
    the queries of a part.  A task holds one block and the queries that meet it; what it returns is k rows a query.
    """
    spark = vectors.sparkSession
    good = reliable(usable(vectors))
    n = good.count()
    model = fit(good, n, aim, most_fit)
    shared = spark.sparkContext.broadcast(model)

    def homed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.home(_dense(batch.column(1))).astype(np.int32))], names=["vec_id", "embedding", "part"])

    def routed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                order = shared.value.order(_dense(some.column(1)))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))], names=["vec_id", "embedding", "route"])

    index = good.mapInArrow(homed, "vec_id long, embedding array<double>, part int")
    sizes = reliable(index.groupBy("part").agg(F.count(F.lit(1)).alias("n")))
    # an id with vectors in several parts is held by the first of them alone, so that parts never hold more than they have
    own = index.groupBy("vec_id").agg(F.min("part").alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # both have at most a row a part, MOST_PARTS squared
    counts = np.zeros(model.parts, dtype=np.int64)
    held_ids = np.zeros(model.parts, dtype=np.int64)
    for out, rows in ((counts, sizes), (held_ids, own)):
        for r in rows.collect():
            out[r["part"]] = r["n"]
    block = max(BLOCK, min(MOST_BLOCK, n // 64))
    in_parts = spark.sparkContext.broadcast((np.maximum(1, -(-counts // block)), held_ids))
    query_blocks = max(1, -(-(n // every + 1) // MOST_QUERIES))

    def sent(batches):
        """For each query the most probable parts, and further ones until they hold k ids beside the query's own."""
        blocks, ids = in_parts.value
        for batch in routed(batches):
            rows, parts, cells = [], [], []
            for i, route in enumerate(batch.column(2)):
                route = np.array(route.values)
                used = max(model_probes, int(np.searchsorted(np.cumsum(ids[route]), k, "right")) + 1)
                for p in route[:used].tolist():
                    rows += [i] * int(blocks[p])
                    parts += [p] * int(blocks[p])
                    cells += range(int(blocks[p]))
            some = batch.select(["vec_id", "embedding"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(parts, pa.int32()), pa.array(cells, pa.int32())], names=["vec_id", "embedding", "part", "c"])

    def dealt(batches):
        blocks, _ = in_parts.value
        for batch in homed(batches):
            of = blocks[batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32))], names=["vec_id", "embedding", "part", "blocks"])

    model_probes = model.probes
    spread = F.xxhash64("vec_id")
    asked = good.where(F.col("vec_id") % every == 0).mapInArrow(sent, "vec_id long, embedding array<double>, part int, c int").withColumn("q", F.pmod(spread, F.lit(query_blocks)).cast("int"))
    placed = good.mapInArrow(dealt, "vec_id long, embedding array<double>, part int, blocks int").withColumn("c", F.pmod(spread, F.col("blocks")).cast("int"))
    held = placed.select("vec_id", "embedding", "part", "c", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"))

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(best(left["vec_id"].to_numpy(), _dense(left["embedding"]), right["vec_id"].to_numpy(), _dense(right["embedding"]), k)) if left.num_rows and right.num_rows else []
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    met = asked.groupBy("part", "c", "q").cogroup(held.groupBy("part", "c", "q")).applyInArrow(ranked, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
