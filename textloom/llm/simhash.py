"""SimHash near-dedup.  Pairs of fingerprints are found by a pigeonring filter, then checked in full."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_of_order, hex64, lean, reliable, small_side
from .components import components

SEED = 42
SHINGLE = 4
#: Fingerprints link at so many differing bits or fewer.
BITS = 4
#: Segments of the ring: (lowest bit, width).  One more than BITS, so that a link has a start whose segment is equal.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
#: Most members of a candidate bucket that meet in one task at once; larger buckets are dealt in blocks.
BLOCK = 2048
#: Buckets of so many members or fewer are compared all at once.
FEW = 64
SHIFTS = np.arange(64, dtype=np.uint64)


def _counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, bit 0 first."""
    return np.unpackbits(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(body: bytes) -> int:
    """The 64-bit fingerprint of a whole text: A-Z lower-cased, ASCII whitespace words, 4-word shingles with repeats.

    A bit is 1 if set in over half of the shingles' hashes.  Fewer than four words are one shingle; none give 0.
    Words are cut from a megabyte at a time and hashes are summed up as they come.
    """
    digest = xxhash.xxh64_intdigest
    total, count, carry, rest, at = np.zeros(64, dtype=np.int64), 0, [], b"", 0
    while True:
        piece = rest + body[at : at + PIECE]
        at += PIECE
        last = at >= len(body)
        words = piece.lower().split()
        if not last and piece and not piece[-1:].isspace() and words:
            # the last word may go on; bytes keep their case until they are cut off whole
            rest = piece[len(piece) - len(words.pop()) :]
        else:
            rest = b""
        words = carry + words
        if len(words) >= SHINGLE:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
            hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], dtype=np.uint64)
            total += _counts(hashes)
            count += len(hashes)
            words = words[-(SHINGLE - 1) :]
        carry = words
        if last:
            break
    if not count:
        return digest(b" ".join(carry), SEED) if carry else 0
    return int((np.uint64(1) << SHIFTS[total * 2 > count]).sum(dtype=np.uint64)) if (total * 2 > count).any() else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (a long, the fingerprint's bits) of every row; null text counts as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or b"") for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("body")).mapInArrow(lean(hashed), f"doc_id {kind}, fp long")


def candidate_keys(fps: DataFrame) -> DataFrame:
    """(key, fp): ten rows a fingerprint, such that two fingerprints that link share a key.

    If 4 bits or fewer differ over a ring of 5 segments, the pigeonring principle gives a start from which every chain
    of l segments differs in 4l/5 bits or fewer: none in the first, one or none in the first two, and so on.  A key is
    the start's segment with half of the next one: with one differing bit or none in it, one of its halves is equal.
    """
    keys = []
    for i, (low, width) in enumerate(RING):
        low2, width2 = RING[(i + 1) % len(RING)]
        first = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        half = width2 // 2
        for j, (at, w) in enumerate(((low2, half), (low2 + half, width2 - half))):
            part = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1))
            keys.append(F.lit((i * 2 + j) << 40) + F.shiftleft(part, 20) + first)
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def chain_ok(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the differing bits x stay within the proportional budgets on the ring from each start segment."""
    ok = np.ones(x.shape, dtype=bool)
    run = np.zeros(x.shape, dtype=np.int64)
    lows = np.array([s[0] for s in RING], dtype=np.uint64)
    masks = np.array([(1 << s[1]) - 1 for s in RING], dtype=np.uint64)
    for length in range(1, len(RING) + 1):
        seg = (start + length - 1) % len(RING)
        run += np.bitwise_count((x >> lows[seg]) & masks[seg])
        ok &= run <= length * BITS // len(RING)
    return ok


def _links(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pigeonring chains first, then the full Hamming check of those left."""
    x = a ^ b
    ok = chain_ok(x, start)
    ok[ok] = np.bitwise_count(x[ok]) <= BITS
    return ok


def _thin(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join two trees of those before them."""
    parent: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = i = parent.setdefault(up, up)
        return i

    out = []
    for a, b in links:
        if (x := find(a)) != (y := find(b)):
            parent[x] = y
            out.append((a, b))
    return out


def _forest(left: np.ndarray, right: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of fingerprints (which may be the same block).

    All are compared, a strip at a time, but only links that join two trees come out: no more than members.
    """
    names = np.unique(np.concatenate((left, right)))
    parent = list(range(len(names)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at_l, at_r = np.searchsorted(names, left), np.searchsorted(names, right)
    out = []
    for i, v in enumerate(left):
        root = np.full(len(right), start)
        near = at_r[_links(np.full(len(right), v), right, root)].tolist()
        mine = find(int(at_l[i]))
        for j in near:
            if (other := find(j)) != mine:
                parent[other] = mine
                out.append((int(v), int(names[j])))
    return out


def edges(fps: DataFrame) -> DataFrame:
    """(a, b): links of distinct fingerprints, thinned within each bucket to those that connect it.

    fps has one row a fingerprint.  Components of the result are those of all links.  Buckets of over BLOCK members are
    dealt in blocks: members of two blocks meet in a task of their own, so no task holds more than two blocks of a key.
    """
    keyed = candidate_keys(fps)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = reliable(sizes.select(F.col("key").alias("k"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    k = keyed.join(sizes, F.col("key") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # a member of block b meets every block: cell (lower, upper), once on either side
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block")))
    k = k.select("key", F.explode(cells).alias("cell"), "block", "fp", "blocks")
    n = max(1, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    k = k.repartition(n, "key", "cell").sortWithinPartitions("key", "cell", "block")

    def linked(batches):
        keep = None

        def groups(data):
            key, cell, block, fp = data
            if not len(key):
                return []
            new = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
            bounds = np.concatenate(([0], new, [len(key)]))
            size = np.diff(bounds)
            out = []
            # small buckets, all of the batch at once: each member with the one off places further in its bucket
            place = np.arange(len(key)) - np.repeat(bounds[:-1], size)
            left = np.repeat(size, size) - place
            left[np.repeat(size, size) > FEW] = 0
            for off in range(1, FEW):
                at = np.flatnonzero(left > off)
                if not len(at):
                    break
                ok = _links(fp[at], fp[at + off], (key[at] >> 41).astype(np.int64))
                out += zip(fp[at[ok]].tolist(), fp[at[ok] + off].tolist())
            for i in np.flatnonzero(size > FEW).tolist():
                s, e = bounds[i], bounds[i + 1]
                cut = s + int(np.searchsorted(block[s:e], block[s], "right"))
                start = int(key[s] >> 41)
                out += _forest(fp[s:e], fp[s:e], start) if cut == e else _forest(fp[s:cut], fp[cut:e], start)
            return _thin(out)

        def emit(found):
            a = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["a", "b"])

        for batch in batches:
            data = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)] + [batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)]
            if keep is not None:
                data = [np.concatenate(x) for x in zip(keep, data)]
            # the last group may go on in the next batch
            key, cell = data[0], data[1]
            differ = np.flatnonzero((key != key[-1]) | (cell != cell[-1]))
            cut = int(differ[-1]) + 1 if len(differ) else 0
            keep = [x[cut:] for x in data]
            if found := groups([x[:cut] for x in data]):
                yield emit(found)
        if keep is not None and (found := groups(keep)):
            yield emit(found)

    return k.select("key", "cell", "block", "fp").mapInArrow(lean(linked), "a long, b long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint, component_id, kept.

    Documents whose fingerprints differ in 4 bits or fewer link; component_id is the smallest doc_id that links reach,
    and ``kept`` marks the row with that id.  Null and wordless texts have fingerprint zero and link like any other.
    Null doc_ids never are a component's id unless all of its ids are null.  Repeated rows each get their row.  Empty
    table: no rows.  Extra columns are not read.

    Texts are read once.  Documents of equal fingerprints are one node from then on, so copies are never paired.
    """
    prints = reliable(fingerprints(docs))
    nodes = reliable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    # order of nodes is that of their bits; a component's id is looked for afterwards
    roots = components(edges(nodes.select("fp")))
    placed = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    placed = reliable(placed)
    ids = free_of_order(placed.groupBy("root").agg(F.min("first_id").alias("component_id")))
    named = reliable(placed.join(ids, "root").select(F.col("fp").alias("node"), "component_id"))
    out = prints.join(named, F.col("fp") == F.col("node"))
    return out.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, one document of each component of links: that of the smallest doc_id.

    Null, empty and wordless texts have fingerprint zero and are one component.  A null id stays only in a component
    without other ids.  Rows that repeat an id stay or go together: all of them, if one is the first of a component.
    An empty table gives an empty one; further columns pass through.  The ids that go are broadcast if they are few; else rows are dealt by
    id once.
    """
    ids = near_dedup(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = small_side(reliable(ids.where(~F.col("kept")).select(F.struct(F.col("doc_id").alias("id")).alias("_gone"))))
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    return rows.join(gone, F.col("_row")["doc_id"].eqNullSafe(F.col("_gone")["id"]), "left_anti").select("_row.*")
