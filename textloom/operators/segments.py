"""Segments of an index: what a task writes about some thousand files, as packed lists of the files' numbers.

A segment is made in the task that has the texts, so nothing is shuffled, and a row for each of its trigrams and words
is sorted instead of one for each in each file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

#: Kinds of rows: a trigram with its files, a word with its files and how often each has it, and the files' paths.
TRIGRAM, WORD, PATHS = 0, 1, 2
SCHEMA = "kind int, key string, segment long, ids binary, counts array<int>, paths array<string>"
_LIST = lambda t: pa.list_(pa.field("element", t))
ARROW = pa.schema([("kind", pa.int32()), ("key", pa.string()), ("segment", pa.int64()), ("ids", pa.binary()), ("counts", _LIST(pa.int32())), ("paths", _LIST(pa.string()))])

#: Most files of a segment (their numbers take 14 bits), and about the most entries of its lists.
FILES, ENTRIES = 1 << 13, 1 << 22
#: Characters of a text that are looked at together.
PIECE = 1 << 22

_WORD = re.compile(rb"[A-Za-z0-9_]+")


def packed(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Lists of ascending numbers, that begin at ``starts``, as differences of one or two bytes each."""
    gaps = np.diff(ids, prepend=0)
    gaps[starts] = ids[starts]
    long = gaps > 127
    at = np.concatenate([[0], np.cumsum(1 + long)])
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]] = np.where(long, gaps & 127 | 128, gaps)
    out[at[:-1][long] + 1] = gaps[long] >> 7
    offsets = np.concatenate([at[starts], at[-1:]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def _numbers(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of packed lists that lie one after another, and the list that each is of.  No list is empty."""
    long = raw > 127
    first = np.concatenate([[True], ~long[:-1]]) if len(raw) else long
    values = (raw & 127).astype(np.int64)
    values[:-1] += np.where(long[:-1], raw[1:].astype(np.int64) << 7, 0)
    of = np.searchsorted(offsets, np.flatnonzero(first), "right") - 1
    sums = np.cumsum(values[first])
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    before = np.concatenate([[0], sums[starts[1:] - 1]])[: len(starts)]
    return sums - before[of], of


def unpacked(data: bytes) -> np.ndarray:
    """The numbers of one packed list."""
    return _numbers(np.frombuffer(data, np.uint8), np.array([0]))[0]


def trigrams(low: str) -> np.ndarray:
    """Distinct trigrams of a text in the order of their characters, 21 bits a character."""
    out = np.empty(0, np.uint64)
    for at in range(0, len(low) - 2, PIECE):
        c = np.frombuffer(low[at : at + PIECE + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        found = np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
        out = np.union1d(out, found) if at else found
    return out


def words(data: bytes) -> Counter:
    """How often each word of 3 to 32 characters is in a text, in lower case."""
    return Counter(w for w in _WORD.findall(data.lower()) if 3 <= len(w) <= 32)


def batch(kind: int, keys: Iterable, segment: int, ids: pa.Array, counts: pa.Array | None = None, paths: list[list] | None = None) -> pa.RecordBatch:
    keys = list(keys)
    n = len(keys)
    columns = [pa.array([kind] * n, pa.int32()), pa.array(keys, pa.string()), pa.array([segment] * n, pa.int64()), ids, counts, paths]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c if c is not None else [None] * n, t) for c, t in zip(columns, ARROW.types)], schema=ARROW)


def _segment(number: int, paths: list[str], grams: list[np.ndarray], counted: list[Counter]) -> Iterator[pa.RecordBatch]:
    yield batch(PATHS, [None], number, None, None, [paths])
    codes = np.concatenate(grams)
    if len(codes):
        order = np.argsort(codes, kind="stable")
        ids, codes = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order], codes[order]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        text = lambda c: chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF)
        yield batch(TRIGRAM, map(text, codes[starts].tolist()), number, packed(ids, starts))
    held: dict[bytes, tuple[list, list]] = {}
    for i, c in enumerate(counted):
        for word, n in c.items():
            of = held.setdefault(word, ([], []))
            of[0].append(i)
            of[1].append(n)
    if held:
        sizes = np.array([len(of[0]) for of in held.values()])
        starts = np.cumsum(sizes) - sizes
        ids = np.concatenate([of[0] for of in held.values()])
        counts = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array([n for of in held.values() for n in of[1]], pa.int32()))
        yield batch(WORD, [w.decode() for w in held], number, packed(ids, starts), counts.cast(ARROW.types[4]))


def made(build: int, files: int = FILES, entries: int = ENTRIES):
    """A function that makes segments of batches of (path, data).  Their numbers hold the build and the task's partition."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = build << 44 | TaskContext.get().partitionId() << 20
        paths, grams, counted, size = [], [], [], 0
        for b in batches:
            for path, data in zip(b.column(0), b.column(1)):
                data = data.as_py()
                paths.append(path.as_py())
                grams.append(trigrams(data.decode("utf-8", "replace").lower()))
                counted.append(words(data))
                size += len(grams[-1]) + len(counted[-1])
                if len(paths) >= files or size >= entries:
                    yield from _segment(number, paths, grams, counted)
                    paths, grams, counted, size, number = [], [], [], 0, number + 1
        if paths:
            yield from _segment(number, paths, grams, counted)

    return work


def living(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of trigrams and words (with column ``live``, a bit for each file of their segment) without files that aren't live."""
    for b in batches:
        if not b.num_rows:
            continue
        kinds, keys, numbers, lists, counts, live = (b.column(i) for i in range(6))
        offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + b.num_rows + 1]
        ids, of = _numbers(np.frombuffer(lists.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0])
        _, one, segment = np.unique(numbers.to_numpy(), return_index=True, return_inverse=True)
        alive = np.zeros((len(one), FILES), bool)
        for k, row in enumerate(one.tolist()):
            flags = np.unpackbits(np.frombuffer(live[row].as_py(), np.uint8))
            alive[k, : len(flags)] = flags
        keep = alive[segment[of], ids]
        left = np.bincount(of[keep], minlength=b.num_rows)
        some = np.flatnonzero(left)
        if not len(some):
            continue
        # only words have counts: those of a row that has none are not in the flat array
        counted = counts.is_valid().to_numpy(zero_copy_only=False)
        values = counts.flatten().filter(pa.array(keep[counted[of]]))
        sizes = np.where(counted, left, 0)[some]
        at = pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append(~counted[some], False))
        rows = pa.array(some)
        columns = [kinds.take(rows), keys.take(rows), numbers.take(rows), packed(ids[keep], np.cumsum(left[some]) - left[some]), pa.ListArray.from_arrays(at, values).cast(ARROW.types[4]), pa.nulls(len(some), ARROW.types[5])]
        yield pa.RecordBatch.from_arrays(columns, schema=ARROW)


def bits(paths: list) -> bytearray:
    """A bit for each path that is there."""
    return bytearray(np.packbits([p is not None for p in paths]).tobytes())


def holding(branches: list[list[str]], lists: list) -> list[int]:
    """Numbers of the files that hold all trigrams of some branch, from a segment's (key, ids)."""
    held = {row["key"]: row["ids"] for row in lists}
    out: set[int] = set()
    for branch in branches:
        if all(t in held for t in branch):
            ids = unpacked(held[branch[0]])
            for t in branch[1:]:
                ids = np.intersect1d(ids, unpacked(held[t]), assume_unique=True)
            out.update(ids.tolist())
    return sorted(out)
