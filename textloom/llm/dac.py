"""Directly addressable codes for token ids.

An id is cut into chunks of 8 bits, lowest first.  Level k holds the k-th chunks of the ids that have one, in order, with
a bitmap that says which ids go on in level k + 1.  A rank directory (ones before every block of 512 bits) finds an id's
place in the next level, so any token is read from a few bytes, without decoding a block.

Layout of a segment, little-endian: magic, version, number of levels, documents, tokens; per document its id, whether
it has one, and the start of its tokens (and one start more, the end); per level the number of codes, the codes, and, if
it isn't the last, the bitmap and the directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"TLDAC\x01"
HEAD = struct.Struct("<6sBxIQ")
CHUNK_BITS = 8
BLOCK = 512


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A segment of documents in the given order; ids are all their tokens, one after another."""
    ids = ids.astype(np.uint32, copy=False)
    levels, rest = [], ids
    while True:
        more = rest >= 1 << CHUNK_BITS
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> CHUNK_BITS
    out = [
        HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids)),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(),
        np.concatenate(([0], np.cumsum(lengths))).astype("<u8").tobytes(),
    ]
    for k, (codes, more) in enumerate(levels):
        out += [struct.pack("<Q", len(codes)), codes.tobytes()]
        if k < len(levels) - 1:
            bits = np.packbits(more, bitorder="little")
            bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint8)))
            ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint64)
            out += [bits.tobytes(), np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u8").tobytes() if len(ones) else b""]
    return b"".join(out)


class Segment:
    """Read access to a packed segment; nothing is decoded until it is asked for."""

    def __init__(self, blob):
        view = memoryview(blob)
        magic, n_levels, self.n_docs, self.n_tokens = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        ids, has = take("<i8", self.n_docs), take("u1", self.n_docs)
        self.doc_ids = [int(i) if h else None for i, h in zip(ids, has)]
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.codes, self.bits, self.ranks = [], [], []
        for k in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.codes.append(take("u1", n))
            if k < n_levels - 1:
                blocks = -(-n // BLOCK)
                self.bits.append(take("u1", blocks * BLOCK // 8))
                self.ranks.append(take("<u8", blocks))

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i of a level's bitmap."""
        block, bit = divmod(i, BLOCK)
        bits = self.bits[level]
        if block >= len(self.ranks[level]):
            return len(self.codes[level + 1])
        first = block * BLOCK // 8
        byte, rest = divmod(bit, 8)
        ones = int(np.bitwise_count(bits[first : first + byte]).sum())
        if rest:
            ones += int(bits[first + byte] & ((1 << rest) - 1)).bit_count()
        return int(self.ranks[level][block]) + ones

    def token(self, i: int) -> int:
        """The i-th token of the segment."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for level, codes in enumerate(self.codes):
            out |= int(codes[i]) << CHUNK_BITS * level
            if level == len(self.bits) or not self.bits[level][i >> 3] >> (i & 7) & 1:
                break
            i = self.rank(level, i)
        return out

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens start to end, found by one rank a level."""
        out = np.zeros(end - start, dtype=np.uint32)
        where = None
        for level, codes in enumerate(self.codes):
            part = codes[start:end].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            if where is None:
                out |= part
            else:
                out[where] |= part
            if level == len(self.bits) or start == end:
                break
            first = start >> 3
            more = np.unpackbits(self.bits[level][first : (end + 7) >> 3], bitorder="little")[start - first * 8 : end - first * 8].astype(bool)
            here = np.flatnonzero(more)
            where = here if where is None else where[here]
            start = self.rank(level, start)
            end = start + len(here)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))
