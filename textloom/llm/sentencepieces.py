"""SentencePiece encoding by suffix-array matching, and decoding.

A batch's new units (words with their space) are concatenated and indexed by a suffix array as deep as the longest
piece; every piece is binary-searched for its range of occurrences; the edges so found are sorted by position and
relaxed from left to right.  For a byte-pair model the relaxation keeps, at each position, the last piece of that
prefix's encoding: of the edges that end there exactly one fits behind the last piece where it starts, because an
encoding is right if and only if each two neighbours are.  Ids are those of the model's own encoder.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, worker_cache

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units whose ids a worker keeps, twice (a young and an old generation); characters of new units indexed at once.
CACHE, INDEXED = 100_000, 200_000
#: Pairs of pieces whose fit a worker remembers.
PAIRS = 300_000
GROUP = 64
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
NONE = -2


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: ints, floats' bytes or bytes."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + n]
        at += n


class Model:
    """Pieces of a byte-pair model with an identity normaliser."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        kind, self.prefix = 1, True
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1):
                    raise ValueError("only models that keep texts as they are")
                self.prefix = bool(norm.get(3, 1))
        if kind != 2:
            raise ValueError("only byte-pair models")
        self.unknown = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        # merge order: the best score first
        self.rank = {i: -self.scores[i] for i in self.ids.values()}
        seen: dict[float, int] = {}
        for r in self.rank.values():
            seen[r] = seen.get(r, 0) + 1
        # equal scores go from left to right, which neighbours alone can tell only within runs of spaces
        if any(seen[self.rank[i]] > 1 and len(p) > 1 and p.strip(SPACE) for p, i in self.ids.items()):
            raise ValueError("only models whose pieces of equal score are runs of spaces")
        #: pieces never go on over a space, and a line feed is in none: texts can be cut there
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.decoded = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else b" \xe2\x81\x87 " if t == UNKNOWN else b"" for p, t in zip(self.pieces, self.types)]
        self._spines: dict[int, tuple[tuple, tuple]] = {}

    def char_id(self, c: str) -> int:
        return self.ids.get(c, -1)

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ids.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or self.rank[r] < best):
                    best, at = self.rank[r], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spines(self, i: int) -> tuple[tuple, tuple] | None:
        """A piece's last parts and first parts, from single characters to itself, in the order its merges make them.

        None for a piece that merging never makes of its own characters.
        """
        if i not in self._spines:
            parts = list(self.pieces[i])
            last, first = [parts[-1]], [parts[0]]
            while len(parts) > 1:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    r = self.ids.get(parts[k] + parts[k + 1])
                    if r is not None and (best is None or self.rank[r] < best):
                        best, at = self.rank[r], k
                if best is None:
                    break
                # the model's own string, so that spines hold no copies
                parts[at : at + 2] = [self.pieces[self.ids[parts[at] + parts[at + 1]]]]
                if parts[-1] != last[-1]:
                    last.append(parts[-1])
                if parts[0] != first[0] and parts[0] != first[-1]:
                    first.append(parts[0])
            self._spines[i] = (tuple(last), tuple(first)) if len(parts) == 1 else None
        return self._spines[i]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces are the encoding of their concatenation.

        As merging goes on, the parts on either side of the border grow along the spines; they fit unless the two that
        meet at some time are merged before either grows.  Runs of spaces have one score, so that their merges go from
        left to right: whether two of them are neighbours is what merging the whole run gives.
        """
        x, y = self.pieces[left], self.pieces[right]
        if not x.strip(SPACE) and not y.strip(SPACE):
            return self.merge(x + y) == [x, y]
        a, b = self.spines(left), self.spines(right)
        if a is None or b is None:
            return False
        a, b = a[0], b[1]
        i = j = 0
        inf = float("inf")
        made = lambda p: self.rank[self.ids[p]]
        ta, tb = [inf] * (len(a) + 1), [inf] * (len(b) + 1)
        # a part is made no earlier than the parts it is made of
        for spine, t in ((a, ta), (b, tb)):
            before = -inf
            for k in range(1, len(spine)):
                before = t[k] = max(before, made(spine[k]))
        while True:
            x = self.ids.get(a[i] + b[j])
            if x is not None and self.rank[x] < ta[i + 1] and self.rank[x] <= tb[j + 1]:
                return False
            if ta[i + 1] == tb[j + 1] == inf:
                return True
            if ta[i + 1] <= tb[j + 1]:
                i += 1
            else:
                j += 1


class Fits:
    """Which pairs of pieces fit, by key: the pairs met lately, in sorted arrays of nine bytes a pair.

    New pairs are gathered beside them and merged in when they are a tenth as many; PAIRS at most are kept.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, bool))] * 2

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.parts)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is known, and whether it fits if so."""
        known, fits = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for have, ok in self.parts:
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                here = have[at] == keys
                known |= here
                fits |= here & ok[at]
        return known, fits

    def add(self, keys: np.ndarray, fits: np.ndarray) -> None:
        """Adds keys that aren't known."""
        if len(self) + len(keys) > PAIRS:
            self.clear()
        few = self._merged(self.parts[1], (keys[:PAIRS], fits[:PAIRS]))
        if len(few[0]) * 10 > len(self.parts[0][0]):
            self.parts = [self._merged(self.parts[0], few), (np.zeros(0, np.int64), np.zeros(0, bool))]
        else:
            self.parts = [self.parts[0], few]

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, fits = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
        order = np.argsort(keys, kind="stable")
        return keys[order], fits[order]


class SuffixEncoder:
    def __init__(self, model: Model):
        self.model = m = model
        chars = sorted({c for p in m.ids for c in p})
        if len(chars) > 65_000:
            raise ValueError("too many characters")
        self.code = {c: k + 1 for k, c in enumerate(chars)}
        table = np.full(0x110000, 0xFFFE, dtype=np.uint16)
        table[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.table = table
        # pieces that their own characters make, in the order of their codes
        able = [(p, i) for p, i in m.ids.items() if m.spines(i) is not None]
        width = m.longest
        self.width = width
        low = np.zeros((len(able), width), dtype=">u2")
        high = np.full((len(able), width), 0xFFFF, dtype=">u2")
        for k, (p, _) in enumerate(able):
            low[k, : len(p)] = high[k, : len(p)] = [self.code[c] for c in p]
        kind = f"S{2 * width}"
        self.low, self.high = low.view(kind).ravel(), high.view(kind).ravel()
        self.piece_ids = np.array([i for _, i in able], dtype=np.int32)
        self.piece_lens = np.array([len(p) for p, _ in able], dtype=np.int32)
        self.single = np.zeros(0x10000, dtype=bool)
        self.single[[self.code[p] for p, _ in able if len(p) == 1]] = True
        self.fit = Fits()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.byte_ids = {c: np.array([m.bytes.get(b, m.unknown) for b in c.encode()] if m.bytes else [m.unknown], dtype="<u4").tobytes() for c in ("\n",)}
        self.long_units = re.compile(rf"\n[^{SPACE}\n]*|{SPACE}+[^{SPACE}\n]*|^[^{SPACE}\n]+")

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every occurrence of every piece in the concatenated units; 0 separates them."""
        padded = np.concatenate((codes, np.zeros(self.width, dtype=np.uint16))).astype(">u2")
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(codes)]).view(self.low.dtype).ravel()
        order = np.argsort(suffixes, kind="stable").astype(np.int32)
        suffixes = suffixes[order]
        first, last = np.searchsorted(suffixes, self.low, "left"), np.searchsorted(suffixes, self.high, "right")
        there = np.flatnonzero(last > first).astype(np.int32)
        n = (last - first)[there]
        place = np.arange(n.sum(), dtype=np.int32)
        place += np.repeat((first[there] - np.cumsum(n) + n).astype(np.int32), n)
        return order[place], np.repeat(there, n)

    def _fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        v = len(self.model.pieces)
        keys, back = np.unique(left.astype(np.int64) * v + right, return_inverse=True)
        known, out = self.fit.get(keys)
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = [self.model.fits(*divmod(key, v)) for key in keys[new].tolist()]
            self.fit.add(keys[new], out[new])
        return out[back]

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit (without line feeds), as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at, size = 0, 0
        for k, u in enumerate(units):
            size += len(u) + 1
            if size >= INDEXED or k == len(units) - 1:
                out += self._indexed(units[at : k + 1])
                at, size = k + 1, 0
        return out

    def _indexed(self, units: list[str]) -> list[bytes]:
        m = self.model
        text = "\0".join(units) + "\0"
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        codes = self.table[chars]
        codes[ends] = 0
        # there are several edges a character: 32 bits each, and none kept for longer than it is read
        at, which = self.edges(codes)
        to = at + self.piece_lens[which]
        piece = self.piece_ids[which]
        del which
        lone = np.flatnonzero(~self.single[codes] & (codes != 0)).astype(np.int32)
        if len(lone):
            at, to, piece = np.concatenate((at, lone)), np.concatenate((to, lone + 1)), np.concatenate((piece, np.full(len(lone), -1, np.int32)))
        # edges by the place where they end, counted from their unit's start
        first = np.repeat(starts, lengths + 1).astype(np.int32)
        place = to - first[at]
        order = np.argsort(place, kind="stable").astype(np.int32)
        at, to, piece, place = at[order], to[order], piece[order], place[order]
        del order
        cuts = np.searchsorted(place, np.arange(1, (place[-1] if len(place) else 0) + 2))
        last = np.full(len(codes) + 1, NONE, dtype=np.int32)
        came = np.full(len(codes) + 1, -1, dtype=np.int32)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, e, p = at[a:b], to[a:b], piece[a:b]
            left = last[s]
            begins = s == first[s]
            ok = begins | ((left != NONE) & ((left < 0) | (p < 0)))
            ask = np.flatnonzero(~ok & (left >= 0) & (p >= 0))
            if len(ask):
                ok[ask] = self._fitting(left[ask], p[ask])
            last[e[ok]] = p[ok]
            came[e[ok]] = s[ok]
        del at, to, piece, place
        # back from the units' ends
        pos, unit, steps = ends.copy(), np.arange(len(units)), []
        while len(pos):
            go = pos > starts[unit]
            pos, unit = pos[go], unit[go]
            if len(pos):
                steps.append((unit, last[pos], came[pos]))
                pos = came[pos]
        if not steps:
            return [b""] * len(units)
        who = np.concatenate([s[0] for s in steps])
        ids = np.concatenate([s[1] for s in steps])
        where = np.concatenate([s[2] for s in steps])
        order = np.lexsort((where, who))
        who, ids, where = who[order], ids[order], where[order]
        bounds = np.searchsorted(who, np.arange(len(units) + 1)).tolist()
        data = ids.astype("<u4").tobytes()
        odd = set(who[ids < 0].tolist())
        out = []
        for k in range(len(units)):
            a, b = bounds[k], bounds[k + 1]
            if k in odd:
                out.append(b"".join(self._char(chr(chars[w])) if i < 0 else data[4 * n : 4 * n + 4] for n, i, w in zip(range(a, b), ids[a:b].tolist(), where[a:b].tolist())))
            else:
                out.append(data[4 * a : 4 * b])
        return out

    def _char(self, c: str) -> bytes:
        m = self.model
        return np.array([m.bytes.get(b, m.unknown) for b in c.encode("utf-8", "replace")] if m.bytes else [m.unknown], dtype="<u4").tobytes()

    def units(self, text: str) -> list[str]:
        """Keys of a text's units: each has a space before it that the key leaves out, or begins with a line feed."""
        s = text.replace(" ", SPACE)
        if not self.model.prefix or not self.model.cuts:
            raise ValueError("this model's pieces cross spaces")
        if SPACE + SPACE not in s and s[0] != SPACE:
            return (SPACE + s).replace("\n", SPACE + "\n").split(SPACE)[1:]
        return [u if u[0] == "\n" else u[1:] for u in self.long_units.findall(SPACE + s)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as little-endian unsigned 32-bit integers; none for an empty text."""
        out = []
        # one string a distinct unit: a text's own copies go before the next text is cut
        same: dict[str, str] = {}
        parts = [[same.setdefault(u, u) for u in self.units(t)] if t else [] for t in texts]
        missing = []
        for u in same.keys() - self.young.keys():
            if (ids := self.old.get(u)) is not None:
                self.young[u] = ids
            else:
                missing.append(u)
        plain = [u[1:] if u[:1] == "\n" else SPACE + u for u in missing]
        for u, ids in zip(missing, self.encode_units(plain)):
            self.young[u] = self.byte_ids["\n"] + ids if u[:1] == "\n" else ids
        get = self.young.__getitem__
        out = [b"".join(map(get, p)) for p in parts]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, as UTF-8; the space that encoding put first is taken off."""
        pieces = self.model.decoded
        out = b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        return out[1:] if out[:1] == b" " else out


_ENCODERS: dict[str, SuffixEncoder] = worker_cache("sentencepieces")


def encoder(path: str) -> SuffixEncoder:
    """One per worker process until it runs tasks of another operator, so that later tasks meet a warm cache."""
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            _ENCODERS[path] = SuffixEncoder(Model(f.read()))
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_crc32, text_crc32, round_trip; with_ids adds the ids, keep other columns.

    Encodes whole texts and decodes the ids again: text_crc32 is that of the decoded text's UTF-8, and round_trip tells
    whether it is the text (a text that holds U+2581 itself comes back with a space there).  Null text counts as empty:
    no ids, crc 0.  Null doc_ids and repeated rows get a row each; an empty table gives none; columns that aren't kept
    are not read.  Texts are read once, with no shuffle.  ``model`` is a path that is there on every node.
    """
    path = model or model_path()
    kept = [docs.schema[c] for c in ("doc_id", *keep)]

    def worked(batches):
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP * 16):
                some = batch.slice(at, GROUP * 16)
                texts = [t or "" for t in some.column(0).to_pylist()]
                ids = enc.encode(texts)
                back = [enc.decode(i) for i in ids]
                columns = [
                    *some.columns[1:],
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(b) for b in back], pa.int64()),
                    pa.array([b == t.encode() for b, t in zip(back, texts)], pa.bool_()),
                ]
                names = [*some.schema.names[1:], "n_tokens", "ids_crc32", "text_crc32", "round_trip"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(i, dtype="<i4") for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens long, ids_crc32 long, text_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select("text", *(f.name for f in kept)).mapInArrow(lean(worked, "sentencepieces"), schema)
