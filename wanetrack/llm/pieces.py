"""SentencePiece encoding that keeps offsets, and decoding, from the model file alone."""

from __future__ import annotations

import functools
import heapq
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The symbol that stands for a space inside pieces.
SPACE = "▁".encode()
#: Fixed values of the file format: kinds of pieces, and the id of a BPE model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2
#: Bytes of text that are encoded at once; a longer text is taken alone.
GROUP_BYTES = 1 << 20
#: Distinct units, and pieces of them, that a worker remembers.
MEMORY, MEMORY_PIECES = 1 << 18, 1 << 22
#: Characters up to which units of one length are merged together, as rows of a matrix.
TOGETHER = 32
_NEVER = np.int32(2**31 - 1)
#: A character without a piece is this and its code point, as a symbol.
_BARE = 1 << 21
_REPLACEMENT = "�".encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, raw[at : at + n]
            at += n


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class PairTable:
    """Which piece two neighbouring symbols make, and the order of its score: a hash table that arrays are looked up in."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank, self.piece = np.full(1 << self.bits, _NEVER), np.zeros(1 << self.bits, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        for key, at, (rank, piece) in zip(keys, self._slot(keys).tolist(), pairs.values(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.rank[at], self.piece[at] = key, rank, piece

    def _slot(self, key: np.ndarray) -> np.ndarray:
        x = key ^ (key >> 32) * np.int64(40503)
        return (x * np.int64(2654435769) >> np.int64(8)) & ((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The table's row of each pair; one with the rank _NEVER where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = self._slot(key)
        open_ = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.keys[at[open_]]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
        return at


class CharacterMap:
    """The compiled map: a trie of byte strings, as a double array, each with its replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if blob else np.zeros(0, "<u4")
        self.strings = blob[4 + size :] if blob else b""

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def replacement(self, value: int) -> bytes:
        return self.strings[value : self.strings.index(b"\0", value)]

    def longest(self, raw: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At every position the length of the longest key that starts there (0: none) and its value.

        left: bytes up to the end of the text that the position belongs to. All positions
        walk the trie together, those that fall off drop out.
        """
        length, value = np.zeros(len(raw), np.int32), np.zeros(len(raw), np.int64)
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        at = np.flatnonzero(left > 0)
        node = np.full(len(at), offset(int(self.units[0])), np.int64)
        step = 0
        while len(at):
            c = raw[at + step].astype(np.int64)
            node = node ^ c
            inside = node < len(self.units)
            unit = self.units[np.where(inside, node, 0)].astype(np.int64)
            alive = inside & ((unit & (0x80000000 | 0xFF)) == c)
            at, node, unit = at[alive], node[alive], unit[alive]
            node = node ^ offset(unit)
            leaf = (unit >> 8) & 1 == 1
            length[at[leaf]] = step + 1
            value[at[leaf]] = self.units[node[leaf]].astype(np.int64) & 0x7FFFFFFF
            step += 1
            more = left[at] > step
            at, node = at[more], node[more]
        return length, value


@dataclass
class Normalised:
    """Texts end to end after normalisation. origin: the source byte each byte comes from, of its own text;
    starts: where each text begins (one more at the end); tails: the source byte each text's last piece ends at."""

    data: np.ndarray
    origin: np.ndarray
    starts: np.ndarray
    tails: np.ndarray


@dataclass
class Pieces:
    """ids, begins and ends (source bytes) of texts end to end; starts: each text's first piece, one more at the end."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    starts: np.ndarray


def _invalid(raw: bytes) -> list[int]:
    """Positions of bytes that are no part of a well-formed UTF-8 character."""
    codes = np.frombuffer(raw.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    lost = (codes >= 0xDC80) & (codes <= 0xDCFF)
    width = np.where(lost, 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
    return (np.cumsum(width) - width)[lost].tolist()


def _replaced(raw: bytes) -> str:
    return re.sub("[\udc80-\udcff]", "\ufffd", raw.decode("utf-8", "surrogateescape"))


class PieceModel:
    """A BPE model with byte fallback, read from its file.

    Unigram models, models with user-defined or unused pieces and models without byte
    fallback are refused.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        rows = [dict(_fields(v)) for k, v in fields if k == 1]
        self.pieces = [r[1].decode() for r in rows]
        self.kinds = [r.get(3, NORMAL) for r in rows]
        trainer = dict(_fields(next((v for k, v in fields if k == 2), b"")))
        spec = dict(_fields(next((v for k, v in fields if k == 3), b"")))
        if trainer.get(3, 1) != BPE or not trainer.get(35) or {USER_DEFINED, UNUSED} & set(self.kinds) or trainer.get(24):
            raise ValueError(f"{path}: a BPE model with byte fallback, without user-defined or unused pieces, is expected")
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        self.vocabulary = {
            p: (-struct.unpack("<f", r.get(2, bytes(4)))[0], i) for i, (p, r, k) in enumerate(zip(self.pieces, rows, self.kinds, strict=True)) if k == NORMAL
        }
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        space = SPACE.decode()
        #: No piece continues over the start of a run of space symbols, so units between such starts are encoded alone.
        self.cut = not any(space in p.lstrip(space) for p in self.vocabulary)
        self._forget()
        self._prepare()
        unk = trainer.get(44, " ⁇ ".encode())
        own = {CONTROL: b"", UNKNOWN: unk}
        surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else own.get(k, p.replace(space, " ").encode()) for p, k in zip(self.pieces, self.kinds, strict=True)
        ]
        self._surface = np.frombuffer(b"".join(surface), np.uint8)
        self._length = np.array([len(s) for s in surface])
        self._start = np.cumsum(self._length) - self._length
        self._kind = np.array(self.kinds)
        self._spaced = np.array([p.startswith(space) for p in self.pieces])

    # --- encoding ---

    def normalise(self, texts: Sequence[bytes]) -> Normalised:
        """Longest-prefix replacement by the character map, each byte with its source.

        A text that isn't empty gets a space in front if the model says so; bytes that are
        no character become U+FFFD; where the model removes extra spaces, those in front,
        at the end and after another go.
        """
        head = 1 if self.prefix else 0
        joined = b"".join(chain.from_iterable((b" "[: head if t else 0], t) for t in texts))
        size = np.array([len(t) + head if t else 0 for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        raw = np.frombuffer(joined, np.uint8)
        text_of = np.repeat(np.arange(len(texts)), size) if self.map or self.squeeze else None
        width = np.ones(len(raw), np.int64)
        events: dict[bytes, np.ndarray] = {}
        taken = []
        try:
            joined.decode("utf-8")
        except UnicodeDecodeError:
            for i, t in enumerate(texts):
                taken += [(begin[i] + head + p, 1, _REPLACEMENT) for p in _invalid(t)]
        if self.map:
            left = begin[text_of + 1] - np.arange(len(raw))
            if head:
                left[begin[:-1][size > 0]] = 0
            length, value = self.map.longest(raw, left)
            bad = {p for p, _, _ in taken}
            free = 0
            for p in np.flatnonzero(length):
                if p >= free and p not in bad:
                    taken.append((p, length[p], self.map.replacement(int(value[p]))))
                    free = p + length[p]
        for p, n, new in taken:
            width[p : p + n] = 0
            width[p] = len(new)
        hit = np.zeros(len(raw), bool)
        by: dict[bytes, list[int]] = {}
        for p, _, new in taken:
            hit[p] = True
            by.setdefault(new, []).append(p)
        spaces = (raw == 32) & ~hit & (width == 1)
        # first as plain spaces; the symbol is put in below
        at = np.cumsum(width) - width
        source = np.repeat(np.arange(len(raw)), width)
        data = raw[source]
        for new, where in by.items():
            if new:
                data[at[np.array(where)][:, None] + np.arange(len(new))] = np.frombuffer(new, np.uint8)
        starts = np.searchsorted(source, begin)
        tails = size - head * (size > 0)
        lead = None
        if self.squeeze:
            lead = np.zeros(len(data), bool)
            lead[at[spaces]] = True
            for new, where in by.items():
                n = len(new) - len(new.lstrip(b" "))
                if n:
                    lead[at[np.array(where)][:, None] + np.arange(n)] = True
            keep, source, tails = self._squeezed(data, source, starts, lead, begin, head)
            starts = np.concatenate([[0], np.cumsum(keep)])[starts]
            data, source = data[keep], source[keep]
        origin = source - np.repeat(begin[:-1] + head, np.diff(starts))
        np.maximum(origin, 0, out=origin)
        if self.escape:
            wide = np.where(data == 32, 3, 1)
            put = np.cumsum(wide) - wide
            where = put[data == 32]
            data, origin = np.repeat(data, wide), np.repeat(origin, wide)
            data[where[:, None] + np.arange(3)] = np.frombuffer(SPACE, np.uint8)
            starts = np.append(put, len(data))[starts]
        return Normalised(data, origin, starts, tails)

    def _squeezed(self, data, source, starts, lead, begin, head):
        """Which bytes stay where extra spaces go, the sources, and the texts' ends in the source."""
        space = data == 32
        keep = np.ones(len(data), bool)
        source = source.copy()
        tails = np.zeros(len(starts) - 1, np.int64)
        after = np.concatenate([[True], space[:-1]])
        keep[lead & after] = False
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            tails[i] = begin[i + 1] - begin[i] - head if b > a else 0
            if a == b:
                continue
            first = a + head  # the dummy prefix is a space of its own
            while first < b and space[first] and lead[first]:
                keep[first] = False
                first += 1
            if first == b:
                keep[a:b] = False
                continue
            keep[a : a + head] = True
            keep[first] = True
            source[a : a + head] = source[first]
            end = b  # a symbol that the text itself holds goes like a space here, as in the library
            while end > a and (space[end - 1] or self.escape and data[max(end - 3, a) : end].tobytes() == SPACE):
                end -= 1 if space[end - 1] else 3
            keep[end:b] = False
            if end < b:
                tails[i] = source[end] - begin[i] - head
        return keep, source, tails

    def _merge(self, unit: bytes) -> tuple[list[int], list[int]]:
        """ids and lengths in bytes of a unit's pieces: the best-scored neighbours merge first, the leftmost of equals.

        A character without a piece becomes its bytes; the last of them covers it.
        """
        symbols: list[str] = list(unit.decode())
        n, vocabulary = len(symbols), self.vocabulary
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := vocabulary.get(both := symbols[i] + symbols[j])):
                heapq.heappush(agenda, (found[0], i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != both or after[i] != j:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        ids, sizes = [], []
        for s in filter(None, symbols):
            raw = s.encode()
            if s in vocabulary:
                ids.append(vocabulary[s][1])
                sizes.append(len(raw))
            else:
                ids += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(raw)]
        return ids, sizes

    def _prepare(self) -> None:
        """Tables for merging many units at once."""
        ranks = {score: i for i, score in enumerate(sorted({v[0] for v in self.vocabulary.values()}))}
        symbols = {p: i for p, (_, i) in self.vocabulary.items()}
        for p in self.vocabulary:
            for c in p:  # a character that is in pieces but none itself
                symbols.setdefault(c, _BARE + ord(c))
        pairs = {}
        for p, (score, i) in self.vocabulary.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    pairs[symbols[p[:k]], symbols[p[k:]]] = ranks[score], i
        self._pairs = PairTable(pairs)
        self._symbol = np.arange(_BARE, _BARE + 0x110000, dtype=np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self._symbol[ord(p)] = i
        self._bytes_of = np.array([len(p.encode()) for p in self.pieces], np.int32)

    def _forget(self) -> None:
        self._known: dict[bytes, int] = {}
        self._used, self._slots = 0, 0
        self._at, self._count = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self._ids, self._sizes = np.zeros(4096, np.int32), np.zeros(4096, np.int32)

    def _keep(self, ids: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Stores the pieces of further units, end to end; their slots."""
        def room(a: np.ndarray, n: int) -> np.ndarray:
            return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

        u, k, m, n = self._used, self._slots, len(ids), len(counts)
        self._ids, self._sizes = room(self._ids, u + m), room(self._sizes, u + m)
        self._at, self._count = room(self._at, k + n), room(self._count, k + n)
        self._ids[u : u + m], self._sizes[u : u + m] = ids, sizes
        self._count[k : k + n] = counts
        self._at[k : k + n] = u + np.cumsum(counts) - counts
        self._used, self._slots = u + m, k + n
        return np.arange(k, k + n)

    def _learn(self, units: list[bytes]) -> np.ndarray:
        """Slots of units not met before: those of one length are merged together, long ones alone."""
        slots = np.zeros(len(units), np.int64)
        if not units:
            return slots
        size = np.array([len(u) for u in units])
        raw = np.frombuffer(b"".join(units), np.uint8)
        first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = np.cumsum(size)
        chars = first[ends] - first[ends - size]
        begin = np.cumsum(chars) - chars
        symbol = self._symbol[np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)]
        for n in np.unique(chars[chars <= TOGETHER]):
            rows = np.flatnonzero(chars == n)
            slots[rows] = self._keep(*self._in_bytes(*self._merge_rows(symbol[begin[rows][:, None] + np.arange(n)])))
        for i in np.flatnonzero(chars > TOGETHER):
            ids, sizes = self._merge(units[i])
            slots[i] = self._keep(np.array(ids, np.int32), np.array(sizes, np.int32), np.array([len(ids)]))[0]
        return slots

    def _in_bytes(self, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, lengths in bytes and counts, characters without a piece as their bytes; the last of these covers it."""
        bare = np.flatnonzero(symbol >= _BARE)
        if not len(bare):
            return symbol, self._bytes_of[symbol], counts
        codes = [chr(c - _BARE).encode() for c in symbol[bare].tolist()]
        width = np.ones(len(symbol), np.int64)
        width[bare] = [len(c) for c in codes]
        at = np.cumsum(width) - width
        ids = np.repeat(np.where(symbol < _BARE, symbol, 0), width)
        sizes = np.repeat(self._bytes_of[np.where(symbol < _BARE, symbol, 0)], width)
        put = _spread(at[bare], width[bare])
        ids[put] = [self.bytes[b] for c in codes for b in c]
        sizes[put] = 0
        sizes[at[bare] + width[bare] - 1] = width[bare]
        return ids, sizes, np.add.reduceat(width, np.cumsum(counts) - counts)

    def _merge_rows(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces, end to end, and their counts, of units that are the rows of a matrix of symbols.

        In each round every row merges its best pair, as _merge() would.
        """
        m, n = symbol.shape
        table, count = self._pairs, np.full(m, n)
        if n == 1:
            return symbol[:, 0], count
        out = symbol.copy()
        found = table.find(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(m, n - 1)
        rank, rows, sym = table.rank[found], np.arange(m), symbol.copy()
        # a last column that never merges stands for the end
        rank = np.column_stack([rank, np.full(m, _NEVER)])
        while True:
            best = rank.argmin(axis=1)
            every = np.arange(len(rows))
            go = rank[every, best] < _NEVER
            if not go.all():
                out[rows[~go]] = sym[~go]
                rows, sym, rank, best = rows[go], sym[go], rank[go], best[go]
                every = np.arange(len(rows))
            if not len(rows):
                break
            made = table.piece[table.find(sym[every, best], sym[every, best + 1])]
            behind = np.arange(n)[None, :] > best[:, None]
            sym = np.where(behind, np.column_stack([sym[:, 1:], sym[:, -1:]]), sym)
            rank = np.where(behind, np.column_stack([rank[:, 1:], rank[:, -1:]]), rank)
            sym[every, best] = made
            count[rows] -= 1
            last = count[rows] - 1
            for at, ok in ((best - 1, best > 0), (best, best < last)):
                i = every[ok]
                rank[i, at[ok]] = table.rank[table.find(sym[i, at[ok]], sym[i, at[ok] + 1])]
            rank[every, last] = _NEVER
        return out[np.arange(n)[None, :] < count[:, None]], count

    def _units(self, text: Normalised) -> np.ndarray:
        """Where units start: at each text, and at each run of space symbols if no piece goes over such a start."""
        d = text.data
        starts = text.starts[:-1][np.diff(text.starts) > 0]
        if not self.cut or len(d) < 3:
            return starts
        mark = np.zeros(len(d) + 3, bool)
        mark[3 : len(d) + 1] = (d[:-2] == SPACE[0]) & (d[1:-1] == SPACE[1]) & (d[2:] == SPACE[2])
        first = mark[3:] & ~mark[:-3]
        first[starts] = True
        return np.flatnonzero(first)

    def encode(self, texts: Sequence[bytes]) -> Pieces:
        """Texts, in UTF-8, as pieces with the source bytes that each of them stands for."""
        text = self.normalise(texts)
        units = self._units(text)
        bounds = np.append(units, len(text.data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(units), [None, pa.py_buffer(bounds), pa.py_buffer(text.data)]).dictionary_encode()
        if len(self._known) > MEMORY or self._used > MEMORY_PIECES:
            self._forget()
        named = coded.dictionary.to_pylist()
        slots = np.array([self._known.get(u, -1) for u in named], np.int64)
        fresh = np.flatnonzero(slots < 0)
        slots[fresh] = self._learn([named[i] for i in fresh])
        self._known.update(zip([named[i] for i in fresh], slots[fresh].tolist(), strict=True))
        slot = slots[coded.indices.to_numpy()]
        take = _spread(self._at[slot], self._count[slot])
        ids, sizes = self._ids[take], self._sizes[take]
        end = np.cumsum(sizes, dtype=np.int64)
        begin = end - sizes
        starts = np.searchsorted(begin, text.starts)
        begins = text.origin[begin]
        ends = np.append(text.origin, 0)[end]
        last = starts[1:] > starts[:-1]
        ends[starts[1:][last] - 1] = text.tails[last]
        # byte pieces but the last of a character cover nothing
        ends = np.where(sizes == 0, begins, ends)
        return Pieces(ids, begins.astype(np.int32), ends.astype(np.int32), starts)

    # --- decoding ---

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts that runs of ids stand for.

        The space that was put in front of a text goes again; control pieces are silent;
        bytes that make up no character become U+FFFD, each of them.
        """
        ids = np.asarray(ids)
        first, size = self._start[ids].copy(), self._length[ids].copy()
        if self.prefix or self.squeeze:
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                while a < b:
                    kind = self._kind[ids[a]]
                    if kind == NORMAL and self._spaced[ids[a]]:
                        first[a] += 1
                        size[a] -= 1
                        if self.squeeze and not size[a]:  # a text that is all spaces loses every one
                            a += 1
                            continue
                    if kind != CONTROL:
                        break
                    a += 1
        data = self._surface[_spread(first, size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])
        at, byte, out = ends[np.asarray(starts)], self._kind[ids] == BYTE, []
        silent = np.concatenate([[0], np.cumsum(self._kind[ids] == CONTROL)])[np.asarray(starts)]
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            raw = data[at[i] : at[i + 1]]
            try:
                if silent[i] == silent[i + 1]:
                    out.append(raw.decode("utf-8"))
                    continue
            except UnicodeDecodeError:
                pass
            # bytes make characters only within a run of byte pieces
            runs = np.flatnonzero(np.concatenate([[True], byte[a + 1 : b] != byte[a : b - 1], [True]])) + a
            held = []
            for x, y in zip(runs[:-1], runs[1:], strict=True):
                held.append(_replaced(data[ends[x] : ends[y]]))
            out.append("".join(held))
        return out


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


ENCODED = "doc_id long, n_tokens long, ids array<int>, begins array<int>, ends array<int>"


def encode_documents(docs: DataFrame, model: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, and for each piece the bytes [begin, end) of the text that it stands for.

    With `decoded`, also the text that the ids stand for, as decode_documents() gives it.

    Ids are those of the sentencepiece library for the model file. Pieces of a character
    without a piece are its bytes, the last of which covers it. Null and empty texts have no
    pieces; rows that repeat are encoded as often as they occur; a null doc_id stays null;
    an empty table gives no rows; other columns are ignored. Texts are whole: short ones
    are encoded some megabytes at a time, a long one alone, which takes about a hundred
    times its size in memory.
    """
    path, schema = model or default_model(), ENCODED + (", decoded string" if decoded else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_model(path)

        def flush(keys: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
            p = coder.encode(texts)
            bounds = pa.array(p.starts, pa.int32())
            listed = [pa.ListArray.from_arrays(bounds, pa.array(v, pa.int32())) for v in (p.ids, p.begins, p.ends)]
            back = [pa.array(coder.decode(p.ids, p.starts), pa.string())] if decoded else []
            return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(p.starts), pa.int64()), *listed, *back], names=names)

        for b in batches:
            at, held, texts = 0, 0, []
            for i in range(b.num_rows):
                t = b.column(1)[i].as_py() or b""
                if texts and held + len(t) > GROUP_BYTES:
                    yield flush(b.column(0).slice(at, len(texts)), texts)
                    at, held, texts = i, 0, []
                texts.append(t)
                held += len(t)
            if texts:
                yield flush(b.column(0).slice(at, len(texts)), texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """The rows of encode_documents with `decoded`, the text that the ids stand for."""
    path, names = model or default_model(), [*encoded.columns, "decoded"]
    ids = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_model(path)
        for b in batches:
            listed = b.column(ids)
            bounds = np.concatenate([[0], np.cumsum(listed.value_lengths().fill_null(0).to_numpy())])
            texts = coder.decode(listed.flatten().to_numpy(), bounds)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also: n_bytes, where the last piece ends in the source, and tiled, whether each span starts where its neighbour ends."""
    done = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), decoded=True)
    rest = F.greatest(F.size("ids") - 1, F.lit(0))
    return done.select(
        "doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
        (F.slice("begins", F.lit(2), rest) == F.slice("ends", F.lit(1), rest)).alias("tiled"),
    )
