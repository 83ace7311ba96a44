"""Whole Arrow text columns as numpy bytes: words, hashes and shingles without per-row Python."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}

CHUNK_BYTES = 1 << 21


class Chunk(NamedTuple):
    """Rows [lo, hi) of a batch: their concatenated UTF-8 bytes and hi - lo + 1 offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string or binary column (nulls count as empty) into pieces of about `limit` bytes, never inside a row."""
    if pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary()).fill_null(b"")
    else:
        column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Chunk(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1024)
        for key, base in (("p", _P), ("i", _P_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["p"], _powers["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial byte hash; spans(prefix, s, e) hashes any span from them."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start])


class Words(NamedTuple):
    """Words of a chunk: byte spans, and for each row the range of its words."""

    start: np.ndarray
    end: np.ndarray
    rows: np.ndarray


def words(chunk: Chunk) -> Words:
    """Maximal runs of bytes other than blank, tab, LF, VT, FF and CR; runs never cross rows."""
    data, off = chunk.data, chunk.offsets
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = inside[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = inside[tails]
    s = np.flatnonzero(first)
    return Words(s, np.flatnonzero(last) + 1, np.searchsorted(s, off))


def word_hashes(chunk: Chunk, w: Words) -> np.ndarray:
    return spans(prefix(lower(chunk.data)), w.start, w.end)


_STEP = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                  0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def shingles(h: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each row and the rows' ranges; a row of 1 to k-1 words gives its whole sequence."""
    n = np.diff(rows)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_rows = np.concatenate([[0], np.cumsum(count)])
    total = int(out_rows[-1])
    at = np.arange(total) - np.repeat(out_rows[:-1] - rows[:-1], count)
    length = np.repeat(np.minimum(n, k), count)
    acc = np.zeros(total, np.uint64)
    for j in range(k):
        if j == 0:
            acc += h[at] * _STEP[0]
        else:
            ok = length > j
            if ok.all():
                acc += h[at + j] * _STEP[j]
            else:
                acc[ok] += h[at[ok] + j] * _STEP[j]
    acc += (length.astype(np.uint64) * _STEP[7])
    return mix(acc), out_rows


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Numbers of common elements of every two sets, as products of incidence matrices of at most `width` columns."""
    size = np.array([len(x) for x in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    if not size.sum():
        return both
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    slot = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[at]
    row = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(slot, kind="stable")
    slot, row = slot[order], row[order]
    for lo in range(0, int((n > 1).sum()), width):
        a, b = np.searchsorted(slot, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[row[a:b], slot[a:b] - lo] = 1
        both += m @ m.T
    both[np.arange(len(sets)), np.arange(len(sets))] = size
    return both
