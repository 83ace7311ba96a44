"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact check."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanetrack.llm import bytesets as B


@dataclass(frozen=True)
class Leak:
    """A window leaks an item when their weighted shingle similarity reaches `similarity`.

    Weights are occurrence counts: sum of minima over sum of maxima. At 0.8 a window's
    64-bit fingerprint lies 9.7 +- 2.9 bits from the item's, so a radius of 20 misses it
    with probability 1.6e-4, and a passage is met by several windows. Radius + 1 blocks
    guarantee that fingerprints within the radius agree in some block. item_block: items
    that one pass over the documents looks for. run_windows: windows whose fingerprints
    are held at once (256 bytes each).
    """

    shingle_words: int = 5
    similarity: float = 0.8
    radius: int = 20
    item_block: int = 32768
    run_windows: int = 16384


class Items:
    """One block of benchmark items: shingles, fingerprints and block tables by window size."""

    def __init__(self, ids: list[int], texts: list[str | None], p: Leak):
        self.p = p
        self.ids: list[int] = []
        self.sets: list[np.ndarray] = []
        self.words: list[int] = []
        at = 0
        for c in B.chunks(pa.array(texts, pa.string())):
            w = B.words(c)
            x, rows = B.shingles(B.word_hashes(c, w), w.rows, p.shingle_words)
            for i in range(c.hi - c.lo):
                if rows[i + 1] > rows[i]:
                    self.ids.append(ids[at + i])
                    self.sets.append(x[rows[i] : rows[i + 1]])
                    self.words.append(int(w.rows[i + 1] - w.rows[i]))
            at += c.hi - c.lo
        self.by_size: dict[int, np.ndarray] = {
            n: np.array([i for i, m in enumerate(self.words) if m == n]) for n in set(self.words)
        }
        self.prints = np.array([fingerprints(s, np.array([0]), len(s))[0] for s in self.sets], np.uint64)
        bounds = np.linspace(0, 64, p.radius + 2).astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(bounds, bounds[1:], strict=False)]
        #: size -> per block: items sorted by the block's bits, and those bits.
        self.tables = {
            n: [(m[o], v[o]) for s, k in self.blocks for v in [self.prints[m] >> s & k] for o in [np.argsort(v)]]
            for n, m in self.by_size.items()
        }
        # shingle -> sizes of the windows that it calls for
        pairs = sorted({(int(x), n) for s, n in zip(self.sets, self.words, strict=True) for x in s.tolist()})
        self.keys = np.array([x for x, _ in pairs], np.uint64)
        self.sizes = np.array([n for _, n in pairs], np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def near(self, n: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) pairs of size n within the radius."""
        found: set[tuple[int, int]] = set()
        for (s, k), (items, bits) in zip(self.blocks, self.tables[n], strict=True):
            v = prints >> s & k
            lo, hi = np.searchsorted(bits, v, "left"), np.searchsorted(bits, v, "right")
            count = hi - lo
            if not count.any():
                continue
            win = np.repeat(np.arange(len(v)), count)
            item = items[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
            close = np.bitwise_count(prints[win] ^ self.prints[item]) <= self.p.radius
            found.update(zip(win[close].tolist(), item[close].tolist(), strict=True))
        return sorted(found)


def fingerprints(x: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """64-bit SimHashes of the windows x[s : s + length], by running sums of every bit."""
    bits = np.unpackbits(B.mix(x ^ B._STEP[4]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(x) + 1, 64), np.int32)
    np.cumsum(bits.astype(np.int8) * 2 - 1, axis=0, out=sums[1:], dtype=np.int32)
    ones = sums[starts + length] - sums[starts] > 0
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64)[:, 0]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima over sum of maxima of occurrence counts."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    low = sum(min(n, y[k]) for k, n in x.items())
    return low / (len(a) + len(b) - low)


def _matches(c: B.Chunk, items: Items) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, words) of the best window of each leaked item."""
    p = items.p
    w = B.words(c)
    h = B.word_hashes(c, w)
    depths = sorted({min(p.shingle_words, n) for n in items.by_size})
    n_words = np.diff(w.rows)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k in depths:
        x, rows = B.shingles(h, w.rows, k)
        # Only windows that hold a shingle of an item of their size can be similar to it.
        hit = np.flatnonzero(items.seen[(x >> np.uint64(42)).astype(np.int64)])
        lo = np.searchsorted(items.keys, x[hit], "left")
        count = np.searchsorted(items.keys, x[hit], "right") - lo
        if not count.any():
            continue
        at = np.repeat(hit, count)
        size = items.sizes[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        if k == p.shingle_words:
            keep = size >= k
        else:
            keep = size == k
        at, size = at[keep], size[keep]
        row = np.searchsorted(rows, at, "right") - 1
        order = np.lexsort((at, row, size))
        at, size, row = at[order], size[order], row[order]
        length = np.minimum(size, n_words[row])
        most = rows[row] + np.maximum(n_words[row] - length, 0)
        first = np.clip(at - np.maximum(length - k, 0), rows[row], most)
        last = np.minimum(at, most)
        i = 0
        while i < len(at):
            # windows of hits that lie side by side form one run
            n, r, j, end = int(size[i]), int(row[i]), i + 1, int(last[i])
            while j < len(at) and size[j] == n and row[j] == r and first[j] <= end + 1:
                end = max(end, int(last[j]))
                j += 1
            a = int(first[i])
            m = max(int(length[i]) - k + 1, 1)
            for lo in range(a, end + 1, p.run_windows):
                hi = min(lo + p.run_windows, end + 1)
                run = x[lo : hi - 1 + m]
                for win, item in items.near(n, fingerprints(run, np.arange(hi - lo), m)):
                    s = similarity(run[win : win + m], items.sets[item])
                    if s >= p.similarity and s > best.get((r, item), (0.0,))[0]:
                        best[r, item] = (s, lo + win - int(rows[r]), int(length[i]))
            i = j
    for (r, item), (s, start, n) in sorted(best.items()):
        yield r, items.ids[item], s, start, n


LEAKS = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def leaks(docs: DataFrame, benchmark: DataFrame, p: Leak = Leak()) -> DataFrame:
    """One row a document and benchmark item that it holds: the best window's similarity and place.

    Windows have the item's number of words, or the whole document where that is shorter.
    The benchmark is the stated query set: it is taken in blocks of about p.item_block
    items, each a bounded broadcast and one pass over all documents. Null and empty texts
    and items match nothing; an item shorter than a shingle matches by its whole
    sequence; equal items and repeated rows are each reported; of windows that are equally
    similar the first is told; either table may be empty; other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    blocks = max(1, -(-wanted.count() // p.item_block))
    key = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = spark.createDataFrame([], LEAKS)
    for b in range(blocks):
        rows = wanted.filter(key == b).orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items(*block.value, p)
            if not items.ids:
                return
            for batch in batches:
                for c in B.chunks(batch.column(1)):
                    found = list(_matches(c, items))
                    ids = batch.column(0).slice(c.lo, c.hi - c.lo).take(pa.array([f[0] for f in found], pa.int64()))
                    cols = [pa.array([f[i] for f in found], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()])]
                    yield pa.RecordBatch.from_arrays([ids, *cols[1:]], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LEAKS)
        out = part if b == 0 else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, p: Leak = Leak()) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows that share a doc_id go together, if any of them holds an item. Rows without a
    doc_id cannot be named and stay. Null and empty texts hold nothing; without benchmark
    items every row stays; an empty table gives no rows.
    """
    bad = leaks(docs, benchmark, p).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("leaked_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["leaked_id"], "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
