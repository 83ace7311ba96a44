"""Document quality from raw bytes: a small convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanetrack.llm import bytesets as B
from wanetrack.llm.labelled import held_out, labelled_sample

_LOW = np.float32(-1e30)


@dataclass(frozen=True)
class Shape:
    """Filters of `width` bytes; chunks of two `half` blocks, each overlapping the next by one."""

    filters: int = 16
    width: int = 6
    half: int = 192
    block: int = 1 << 16


class ByteCNN:
    """conv -> ReLU-free max over each chunk -> max, min and mean over chunks -> logistic unit.

    The first layer works on one-hot bytes, so a filter is a table of 256 weights for each
    of its positions; two positions at a time are looked up as one 16-bit pair.
    """

    def __init__(self, shape: Shape = Shape(), seed: int = 3):
        rng = np.random.default_rng(seed)
        self.shape = shape
        self.table = rng.normal(0, 0.3, (shape.width, 256, shape.filters)).astype(np.float32)
        self.out = rng.normal(0, 0.1, 3 * shape.filters).astype(np.float32)
        self.bias = np.float32(0.0)

    def _pairs(self) -> list[np.ndarray]:
        t, f = self.table, self.shape.filters
        return [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, f) for j in range(0, self.shape.width, 2)]

    def _padded(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with `width` zeros after every row; places where no filter may start; the starts of half blocks; the rows' ranges.

        Filters start at a row's own bytes, or once in the padding of an empty row, so they never reach the next row.
        """
        pad, n = self.shape.width, np.diff(off)
        places = off[:-1] + pad * np.arange(len(n))
        out = np.zeros(len(data) + pad * len(n) + pad, np.uint8)
        at = np.arange(len(data)) + np.repeat(pad * np.arange(len(n)), n)
        out[at] = data
        shut = np.ones(len(out), bool)
        shut[at] = False
        shut[places[n == 0]] = False
        count = np.maximum(1, -(-n // self.shape.half))
        first = np.concatenate([[0], np.cumsum(count)])
        starts = np.repeat(places - self.shape.half * first[:-1], count) + self.shape.half * np.arange(first[-1])
        return out, shut, starts, first

    def _halves(self, padded: np.ndarray, shut: np.ndarray, starts: np.ndarray, arg: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each half block, and where it is."""
        s, pairs = self.shape, self._pairs()
        code = padded[:-1].astype(np.int32) << 8 | padded[1:]
        top = np.empty((len(starts), s.filters), self.table.dtype)
        at = np.empty((len(starts), s.filters), np.int64) if arg else None
        total = len(padded) - s.width + 1
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + s.block)))
            a, b = starts[lo], starts[hi] if hi < len(starts) else total
            r = pairs[0][code[a:b]]
            for k in range(1, len(pairs)):
                r += pairs[k][code[a + 2 * k : b + 2 * k]]
            r[shut[a:b]] = _LOW
            cut = starts[lo:hi] - a
            if arg:
                for i, (x, y) in enumerate(zip(cut, [*cut[1:], b - a], strict=True)):
                    w = r[x:y].argmax(0)
                    at[lo + i] = a + x + w
                    top[lo + i] = r[x + w, np.arange(s.filters)]
            else:
                top[lo:hi] = np.maximum.reduceat(r, cut)
            lo = hi
        return top, at

    def _features(self, top: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Chunks join each half block with the next of its row; rows take max, min and mean over chunks."""
        n = np.diff(first)
        last = np.zeros(len(top), bool)
        last[first[1:] - 1] = True
        nxt = np.where((~last)[:, None], np.vstack([top[1:], top[-1:]]), _LOW)
        pick = nxt > top
        chunk = np.where(pick, nxt, top)
        keep = ~(last & np.repeat(n > 1, n))
        rows = np.flatnonzero(keep)
        heads = np.searchsorted(rows, first[:-1])
        c = chunk[rows]
        count = np.diff(np.append(heads, len(rows)))[:, None]
        z = np.hstack([np.maximum.reduceat(c, heads), np.minimum.reduceat(c, heads), np.add.reduceat(c, heads) / count])
        return np.tanh(z / 4), (pick[rows], rows, heads, c, count[:, 0])

    def probabilities(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        padded, shut, starts, first = self._padded(data, off)
        top, _ = self._halves(padded, shut, starts, False)
        x, _ = self._features(top, first)
        return 1 / (1 + np.exp(-np.clip((x @ self.out + self.bias).astype(np.float64), -60, 60)))

    def gradient(self, data: np.ndarray, off: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the mean log loss, by the filters, the output weights and the bias; that of a maximum goes to the bytes it was read from."""
        f = self.shape.filters
        padded, shut, starts, first = self._padded(data, off)
        top, at = self._halves(padded, shut, starts, True)
        x, (pick, rows, heads, c, count) = self._features(top, first)
        p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.bias, -30, 30)))
        g = (p - y).astype(self.table.dtype) / len(y)
        gz = (g[:, None] * self.out) * (1 - x * x) / 4
        doc = np.repeat(np.arange(len(y)), count)
        gc = gz[doc, 2 * f :] / count[doc][:, None]
        for k, ends in ((0, np.maximum.reduceat(c, heads)), (1, np.minimum.reduceat(c, heads))):
            hit = (ends[doc] == c).astype(c.dtype)  # overlapping chunks may share the half block that is the largest
            gc = gc + hit / np.add.reduceat(hit, heads)[doc] * gz[doc, k * f : (k + 1) * f]
        src = at[rows[:, None] + pick, np.arange(f)]
        table = np.zeros_like(self.table)
        for j in range(self.shape.width):
            np.add.at(table[j], (padded[src + j], np.broadcast_to(np.arange(f), src.shape)), gc)
        return table, x.T @ g, float(g.sum())

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 1024, batch: int = 32, rate: float = 0.02) -> ByteCNN:
        """Adam on the log loss.

        A small sample is passed over more often, so that training takes about as many steps.
        """
        rng = np.random.default_rng(11)
        params = [self.table, self.out]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        bm = bv = 0.0
        step = 0
        epochs = max(1, steps * batch // len(texts))
        for epoch in range(epochs):
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                ids = order[lo : lo + batch]
                off = np.concatenate([[0], np.cumsum([len(texts[i]) for i in ids])])
                data = np.frombuffer(b"".join(texts[i] for i in ids), np.uint8)
                g_table, g_out, gb = self.gradient(data, off, y[ids])
                step += 1
                for q, gq, (m, v) in zip(params, (g_table, g_out), moments, strict=True):
                    m += 0.1 * (gq - m)
                    v += 0.001 * (gq * gq - v)
                    q -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
                bm += 0.1 * (gb - bm)
                bv += 0.001 * (gb * gb - bv)
                self.bias -= np.float32(now * (bm / (1 - 0.9**step)) / (np.sqrt(bv / (1 - 0.999**step)) + 1e-7))
        return self


#: Labelled rows that training takes at most.
TRAIN_ROWS = 4096


def train_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, remainder: int = 0, limit: int = TRAIN_ROWS
) -> ByteCNN:
    """Fits on at most `limit` labelled rows outside the held-out fold. Without any, every score is 0.5.

    The sample and its handling of nulls, repeats and empty tables are those of labelled_sample().
    """
    rows = labelled_sample(docs, labels, "quality", ~held_out(folds, remainder), limit)
    net = ByteCNN()
    if rows.empty:
        net.out[:] = 0
        return net
    return net.fit([t.encode() for t in rows["text"]], rows["label"].to_numpy(np.float32))


def score_quality(docs: DataFrame, net: ByteCNN) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every whole text.

    Null and empty texts are scored as a run of padding; repeated rows are scored as often
    as they occur; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(net.probabilities(c.data, c.offsets))],
                    names=["doc_id", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, net).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, net: ByteCNN, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least `threshold`.

    Null and empty texts are scored as by score_quality(); repeated rows fare alike; a
    score equal to the threshold stays; an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in B.chunks(batch.column(at)):
                good = net.probabilities(c.data, c.offsets) >= threshold
                yield batch.slice(c.lo, c.hi - c.lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
