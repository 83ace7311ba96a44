"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanetrack.llm import bytesets as B
from wanetrack.llm.labelled import held_out, labelled_sample


@dataclass(frozen=True)
class Grams:
    """Distinct n-grams of characters of lower-cased text, of several sizes, hashed into 2^bits features."""

    sizes: tuple[int, ...] = (4, 6, 8)
    bits: int = 22
    train_rows: int = 8192
    steps: int = 65536
    rate: float = 0.05
    ridge: float = 1e-4


def features(c: B.Chunk, g: Grams) -> Iterator[np.ndarray]:
    """The distinct features of each row of a chunk."""
    pre = B.prefix(B.lower(c.data))
    slot = np.zeros(1 << g.bits, np.int32)
    border = np.flatnonzero(np.append(c.data & 0xC0 != 0x80, True))  # where characters begin, and the end
    rows = np.searchsorted(border, c.offsets)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        parts = []
        for n in g.sizes:
            if b - a >= n:
                s = border[a : b + 1]
                parts.append((B.spans(pre, s[:-n], s[n:]) >> np.uint64(64 - g.bits)).astype(np.int32))
        h = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        at = np.arange(len(h), dtype=np.int32)
        slot[h] = at  # the last place of each feature stays
        yield h[slot[h] == at]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, g: Grams) -> np.ndarray:
    """Log of how much likelier a feature is among rows of label 1, with one more row of either label."""
    seen = np.ones((2, 1 << g.bits), np.float32)
    for x, label in zip(rows, y, strict=True):
        seen[int(label), x] += 1
    n = (np.array([(y == 0).sum(), (y == 1).sum()]) + 2).astype(np.float32)
    return np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])


def fit(sample: pd.DataFrame, g: Grams) -> tuple[np.ndarray, float]:
    """Logistic loss with a ridge on ratio-scaled features by AdaGrad; returns scaled weights and a bias."""
    y = sample["label"].to_numpy()
    if not len(y):
        return np.zeros(1 << g.bits, np.float32), 0.0
    rows = [x for c in B.chunks(pa.array(sample["text"], pa.string())) for x in features(c, g)]
    ratio = log_count_ratios(rows, y, g)
    w, grown = np.zeros_like(ratio), np.full_like(ratio, 1e-8)
    bias, bias_grown = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 1e-8
    rng = np.random.default_rng(5)
    for _ in range(max(1, g.steps // len(y))):
        for i in rng.permutation(len(y)):
            x = rows[i]
            v = ratio[x]
            z = bias + float(w[x] @ v)
            d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            step = d * v + g.ridge * w[x]
            grown[x] += step * step
            w[x] -= g.rate * step / np.sqrt(grown[x])
            bias_grown += d * d
            bias -= 10 * g.rate * d / bias_grown**0.5
    return (w * ratio).astype(np.float32), bias


def train_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 3, remainder: int = 1, g: Grams = Grams()
) -> tuple[np.ndarray, float]:
    """Fits on at most g.train_rows labelled rows outside the held-out fold. Without any, every score is 0.5.

    The sample and its handling of nulls, repeats and empty tables are those of labelled_sample().
    """
    return fit(labelled_sample(docs, labels, "toxic", ~held_out(folds, remainder), g.train_rows), g)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], g: Grams = Grams()) -> DataFrame:
    """doc_id and score (0 to 1, higher: likelier toxic) of every whole text.

    Texts too short for any n-gram, null and empty ones included, get the bias alone;
    repeated rows are scored as often as they occur; other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(model[0])  # 4 bytes x 2^bits, whatever the data
    bias = model[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for c in B.chunks(batch.column(1)):
                z = np.array([bias + float(w[x].sum(dtype=np.float64)) for x in features(c, g)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.hi - c.lo), pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))],
                    names=["doc_id", "score"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
