"""Best-fit-decreasing packing of token ids, with a segment tree over free capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanetrack.llm.tokens import SEPARATOR_ID, default_tokenizer, encoder, separated

LENGTH = 1024
#: Tokens that one task packs together. Larger pools waste less; this bounds a worker's memory.
POOL_TOKENS = 1 << 21

SEQUENCES = (
    "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, "
    "cu_seqlens array<int>, ids binary, position_ids binary"
)


class CapacityTree:
    """Counts of open sequences by free capacity; finds the least capacity that fits in O(log length)."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        self._shift(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, sequence) with the least capacity >= need."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.size
        self._shift(capacity, -1)
        return capacity, self.open[capacity].pop()

    def _shift(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Sequences as lists of item indices. Items are placed longest first, ties in input order."""
    tree = CapacityTree(length)
    out: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        if found is None:
            out.append([i])
            left, k = length - n, len(out) - 1
        else:
            left, k = found[0] - n, found[1]
            out[k].append(i)
        if left:
            tree.add(left, k)
    return out


def pack_best_fit(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    separator: int = SEPARATOR_ID,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """Packs documents into rows of exactly `length` ids with little padding and no shuffle.

    Documents over `length` are split without loss: full sequences of their own, and a
    tail that is packed like a short document. Each task packs pools of `pool_tokens`, so
    memory is bounded and nothing meets in one place. A row has the ids padded with the
    separator (uint32, little-endian), cumulative segment lengths from 0 to n_tokens, and
    position ids that start again at every segment (padding: 0). sequence_id is unique and
    rises within a partition. Null and empty texts are their separator alone; repeated
    rows are packed as often as they occur; an empty table gives no rows; other columns
    of docs are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        base, made = TaskContext.get().partitionId() << 36, 0
        keys: list[int | None] = []
        starts: list[int] = []
        pieces: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made
            sequences = best_fit_decreasing(np.array([len(p) for p in pieces], np.int64), length)
            ids = np.full((len(sequences), length), separator, "<u4")
            positions = np.zeros((len(sequences), length), "<u4")
            cums = []
            for row, members in enumerate(sequences):
                at, cum = 0, [0]
                for i in members:
                    n = len(pieces[i])
                    ids[row, at : at + n] = pieces[i]
                    positions[row, at : at + n] = np.arange(n)
                    at += n
                    cum.append(at)
                cums.append(cum)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([base + made + k for k in range(len(sequences))], pa.int64()),
                    pa.array([c[-1] for c in cums], pa.int32()),
                    pa.array([[keys[i] for i in m] for m in sequences], pa.list_(pa.int64())),
                    pa.array([[starts[i] for i in m] for m in sequences], pa.list_(pa.int64())),
                    pa.array(cums, pa.list_(pa.int32())),
                    pa.array([r.tobytes() for r in ids], pa.binary()),
                    pa.array([r.tobytes() for r in positions], pa.binary()),
                ],
                names=["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "position_ids"],
            )
            made += len(sequences)
            for x in (keys, starts, pieces):
                x.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = separated(enc, text.as_py(), separator)
                for s in range(0, len(row), length):
                    keys.append(key)
                    starts.append(s)
                    pieces.append(row[s : s + length])
                held += len(row)
                if held >= pool_tokens:
                    yield flush()
                    held = 0
        if pieces:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SEQUENCES)


def write_packed(sequences: DataFrame, path: str) -> None:
    """Writes the id matrix rows, cumulative lengths and position resets as Parquet; the path must be new.

    Nulls, empty and repeated texts and empty tables have been settled by pack_best_fit();
    an empty table writes a folder without rows.
    """
    sequences.write.parquet(path)


def op9_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a packed sequence, with checksums in place of the id and position rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_best_fit(docs).select(
        "sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("positions_crc32"),
    )
