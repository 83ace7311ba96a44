"""Concatenate-and-cut packing: two-pass prefix sums give every document a global token offset."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wanetrack.llm.scratch import Scratch
from wanetrack.llm.tokens import SEPARATOR_ID, binary_column, default_tokenizer, encoder, separated

LENGTH = 1024
#: Rows of the per-partition totals that may be broadcast (16 bytes each).
BROADCAST_PARTITIONS = 1_000_000
_FLUSH = 1 << 22

TOKENS = "doc_id long, pid int, local_start long, n_tokens long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def token_table(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR_ID) -> DataFrame:
    """Tokenises each document once. local_start: its place among the tokens of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        pid, at = TaskContext.get().partitionId(), 0
        keys, starts, counts, ids, held = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([pid] * len(keys), pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(counts, pa.int64()), binary_column(ids)],
                names=["doc_id", "pid", "local_start", "n_tokens", "ids"],
            )
            for x in (keys, starts, counts, ids):
                x.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = separated(enc, text.as_py(), separator)
                keys.append(key)
                starts.append(at)
                counts.append(len(row))
                ids.append(row.astype(enc.width))
                at += len(row)
                held += len(row)
                if held >= _FLUSH:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


def _bases(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """Second pass of the prefix sum: one row a partition, far below what a broadcast may hold."""
    totals = tokens.groupBy("pid").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.table(
        totals.select("pid", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "bases"
    )
    return F.broadcast(bases) if bases.count() <= BROADCAST_PARTITIONS else bases


def pack_concatenated(
    docs: DataFrame,
    tokenizer: str | None = None,
    length: int = LENGTH,
    separator: int = SEPARATOR_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Lays all documents end to end and cuts the stream every `length` tokens.

    Pass one tokenises once into a table in the shared folder and numbers the tokens of
    each partition; a prefix sum over the partitions' totals turns these into global
    offsets, so pass two cuts each document where it lies without moving any token. One
    row a boundary record: the piece of a document in one sequence. Only the last
    sequence needs padding. Null and empty texts are their separator alone; repeated
    rows and repeated doc_ids are packed as often as they occur; an empty table gives
    no rows; other columns of docs are ignored. Ids come as little-endian uint32.
    """
    spark: SparkSession = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    scratch = Scratch(spark, "pack")
    tokens = scratch.table(token_table(docs, tokenizer, separator), "tokens")
    placed = tokens.join(_bases(tokens, scratch), "pid").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("at"), "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(tokenizer).width
        for batch in batches:
            rows = []
            for key, at, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                at, ids = at.as_py(), np.frombuffer(raw.as_buffer(), width).astype("<u4")
                start = 0
                while start < len(ids):
                    seq, offset = divmod(at + start, length)
                    n = min(length - offset, len(ids) - start)
                    piece = ids[start : start + n].tobytes()
                    rows.append((key.as_py(), start, n, zlib.crc32(piece), len(ids), seq, offset, piece if with_ids else None))
                    start += n
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

    out = placed.mapInArrow(cut, PIECES)
    return out if with_ids else out.drop("ids")


def op10_pack_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_concatenated(docs, with_ids=False)
