"""Labelled rows: held-out folds by checksum, and bounded training samples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wanetrack.llm.scratch import Scratch

#: Label keys that one broadcast may hold (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def checksum(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def held_out(folds: int, remainder: int, key: str = "doc_id") -> Column:
    return checksum(key) % folds == remainder


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, max_bytes: int = 256 << 20
) -> pd.DataFrame:
    """(text, label) of at most `limit` labelled ids that `keep` allows, those with the least checksums, whole texts.

    Bounded by rows and, over the ids in that order, by max_bytes of text, so the driver
    may hold it. Null labels don't count; a doc_id that is labelled more than once takes
    its largest label; one that runs with several texts takes the least. Null texts are
    empty. Empty tables give an empty sample.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .filter(keep)
        .orderBy(checksum(), "doc_id")
        .limit(limit)
    )
    if limit <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(chosen, "doc_id")
    rows = Scratch(docs.sparkSession, "labelled").table(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "rows")
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(checksum(), "doc_id"))  # at most `limit` numbers
    fits = rows.select("doc_id", so_far.alias("bytes")).filter(F.col("bytes") <= max_bytes).select("doc_id")
    out = rows.join(fits, "doc_id", "left_semi").toPandas().sort_values("doc_id", kind="stable")
    return out[["text", "label"]].reset_index(drop=True)
