"""Corpus cleaning in stages; each reads what its predecessor kept.

All stages take null, empty and very long texts, null and repeated doc_ids, further columns
of any name and empty tables; what comes out then is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wanetrack.llm.bytecnn import keep_quality, train_quality
from wanetrack.llm.decontaminate import decontaminate
from wanetrack.llm.minhash import keep_one
from wanetrack.llm.packing import pack_concatenated
from wanetrack.llm.scratch import Scratch
from wanetrack.llm.suffixmerge import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows whose text the byte network scores below 0.3 go.

    Each row is judged by its text alone, null and empty ones alike; a score of just 0.3
    stays. Without labels every score is 0.5, so every row stays.
    """
    net = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_quality(docs, net)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays (five-word shingles, 0.8).

    Rows are told apart by doc_id and text; which one stays is keep_one()'s rule. Rows
    without a doc_id, and rows without words, stay.
    """
    return keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: byte strings of 200 that occur twice are cut out of the texts; every row stays.

    All occurrences go, the first included. Null texts come out empty; rows that repeat
    each other lose all that is long enough.
    """
    return cut_repeats(docs)


def benchmark_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go.

    Rows that share a doc_id go together; rows without one stay. An empty benchmark
    removes nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the kept texts as fixed windows of token ids, one row a piece.

    Null and empty texts are their separator; repeated rows are packed as often as they occur.
    """
    return pack_concatenated(docs, with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", passage_dedup),
    ("benchmark decontamination", benchmark_removal),
    ("packing", pack),
]

#: No stage but the fourth is within SQL's reach (a trained network, sketches, transforms, token ids).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, name.replace(" ", "-"))
    return docs
