"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
#: Spark's own setting: the shuffle files of a finished execution are removed at once.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a new one in local mode, an error on a cluster."""
    where = spark.sparkContext.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wanetrack-")
        spark.conf.set(_KEY, where)
    return where.rstrip("/")


class Scratch:
    """Writes lineage cuts as Parquet under one folder of the shared directory.

    A table that is read back has no lineage: an executor that dies costs the tasks it
    ran, never the jobs before. drop() removes tables once their readers have finished.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def table(self, df: DataFrame, label: str) -> DataFrame:
        path = self.path(label)
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t.scratch_path)


def one_partition_each(df: DataFrame, key: str, n: int, reduce: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Applies reduce to the rows of every key, numbers from 0 to n - 1, each in a partition and task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if held:
            yield from reduce(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return df.repartitionById(n, F.col(key).cast("int")).mapInArrow(run, schema)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def local_path(uri: str) -> str:
    """A shared-folder URI as a path that a Python worker can map into memory."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped files need spark.checkpoint.dir on a mounted file system")
    return uri
