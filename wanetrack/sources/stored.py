"""History tables that are kept as Parquet by partition and changed in place, partition by partition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wanetrack.sources.tables import written


def same_key(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equality of two rows' keys in which nulls equal each other."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def first_of_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """One row a key: the first in `order`, what is left of ties by the values of all columns."""
    w = Window.partitionBy(*keys).orderBy(*order, *[F.col(c) for c in df.columns])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


class StoredTable:
    """A table with a key in folders by one column, for a single writer at a time.

    Changes read and write only the partitions that they touch: rows to add are appended,
    rows to change are worked out into a table of their own first and then put in place by
    Spark's dynamic partition overwrite, so a job that dies leaves the table as it was.
    Files of other partitions stay the same files. Null keys equal each other.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: Sequence[str], partition: str):
        self.spark, self.path, self.keys, self.partition = spark, path.rstrip("/"), list(keys), partition
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _fs(self, path: str, encoded: bool = False):
        """The path and its file system; encoded: as in file metadata, where odd characters are escaped."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path) if encoded else path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self) -> DataFrame:
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def _aligned(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])

    def append_new(self, new: DataFrame, order: Sequence[Column] = ()) -> None:
        """HIS3: rows of a key already there stay as they are, others are added; no file is rewritten."""
        old, rows = self.read().select(*self.keys), first_of_key(self._aligned(new), self.keys, order)
        fresh = written(rows.join(old, same_key(rows, old, self.keys), "left_anti"), "fresh")
        fresh.write.mode("append").partitionBy(self.partition).parquet(self.path)

    def replace(self, new: DataFrame, order: Sequence[Column] = ()) -> None:
        """HIS4: the new row of a key wins, among several the first in `order`. A key may move to another partition."""
        rows = written(first_of_key(self._aligned(new), self.keys, order), "new")
        old = self.read()
        hit = old.join(rows, same_key(old, rows, self.keys), "left_semi").select(self.partition)
        touched = hit.union(rows.select(self.partition)).distinct()
        held = old.join(F.broadcast(touched), old[self.partition].eqNullSafe(touched[self.partition]), "left_semi")  # a row a partition
        kept = held.join(rows, same_key(held, rows, self.keys), "left_anti")
        self._put(kept.unionByName(rows), touched)

    def update(self, where: Column, values: dict[str, Column]) -> None:
        """HIS5: sets columns of the rows for which `where` holds; neither the key nor the partition may be among them."""
        if {*values} & {*self.keys, self.partition}:
            raise ValueError("update() changes neither keys nor the partition column; use replace()")
        old = self.read()
        changed = F.coalesce(where, F.lit(False)) & reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(v) for c, v in values.items()])
        touched = old.filter(changed).select(self.partition).distinct()
        held = old.join(F.broadcast(touched), old[self.partition].eqNullSafe(touched[self.partition]), "left_semi").select(old["*"])  # a row a partition
        hit = F.coalesce(where, F.lit(False))
        self._put(held.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}), touched)

    def prune(self, before: object) -> int:
        """HIS6: removes the partitions below `before`, and tells how many; nothing is read or rewritten."""
        return self._remove(self.read().filter(F.col(self.partition) < F.lit(before)).select(self.partition).distinct())

    def _put(self, rows: DataFrame, touched: DataFrame) -> None:
        done, left = written(self._aligned(rows), "put"), written(touched, "touched")
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(self.path)
        now = done.select(self.partition).distinct()
        self._remove(left.join(now, left[self.partition].eqNullSafe(now[self.partition]), "left_anti"))

    def _remove(self, gone: DataFrame) -> int:
        """Deletes the folders of these partitions; their number is that of the table's folders at most."""
        p, fs = self._fs(self.path)
        if not fs.exists(p):
            return 0
        stored = self.spark.read.schema(self.schema).parquet(self.path)
        files = stored.select(self.partition, F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
        folders = [r["folder"] for r in files.join(F.broadcast(gone), files[self.partition].eqNullSafe(gone[self.partition]), "left_semi").select("folder").distinct().collect()]
        for f in folders:
            p, fs = self._fs(f, encoded=True)
            fs.delete(p, True)
        return len(folders)
