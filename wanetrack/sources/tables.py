"""Reading and writing asset tables."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path under the folder that all executors share, spark.checkpoint.dir. Where it is unset, a new one in local mode, an error on a cluster."""
    key = "spark.checkpoint.dir"
    where = spark.sparkContext.getConf().get(key) or spark.conf.get(key, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="wanetrack-")
        spark.conf.set(key, where)
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: what reads it later runs nothing before it again, and outlives lost executors.

    The table stays until that folder is cleared, since results are read from it lazily.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """SRC1, SRC2: by extension: .csv (a header; give a schema), .json (an array of records), Parquet otherwise."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    bare = path.rstrip("/").lower()
    if bare.endswith(".csv"):
        return reader.csv(path, header=True)
    if bare.endswith((".json", ".jsonl")):
        return reader.json(path, multiLine=bare.endswith(".json"))
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """SNK1: Parquet, or CSV by extension; partitioned by split or snapshot where asked."""
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    if path.lower().endswith(".csv"):
        writer.csv(path, header=True)
    else:
        writer.parquet(path)


def write_entity_files(df: DataFrame, folder: str, entity: str = "battery_id") -> None:
    """SRC3's files: one CSV file an entity, named after it, in a new folder that all executors share.

    A file is moved to its name when it is whole, so a task that runs again replaces what it wrote. Spark's own writer by partition
    makes a folder an entity, and pays for it again in the commit and in each listing.
    """
    where = "/" + folder[len("file:"):].lstrip("/") if folder.startswith("file:") else folder
    header = ",".join(df.columns)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(where)
        fs.create_dir(root)
        rows = itertools.chain.from_iterable(zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
        n = 0
        for name, group in itertools.groupby(rows, key=lambda r: r[0]):
            if not name:
                raise ValueError(f"rows without a {entity} have no file to lie in")
            # Spark's readers skip names that begin with a dot or an underscore
            stem = re.sub("^[._]", lambda m: f"%{ord(m[0]):02X}", quote(name, safe=" "))
            part = f"{root}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(f"{header}\n".encode())
                for some in itertools.batched(group, 4096):
                    out.write("".join(f"{line}\n" for _, line in some).encode())
            fs.move(part, f"{root}/{stem}.csv")
            n += 1
        yield pa.RecordBatch.from_pydict({"n": [n]})

    lines = df.select(F.col(entity).cast("string").alias("name"), F.to_csv(F.struct(*df.columns)).alias("line"))
    lines.repartition("name").sortWithinPartitions("name").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def read_entity_files(spark: SparkSession, pattern: str, schema: str, entity: str = "battery_id") -> tuple[DataFrame, DataFrame]:
    """SRC3: one CSV file an entity, named after it. Returns the good files' rows, and the files that hold several ids.

    Each file is opened once: its rows are written to the shared folder, where both results are read from. A folder is listed
    at once, a pattern by looking up each file that it matches.
    """
    rows = spark.read.schema(schema).csv(pattern, header=True).withColumn("file", F.col("_metadata.file_path"))
    # a task holds the buffers of all files that it opened until it ends: Spark gives it 32 small files, 8 times that here
    few = max(spark.sparkContext.defaultParallelism, -(-rows.rdd.getNumPartitions() // 8))
    rows = written(rows.coalesce(few), "entity-rows")
    per = rows.groupBy("file").agg(F.count_distinct(entity).alias("n_ids"))
    bad = per.filter("n_ids > 1")
    good = rows.join(bad, "file", "left_anti")
    stem = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    return good.withColumn(entity, F.coalesce(entity, stem)).drop("file"), bad


#: name, type, required.
CYCLE_COLUMNS = (
    ("battery_id", "string", True), ("cycle_index", "int", True), ("capacity_ah", "double", True), ("ambient_temperature_c", "double", False),
    ("voltage_min_v", "double", False), ("temperature_max_c", "double", False), ("internal_resistance_ohm", "double", False),
    ("charge_duration_s", "double", False), ("discharge_duration_s", "double", False), ("rectified_impedance_ohm", "double", False),
)


def coerce_schema(df: DataFrame, columns=CYCLE_COLUMNS, strict: bool = False) -> DataFrame:
    """SRC5: required columns must be there, optional ones are added as null, values that don't cast become null;
    extra columns follow the canonical block unless strict."""
    have = set(df.columns)
    lacking = [c for c, _, required in columns if required and c not in have]
    if lacking:
        raise ValueError(f"required columns are missing: {lacking}")
    block = [(F.col(c).try_cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t, _ in columns]
    named = {c for c, _, _ in columns}
    return df.select(*block, *([] if strict else [F.col(c) for c in df.columns if c not in named]))


def drop_labels(df: DataFrame, exact: Sequence[str] = ("eol_cycle", "is_censored", "life_fraction"), prefixes: Sequence[str] = ("rul_", "fails_in_")) -> DataFrame:
    """SRC6: what a scoring input may not carry."""
    return df.drop(*[c for c in df.columns if c in exact or c.startswith(tuple(prefixes))])
