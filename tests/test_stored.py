"""Stored tables change in place, and only where they must."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from wanetrack.operators import monitoring
from wanetrack.sources.stored import StoredTable

SCHEMA = "id string, day string, n int, acknowledged boolean"


@pytest.fixture
def kept(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], "day")
    assert t.read().count() == 0 and t.prune("9") == 0
    t.append_new(spark.createDataFrame([("a", "1", 1, False), ("b", "1", 2, False), ("c", "2", 3, True), (None, "2", 4, False), ("e", "3", 5, False), ("f", None, 6, False)], SCHEMA))
    return t


def rows(t):
    return sorted((tuple(r) for r in t.read().collect()), key=repr)


def files(t, day):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{t.path}/day={day}/*.parquet")}


def test_a_known_key_is_left_alone(spark, kept):
    before = rows(kept)
    old = files(kept, "1")
    kept.append_new(spark.createDataFrame([("a", "9", 99, False), (None, "2", 98, False), ("g", "1", 7, False), ("g", "1", 8, False)], SCHEMA))
    assert rows(kept) == sorted([*before, ("g", "1", 7, False)], key=repr)
    assert old.items() <= files(kept, "1").items()


def test_a_new_row_wins_and_may_move(spark, kept):
    untouched = files(kept, "1")
    assert untouched
    kept.replace(spark.createDataFrame([("c", "2", 30, False), (None, "4", 40, False), ("e", "2", 50, False), ("e", "2", 51, False)], SCHEMA), [F.desc("n")])
    assert rows(kept) == sorted([("a", "1", 1, False), ("b", "1", 2, False), ("c", "2", 30, False), (None, "4", 40, False), ("e", "2", 51, False), ("f", None, 6, False)], key=repr)
    assert files(kept, "1") == untouched and not glob.glob(f"{kept.path}/day=3")


def test_updates_touch_their_partitions_alone(spark, kept):
    one, two = files(kept, "1"), files(kept, "2")
    kept.update(F.col("n") >= 3, {"acknowledged": F.lit(True)})
    assert {(r[2], r[3]) for r in rows(kept)} == {(n, n >= 3) for n in range(1, 7)}
    assert files(kept, "1") == one and files(kept, "2") != two
    three = files(kept, "3")
    kept.update(F.col("n") >= 3, {"acknowledged": F.lit(True)})
    assert files(kept, "3") == three
    with pytest.raises(ValueError, match="keys"):
        kept.update(F.lit(True), {"id": F.lit("x")})


def test_pruning_drops_folders(kept):
    two = files(kept, "2")
    assert kept.prune("2") == 1
    assert {r[0] for r in rows(kept)} == {"c", None, "e", "f"} and files(kept, "2") == two and not glob.glob(f"{kept.path}/day=1")


def test_odd_partition_values(spark, tmp_path):
    t = StoredTable(spark, str(tmp_path / "odd t"), "k int, p string, v int", ["k"], "p")
    t.append_new(spark.createDataFrame([(1, "a b/c=d%", 1), (2, "x y", 2)], "k int, p string, v int"))
    assert t.prune("b") == 1 and [tuple(r) for r in t.read().collect()] == [(2, "x y", 2)]


def test_null_keys_are_one_key(spark):
    s = "k string, v int"
    old, new = spark.createDataFrame([(None, 1), ("a", 2)], s), spark.createDataFrame([(None, 3), ("a", 4), ("b", 6), ("b", 5)], s)
    got = sorted(map(tuple, monitoring.insert_or_ignore(old, new, ["k"]).collect()), key=repr)
    assert got == sorted([(None, 1), ("a", 2), ("b", 5)], key=repr)
