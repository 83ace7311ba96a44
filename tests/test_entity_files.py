"""Files of one entity each: written without a folder for each of them, listed by folder, opened once."""

import os

import duckdb

import __spark_entry__ as entry
from wanetrack.sources import tables


def test_each_file_is_opened_once(spark, tmp_path):
    """What is returned reads the rows as they were written once, so it still stands when the files are gone."""
    for name, rows in {"e1": "e1,1\ne1,2", "bad": "x,1\ny,2"}.items():
        (tmp_path / f"{name}.csv").write_text("battery_id,value\n" + rows + "\n")
    good, bad = tables.read_entity_files(spark, str(tmp_path), "battery_id string, value double")
    for f in tmp_path.iterdir():
        f.unlink()
    assert sorted((r.battery_id, r.value) for r in good.collect()) == [("e1", 1), ("e1", 2)]
    assert [(r.file.endswith("bad.csv"), r.n_ids) for r in bad.collect()] == [(True, 2)]


def test_written_files_are_named_after_their_entity(spark, tmp_path):
    ids = ["e1", "e 2", "_x", ".y", "a/b", 'q"u', "c,d", "50%", "50%25", "é"]
    rows = [(i, k, v) for i in ids for k, v in enumerate([1.5, None, float("nan"), float("-inf"), 0.1 + 0.2])]
    schema = "battery_id string, k long, value double"
    folder = tables.shared_folder(spark, "named")
    tables.write_entity_files(spark.createDataFrame(rows, schema).repartition(3, "k"), folder)
    where = folder.removeprefix("file://")
    assert len(os.listdir(where)) == len(ids) and {"e1.csv", "e 2.csv", "%5Fx.csv"} <= set(os.listdir(where))
    good, bad = tables.read_entity_files(spark, folder, schema)
    assert sorted(map(repr, map(tuple, good.collect()))) == sorted(map(repr, rows))
    assert bad.count() == 0


def test_entity_files_of_rows_without_an_id(spark, tmp_path):
    """Against the statement; an event without a user was counted under the name of the file it lay in."""
    duckdb.sql(f"""copy (select i as event_id, timestamp '2024-01-01' as ts, case when i % 5 > 0 then i % 7 end as user_id, 'x' as event_type,
      i / 8.0 as value, '' as props from range(100) t(i)) to '{tmp_path}/events.parquet' (format parquet)""")
    want = duckdb.sql(entry.oracle_sql()["src3_entity_files"].replace("from events", f"from '{tmp_path}/events.parquet'")).fetchall()
    got = [tuple(r) for r in entry.queries()["src3_entity_files"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 8


def test_a_task_opens_few_of_many_files(spark, tmp_path):
    """A task keeps the buffers of the files it opened, so their number may not grow with the folder: 256, not 9,000 over a fixed number of tasks."""
    for i in range(9_000):
        (tmp_path / f"e{i}.csv").write_text(f"battery_id,value\ne{i},{i}\n")
    good, _ = tables.read_entity_files(spark, str(tmp_path), "battery_id string, value double")
    assert good.groupBy().sum("value").first()[0] == 9_000 * 8_999 / 2
    assert 9_000 / 256 <= len(good.inputFiles()) <= 9_000 / 16
