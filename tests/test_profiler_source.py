import sqlite3

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auklet.sources.profiler_db import RELATIONS, read_profiles
from auklet.sources.profiler_source import ProfilerReader, ProfilerSource


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    spark.dataSource.register(ProfilerSource)
    top = tmp_path_factory.mktemp("profiles")
    for rank in (0, 3, 12):
        (top / f"r{rank}").mkdir()
        con = sqlite3.connect(top / f"r{rank}" / f"ascend_pytorch_profiler_{rank}.db")
        con.execute("create table TASK (startNs integer, endNs integer, connectionId integer, taskType integer)")
        con.executemany("insert into TASK values (?, ?, ?, ?)", [(k * 10, k * 10 + 5, k % 7 or None, k % 3) for k in range(1000 * (rank + 1) // (1 + rank % 2))])
        con.execute("create table META_DATA (name text, value text)")
        con.execute("insert into META_DATA values ('parallel', '日本'), ('empty', null)")
        con.execute("delete from TASK where rowid between 100 and 150")
        if rank == 3:
            con.execute("create table STEP_TIME (startNs integer, endNs integer)")
        con.commit()
        con.close()
    (top / "other.db").write_bytes(b"no database")
    return str(top)


def load(spark, folder, relation, rows=300, schema=None):
    reader = spark.read.format("profiler").option("relation", relation).option("folder", f"file://{folder}").option("rows", rows)
    return (reader.schema(schema) if schema else reader).load()


@pytest.mark.parametrize("relation", list(RELATIONS))
def test_equals_the_whole_file_reader(spark, folder, relation):
    got, want = load(spark, folder, relation), read_profiles(spark, f"file://{folder}", relation)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_ranges_of_one_file_are_read_by_several_tasks(spark, folder):
    df = load(spark, folder, "tasks").withColumn("part", F.spark_partition_id())
    parts = df.groupBy("rank").agg(F.countDistinct("part").alias("parts"), F.max("rowid").alias("last")).collect()
    assert {r.rank: r.parts for r in parts} == {r.rank: -(-r["last"] // 300) for r in parts} and max(r.parts for r in parts) > 10


def reader(folder, schema="rank int, start bigint, conn bigint", **options):
    return ProfilerReader({"relation": "tasks", "folder": folder, "rows": "300", **options}, StructType.fromDDL(schema))


def test_filters_and_columns_are_pushed_into_sqlite(folder):
    one = reader(folder)
    left = list(one.pushFilters([ds.GreaterThanOrEqual(("start",), 500), ds.IsNotNull(("conn",)), ds.EqualTo(("rank",), 3), ds.In(("conn",), (1, 2)), ds.StringContains(("start",), "1"), ds.EqualTo(("a", "b"), 1)]))
    assert [type(f).__name__ for f in left] == ["StringContains", "EqualTo"]
    ranges = one.partitions()
    assert {p.rank for p in ranges} == {3} and len(ranges) > 1
    batches = [b for p in ranges for b in one.read(p)]
    assert all(b.schema.names == ["rank", "start", "conn"] for b in batches)
    rows = [r for b in batches for r in b.to_pylist()]
    want = [{"rank": 3, "start": k * 10, "conn": k % 7} for k in range(2000) if not 99 <= k <= 149 and k >= 50 and k % 7 in (1, 2)]
    assert rows == want


def test_spark_pushes_them(spark, folder):
    df = load(spark, folder, "tasks").where("rank = 12 and start < 1000 and conn is not null").select("start")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == sum(1 for k in range(99) if k % 7)
    assert "Filter" not in plan.replace("RuntimeFilters", "")  # nothing is left for Spark to compare
    narrow = load(spark, folder, "tasks", schema="rank int, type_id bigint")
    assert narrow.columns == ["rank", "type_id"] and narrow.where("type_id = 2").count() == load(spark, folder, "tasks").where("type_id = 2").count()


def test_empty_folder_and_copies(spark, folder, tmp_path):
    (tmp_path / "none").mkdir()
    assert load(spark, str(tmp_path / "none"), "tasks").count() == 0
    whole = reader(folder)
    whole.folder = f"file://{folder}"
    part = next(p for p in whole.partitions() if p.rank == 3)
    copied = type(part)(part.rank, part.path)  # as a store that isn't mounted gives it: the whole file, by a copy
    assert sum(b.num_rows for b in whole.read(copied)) == 2000 - 51
