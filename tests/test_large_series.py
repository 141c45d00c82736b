import contextlib
import io

from pyspark.sql import Window
from pyspark.sql import functions as F

from auklet.operators import gauges
from auklet.sources import probes, rank_files


def largest_share(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_one_long_series_is_many_tasks(spark):
    k = F.col("id")
    rows = spark.range(6000).where("id not between 1000 and 3999").select((k * 97).alias("batch"), F.lit("eth0").alias("interface"), *[((k * (7 + i)) % 1009).alias(c) for i, c in enumerate(probes.NET_FIELDS)])
    got = gauges.with_before(rows, ["interface"], "batch", ["rx_bytes"])
    whole = rows.withColumn("before_rx_bytes", F.lag("rx_bytes").over(Window.partitionBy("interface").orderBy("batch")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select(got.columns).collect()))
    assert largest_share(gauges.network(rows, ["batch"], [], "batch")) < 0.2


def test_times_and_empty_names(spark):
    rows = spark.createDataFrame([(None, 1, 5), (None, 9000, 7), ("a", 2, 1), ("a", 3, 4), ("a", 99999, None), ("a", 200000, 8)], "interface string, s long, n long")
    rows = rows.select("interface", F.timestamp_seconds("s").alias("at"), "s", "n")
    got = {(r.interface, r.s): r.before_n for r in gauges.with_before(rows, ["interface"], "at", ["n"]).collect()}
    assert got == {(None, 1): None, (None, 9000): 5, ("a", 2): None, ("a", 3): 1, ("a", 99999): 4, ("a", 200000): None}


def test_inventories_are_sorted_in_many_tasks(spark):
    texts = F.array(*[F.lit(x) for x in ("Locator: lost", "Handle 1", "Size: 2 GB", " Locator: D0", "Other: x", "Handle 2", "Size: none", "Locator: D1")])
    lines = spark.range(3000).select(F.col("id").alias("batch"), F.col("id").cast("string").alias("source"), F.posexplode(texts).alias("pos", "value"))
    found = probes.memory_modules(lines)
    assert {(r.locator, r.size_mb) for r in found.collect()} == {("D0", 2048)} and found.count() == 3000
    assert largest_share(found) < 0.02


def test_repeated_group_texts_are_parsed_once(spark):
    text = '{"g": {"group_name": "tp", "global_ranks": [3, 1, 2, 9]}, "%s": {"group_name": "pp", "global_ranks": [1, 2]}}'
    texts = spark.createDataFrame([(1, text % "h"), (2, text % "h"), (3, text % "i")], "rank int, value string")
    groups = rank_files.groups_of(texts)
    assert sorted(map(tuple, groups.collect())) == [("pp", "h", [1, 2]), ("pp", "i", [1, 2]), ("tp", "g", [1, 2, 3])]
    with contextlib.redirect_stdout(io.StringIO()) as said:
        groups.explain()
    plan = said.getvalue()
    assert "Aggregate(keys=[value" in plan[plan.index("from_json") :]
