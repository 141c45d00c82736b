"""File sinks: JSON lines by component and day, KPI days with expiry, snapshots, expositions and rank tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auklet.operators.series import exposition


def write_points(points: DataFrame, folder: str, ts: str = "ts_s") -> None:
    """Points as JSON lines below component=.../day=..., one file for each of a write's partitions of a day."""
    rows = points.withColumn("day", F.to_date(F.timestamp_seconds(ts)))
    rows.repartition("component", "day").write.mode("append").partitionBy("component", "day").json(folder)


def write_kpi_days(samples: DataFrame, folder: str, batch: int | None = None) -> None:
    """KPI samples (ts, vals, cpu_avg) as JSON lines below day=..., by the sample's own day.

    With the number of a micro-batch they stand below batch=... of their day, and replace what a first try of it wrote there.
    """
    rows = samples.withColumn("day", F.to_date(F.timestamp_seconds("ts")))
    if batch is None:
        rows.write.mode("append").partitionBy("day").json(folder)
    else:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").json(folder)


def samples_of(kpi: DataFrame) -> DataFrame:
    """KPI rows (ts_s, card, metric, value) as samples: one row for each time, with the fields of every card, and no processor averages."""
    cards = kpi.groupBy("ts_s", "card").agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("fields"))  # as many as there are metrics
    got = cards.groupBy(F.col("ts_s").alias("ts")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("card").cast("string").alias("card"), "fields"))).alias("vals"))
    return got.withColumn("cpu_avg", F.lit(None).cast("map<string,double>"))


def expired_days(spark, folder: str, before: date) -> list[str]:
    """Day folders that are older than a date; the caller deletes them. Listed through Spark's file system, so any store works."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [(str(f.getPath()), f.getPath().getName()) for f in found]
    return sorted(p for p, n in names if n.startswith("day=") and n[4:] < before.isoformat())


def prune_days(spark, folder: str, before: date) -> int:
    """Deletes expired day folders of a KPI table that write_kpi_days made; returns how many."""
    gone = expired_days(spark, folder, before)
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def _listed(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): points as an array in the order of `ord`."""
    point = F.struct("component", "name", "value", "unit", "labels").alias("m")
    got = rows.groupBy(*keys).agg(F.collect_list(F.struct("ord", point)).alias("all_"))
    ordered = F.array_sort("all_", lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))  # maps can't be compared
    return got.select(*keys, F.transform(ordered, lambda x: x["m"]).alias(name))


def snapshots(points: DataFrame, history: DataFrame | None = None, specs: DataFrame | None = None) -> DataFrame:
    """(component, batch, metrics, history): a document for each component's points of one batch; history is (component, series, history).

    With specs (points that are sent once, kept from earlier batches, and hardware identity) documents also have those of their component.
    """
    if specs is not None:
        return snapshots(points, history).join(_listed(specs, ["component"], "specs"), "component", "left")
    docs = points.groupBy("component").agg(F.max("batch").alias("batch")).join(_listed(points, ["component"], "metrics"), "component")
    if history is None:
        return docs.withColumn("history", F.lit(None).cast("map<string,array<double>>"))
    h = history.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("series", "history"))).alias("history"))
    return docs.join(h, "component", "left")


def global_snapshot(scores: DataFrame, health: DataFrame, key: str, intervals: dict[str, float] | None = None, specs: DataFrame | None = None) -> DataFrame:
    """(key, health, collectors, intervals_ms, system_specs): a document for each node over all of its components.

    scores are (key, component, score, max), health (key, score, grade, server_type); specs are points of the whole system (key,
    component, name, value, unit, labels, ord). A node without points has no document.
    """
    parts = scores.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("component", "score", "max"))).alias("collectors"))  # as many as there are kinds of probes
    docs = health.select(key, F.struct("score", "grade", "server_type").alias("health")).join(parts, key)
    pairs = [x for c, s in sorted((intervals or {}).items()) for x in (F.lit(c), F.lit(int(s * 1000)))]
    docs = docs.withColumn("intervals_ms", F.create_map(*pairs).cast("map<string,int>"))
    if specs is None:
        return docs.withColumn("system_specs", F.lit(None).cast("array<struct<component:string,name:string,value:double,unit:string,labels:map<string,string>>>"))
    return docs.join(_listed(specs, [key], "system_specs"), key, "left")


def _listed_folders(spark: SparkSession, folder: str) -> list:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(fs, f.getPath()) for f in fs.listStatus(path)] if fs.exists(path) else []


def versions(spark: SparkSession, folder: str, name: str = "version") -> list[int]:
    """Numbers of the folders name=N that were written whole, ascending: Spark's writer marks a folder when all its files are there."""
    whole = [at.getName() for fs, at in _listed_folders(spark, folder) if at.getName().startswith(f"{name}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS"))]
    return sorted(int(x.partition("=")[2]) for x in whole)


def publish(df: DataFrame, folder: str, keep: int = 3) -> int:
    """Writes JSON lines as the folder's next version, which readers (`published`) see at once when it is whole; the number of the version.

    The newest `keep` versions stay for readers that have begun; older ones and parts that failed writers left go. One writer at a time.
    """
    spark = df.sparkSession
    taken = [int(at.getName().partition("=")[2]) for _, at in _listed_folders(spark, folder) if at.getName().startswith("version=")]
    number = max(taken, default=0) + 1
    df.write.json(f"{folder}/version={number}")
    whole = versions(spark, folder)
    for fs, at in _listed_folders(spark, folder):
        if at.getName().startswith("version=") and int(at.getName().partition("=")[2]) not in whole[-keep:]:
            fs.delete(at, True)
    return number


def published(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The newest whole version; no rows before the first."""
    known = versions(spark, folder)
    return spark.read.schema(schema).json(f"{folder}/version={known[-1]}") if known else spark.createDataFrame([], schema)


def replace(df: DataFrame, folder: str) -> None:
    """Writes JSON lines beside the folder and then puts them in its place by two renames, so readers never see a part.

    Between the renames there is no folder; readers that mustn't meet that take `publish` and `published`.
    """
    spark = df.sparkSession
    new, old = (f"{folder.rstrip('/')}.{x}-{uuid.uuid4().hex}" for x in ("new", "old"))
    df.write.json(new)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path(folder)):
        fs.rename(path(folder), path(old))
    fs.rename(path(new), path(folder))
    fs.delete(path(old), True)


def write_snapshots(points: DataFrame, folder: str, history: DataFrame | None = None, specs: DataFrame | None = None) -> None:
    """Replaces the documents at once; one batch of a component is a bounded group."""
    replace(snapshots(points, history, specs), folder)


def publish_snapshots(points: DataFrame, folder: str, history: DataFrame | None = None, specs: DataFrame | None = None) -> int:
    """Publishes the documents as the folder's next version, for readers that go on meanwhile (`snapshots.published_snapshots`)."""
    return publish(snapshots(points, history, specs), folder)


def whole_nodes(scores: DataFrame, key: str, components: list[str]) -> DataFrame:
    """(key): nodes of which every component has reported, whose global document can be made."""
    wanted = F.array(*[F.lit(c) for c in sorted(set(components))])
    return scores.where(F.col("component").isin(components)).groupBy(key).agg(F.array_sort(F.collect_set("component")).alias("c_")).where(F.col("c_") == wanted).select(key)


def publish_global_snapshot(scores: DataFrame, health: DataFrame, key: str, folder: str, components: list[str], intervals: dict[str, float] | None = None, specs: DataFrame | None = None) -> int | None:
    """Publishes the global documents of nodes of which all components have reported; nothing is published, and None given, while there is none."""
    ready = whole_nodes(scores, key, components)
    docs = global_snapshot(scores, health, key, intervals, specs).join(ready, key, "left_semi")
    return None if docs.isEmpty() else publish(docs, folder)


def write_exposition(points: DataFrame, folder: str, prefix: str = "node") -> None:
    """A scrape's lines in order, over as many files as the range needs; read in name order they are one text."""
    rows = exposition(points, prefix).repartitionByRange("first", "rank", "ord").sortWithinPartitions("first", "rank", "ord")
    rows.select("line").write.mode("overwrite").text(folder)


def write_rank_table(wide: DataFrame, folder: str) -> None:
    """Metrics of ranks as CSV with a header, sorted by rank within files of rank ranges."""
    wide.repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").option("header", True).csv(folder)


def write_documents(df: DataFrame, folder: str) -> None:
    """Results with nested columns as JSON lines."""
    df.write.mode("overwrite").json(folder)


def write_rank_files(groups: DataFrame, hosts: DataFrame, folder: str) -> None:
    """Groups (domain, name, ranks) and hosts (rank, host) of a job as JSON lines, a row once however often it comes."""
    groups.select("name", F.struct(F.col("domain").alias("group_name"), F.col("ranks").alias("global_ranks")).alias("group")).distinct().write.mode("overwrite").json(f"{folder}/groups")
    hosts.select(F.col("rank").cast("string").alias("rank"), F.col("host").alias("hostUid")).dropDuplicates(["rank"]).write.mode("overwrite").json(f"{folder}/hosts")
