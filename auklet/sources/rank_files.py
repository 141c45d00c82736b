"""Files that a slow-rank job keeps for each rank: its groups and host as JSON, its figures by step as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auklet.sources.probes import read_lines

# Names of the files, whose number is the rank, and the figures' column that numbers steps
GROUPS, HOSTS, FIGURES = r"group_info_(\d+)\.json$", r"host_info_(\d+)\.json$", r"global_rank_(\d+)\.csv$"
STEP = "stepindex"
_GROUP = "map<string,struct<group_name:string,global_ranks:array<int>>>"


def _ranked(spark: SparkSession, folder: str, pattern: str, glob: str) -> DataFrame:
    """(rank, value) of small JSON files, each as one text."""
    rows = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return rows.select(F.regexp_extract("_metadata.file_path", pattern, 1).try_cast("int").alias("rank"), "value").where("rank is not null")


def groups_of(texts: DataFrame) -> DataFrame:
    """(domain, name, ranks): distinct groups of more than one rank in (rank, value) JSON texts; ranks sorted, only those that have a file."""
    parsed = texts.select("value").distinct().select(F.explode(F.from_json("value", _GROUP)).alias("name", "g")).where("coalesce(g.group_name, '') <> ''")
    lists = parsed.select(F.col("g.group_name").alias("domain"), "name", F.col("g.global_ranks").alias("ranks")).distinct()  # each of a group's ranks lists all
    each = lists.select("domain", "name", F.explode("ranks").alias("rank")).distinct()
    there = each.join(texts.select("rank").distinct(), "rank", "left_semi")
    return there.groupBy("domain", "name").agg(F.array_sort(F.collect_list("rank")).alias("ranks")).where(F.size("ranks") > 1)


def hosts_of(texts: DataFrame) -> DataFrame:
    """(rank, host) of (rank, value) JSON texts; ranks without a host give no row."""
    host = F.get_json_object("value", "$.hostUid")
    return texts.select("rank", host.alias("host")).where("coalesce(host, '') <> ''")


def read_groups(spark: SparkSession, folder: str) -> DataFrame:
    return groups_of(_ranked(spark, folder, GROUPS, "group_info_*.json"))


def read_hosts(spark: SparkSession, folder: str) -> DataFrame:
    return hosts_of(_ranked(spark, folder, HOSTS, "host_info_*.json"))


def figures_of(lines: DataFrame, rank: Column) -> DataFrame:
    """(rank, metric, step, value) of CSV lines (source, pos, value); columns are named by each file's first line, cells that are no numbers are null."""
    cells = F.transform(F.split("value", ","), lambda c: F.trim(c))
    heads = lines.where("pos = 0").select("source", cells.alias("names"))
    rows = lines.where("pos > 0").select("source", rank.alias("rank"), F.col("pos").alias("step"), cells.alias("cells")).join(heads, "source")
    each = F.arrays_zip("names", F.slice("cells", F.lit(1), F.size("names")).alias("cells"))
    flat = rows.select("rank", "step", F.explode(each).alias("c")).where(F.col("c.names").isNotNull() & (F.lower("c.names") != STEP))
    return flat.select("rank", F.col("c.names").alias("metric"), "step", F.col("c.cells").try_cast("double").alias("value"))


def read_figures(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_lines(spark, f"{folder}/global_rank_*.csv", F.lit(0))
    return figures_of(lines, F.regexp_extract("source", FIGURES, 1).try_cast("int"))


def settled_steps(figures: DataFrame) -> DataFrame:
    """(rank, metric, value): each metric's value at the step before the last, which may still be running, or at the only one; none where that is no number."""
    last = figures.groupBy("rank", "metric").agg(F.max("step").alias("last"), F.count("*").alias("n"))
    chosen = F.when(F.col("n") > 1, F.col("step") == F.col("last") - 1).otherwise(F.lit(True))  # steps are numbered by line, without gaps
    return figures.join(last, ["rank", "metric"]).where(chosen & F.col("value").isNotNull()).select("rank", "metric", "value")
