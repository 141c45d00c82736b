"""Snapshot documents: what the snapshot sink wrote, read back and joined to one view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auklet.sinks.files import published

POINT = "struct<component:string,name:string,value:double,unit:string,labels:map<string,string>>"
SCHEMA = f"component string, batch bigint, metrics array<{POINT}>, history map<string,array<double>>"


def read_snapshots(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row for each component's document; unreadable ones are left out."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True).json(paths)


def published_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the newest whole version in a folder that files.publish_snapshots writes; none before the first."""
    return published(spark, folder, SCHEMA)


def snapshot_points(snapshots: DataFrame) -> DataFrame:
    """All documents' points as rows."""
    rows = snapshots.select("batch", F.posexplode("metrics").alias("ord", "m"))
    return rows.select("batch", "ord", "m.component", "m.name", "m.value", "m.unit", "m.labels")
