"""A Spark session with the settings that this library relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Partitions at least over which rows are dealt that a task then sorts, so that one holds a small part of them; up to 200 the writing side sorts nothing.
SORT_PARTITIONS = 200


def session(app: str = "auklet", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution and Arrow; partition counts are left to adaptive coalescing unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once for several readers: a checkpoint where a shared folder is set, which also ends the plan; otherwise kept in memory and on disk.

    Either survives lost executors: a checkpoint is in the shared folder, kept partitions are computed again.
    """
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over SORT_PARTITIONS at least, whatever few the session shuffles to."""
    return df.repartition(max(SORT_PARTITIONS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)
