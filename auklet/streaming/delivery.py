"""Debounced deliveries: a push counts for the debounce only if it was delivered, in whichever micro-batch that was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auklet.sinks.files import versions
from auklet.sinks.push import attempts, post

KEYS = ["subscription", "npu", "type"]
_LEDGER = "subscription string, npu string, type string, delivered_s long"


def _pushed(retries: int, backoff_s: float, timeout_s: float, send: Callable[[str, str, float], bool]):
    """Rows sorted by key and time: each is sent if its key's last delivery is `gap_s` ago or more; only a delivery moves that on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for f in frames:
            out = []
            for event, endpoint, body, ts, gap, before, *key in f.itertuples(index=False, name=None):
                if key != now:
                    now, last = key, None if pd.isna(before) else int(before)
                tries, ok, early = 0, False, gap > 0 and last is not None and ts - last < gap
                if not early:
                    tries, ok = attempts(endpoint, body, retries, backoff_s, timeout_s, send)
                    last = ts if ok else last
                out.append((event, *key, ts, tries, ok, early))
            yield pd.DataFrame(out, columns=["event_id", *KEYS, "ts_s", "attempts", "delivered", "suppressed"])

    return run


def pushed_batch(pairs: DataFrame, folder: str, number: int, keep_s: int = 30 * 86400, retries: int = 3, backoff_s: float = 0.5, timeout_s: float = 30.0, send: Callable[[str, str, float], bool] = post) -> DataFrame:
    """(event_id, subscription, npu, type, ts_s, attempts, delivered, suppressed): what became of a micro-batch's pairs, which is sent at most once.

    pairs are (event_id, subscription, npu, type, ts_s, debounce_s, endpoint, ...). The ledger below folder/ledger holds each key's last delivery; each
    micro-batch reads the version before its own and merges its deliveries into the next, so a failed push suppresses nothing. Results are below
    folder/deliveries. A repeated micro-batch sends nothing if its results were written, and makes its version of the ledger anew.
    Deliveries more than keep_s older than the newest are forgotten; it must be more than the longest debounce.
    """
    spark = pairs.sparkSession
    here = f"{folder}/deliveries/batch={number}"
    known = [v for v in versions(spark, f"{folder}/ledger", "batch") if v < number]
    ledger = spark.read.schema(_LEDGER).parquet(f"{folder}/ledger/batch={known[-1]}") if known else spark.createDataFrame([], _LEDGER)
    if number not in versions(spark, f"{folder}/deliveries", "batch"):
        body = F.to_json(F.struct(*[F.col(c) for c in pairs.columns if c not in ("endpoint", "debounce_s")]))
        rows = pairs.withColumn("body_", body).join(ledger, KEYS, "left").repartition(*KEYS).sortWithinPartitions(*KEYS, "ts_s", "event_id")
        rows = rows.select("event_id", "endpoint", F.col("body_"), "ts_s", "debounce_s", "delivered_s", *KEYS)
        out = rows.mapInPandas(_pushed(retries, backoff_s, timeout_s, send), "event_id string, subscription string, npu string, type string, ts_s long, attempts int, delivered boolean, suppressed boolean")
        out.write.mode("overwrite").parquet(here)
    done = spark.read.parquet(here)
    merged = ledger.union(done.where("delivered").select(*KEYS, "ts_s")).groupBy(*KEYS).agg(F.max("delivered_s").alias("delivered_s"))
    newest = merged.agg(F.max("delivered_s").alias("newest_"))  # one row
    kept = merged.join(F.broadcast(newest)).where(F.col("delivered_s") >= F.col("newest_") - keep_s).drop("newest_")
    kept.write.mode("overwrite").parquet(f"{folder}/ledger/batch={number}")
    return done


def debounced_deliveries(pairs: DataFrame, folder: str, checkpoint: str, **how):
    """Starts pushing a stream's pairs; see pushed_batch."""

    def each(df: DataFrame, number: int) -> None:
        pushed_batch(df, folder, number, **how)

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def ledger_of(spark: SparkSession, folder: str) -> DataFrame:
    """(subscription, npu, type, delivered_s): the newest version of the ledger."""
    known = versions(spark, f"{folder}/ledger", "batch")
    return spark.read.schema(_LEDGER).parquet(f"{folder}/ledger/batch={known[-1]}") if known else spark.createDataFrame([], _LEDGER)
