"""Aggregates of samples and intervals, each one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRAP = 18446744073709551616.0


def bucket(ts: Column, width: int) -> Column:
    return ts - F.pmod(ts, F.lit(width))


def midmean(df: DataFrame, keys: list[str], value: str = "value", ratio: float = 0.25, least: int = 4) -> DataFrame:
    """keys and `value`: the mean without max(1, n * ratio) values at each end; the plain mean of fewer than `least`.

    If fewer than two values would remain, the upper median. Ranks come from a sort by key, so a group of any size spills
    instead of being gathered in one array.
    """
    w = Window.partitionBy(*keys)
    n, cut = F.col("n_"), F.greatest(F.lit(1), F.floor(F.col("n_") * ratio))
    rows = df.where(F.col(value).isNotNull()).withColumn("n_", F.count("*").over(w)).withColumn("k_", F.row_number().over(w.orderBy(value)))
    few = n - 2 * cut < 2
    kept = (n < least) | (few & (F.col("k_") == F.floor(n / 2) + 1)) | (~few & F.col("k_").between(cut + 1, n - cut))
    return rows.groupBy(*keys).agg(F.avg(F.when(kept, F.col(value))).alias(value))


def counter_delta(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """keys and `value`: last less first in order, 0 for one sample; a negative difference wraps at 2^64."""
    at = F.struct(*order)
    got = df.groupBy(*keys).agg(F.max_by(value, at).alias("last_"), F.min_by(value, at).alias("first_"), F.count("*").alias("n_"))
    d = F.col("last_") - F.col("first_")
    return got.select(*keys, F.when(F.col("n_") < 2, 0.0).when(d < 0, d + WRAP).otherwise(d).alias(value))


def baselines(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean, sample deviation (0 for one), min, max and exact percentiles with linear interpolation."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    got = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("lowest"), F.max(value).alias("highest"), q.alias("q_")
    )
    return got.select(*keys, "n", "mean", "std", "lowest", "highest", *[F.col("q_")[k].alias(c) for k, c in enumerate(("p50", "p95", "p99"))])


def trend(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, slope and r2 of the least-squares line; (0, 0) for one point or a constant x, r2 of 1 for a constant y."""
    got = df.groupBy(*keys).agg(F.count(y).alias("n"), F.regr_slope(y, x).alias("s_"), F.regr_r2(y, x).alias("r_"))
    flat = (F.col("n") < 2) | F.col("s_").isNull()
    return got.select(*keys, "n", F.when(flat, 0.0).otherwise(F.col("s_")).alias("slope"), F.when(flat, 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce("r_", F.lit(1.0)))).alias("r2"))


def against_peers(df: DataFrame, key: str, member: str, value: str = "value") -> DataFrame:
    """Each member's mean, and the mean of all other members' values pooled, by key; null without others."""
    own = df.groupBy(key, member).agg(F.sum(value).alias("s_"), F.count(value).alias("n_"))
    w = Window.partitionBy(key)
    s, n = F.sum("s_").over(w) - F.col("s_"), F.sum("n_").over(w) - F.col("n_")
    return own.select(key, member, (F.col("s_") / F.col("n_")).alias("own_mean"), F.when(n > 0, s / F.nullif(n, F.lit(0))).alias("peer_mean"))


def mean_of_valid(value: Column) -> Column:
    """Rounded mean of the values that aren't negative; null without any."""
    return F.round(F.avg(F.when(value >= 0, value))).cast("bigint")


def trimmed_pair(df: DataFrame, keys: list[str], duration: str, count: str, order: str) -> DataFrame:
    """Rounded means of duration and count without the rows of least and greatest duration, where there are over two."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("n_", F.count("*").over(w)).withColumn("k_", F.row_number().over(w.orderBy(duration, order)))
    rows = rows.where((F.col("n_") <= 2) | F.col("k_").between(2, F.col("n_") - 1))
    return rows.groupBy(*keys).agg(F.round(F.avg(duration)).cast("bigint").alias(duration), F.round(F.avg(count)).cast("bigint").alias(count))


def union_length(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """keys and `covered`: the length of the union of intervals."""
    before = Window.partitionBy(*keys).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("reach_", F.max(stop).over(before))
    fresh = F.greatest(F.lit(0), F.col(stop) - F.greatest(F.col(start), F.coalesce("reach_", F.col(start))))
    return rows.groupBy(*keys).agg(F.sum(fresh).alias("covered"))


def smoothed(df: DataFrame, host: str = "host", value: str = "value") -> DataFrame:
    """Each row's value becomes its host's mean, without one least and one greatest where there are over two; no host, no change."""
    w = Window.partitionBy(host)
    n, s = F.count(value).over(w), F.sum(value).over(w)
    mean = F.when(n > 2, (s - F.min(value).over(w) - F.max(value).over(w)) / F.nullif(n - 2, F.lit(0))).otherwise(s / n)
    return df.withColumn("smooth", F.when(F.col(host).isNull(), F.col(value)).otherwise(mean))
