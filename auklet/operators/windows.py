"""What depends on the sample before, by series: deltas, rates, shares, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def cpu_usage(counters: DataFrame, keys: list[str], order: list[str], fields: list[str], idle: str) -> DataFrame:
    """Share of the time since the sample before that wasn't idle, and of each field, in percent.

    Nothing passed: 0. The first sample has a usage of 0 and no shares.
    """
    w = _before(keys, order)
    total = sum((F.col(f) for f in fields[1:]), F.col(fields[0]))
    rows = counters.withColumn("total_", total)
    d = {f: F.col(f) - F.lag(f).over(w) for f in fields} | {"total_": F.col("total_") - F.lag("total_").over(w)}
    rows = rows.withColumns({f"d_{f}": c for f, c in d.items()})
    share = lambda part: F.when(F.col("d_total_").isNull(), None).when(F.col("d_total_") > 0, 100.0 * part / F.nullif(F.col("d_total_"), F.lit(0))).otherwise(0.0)
    usage = F.coalesce(share(F.col("d_total_") - F.col(f"d_{idle}")), F.lit(0.0))
    return rows.select(*keys, *order, usage.alias("usage"), *[share(F.col(f"d_{f}")).alias(f"{f}_pct") for f in fields])


def cpu_shares(counters: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Percent of each field's increase, decreases counting as none; where nothing increased, the last shares before that aren't null."""
    w = _before(keys, order)
    rows = counters.withColumns({f"d_{f}": F.when(F.lag(f).over(w).isNotNull(), F.greatest(F.lit(0), F.col(f) - F.lag(f).over(w))) for f in fields})
    total = sum((F.col(f"d_{f}") for f in fields[1:]), F.col(f"d_{fields[0]}"))
    rows = rows.withColumn("t_", total)
    now = F.when(F.col("t_") > 0, F.struct(*[(100.0 * F.col(f"d_{f}") / F.nullif(F.col("t_"), F.lit(0))).alias(f"{f}_pct") for f in fields]))
    last = F.last(now, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("s_", last).select(*keys, *order, "s_.*")


def clamped_delta(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Increase since the sample before; 0 on the first and on a reset."""
    prev = F.lag(value).over(_before(keys, order))
    return df.select(*keys, *order, F.when(F.col(value) >= prev, F.col(value) - prev).otherwise(F.lit(0)).alias("delta"))


def rate(df: DataFrame, keys: list[str], order: list[str], ts: str, value: str = "value", seconds: float | None = None) -> DataFrame:
    """Increase by second since the sample before, over elapsed time or a fixed interval; no row for the first sample or without elapsed time."""
    w = _before(keys, order)
    gap = F.lit(float(seconds)) if seconds else (F.col(ts) - F.lag(ts).over(w)).cast("double")
    rows = df.withColumns({"gap_": gap, "prev_": F.lag(value).over(w)})
    return rows.where("prev_ is not null and gap_ > 0").select(*keys, *order, (F.greatest(F.lit(0), F.col(value) - F.col("prev_")) / F.col("gap_")).alias("rate"))


def error_delta(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """Difference to the sample before; 0 if there is none or it was 0."""
    prev = F.lag(value).over(_before(keys, order))
    return df.select(*keys, *order, F.when(prev > 0, F.col(value) - prev).otherwise(F.lit(0)).alias("delta"))


def history(df: DataFrame, keys: list[str], order: list[str], value: str = "value", last: int = 60) -> DataFrame:
    """The last values of each series in order, without negative ones; only those rows are gathered."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = df.where(F.col(value) >= 0).withColumn("k_", F.row_number().over(newest)).where(F.col("k_") <= last)
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct((-F.col("k_")).alias("k"), F.col(value).alias("v")))).alias("h_"))
    return got.select(*keys, F.transform("h_", lambda x: x["v"]).alias("history"))


def unbroken(points: DataFrame, scope: str, series: str, poll: str, value: str = "value", last: int = 60) -> DataFrame:
    """(scope, series, history) of the series in a scope's newest poll: their last values, back to the first poll that lacks them.

    Of several values of a poll the largest counts, negative ones aren't kept. Polls are numbered within a scope; they are far fewer than points.
    """
    polls = points.groupBy(scope, poll).agg(F.first(F.lit(1)).alias("one_"))
    polls = polls.select(scope, poll, F.row_number().over(Window.partitionBy(scope).orderBy(F.desc(poll))).alias("back_"))
    rows = points.groupBy(scope, series, poll).agg(F.max(value).alias(value)).join(polls, [scope, poll])
    rows = rows.withColumn("k_", F.row_number().over(Window.partitionBy(scope, series).orderBy("back_"))).where("k_ = back_")
    kept = rows.where(F.col(value) >= 0).withColumn("place_", F.row_number().over(Window.partitionBy(scope, series).orderBy("back_"))).where(F.col("place_") <= last)
    held = kept.groupBy(scope, series).agg(F.sort_array(F.collect_list(F.struct((-F.col("back_")).alias("k"), F.col(value).alias("v")))).alias("h_"))
    newest = rows.where("back_ = 1").select(scope, series).join(held, [scope, series], "left")
    return newest.select(scope, series, F.coalesce(F.transform("h_", lambda x: x["v"]), F.array().cast("array<double>")).alias("history"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of each key's newest batch."""
    newest = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("o_"))
    return df.join(newest, keys).where(F.struct(*order) == F.col("o_")).drop("o_")


def second_to_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row before the last of each key, or its only row."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"n_": F.count("*").over(w), "k_": F.row_number().over(w.orderBy(*[F.desc(c) for c in order]))})
    return rows.where(F.col("k_") == F.least(F.lit(2), F.col("n_"))).drop("n_", "k_")


def top_and_bottom(df: DataFrame, keys: list[str], value: str, tie: str, top: int = 30, bottom: int = 5) -> DataFrame:
    """Of each key the `top` greatest and `bottom` least rows, none twice."""
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"place": F.row_number().over(w.orderBy(F.desc(value), tie)), "n_": F.count("*").over(w)})
    return rows.where((F.col("place") <= top) | (F.col("place") > F.col("n_") - bottom)).drop("n_")


def chunks(position: Column, n: Column, parts: int) -> Column:
    """Which of the runs of max(1, n // parts) positions (from 1) it is in; what is over makes further runs."""
    return F.floor((position - 1) / F.greatest(F.lit(1), F.floor(n / parts))).cast("int")


def axis(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Axis limits: one more at the top of a flat series; from 0 where the spread is under a hundredth of the greatest value."""
    got = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    small = (F.col("hi") - F.col("lo") < 0.01 * F.col("hi")) & (F.col("lo") > 0)
    return got.select(*keys, F.when(small, 0.0).otherwise(F.col("lo")).alias("lo"), F.when(F.col("hi") == F.col("lo"), F.col("hi") + 1).otherwise(F.col("hi")).alias("hi"), "mean")
