"""Structured Streaming twins of the batch operators: event time with a watermark, state in checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auklet.operators.catalog import kpi_points
from auklet.sinks.files import samples_of, write_kpi_days
from auklet.sinks.push import delivered


def minute_means(points: DataFrame, ts: str = "ts", width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """(bucket, card, metric, n, mean, lowest, highest): each window once, after the watermark has passed it."""
    rows = points.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "card", "metric")
    got = rows.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))
    return got.select(F.col("w.start").alias("bucket"), "card", "metric", "n", "mean", "lowest", "highest")


def counter_increments(points: DataFrame, keys: list[str], ts: str = "ts", width: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """(bucket, keys, value): last less first of each window; a reset wraps at 2^64."""
    rows = points.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys)
    got = rows.agg(F.max_by("value", ts).alias("b"), F.min_by("value", ts).alias("a"))
    d = F.col("b") - F.col("a")
    return got.select(F.col("w.start").alias("bucket"), *keys, F.when(d < 0, d + F.lit(18446744073709551616.0)).otherwise(d).alias("value"))


def _by_key(step: Callable[[tuple, pd.DataFrame, tuple], tuple[pd.DataFrame, tuple]], start: tuple, idle_ms: int | None):
    """A stateful function that folds a key's rows of a batch into its state, in the order of `seq`; keys without rows for idle_ms are forgotten, if it is given."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else start
        for f in sorted_frames(frames):
            out, now = step(key, f, now)
            if len(out):
                yield out
        state.update(now)
        if idle_ms:
            state.setTimeoutDuration(idle_ms)

    return run


def _timeout(idle_ms: int | None) -> str:
    """A stream that runs until its input is used up must not have timeouts: it would wait for them for ever."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def sorted_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key's rows of one micro-batch in order; they are as many as its source's rate gives, not the whole stream."""
    rows = pd.concat(list(frames))
    if len(rows):
        yield rows.sort_values("seq", kind="stable")


def transitions(states: DataFrame, key: str, key_type: str = "long", idle_ms: int | None = None) -> DataFrame:
    """(key, seq, active): rows at which a flag changes, across batches; states are (key, seq, active). Rows not after the last one seen are late and dropped."""

    def step(k, f, now):
        last, at = now
        f = f[f["seq"] > at]
        flags = f["active"].to_numpy(bool)
        before = [last, *flags[:-1]] if len(flags) else []
        out = f[[a != b for a, b in zip(flags, before, strict=True)]]
        if len(f):
            last, at = bool(flags[-1]), int(f["seq"].iloc[-1])
        return pd.DataFrame({key: [k[0]] * len(out), "seq": out["seq"], "active": out["active"]}), (last, at)

    return states.select(key, "seq", "active").groupBy(key).applyInPandasWithState(_by_key(step, (False, -(1 << 62)), idle_ms), f"{key} {key_type}, seq long, active boolean", "active boolean, seq long", "append", _timeout(idle_ms))


def debounced(pairs: DataFrame, key: str, key_type: str = "string", idle_ms: int | None = None) -> DataFrame:
    """(key, seq): rows at least `gap` after the last one let through; pairs are (key, seq, gap)."""

    def step(k, f, now):
        kept, out = now[0], []
        for seq, gap in f[["seq", "gap"]].itertuples(index=False, name=None):
            if kept is None or seq - kept >= gap:
                kept = seq
                out.append(seq)
        return pd.DataFrame({key: [k[0]] * len(out), "seq": out}), (kept,)

    return pairs.select(key, "seq", "gap").groupBy(key).applyInPandasWithState(_by_key(step, (None,), idle_ms), f"{key} {key_type}, seq long", "kept long", "append", _timeout(idle_ms))


def rings(points: DataFrame, key: str, last: int = 60, key_type: str = "string", idle_ms: int | None = None) -> DataFrame:
    """(key, seq, history): after each batch the last values of each series it touched, without negative ones; points are (key, seq, value)."""

    def step(k, f, now):
        values = (list(now[0]) + f.loc[f["value"] >= 0, "value"].tolist())[-last:]
        return pd.DataFrame({key: [k[0]], "seq": [int(f["seq"].max())], "history": [values]}), (values,)

    return points.select(key, "seq", "value").groupBy(key).applyInPandasWithState(_by_key(step, ([],), idle_ms), f"{key} {key_type}, seq long, history array<double>", "history array<double>", "update", _timeout(idle_ms))


def latest_batch(points: DataFrame, key: str, order: str, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands `write` the rows of each key's newest batch within each micro-batch (it replaces what it had)."""

    def each(df: DataFrame, number: int) -> None:
        newest = df.groupBy(key).agg(F.max(order).alias("newest_"))
        write(df.join(newest, key).where(F.col(order) == F.col("newest_")).drop("newest_"), number)

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def increments(points: DataFrame, key: str, key_type: str = "string", idle_ms: int | None = None) -> DataFrame:
    """(key, seq, delta): a counter's increase since the row before, across batches; 0 on the first and on a reset; points are (key, seq, value)."""

    def step(k, f, now):
        values = f["value"].to_numpy(float)
        before = [values[0] if now[0] is None else now[0], *values[:-1]]
        delta = [max(0.0, b - a) for a, b in zip(before, values, strict=True)]
        return pd.DataFrame({key: [k[0]] * len(f), "seq": f["seq"], "delta": delta}), (float(values[-1]),)

    return points.select(key, "seq", "value").groupBy(key).applyInPandasWithState(_by_key(step, (None,), idle_ms), f"{key} {key_type}, seq long, delta double", "last double", "append", _timeout(idle_ms))


def first_values(points: DataFrame, key: str, key_type: str = "string", idle_ms: int | None = None) -> DataFrame:
    """(key, seq, value): values that are sent once, at the first sight of their key; points are (key, seq, value)."""

    def step(k, f, now):
        out = f.head(0 if now[0] else 1)
        return pd.DataFrame({key: [k[0]] * len(out), "seq": out["seq"], "value": out["value"]}), (True,)

    return points.select(key, "seq", "value").groupBy(key).applyInPandasWithState(_by_key(step, (False,), idle_ms), f"{key} {key_type}, seq long, value double", "sent boolean", "append", _timeout(idle_ms))


def deliveries(pairs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **how):
    """Starts a query that sends each micro-batch's pairs once and hands `write` what became of them."""

    def each(df: DataFrame, number: int) -> None:
        write(delivered(df, **how), number)

    return pairs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def kpi_tap(points: DataFrame, folder: str, checkpoint: str, every: str = "60 seconds"):
    """Starts a query that turns each interval's device points into KPI samples and flushes them to the files of their day; a repeated micro-batch replaces its own."""

    def each(df: DataFrame, number: int) -> None:
        write_kpi_days(samples_of(kpi_points(df)), folder, number)

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=every)
