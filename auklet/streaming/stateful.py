"""Streams that keep state by event time: rows are held until the watermark has passed the time at which their group is complete, and
folded in order then. Rows that come later pass through, marked `late`, for the batch operators (`backfilled`).

These use processors with state of their own (maps, lists, timers), which Spark keeps in RocksDB: `auklet.session` sets that.
A restarted query goes on from its checkpoint. Output has a column `kind`: `row`, or `late` with what is known of the late row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from auklet.operators.aggregates import WRAP
from auklet.operators.faults import point_faults
from auklet.operators.kpi import COUNTERS


class _Closing(StatefulProcessor):
    """Holds a key's rows until the watermark has passed their `closes` (ms); subclasses say how rows are held, and what comes of them."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for f in rows:
            late = f["closes"] <= passed
            if late.any():
                yield self.out("late", key, self.told(f[late]))
            self.hold(f[~late])
            for at in f.loc[~late, "closes"].unique():
                self.handle.registerTimer(int(at))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self.closed(expiredTimerInfo.getExpiryTimeInMs())
        if len(found):
            yield self.out("row", key, found)

    def out(self, kind: str, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(kind, *key, *r) for r in rows], dtype=object)  # columns go by position

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, mode: str = "append", time: str = "eventTime") -> DataFrame:
    """The processor's rows; its key columns get their own names and types back."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    named = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return df.groupBy(*keys).transformWithStateInPandas(processor, f"kind string, {named}, {out}", mode, time)


class _Faults(_Closing):
    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "closes long, batch long, npu string, name string", "ord long, fires string")
        self.active = handle.getMapState("active", "npu string, type string", "severity string")

    def hold(self, f: pd.DataFrame) -> None:
        for closes, batch, npu, name, ord_, fires in f[["closes", "batch", "npu", "name", "ord", "fires"]].itertuples(index=False, name=None):
            at = (int(closes), int(batch), npu, name)
            if not self.held.containsKey(at) or self.held.getValue(at)[0] <= ord_:  # the last point of a name counts
                self.held.updateValue(at, (int(ord_), fires))

    def told(self, f: pd.DataFrame) -> list[tuple]:
        return [(npu, None, None, batch, None, name, ord_) for npu, batch, name, ord_ in f[["npu", "batch", "name", "ord"]].itertuples(index=False, name=None)]

    def closed(self, at: int) -> list[tuple]:
        batches: dict[int, dict[tuple[str, str], str]] = defaultdict(dict)
        for (closes, batch, npu, name), (_, fires) in list(self.held.iterator()):
            if closes <= at:
                batches[batch] |= {(npu, t): s for t, s in (x.split(":") for x in fires.split(",") if x)}
                self.held.removeKey((closes, batch, npu, name))
        rows = []
        before = {tuple(k): v[0] for k, v in self.active.iterator()}
        for batch in sorted(batches):
            now = batches[batch]
            rows += [(*k, s, batch, True, None, None) for k, s in before.items() if k not in now]
            rows += [(*k, s, batch, False, None, None) for k, s in now.items() if k not in before]
            before = now
        if batches:
            for k in list(self.active.keys()):
                self.active.removeKey(tuple(k))
            for k, s in before.items():
                self.active.updateValue(k, (s,))
        return rows


def fault_events(points: DataFrame, scope: str = "host", device: str = "npu", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """(kind, scope, npu, type, severity, batch, recovered, name, ord): raise and recover events of devices, by the rules of `faults.active_faults`.

    points are (scope, device, batch, name, value, labels, ord, ts, closes): closes is when the batch is complete. A fault
    that lasts says nothing; it recovers at the first later batch of its scope in which it isn't active, whether or not the
    device is in it. The rows equal `faults.transitions` over the same points. A late row is told with its npu, batch, name and ord.
    """
    rows = points.withWatermark(ts, late)
    fires = F.array_join(F.transform(point_faults(), lambda x: F.concat(x["type"], F.lit(":"), x["severity"])), ",")
    rows = rows.select(F.col(scope), F.col(device).cast("string").alias("npu"), "batch", "name", "ord", fires.alias("fires"), F.unix_millis("closes").alias("closes"))
    return _run(rows, [scope], _Faults(), "npu string, type string, severity string, batch long, recovered boolean, name string, ord long")


class _Buckets(_Closing):
    def __init__(self, counters: list[str], ratio: float, least: int, width_ms: int):
        self.counters, self.ratio, self.least, self.width_ms = counters, ratio, least, width_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.values = handle.getMapState("values", "closes long, value double", "n long")
        self.ends = handle.getMapState("ends", "closes long", "n long, first_s long, first_ord long, first double, last_s long, last_ord long, last double")

    def hold(self, f: pd.DataFrame) -> None:
        gauge = ~f["metric"].isin(self.counters)
        for (closes, value), n in f[gauge].groupby(["closes", "value"]).size().items():  # nulls aren't counted
            at = (int(closes), float(value))
            self.values.updateValue(at, (int(n) + (self.values.getValue(at)[0] if self.values.containsKey(at) else 0),))
        for closes, own in f[~gauge].sort_values(["ts_s", "ord"]).groupby("closes"):
            first, last = (tuple(own[["ts_s", "ord", "value"]].iloc[k]) for k in (0, -1))
            n, *ends = self.ends.getValue((int(closes),)) if self.ends.containsKey((int(closes),)) else (0, *first, *last)
            first, last = min(tuple(ends[:3]), first), max(tuple(ends[3:]), last)
            state = (n + len(own), *(kind(x) for end in (first, last) for kind, x in zip((int, int, float), end, strict=True)))
            self.ends.updateValue((int(closes),), state)

    def told(self, f: pd.DataFrame) -> list[tuple]:
        return [((closes - self.width_ms) // 1000, value, ts, ord_) for closes, value, ts, ord_ in f[["closes", "value", "ts_s", "ord"]].itertuples(index=False, name=None)]

    def closed(self, at: int) -> list[tuple]:
        counts: dict[int, list[tuple[float, int]]] = defaultdict(list)
        for (closes, value), (n,) in list(self.values.iterator()):
            if closes <= at:
                counts[closes].append((value, n))
                self.values.removeKey((closes, value))
        found = [(closes, midmean_of(pairs, self.ratio, self.least)) for closes, pairs in counts.items()]
        for (closes,), (n, _, _, first, _, _, last) in list(self.ends.iterator()):
            if closes <= at:
                found.append((closes, 0.0 if n < 2 else last - first + (WRAP if last < first else 0.0)))
                self.ends.removeKey((closes,))
        return [((closes - self.width_ms) // 1000, value, None, None) for closes, value in sorted(found)]


def midmean_of(pairs: list[tuple[float, int]], ratio: float, least: int) -> float:
    """`aggregates.midmean` of values that are given as (value, how often)."""
    n = sum(k for _, k in pairs)
    cut = max(1, int(n * ratio))
    lo, hi = (0, n) if n < least else (n // 2, n // 2 + 1) if n - 2 * cut < 2 else (cut, n - cut)  # of the sorted values those from lo to hi
    total, at = 0.0, 0
    for value, k in sorted(pairs):
        total += value * max(0, min(at + k, hi) - max(at, lo))
        at += k
    return total / (hi - lo)


def minute_table(samples: DataFrame, bucket_s: int = 60, late: str = "2 minutes", ratio: float = 0.25, least: int = 4, counters: tuple[str, ...] = tuple(COUNTERS)) -> DataFrame:
    """(kind, card, metric, bucket, value, ts_s, ord): trimmed means of gauges and increments of counters, each bucket once it is complete.

    samples are (ts timestamp, ts_s, card, metric, value, ord). State is mergeable: how often each value occurs in a bucket, and a
    counter's ends. The rows equal `kpi.minute_table` over the same samples. A late row is told with its bucket, value, ts_s and ord.
    """
    closes = (F.col("ts_s") - F.pmod("ts_s", F.lit(bucket_s)) + bucket_s) * 1000
    rows = samples.withWatermark("ts", late).select("card", "metric", "ts_s", "ord", "value", closes.alias("closes"))
    return _run(rows, ["card", "metric"], _Buckets(list(counters), ratio, least, bucket_s * 1000), "bucket long, value double, ts_s long, ord long")


class _Views(_Closing):
    def __init__(self, last: int):
        self.last = last

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "closes long, poll long, series string", "value double")
        self.series = handle.getMapState("series", "series string", "history array<double>")

    def hold(self, f: pd.DataFrame) -> None:
        for closes, poll, series, value in f[["closes", "poll", "series", "value"]].itertuples(index=False, name=None):
            at = (int(closes), int(poll), series)
            old = self.held.getValue(at)[0] if self.held.containsKey(at) else value
            self.held.updateValue(at, (float(max(old, value)),))

    def told(self, f: pd.DataFrame) -> list[tuple]:
        return [(series, poll, [value]) for series, poll, value in f[["series", "poll", "value"]].itertuples(index=False, name=None)]

    def closed(self, at: int) -> list[tuple]:
        polls: dict[int, dict[str, float]] = defaultdict(dict)
        for (closes, poll, series), (value,) in list(self.held.iterator()):
            if closes <= at:
                polls[poll][series] = value
                self.held.removeKey((closes, poll, series))
        rows = []
        for poll in sorted(polls):
            for (series,) in list(self.series.keys()):
                if series not in polls[poll]:
                    self.series.removeKey((series,))
            for series, value in polls[poll].items():
                before = list(self.series.getValue((series,))[0]) if self.series.containsKey((series,)) else []
                self.series.updateValue((series,), ([float(x) for x in (before + [value] * (value >= 0))[-self.last :]],))
            rows += [(series, poll, list(history)) for (series,), (history,) in self.series.iterator()]
        return rows


def rolling_views(points: DataFrame, scope: str, last: int = 60, late: str = "1 minute") -> DataFrame:
    """(kind, scope, series, poll, history): after each complete poll of a scope the last values of the series that it has.

    points are (scope, series text, poll, value, ts, closes); of several values of a poll the largest counts, negative ones
    aren't kept. A series that a poll lacks is forgotten; if it comes back, its history begins anew, as in `windows.unbroken`.
    """
    rows = points.withWatermark("ts", late).select(scope, "series", "poll", "value", F.unix_millis("closes").alias("closes"))
    return _run(rows, [scope], _Views(last), "series string, poll long, history array<double>")


class _Newest(StatefulProcessor):
    """The newest rows of a key, in a list that is forgotten when nothing was written to it for a while."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle) -> None:
        self.rows = handle.getListState("rows", "seq long, value string", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for f in rows:
            kept = sorted([*kept, *f[["seq", "value"]].itertuples(index=False, name=None)])[-self.n :]
        kept = [(int(seq), value) for seq, value in kept]
        if kept:
            self.rows.put(kept)
            yield pd.DataFrame([("row", *key, kept[-1][0], [{"seq": s, "value": v} for s, v in kept])], dtype=object)

    def close(self) -> None:
        pass


def newest_rows(rows: DataFrame, key: str, n: int, idle_ms: int | None = None) -> DataFrame:
    """(kind, key, newest, rows): after each micro-batch the n rows of largest seq of every key that it touched, in order; rows are (key, seq, value text).

    The order of arrival doesn't matter. A key that nothing was written to for idle_ms is forgotten, if that is given.
    """
    return _run(rows.select(key, "seq", F.col("value").cast("string").alias("value")), [key], _Newest(n, idle_ms), "newest long, rows array<struct<seq:bigint,value:string>>", "update", "processingTime" if idle_ms else "none")


def value_rings(points: DataFrame, key: str, last: int = 60, idle_ms: int | None = None) -> DataFrame:
    """(key, newest, history): the last values of every series that a micro-batch touched, without negative ones; points are (key, seq, value)."""
    got = newest_rows(points.where("value >= 0"), key, last, idle_ms)
    return got.select(key, "newest", F.transform("rows", lambda r: r["value"].cast("double")).alias("history"))


def event_ring(events: DataFrame, n: int = 1024, shards: int = 16, idle_ms: int | None = None) -> DataFrame:
    """(shard, newest, rows): the newest events, dealt over shards by a hash of seq, so that no task keeps the whole stream's; events are (seq, value text).

    Every shard keeps n, so the newest n of all shards' last rows (`newest_of`) are the newest n of the stream.
    """
    return newest_rows(events.withColumn("shard", F.pmod(F.xxhash64("seq"), F.lit(shards)).cast("int")), "shard", n, idle_ms).drop("kind")


def newest_of(rings: DataFrame, n: int = 1024, batch: str = "batch") -> DataFrame:
    """(seq, value): the newest n events of what event_ring wrote so far, with the number of the micro-batch; every shard's last row counts."""
    last = rings.groupBy("shard").agg(F.max_by("rows", batch).alias("rows"))
    return last.select(F.inline("rows")).orderBy(F.desc("seq")).limit(n)


def unique(points: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Points of each key once within the watermark's delay, so what a source sends again isn't counted twice."""
    return points.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def routed(out: DataFrame, folder: str, checkpoint: str):
    """Starts writing rows to folder/row and late ones to folder/late, below batch=N: a repeated micro-batch replaces what it wrote."""

    def each(df: DataFrame, number: int) -> None:
        df = df.persist()
        for kind in ("row", "late"):
            df.where(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/{kind}/batch={number}")
        df.unpersist()

    return out.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint)


def backfilled(results: DataFrame, late: DataFrame, source: DataFrame, keys: list[str], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream gave, with every key that has late rows computed anew by the batch operator over all of its source rows.

    keys name columns of all three tables: the least groups that the operator treats apart (a bucket of a card's metric, a host's events).
    """
    touched = late.select(*keys).distinct()
    anew = operator(source.join(touched, keys, "left_semi"))
    return results.join(touched, keys, "left_anti").select(*anew.columns).unionByName(anew)

