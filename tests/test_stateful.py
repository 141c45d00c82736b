"""Streams by event time, over several micro-batches and a restart, held against the batch operators over the same rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from auklet.operators import faults, kpi, windows
from auklet.operators.aggregates import midmean
from auklet.plans import views as V
from auklet.plans.fleet_queries import QUERIES
from auklet.streaming import stateful
from tests.oracle import DATA

SF = str(DATA / "sf0.001")
DAY = 86_400


@pytest.fixture
def batches(spark, tmp_path):
    """Writes micro-batches as files; `run` reads all that aren't read yet to the end, from the same checkpoint, as a restarted query does."""

    class Batches:
        folder, n = f"file://{tmp_path}", 0

        def add(self, *parts):
            for df in parts:
                df.coalesce(1).write.json(f"{self.folder}/in/b{self.n:03d}")
                self.n += 1
                self.schema = df.schema

        def source(self):
            return spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{self.folder}/in")

        def run(self, job):
            query = stateful.routed(job(self.source()), f"{self.folder}/out", f"{self.folder}/check").trigger(availableNow=True).start()
            query.awaitTermination(300)
            assert query.exception() is None
            read = lambda kind: spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/out/{kind}")
            return read("row"), read("late")

    return Batches()


def days(df, lo, hi):
    return df.where((F.col("day_") >= lo) & (F.col("day_") < hi))


def with_days(spark, df, ts_s):
    """df with its event time, and the time at which its day is complete."""
    day = F.floor(ts_s / DAY).cast("long")
    return df.withColumns({"ts": F.timestamp_seconds(ts_s), "closes": F.timestamp_seconds((day + 1) * DAY), "day_": day - 19723})  # 2024-01-01 is day 19723


def test_fault_events_equal_the_batch_query_with_late_rows_and_a_restart(spark, batches):
    at = V.table(spark, SF, "events").select(F.col("event_id").alias("ord"), V.seconds(F.col("ts")).alias("ts_s"))
    points = with_days(spark, V.probes(spark, SF).join(at, "ord"), F.col("ts_s")).drop("ts_s").persist()
    behind = F.col("ord") % 9 == 0  # these come two batches later, within the watermark's delay
    lost = (F.col("ord") % 50 == 7) & (F.col("day_") < 8)  # and these far too late
    cut = [0, 7, 12, 16, 21, 40]
    parts = [days(points, a, b).where(~behind & ~lost) for a, b in zip(cut, cut[1:], strict=False)]
    parts = [p if k < 1 else p.union(days(points, cut[k - 1], cut[k]).where(behind & ~lost)) for k, p in enumerate(parts)]
    end = points.where("host = 0").limit(1).withColumns({"host": F.lit(99), "ts": F.timestamp_seconds(F.lit(2_000_000_000)), "closes": F.timestamp_seconds(F.lit(2_100_000_000))})
    last = days(points, cut[-2], cut[-1]).where(behind & ~lost).union(end)

    job = lambda s: stateful.fault_events(s, late="10 days")
    batches.add(*parts[:3])
    batches.run(job)
    batches.add(*parts[3:], last)
    batches.run(job)
    gone = points.where(lost)
    assert gone.count() > 3
    batches.add(gone)  # after everything has been closed
    rows, late = batches.run(job)

    key = lambda r: (r.host, str(r.npu), r.type, r.severity, r.batch, r.recovered)
    batch = lambda p: faults.transitions(faults.active_faults(p, ["host", "npu", "batch"]), p.select("host", "batch"), ["host"])
    assert sorted(map(key, rows.collect())) == sorted(map(key, batch(points.where(~lost)).collect()))
    assert sorted(r.ord for r in late.collect()) == sorted(r.ord for r in gone.collect())
    whole = stateful.backfilled(rows.withColumn("npu", F.col("npu").cast("int")), late, points, ["host"], batch)
    want = QUERIES["df1_fault_events"](spark, SF).collect()
    assert sorted(map(key, whole.collect())) == sorted(map(key, want)) and len(want) > 100


def test_a_device_that_a_batch_lacks_recovers(spark, batches):
    schema = "host int, npu int, batch long, name string, value double, labels map<string,string>, ord long, ts timestamp, closes timestamp"
    row = lambda npu, b, name="hbm_double_ecc", value=1.0: (0, npu, b, name, value, {}, b * 10 + npu)

    def df(rows):
        plain = spark.createDataFrame(rows, schema.rsplit(", ts", 1)[0])
        return plain.withColumns({"ts": F.timestamp_seconds(F.col("batch") * 60), "closes": F.timestamp_seconds(F.col("batch") * 60 + 60)})

    batches.add(df([row(1, 1), row(2, 1), row(1, 2)]), df([row(1, 3), row(2, 3, "card_drop", 0.0), row(2, 4, "card_drop", 1.0)]), df([row(7, 99)]))
    rows, late = batches.run(lambda s: stateful.fault_events(s, late="1 second"))
    got = sorted((r.batch, r.npu, r.type, r.recovered) for r in rows.where("batch < 99").collect())
    assert got == [(1, "1", "hbm_uce", False), (1, "2", "hbm_uce", False), (2, "2", "hbm_uce", True), (4, "1", "hbm_uce", True), (4, "2", "card_drop", False)]
    assert late.count() == 0


def test_buckets_equal_the_batch_table_and_backfill_mends_late_ones(spark, batches):
    samples = with_days(spark, V.kpi(spark, SF), F.col("ts_s")).drop("closes").persist()
    lost = (F.col("ord") % 40 == 3) & (F.col("day_") < 6)
    cut = [0, 6, 13, 22, 40]
    parts = [days(samples, a, b).where(~lost) for a, b in zip(cut, cut[1:], strict=False)]
    end = samples.limit(1).withColumns({"ts": F.timestamp_seconds(F.lit(2_000_000_000)), "ts_s": F.lit(2_000_000_000).cast("long")})
    job = lambda s: stateful.minute_table(s, bucket_s=DAY, late="1 hour")
    batches.add(*parts[:2])
    batches.run(job)
    batches.add(*parts[2:], end, samples.where(lost))
    rows, late = batches.run(job)

    s = kpi.Settings(bucket_s=DAY)
    table = lambda df: {(r.bucket, r.card, r.metric): r.value for r in df.collect()}
    want = table(kpi.minute_table(samples.where(~lost), s))
    got = table(rows)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 300
    assert sorted(r.ord for r in late.collect()) == sorted(r.ord for r in samples.where(lost).collect()) and late.count() > 3
    source = samples.withColumn("bucket", F.col("ts_s") - F.pmod("ts_s", F.lit(DAY)))
    whole = table(stateful.backfilled(rows, late, source, ["bucket", "card", "metric"], lambda df: kpi.minute_table(df.drop("bucket"), s)))
    want = table(kpi.minute_table(samples, s))
    assert whole.keys() == want.keys() and all(whole[k] == pytest.approx(want[k]) for k in want)


def test_midmean_of_counts(spark):
    rng = random.Random(4)
    for n in range(1, 30):
        values = [float(rng.randrange(6)) for _ in range(n)]
        want = midmean(spark.createDataFrame([(1, v) for v in values], "k int, value double"), ["k"]).first().value
        assert stateful.midmean_of([(v, values.count(v)) for v in set(values)], 0.25, 4) == pytest.approx(want)
        if n > 6:
            break
    twenty = [39, 40, 41, 42, 43, 44, 45, 45, 46, 46, 47, 47, 48, 49, 50, 51, 55, 60, 65, 72]
    assert stateful.midmean_of([(v, twenty.count(v)) for v in set(twenty)], 0.25, 4) == pytest.approx(sum(sorted(twenty)[5:15]) / 10)


def test_value_rings_equal_histories_whatever_the_order(spark, batches):
    points = V.states(spark, SF).select(F.col("npu").cast("string").alias("npu"), F.col("batch").cast("long").alias("seq"), (F.col("value") - 50).alias("value")).persist()
    for k in (2, 0, 1):  # histories come out of order
        batches.add(points.where(F.col("seq") % 3 == k))
    for k in range(2):
        query = stateful.value_rings(batches.source(), "npu", last=20).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{batches.folder}/rings/batch={n}"))
        query.option("checkpointLocation", f"{batches.folder}/c").trigger(availableNow=True).start().awaitTermination(200)
        if not k:
            batches.add(points.withColumn("seq", F.col("seq") + 1000).where("seq % 2 = 0"))
    last = spark.read.parquet(f"{batches.folder}/rings").groupBy("npu").agg(F.max_by("history", "batch").alias("history"))
    whole = points.union(points.withColumn("seq", F.col("seq") + 1000).where("seq % 2 = 0"))
    want = windows.history(whole, ["npu"], ["seq"], last=20)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))


def test_event_ring_equals_newest(spark, batches):
    events = V.table(spark, SF, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("value"))
    batches.add(*(events.where(F.col("seq") % 4 == k) for k in (3, 1, 0, 2)))
    query = stateful.event_ring(batches.source(), n=100, shards=3).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{batches.folder}/ring/batch={n}"))
    query.option("checkpointLocation", f"{batches.folder}/c").trigger(availableNow=True).start().awaitTermination(200)
    got = stateful.newest_of(spark.read.parquet(f"{batches.folder}/ring"), 100).collect()
    want = faults.newest(events, "seq", 100).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_idle_keys_are_forgotten(spark, batches):
    """A stream with a time to live runs until it is stopped."""
    df = lambda rows: spark.createDataFrame(rows, "key string, seq long, value double")
    batches.add(df([("a", 1, 1.0)]))
    writer = stateful.value_rings(batches.source(), "key", idle_ms=1).writeStream.outputMode("update").format("memory").queryName("idle").option("checkpointLocation", f"{batches.folder}/c")
    query = writer.trigger(processingTime="1 second").start()
    try:
        for n in (1, 2):  # it never has nothing left to do: the clock goes on
            until = time.monotonic() + 60
            while spark.table("idle").count() < n and time.monotonic() < until:
                time.sleep(0.5)
            if n == 1:
                time.sleep(2)
                batches.add(df([("a", 2, 2.0)]))
        got = [r.history for r in spark.table("idle").collect()]
    finally:
        query.stop()
    assert got == [[1.0], [2.0]]


def test_rolling_views_forget_series_that_a_poll_lacks(spark, batches):
    rows = V.table(spark, SF, "events").select((F.col("user_id") % 2).cast("int").alias("host"), F.col("user_id").cast("string").alias("series"), (F.col("value") - 20).alias("value"), V.seconds(F.col("ts")).alias("s"))
    points = with_days(spark, rows, F.col("s")).withColumn("poll", F.col("day_")).drop("s").persist()
    end = points.limit(1).withColumns({"host": F.lit(9), "ts": F.timestamp_seconds(F.lit(2_000_000_000)), "closes": F.timestamp_seconds(F.lit(2_100_000_000))})
    cut = [0, 9, 19, 40]
    parts = [days(points, a, b) for a, b in zip(cut, cut[1:], strict=False)]
    job = lambda s: stateful.rolling_views(s, "host", last=5, late="1 hour")
    batches.add(parts[0], parts[1])
    batches.run(job)
    batches.add(parts[2], end)
    got, late = batches.run(job)
    assert late.count() == 0
    for upto in (12, 40):
        newest = got.where(F.col("poll") < upto)
        newest = newest.join(newest.groupBy("host").agg(F.max("poll").alias("poll")), ["host", "poll"])
        want = windows.unbroken(points.where(F.col("poll") < upto), "host", "series", "poll", last=5).collect()
        assert sorted((r.host, r.series, tuple(r.history)) for r in newest.collect()) == sorted((r.host, r.series, tuple(r.history)) for r in want) and len({len(r.history) for r in want}) > 2


def test_unique_drops_what_a_source_sends_again(spark, batches):
    df = lambda rows: spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    batches.add(df([("a", 10), ("b", 11), ("a", 10)]), df([("a", 10), ("c", 30)]), df([("b", 11), ("c", 31), ("d", 32)]))
    query = stateful.unique(batches.source(), ["k"], late="1 hour").writeStream.format("memory").queryName("once").option("checkpointLocation", f"{batches.folder}/c").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert sorted(r.k for r in spark.table("once").collect()) == ["a", "b", "c", "d"]
