import pytest
from pyspark.sql import functions as F

from auklet.operators import faults
from auklet.streaming import jobs


@pytest.fixture
def stream(spark, tmp_path):
    """Batches of rows as a file stream, a file each, read to the end; gives all rows that came out."""

    def run(batches, schema, job, mode="append"):
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/in/b{k:03d}")
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"file://{tmp_path}/in")
        name = f"out_{tmp_path.name}".replace("-", "_")
        query = job(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.table(name).collect()

    return run


def test_minute_windows_equal_batch(spark, stream):
    at = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}"
    rows = [(at(s), s % 2, "temp", float(s)) for s in range(0, 600, 20)]
    schema = "ts timestamp, card int, metric string, value double"
    text = "ts string, card int, metric string, value double"
    typed = [spark.createDataFrame(part, text).withColumn("ts", F.to_timestamp("ts")).collect() for part in (rows[:15], rows[15:])]
    got = stream(typed, schema, jobs.minute_means)
    whole = jobs.minute_means(spark.createDataFrame(typed[0] + typed[1], schema)).collect()
    assert set(got) <= set(whole) and (len(whole), len(got)) == (10, 7)  # the newest windows wait for the watermark


def test_transitions_equal_batch(spark, stream):
    flags = [0, 1, 1, 0, 0, 1, 0, 1, 1, 1, 0, 0]
    rows = [(npu, k, bool(f) != (npu == 2)) for npu in (1, 2) for k, f in enumerate(flags)]
    schema = "npu long, seq long, active boolean"
    got = stream([[r for r in rows if r[1] < 5], [r for r in rows if r[1] >= 5]], schema, lambda s: jobs.transitions(s, "npu"))
    want = faults.edges(spark.createDataFrame(rows, schema), ["npu"], "seq").collect()
    assert sorted(got) == sorted((r.npu, r.seq, r.active) for r in want)


def test_debounce_equals_batch(spark, stream):
    rows = [(f"k{k % 2}", k * k % 97 + 97 * (k // 10), 40) for k in range(30)]
    schema = "key string, seq long, gap long"
    parts = [[r for r in rows if r[1] // 97 == part] for part in range(3)]
    got = stream(parts, schema, lambda s: jobs.debounced(s, "key"))
    want = faults.debounced(spark.createDataFrame(rows, schema), ["key"], "seq", "gap", "seq").collect()
    assert sorted((r.key, r.seq) for r in got) == sorted((r.key, r.seq) for r in want)


def test_rings_keep_the_last_values(stream):
    rows = [("a", k, float(k - 2)) for k in range(9)]
    got = stream([rows[:4], rows[4:]], "key string, seq long, value double", lambda s: jobs.rings(s, "key", last=3), "update")
    assert sorted((r.seq, r.history) for r in got) == [(3, [0.0, 1.0]), (8, [4.0, 5.0, 6.0])]


def test_increments_and_first_values_go_over_batches(spark, stream):
    rows = [("a", 1, 5.0), ("b", 1, 7.0), ("a", 2, 9.0), ("a", 3, 4.0), ("b", 2, 7.5), ("a", 4, 4.5)]
    got = stream([rows[:3], rows[3:]], "key string, seq long, value double", lambda s: jobs.increments(s, "key"))
    assert sorted(map(tuple, got)) == [("a", 1, 0.0), ("a", 2, 4.0), ("a", 3, 0.0), ("a", 4, 0.5), ("b", 1, 0.0), ("b", 2, 0.5)]


def test_first_values_are_sent_once(spark, stream):
    rows = [("a", 1, 5.0), ("b", 1, 7.0), ("a", 2, 9.0), ("c", 3, 4.0)]
    got = stream([rows[:2], rows[2:]], "key string, seq long, value double", lambda s: jobs.first_values(s, "key"))
    assert sorted(map(tuple, got)) == [("a", 1, 5.0), ("b", 1, 7.0), ("c", 3, 4.0)]


def test_kpi_tap_flushes_to_days(spark, tmp_path):
    from auklet.sources.kpi_files import read_kpi_json

    schema = "ts_s long, component string, name string, value double, unit string, labels map<string,string>, ord long"
    spark.createDataFrame([(60, "npu", "temperature", 40.0, "C", {"npu_id": "1"}, 1), (60, "cpu", "usage", 4.0, "%", {}, 2)], schema).write.json(f"file://{tmp_path}/in")
    query = jobs.kpi_tap(spark.readStream.schema(schema).json(f"file://{tmp_path}/in"), f"file://{tmp_path}/kpi", f"file://{tmp_path}/check", "1 second").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.ts_s, r.card, r.metric, r.value) for r in read_kpi_json(spark, f"file://{tmp_path}/kpi/day=*").collect()] == [(60, 1, "temp", 40.0)]


def test_a_repeated_micro_batch_replaces_its_samples(spark, tmp_path):
    from auklet.sinks.files import write_kpi_days
    from auklet.sources.kpi_files import read_kpi_json

    folder = f"file://{tmp_path}/kpi"
    samples = lambda v: spark.createDataFrame([(60, {"1": {"temp": v}}, {}), (90_000, {"1": {"temp": v}}, {})], "ts long, vals map<string,map<string,double>>, cpu_avg map<string,string>")
    for number, value in ((0, 1.0), (1, 2.0), (1, 3.0)):
        write_kpi_days(samples(value), folder, number)
    assert sorted((r.ts_s, r.value) for r in read_kpi_json(spark, f"{folder}/day=*").collect()) == [(60, 1.0), (60, 3.0), (90_000, 1.0), (90_000, 3.0)]


def test_counter_increments_equal_batch(spark, stream):
    rows = [("a", s, float(s % 50)) for s in range(0, 300, 7)] + [("b", s, 2.0 * s) for s in range(0, 300, 11)]
    schema = "key string, s long, value double"
    typed = lambda df: df.withColumn("ts", F.timestamp_seconds("s"))
    job = lambda df: jobs.counter_increments(typed(df), ["key"])
    got = stream([[r for r in rows if r[1] < 150], [r for r in rows if r[1] >= 150]], schema, job)
    whole = job(spark.createDataFrame(rows, schema)).collect()
    assert got and set(got) <= set(whole)
    from auklet.operators.aggregates import bucket, counter_delta

    want = counter_delta(spark.createDataFrame(rows, schema).withColumn("b", bucket(F.col("s"), 60)), ["b", "key"], ["s"]).collect()
    assert sorted((int(r.bucket.timestamp()), r.key, r.value) for r in whole) == sorted((r.b, r.key, r.value) for r in want)


def test_latest_batch_and_deliveries(spark, tmp_path):
    from auklet.operators import windows

    rows = [("cpu", 1, 1.0), ("cpu", 2, 2.0), ("cpu", 2, 3.0), ("disk", 1, 4.0)]
    schema = "component string, batch long, value double"
    spark.createDataFrame(rows, schema).write.json(f"file://{tmp_path}/in")
    source = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
    query = jobs.latest_batch(source, "component", "batch", lambda df, n: df.write.parquet(f"file://{tmp_path}/out/n={n}"), f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out").select("component", "batch", "value").collect()
    want = windows.latest(spark.createDataFrame(rows, schema), ["component"], ["batch"]).select("component", "batch", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3

    log = str(tmp_path / "sent")

    def send(endpoint, body, timeout_s):
        with open(log, "a") as f:
            f.write(body + "\n")
        return '"e1"' not in body

    spark.createDataFrame([("e0", "http://x", 1), ("e1", "http://x", 2)], "event_id string, endpoint string, k int").write.json(f"file://{tmp_path}/pairs")
    pairs = spark.readStream.schema("event_id string, endpoint string, k int").json(f"file://{tmp_path}/pairs")
    query = jobs.deliveries(pairs, lambda df, n: df.write.parquet(f"file://{tmp_path}/told/n={n}"), f"file://{tmp_path}/c2", retries=1, backoff_s=0.0, send=send).trigger(availableNow=True).start()
    query.awaitTermination(120)
    told = {r.event_id: (r.attempts, r.delivered) for r in spark.read.parquet(f"file://{tmp_path}/told").collect()}
    assert told == {"e0": (1, True), "e1": (2, False)} and len(open(log).readlines()) == 3
