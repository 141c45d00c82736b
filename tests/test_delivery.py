"""Pushes over micro-batches: what failed counts for nothing, and what was taken isn't sent again."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from auklet.sinks.push_stream import EventPush
from auklet.streaming import delivery


@pytest.fixture
def server():
    """Takes events, but those whose id is in `refused`."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            ok = body["event_id"] not in server.refused
            server.seen.append((body["event_id"], ok, body))
            self.send_response(200 if ok else 503)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.refused, server.seen, server.url = set(), [], f"http://127.0.0.1:{server.server_port}/"
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server
    server.shutdown()


def pairs(spark, rows, server):
    df = spark.createDataFrame(rows, "event_id string, subscription string, npu string, type string, ts_s long, debounce_s long")
    return df.withColumn("endpoint", F.lit(server.url))


HOW = {"retries": 0, "backoff_s": 0.0, "timeout_s": 10.0}


def test_a_failed_push_suppresses_nothing(spark, server, tmp_path):
    rows = [
        [("a1", "s1", "1", "card_drop", 100, 60), ("b1", "s1", "2", "card_drop", 100, 60), ("b2", "s1", "2", "card_drop", 130, 60), ("c1", "s2", "1", "card_drop", 100, 0), ("c2", "s2", "1", "card_drop", 101, 0)],
        [("a2", "s1", "1", "card_drop", 120, 60), ("b3", "s1", "2", "card_drop", 159, 60), ("b4", "s1", "2", "card_drop", 190, 60)],
        [("a3", "s1", "1", "card_drop", 150, 60), ("a4", "s1", "1", "card_drop", 180, 60), ("b5", "s1", "2", "card_drop", 240, 60), ("b6", "s1", "2", "card_drop", 250, 60)],
    ]
    server.refused = {"a1", "b1", "b4"}
    folder = f"file://{tmp_path}"
    for k, part in enumerate(rows):
        pairs(spark, part, server).coalesce(1).write.json(f"{folder}/in/b{k}")
    source = spark.readStream.schema(pairs(spark, rows[0], server).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{folder}/in")
    for _ in range(2):  # the second run finds nothing new
        query = delivery.debounced_deliveries(source, f"{folder}/out", f"{folder}/check", **HOW).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r.event_id: "delivered" if r.delivered else "suppressed" if r.suppressed else "failed" for r in spark.read.parquet(f"{folder}/out/deliveries").collect()}
    # a1 failed, so a2 goes; a3 is early after a2. b1 failed, so b2 goes at 130; b3 is early; b4 failed, so b5 goes, 110 after b2; b6 is early
    assert got == {"a1": "failed", "a2": "delivered", "a3": "suppressed", "a4": "delivered", "b1": "failed", "b2": "delivered", "b3": "suppressed", "b4": "failed", "b5": "delivered", "b6": "suppressed", "c1": "delivered", "c2": "delivered"}
    assert Counter(e for e, _, _ in server.seen) == Counter(e for e, what in got.items() if what != "suppressed")
    assert {(r.subscription, r.npu): r.delivered_s for r in delivery.ledger_of(spark, f"{folder}/out").collect()} == {("s1", "1"): 180, ("s1", "2"): 240, ("s2", "1"): 101}


def test_a_repeated_micro_batch_sends_nothing_and_mends_its_ledger(spark, server, tmp_path):
    import shutil

    folder = f"file://{tmp_path}"
    first, second = [("a1", "s", "1", "t", 100, 60)], [("a2", "s", "1", "t", 170, 60), ("a3", "s", "1", "t", 180, 60)]
    delivery.pushed_batch(pairs(spark, first, server), folder, 0, **HOW)
    delivery.pushed_batch(pairs(spark, second, server), folder, 1, **HOW)
    shutil.rmtree(tmp_path / "ledger" / "batch=1")  # lost between the results and the ledger
    again = delivery.pushed_batch(pairs(spark, second, server), folder, 1, **HOW)
    assert sorted((r.event_id, r.delivered) for r in again.collect()) == [("a2", True), ("a3", False)]
    assert [e for e, _, _ in server.seen] == ["a1", "a2"]
    delivery.pushed_batch(pairs(spark, [("a4", "s", "1", "t", 200, 60), ("a5", "s", "1", "t", 230, 60)], server), folder, 2, **HOW)
    assert [e for e, _, _ in server.seen] == ["a1", "a2", "a5"]
    delivery.pushed_batch(pairs(spark, [], server), folder, 3, **HOW)
    delivery.pushed_batch(pairs(spark, [("x", "s", "9", "t", 10**7, 60)], server), folder, 4, **HOW)
    assert [(r.npu, r.delivered_s) for r in delivery.ledger_of(spark, folder).collect()] == [("9", 10**7)]  # what is long past is forgotten


def test_the_streaming_sink_goes_on_after_a_task_failed(spark, server, tmp_path):
    spark.dataSource.register(EventPush)
    folder = f"file://{tmp_path}"
    schema = "event_id string, endpoint string, k int"
    rows = [(f"e{k}", server.url, k) for k in range(12)]
    for b, part in enumerate((rows[:8], rows[8:])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{folder}/in/b{b}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{folder}/in").repartitionByRange(2, "k")

    def start():
        writer = source.writeStream.format("event_push").option("marks", f"{folder}/marks").option("retries", 0).option("timeout_s", 5).option("checkpointLocation", f"{folder}/check")
        return writer.trigger(availableNow=True).start()

    server.refused = {"e6"}  # in the second task of the first micro-batch
    with pytest.raises(StreamingQueryException):
        start().awaitTermination(120)
    taken = {e for e, ok, _ in server.seen if ok}
    assert taken and "e6" not in taken and not taken & {r[0] for r in rows[8:]}
    server.refused = set()
    query = start()
    query.awaitTermination(120)
    assert query.exception() is None
    assert Counter(e for e, ok, _ in server.seen if ok) == Counter(r[0] for r in rows)  # each was taken once
    told = [json.loads(p.read_text()) for p in sorted((tmp_path / "marks" / "committed").glob("*.json"))]
    assert sum(t["sent"] + t["skipped"] for t in told) == 12 and told[0]["skipped"] == len(taken)
    assert not list((tmp_path / "marks" / "sent").iterdir())
    assert all(set(body) == {"event_id", "k"} for _, _, body in server.seen)
