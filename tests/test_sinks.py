import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from auklet.operators.series import plain_number
from auklet.sinks import files, push, reports
from auklet.sources.snapshots import read_snapshots, snapshot_points


@pytest.fixture
def points(spark):
    rows = [(3, "cpu", "usage", 5.5, "%", {"core": "total"}, 0, 0), (3, "cpu", "user_time", 1e21, "", {}, 1, 86400), (3, "disk", "io.wait-x", 2.0, "", {"b": 'q"\\', "a": "1"}, 2, 86400)]
    return spark.createDataFrame(rows, "batch long, component string, name string, value double, unit string, labels map<string,string>, ord int, ts_s long")


def test_points_by_component_and_day(spark, points, tmp_path):
    files.write_points(points, f"file://{tmp_path}/out")
    got = spark.read.json(f"file://{tmp_path}/out")
    assert sorted((r.component, str(r.day)) for r in got.collect()) == [("cpu", "1970-01-01"), ("cpu", "1970-01-02"), ("disk", "1970-01-02")]


def test_expired_days_go(spark, tmp_path):
    samples = spark.createDataFrame([(0, {}, {}), (86400 * 3, {}, {})], "ts long, vals map<string,map<string,double>>, cpu_avg map<string,string>")
    files.write_kpi_days(samples, f"file://{tmp_path}/kpi")
    assert files.prune_days(spark, f"file://{tmp_path}/kpi", date(1970, 1, 3)) == 1
    assert sorted(p.name for p in (tmp_path / "kpi").glob("day=*")) == ["day=1970-01-04"]


def test_snapshots_come_back(spark, points, tmp_path):
    history = spark.createDataFrame([("cpu", "usage", [1.0, 2.0])], "component string, series string, history array<double>")
    files.write_snapshots(points, f"file://{tmp_path}/snap", history)
    docs = read_snapshots(spark, f"file://{tmp_path}/snap")
    assert {r.component: r.history for r in docs.collect()} == {"cpu": {"usage": [1.0, 2.0]}, "disk": None}
    assert sorted((r.component, r.ord, r.value) for r in snapshot_points(docs).collect()) == [("cpu", 0, 5.5), ("cpu", 1, 1e21), ("disk", 0, 2.0)]


def test_exposition_text(points, tmp_path):
    files.write_exposition(points, f"file://{tmp_path}/prom")
    text = "".join(p.read_text() for p in sorted((tmp_path / "prom").glob("part-*")))
    assert text.splitlines() == [
        "# HELP node_cpu_usage cpu/usage", "# TYPE node_cpu_usage gauge", 'node_cpu_usage{core="total"} 5.5',
        "# HELP node_cpu_user_time cpu/user_time", "# TYPE node_cpu_user_time counter", "node_cpu_user_time 1000000000000000000000",
        "# HELP node_disk_io_wait_x disk/io.wait-x", "# TYPE node_disk_io_wait_x gauge", 'node_disk_io_wait_x{a="1",b="q\\"\\\\"} 2',
    ]


def test_numbers_without_exponents(spark):
    given = [0.0, -0.5, 1e-7, 123456789.125, 1.5e20, 2.0, float("inf"), -3e-5]
    got = [r.t for r in spark.createDataFrame([(v,) for v in given], "v double").select(plain_number(F.col("v")).alias("t")).collect()]
    assert got == ["0", "-0.5", "0.0000001", "123456789.125", "150000000000000000000", "2", "+Inf", "-0.00003"]


def test_rank_table(spark, tmp_path):
    files.write_rank_table(spark.createDataFrame([(2, 5), (1, 4)], "rank int, x int"), f"file://{tmp_path}/csv")
    assert "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part-*"))).replace("rank,x\n", "") == "1,4\n2,5\n"


def test_pushes_are_tried_again(spark, tmp_path):
    events = push.with_event_ids(spark.createDataFrame([("a", "ok"), ("b", "down")], "type string, endpoint string"), ["type"])
    got = push.pushed(events, retries=2, backoff_s=0.0, send=lambda to, body, _: to == "ok" and json.loads(body)["type"] == "a").collect()
    assert sorted((r.endpoint, r.attempts, r.delivered) for r in got) == [("down", 3, False), ("ok", 1, True)]
    assert len({r.event_id for r in got}) == 2


def test_reports(spark):
    cards = spark.createDataFrame([(1, "normal", 0.0, "info", None, ""), (2, "confirmed_anomaly", 7.0, "critical", "x", "temp")], "card int, quadrant string, composite double, severity string, cause string, abnormal string")
    assert [r.line[:6] for r in reports.card_report(cards).orderBy("section", "place").collect()] == ["card 2", "card 1"]
    figures = spark.createDataFrame([(r, "m", r * 1000) for r in range(50)], "rank int, metric string, value long")
    got = reports.metric_report(figures, "m").orderBy("place").collect()
    assert len(got) == 35 and got[0].rank == 49 and len(got[0].bar) == 40 and got[-1].rank == 0


def test_delivered_sends_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def send(endpoint, body, timeout_s):
        with open(log, "a") as f:
            f.write(endpoint + "\n")
        return True

    pairs = spark.createDataFrame([(f"e{k}", "http://x", k) for k in range(20)], "event_id string, endpoint string, k int")
    out = push.delivered(pairs, send=send)
    assert out.count() == 20 and out.where("delivered").count() == 20 and len(open(log).readlines()) == 20


def test_snapshots_are_replaced_with_specs(spark, points, tmp_path):
    folder = f"file://{tmp_path}/snap"
    files.write_snapshots(points, folder)
    files.write_snapshots(points.where("component = 'cpu'"), folder, None, points.where("name = 'usage'"))
    got = [json.loads(x) for p in (tmp_path / "snap").glob("part-*") for x in p.read_text().splitlines()]
    assert [(d["component"], len(d["metrics"]), [m["name"] for m in d["specs"]]) for d in got] == [("cpu", 2, ["usage"])]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["snap"]


def test_kpi_samples_come_back(spark, tmp_path):
    from auklet.sources.kpi_files import read_kpi_json

    rows = [(60, 0, "temp", 1.5), (60, 0, "power", 2.0), (60, 3, "temp", 4.0), (86460, 0, "temp", 5.0)]
    files.write_kpi_days(files.samples_of(spark.createDataFrame(rows, "ts_s long, card int, metric string, value double")), f"file://{tmp_path}/kpi")
    assert sorted(tuple(r)[:4] for r in read_kpi_json(spark, f"file://{tmp_path}/kpi/day=*").collect()) == sorted(rows)
