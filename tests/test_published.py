import threading
from datetime import datetime, timezone

import pytest

from auklet.sinks import files
from auklet.sources import kpi_files as K
from auklet.sources.snapshots import published_snapshots


@pytest.fixture
def points(spark):
    rows = [("cpu", "usage", 5.5, "%", {"core": "total"}, 1, 0), ("cpu", "temp", 40.0, "C", {}, 1, 1), ("disk", "io", 2.0, "", {"device": "sda"}, 1, 2)]
    return spark.createDataFrame(rows, "component string, name string, value double, unit string, labels map<string,string>, batch bigint, ord long")


def test_readers_meet_a_whole_version_at_any_time(spark, points, tmp_path):
    folder, wrong, stop = f"file://{tmp_path}/snap", [], threading.Event()
    assert published_snapshots(spark, folder).count() == 0
    files.publish_snapshots(points, folder)

    def read():
        while not stop.is_set():
            try:
                got = {r.component: len(r.metrics) for r in published_snapshots(spark, folder).collect()}
                if got not in ({"cpu": 2, "disk": 1}, {"cpu": 2}):
                    wrong.append(got)
            except Exception as e:  # noqa: BLE001
                wrong.append(repr(e)[:300])

    reader = threading.Thread(target=read)
    reader.start()
    numbers = [files.publish_snapshots(points if k % 2 else points.where("component = 'cpu'"), folder) for k in range(8)]
    stop.set()
    reader.join()
    assert not wrong and numbers == list(range(2, 10))
    assert files.versions(spark, folder) == [7, 8, 9]  # the newest three stay
    assert {r.component for r in published_snapshots(spark, folder).collect()} == {"cpu", "disk"}


def test_a_failed_writer_leaves_the_last_version(spark, points, tmp_path):
    folder = f"file://{tmp_path}/snap"
    files.publish_snapshots(points, folder)
    (tmp_path / "snap" / "version=2").mkdir()
    (tmp_path / "snap" / "version=2" / "part-0.json").write_text('{"component": "half"')
    assert {r.component for r in published_snapshots(spark, folder).collect()} == {"cpu", "disk"}
    assert files.publish_snapshots(points.where("component = 'disk'"), folder) == 3 and files.versions(spark, folder) == [1, 3]
    assert not (tmp_path / "snap" / "version=2").exists()


def test_global_documents_wait_for_all_components(spark, tmp_path):
    folder = f"file://{tmp_path}/global"
    health = spark.createDataFrame([(1, 90.0, "Excellent", "cpu"), (2, 70.0, "Good", "cpu")], "node int, score double, grade string, server_type string")
    scores = lambda rows: spark.createDataFrame(rows, "node int, component string, score double, max double")
    some = [(1, "cpu", 9.0, 10.0), (2, "disk", 5.0, 10.0)]
    publish = lambda rows: files.publish_global_snapshot(scores(rows), health, "node", folder, ["cpu", "disk"])
    assert publish(some) is None and files.versions(spark, folder) == []
    assert publish([*some, (1, "disk", 4.0, 10.0), (1, "gpu", 1.0, 1.0)]) == 1
    assert [r.node for r in files.published(spark, folder, "node int").collect()] == [1]
    assert publish([*some, (1, "disk", 4.0, 10.0), (2, "cpu", 1.0, 1.0)]) == 2
    assert sorted(r.node for r in files.published(spark, folder, "node int").collect()) == [1, 2]


def at(day, hour=12):
    return datetime(2026, 1, day, hour, tzinfo=timezone.utc)


def test_days_are_local_and_may_be_given_backwards():
    first, last = K.local_days(at(2, 20), at(3, 20), "Asia/Shanghai")
    assert (first.isoformat(), last.isoformat()) == ("2026-01-03", "2026-01-04")
    assert K.local_days(at(3, 20), at(2, 20), "Asia/Shanghai") == (first, last)
    assert K.local_days(at(2, 2), at(2, 2), "America/New_York")[0].isoformat() == "2026-01-01"


def test_scan_counts_malformed_lines_and_skips_missing_days(spark, tmp_path):
    good = '{"ts": %d, "vals": {"0": {"temp": 40.5, "power": 300}, "1": {"temp": 41}}, "cpu_avg": {"0": "1.5"}, "more": [1]}'
    (tmp_path / "straggler_kpi_2026-01-01.jsonl").write_text("\n".join([good % 60, "{broken", "", good % 120, "[1, 2]"]) + "\n")
    (tmp_path / "straggler_kpi_2026-01-03.jsonl").write_text(good % 180 + '\n{"ts": "x", "vals": 7}\n')
    (tmp_path / "straggler_kpi_2026-01-09.jsonl").write_text(good % 999)
    samples, malformed = K.scan_kpi_days(spark, f"file://{tmp_path}", at(1), at(5))
    assert sorted(r.ts for r in samples.collect()) == [60, 120, 180]
    assert {r.file: r.n for r in malformed.collect()} == {"straggler_kpi_2026-01-01.jsonl": 2, "straggler_kpi_2026-01-03.jsonl": 1}
    assert sorted((r.ts_s, r.card, r.metric) for r in K.long_kpi(samples).collect())[:3] == [(60, 0, "power"), (60, 0, "temp"), (60, 1, "temp")]
    samples, malformed = K.scan_kpi_days(spark, f"file://{tmp_path}", at(9), at(9))
    assert samples.count() == 1 and malformed.count() == 0


def test_a_range_without_samples_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="2026-01-04"):
        K.scan_kpi_days(spark, f"file://{tmp_path}", at(4), at(6))
    (tmp_path / "straggler_kpi_2026-01-04.jsonl").write_text("nothing\n\n")
    with pytest.raises(ValueError, match="no KPI samples"):
        K.scan_kpi_days(spark, f"file://{tmp_path}", at(4), at(6))
