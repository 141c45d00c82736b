import pytest
from pyspark.sql import functions as F

from auklet.sources import kpi_files, probes


@pytest.fixture
def lines(spark):
    def make(*texts, source="s"):
        return spark.createDataFrame([(1, source, k, t) for k, t in enumerate(texts)], "batch int, source string, pos int, value string")

    return make


def one(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_processor_lines(lines):
    got = probes.cpu_times(lines("cpu  10 1 2 3", "cpu0 5 0 1", "ctxt 77", "intr 1", ""))
    assert one(got, "core", "user", "idle", "steal") == [("0", 5, 0, 0), ("total", 10, 3, 0)]
    assert one(probes.context_switches(lines("cpu 1", "ctxt 77")), "switches") == [(77,)]


def test_load_memory_and_pages(lines):
    assert one(probes.load_average(lines("0.5 0.25 1.75 2/345 9999")), "load_1m", "load_15m", "running", "total") == [(0.5, 1.75, 2, 345)]
    assert one(probes.memory_info(lines("MemTotal:   100 kB", "HugePages_Total:   3", "bad")), "key", "kb") == [("HugePages_Total", 3), ("MemTotal", 100)]
    assert one(probes.key_values(lines("pgfault 12", "x y")), "key", "n") == [("pgfault", 12)]
    got = probes.buddy_orders(lines("Node 0, zone Normal 4 2 1 0", "Node 1, zone DMA 0 0"))
    assert one(got, "node", "zone", "fragmentation", "top_order") == [(0, "Normal", 100.0 * 4 / 12, 2), (1, "DMA", 0.0, -1)]


def test_devices(lines):
    disk = lines("8 0 sda 1 2 3 4 5 6 7 8", "8 1 sda1 1 2 3 4 5 6 7 8", "1 0 ram0 0 0 0 0 0 0 0 0", "short")
    assert one(probes.disk_counters(disk), "device", "reads", "sectors_read", "writes", "sectors_written") == [("sda", 1, 3, 5, 7)]
    net = lines("Inter-| x", " face | y", "  lo: 1 2 0 0 0 0 0 0 3 4 0 0", " eth0: 5 6 7 8 0 0 0 0 9 10 11 12 0")
    assert one(probes.net_counters(net), "interface", "rx_bytes", "rx_drop", "tx_bytes", "tx_drop") == [("eth0", 5, 8, 9, 12)]
    assert one(probes.mounts(lines("/dev/sda1 / ext4 rw", "proc /proc proc rw")), "device", "mount") == [("/dev/sda1", "/")]
    sockets = lines("  sl local rem st", " 0: a b 0A c", " 1: a b 01 c", " 2: a b 0a c", " 3: a b FF c")
    assert one(probes.tcp_states(sockets), "state", "n") == [("ESTABLISHED", 1), ("LISTEN", 2)]


def test_pressure_and_lists(lines):
    got = probes.pressure(lines("some avg10=0.50 total=12", "full avg10=1.5", "junk"))
    assert one(got, "kind", "field", "value") == [("full", "avg10", 1.5), ("some", "avg10", 0.5), ("some", "total", 12.0)]
    assert [r.cpus for r in probes.cpu_list(lines("0-3,5")).collect()] == [[0, 1, 2, 3, 5]]


def test_sensors(lines):
    got = probes.sensors(lines("CPU1 Temp | 65.000 degrees C | ok", "Inlet | 21.5 | degrees C | ok", "FAN1 F Speed | na | ok", "x"))
    assert one(got.na.fill(-1.0), "name", "value", "unit", "status") == [("CPU1 Temp", 65.0, "degrees C", "ok"), ("FAN1 F Speed", -1.0, "na", "ok"), ("Inlet", 21.5, "degrees C", "ok")]
    names = ["Inlet Temp", "FAN1 Power", "Power", "Power1", "FAN2 F Speed", "CPU1 Temp"]
    kinds = lines(*names).select(probes.sensor_kind(probes.F.col("value")).alias("k"), "pos").orderBy("pos").collect()
    assert [r.k for r in kinds] == ["inlet_temp", "fan_power", "power", None, "fan_speed", "cpu_temp"]


def test_device_tools(lines):
    assert one(probes.gpu_rows(lines("0, 82, 1, 2, 72, 250.50, x, 0, 1545", "1, 2")), "gpu", "utilization", "fan_speed", "clock") == [("0", 82.0, 0.0, 1545.0)]
    assert one(probes.labelled_numbers(lines("packet statistics:", "mac_tx:5", "  Net TX: 1250.5 MB")), "key", "value") == [("Net TX", 1250.5), ("mac_tx", 5.0)]
    log = lines("Machine Check on CPU 1: uncorrected error", "Machine Check CPU 1: corrected error", "Machine Check CPU 1: corrected", "else")
    assert one(probes.machine_checks(log), "socket", "kind", "n") == [(1, "ce", 2), (1, "uce", 1)]
    counts = probes.log_counts(lines("Out of memory: Killed process 3", "I/O error", "ok"), probes.LOG_PATTERNS, ["batch"])
    assert one(counts, "oom", "io_errors") == [(1, 1)]


def test_inventories(lines):
    text = ["head", "Handle 0x1, DMI type 17", "\tLocator: DIMM0", "\tSize: 16 GB", "\tType: DDR4", "Handle 0x2, DMI type 17", "\tLocator: DIMM1", "\tSize: No Module Installed"]
    assert one(probes.memory_modules(lines(*text)), "locator", "size_mb", "type") == [("DIMM0", 16384, "DDR4")]
    got = probes.disk_identity(lines("Model Family:  F", "Device Model:  M", "User Capacity: 500,107 bytes [500 GB]", "SMART overall-health self-assessment test result: PASSED"))
    assert one(got, "model", "capacity", "passed") == [("M", "500 GB", True)]
    assert one(probes.processor_layout(lines("CPU(s):  28", "Socket(s): 2")), "cpus", "sockets") == [(28, 2)]


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "stat").write_text("cpu 1 2 3 4\ncpu0 1 2 3 4\n")
    got = probes.cpu_times(probes.read_lines(spark, f"file://{tmp_path}", probes.F.lit(7)))
    assert one(got, "batch", "core", "user") == [(7, "0", 1), (7, "total", 1)]


def test_kpi_json(spark, tmp_path):
    good = '{"ts": 60, "vals": {"0": {"temp": 50, "x": 1}, "card": {"temp": 1}}, "cpu_avg": {"a": "3"}, "other": 1}'
    (tmp_path / "straggler_kpi_2026-01-01.jsonl").write_text(good + "\nnot json\n")
    from datetime import date

    paths = kpi_files.day_files(f"file://{tmp_path}", date(2026, 1, 1), date(2026, 1, 1))
    assert one(kpi_files.read_kpi_json(spark, paths), "ts_s", "card", "metric", "value") == [(60, 0, "temp", 50.0), (60, 0, "x", 1.0)]
    assert len(kpi_files.day_files("f", date(2026, 1, 1), date(2026, 1, 3))) == 3


def test_kpi_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('NPU_CARD_TEMP,timestamp,CPU_average\n"{""0"":50,""1"":""61.5"",""z"":3}",120,"{}"\nbad,130,x\n')
    got = kpi_files.read_kpi_csv(spark, f"file://{tmp_path}/a.csv")
    assert one(got, "ts_s", "card", "metric", "value") == [(120, 0, "temp", 50.0), (120, 1, "temp", 61.5)]
    assert one(kpi_files.known_cards(got), "card") == [(0,), (1,)]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """A log of many blocks: places are those in the file, whatever the blocks' order."""
    lines = [f"line {k} {'x' * (k % 90)}" if k % 11 else "" for k in range(20_000)]
    (tmp_path / "log").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = {r.pos: r.value for r in probes.read_lines(spark, f"file://{tmp_path}/log").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: x for k, x in enumerate(lines) if x}


def test_rank_files(spark, tmp_path):
    """Groups of more than one rank, hosts, and the step before the last of each metric, from the files of a job."""
    from auklet.sources import rank_files

    for r in (0, 1, 7):
        (tmp_path / f"group_info_{r}.json").write_text('{"a": {"group_name": "tp", "global_ranks": [1, 0, 9]},\n "b": {"group_name": "dp", "global_ranks": [7]}, "c": {"group_name": ""}}')
        (tmp_path / f"host_info_{r}.json").write_text('{"rank": "%d", "hostUid": "%s"}' % (r, "h" * (r < 7)))
    (tmp_path / "global_rank_0.csv").write_text("stepindex,took,wait\n1,5,x\n2,6.5,7\n3,9,8\n")
    (tmp_path / "global_rank_1.csv").write_text("stepindex,took\n1,4\n")
    (tmp_path / "global_rank_7.csv").write_text("stepindex,took\n1,-\n2,4\n")
    folder = f"file://{tmp_path}"
    assert [(r.domain, r.name, r.ranks) for r in rank_files.read_groups(spark, folder).collect()] == [("tp", "a", [0, 1])]
    assert {r.rank: r.host for r in rank_files.read_hosts(spark, folder).collect()} == {0: "h", 1: "h"}
    got = rank_files.settled_steps(rank_files.read_figures(spark, folder)).collect()
    assert sorted(map(tuple, got)) == [(0, "took", 6.5), (0, "wait", 7.0), (1, "took", 4.0)]


def test_rates_and_texts_of_tools(spark):
    """First numbers, last lines and missing ones, as the tools' own parsers take them."""
    from auklet.operators import gauges as G
    from auklet.sources import probes as P

    def lines(*values):
        return spark.createDataFrame([(1, "p", k, v) for k, v in enumerate(values)], "batch long, source string, pos int, value string")

    rates = P.bandwidths(lines("Bandwidth TX:", "Net TX 12.5 MB/s", "net rx: 3 4", "PCIe TX: fast", "pcie rx +1e3x 7"), P.NET_BANDWIDTHS).first()
    assert (rates.net_tx_bandwidth, rates.net_rx_bandwidth, rates.pcie_tx_bandwidth, rates.pcie_rx_bandwidth) == (12.5, 3.0, 0.0, 7.0)
    assert [r.text for r in P.labelled_text(lines("no colon link", "Link: UP now", "link: DOWN"), "Link").collect()] == ["UP now"]
    assert [r.text for r in P.labelled_text(lines("nothing"), "Link:").collect()] == [""]
    assert {(r.key, r.n) for r in P.statistics(lines("packet statistics:", "a_oct_b:5", "x: -1", "y:1.5", "plain 7", "z:8")).collect()} == {("a_oct_b", 5), ("z", 8)}
    units = {r.name: r.unit for r in G.device_counters(P.statistics(lines("a_oct_b:5", "z:8")).withColumn("id", F.lit(3)), ["batch"], "id").collect()}
    assert units == {"a_oct_b": "bytes", "z": ""}
    samples = spark.createDataFrame([("h", "sda", t, r, r * 2048, r, r, r, r) for t, r in ((0, 10), (5, 35), (5, 36), (10, 4), (20, 104))], "host string, device string, s long, reads long, sectors_read long, ms_read long, writes long, sectors_written long, ms_written long")
    got = {(r.s, r.name): r.value for r in G.disk_rates(samples, ["host"], "s").where("labels['direction'] is null or labels['direction'] = 'read'").collect()}
    assert got[20, "iops"] == 10.0 and got[20, "throughput"] == 10.0 and got[10, "iops"] == 0.0 and got[20, "read_latency"] == 10.0 and (0, "iops") not in got
