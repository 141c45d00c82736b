"""Queries of the probe parsers and of the points made from them: line items stand for the lines of a probe, orders for its batches.

Each line's text is written from a line item's columns, parsed by the library, and must give those columns back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from auklet.functions import scalars as X
from auklet.operators import gauges as G
from auklet.operators import health as H
from auklet.operators import series as S
from auklet.operators import windows as W
from auklet.plans import fleet_queries, metric_queries, profiler_queries
from auklet.plans import views as V
from auklet.sinks import files, reports
from auklet.sources import probes as P
from auklet.sources import rank_files as R

KEYS = ["Total", "Free", "Cached", "Dirty", "Mapped", "Slab", "None"]
DEVICES = ["sda", "sda1", "nvme0n1", "loop0", "vdb", "nvme0n1p2", "xvdc"]
FILESYSTEMS = ["ext4", "tmpfs", "xfs", "overlay", "proc", "btrfs", "nfs"]
CODES = ["01", "0A", "06", "0a", "FF", "08", "01"]
SENSORS = ["Inlet Temp", "FAN{u} F Speed", "Power", "CPU1 Temp", "FAN2 Power", "Outlet Temp", "FAN R Speed"]
COUNTERS = ["nr_isolated_anon", "nr_isolated_file", "nr_free_pages", "pgfault", "nr_dirty", "x", "y"]


def rows(s, d):
    """(batch, pos, q, p, k, u) of line items; of those that share their numbers the largest figures, so a line is one row."""
    whole = lambda c: F.max(F.floor(c).cast("bigint"))
    keys = F.col("l_orderkey").alias("batch"), F.col("l_linenumber").cast("int").alias("pos")
    return V.table(s, d, "lineitem").groupBy(*keys).agg(whole("l_quantity").alias("q"), whole("l_extendedprice").alias("p"), F.max("l_partkey").alias("k"), F.max("l_suppkey").alias("u"))


def inventory(s, d, *templates: str):
    """The lines of an inventory for each order: all templates in order."""
    o = V.table(s, d, "orders").select(F.col("o_orderkey").alias("batch"), F.floor("o_totalprice").cast("bigint").alias("p"), (F.col("o_custkey") % 97 + 1).alias("q"), F.col("o_custkey").alias("u"))
    return o.select("batch", F.lit("probe").alias("source"), F.posexplode(F.array(*[text(t) for t in templates])).alias("pos", "value"))


def text(template: str):
    """A column of a template with {names} of columns."""
    parts = [x for a in template.split("{") for x in a.split("}")]
    return F.concat(*[F.col(x).cast("string") if n % 2 else F.lit(x) for n, x in enumerate(parts)])


def of_pos(*each):
    """The column that belongs to the line's number, from 1 on."""
    return F.element_at(F.array(*[text(x) if isinstance(x, str) else x for x in each]), F.col("pos"))


def lines(s, d, value, first: int = 1):
    """Lines of a probe; `first` is what line number 1 has as its place."""
    value = text(value) if isinstance(value, str) else value
    return rows(s, d).select("batch", F.lit("probe").alias("source"), (F.col("pos") - 1 + first).alias("pos"), value.alias("value"))


#: The caches of the view, by the line's number.
CACHE_LEVELS, CACHE_TYPES = [1, 1, 2, 3, 4, 1, 0], ["Data", "Instruction", "Unified", "Unified", "Unified", "Unified", "Data"]


def core_lists(s, d):
    """(batch, kind, n): three lists of cores of each batch, as far as it has lines for them."""
    kind = F.element_at(F.array(F.lit("online"), F.lit("offline"), F.lit("isolated")), F.when(F.col("pos") <= 3, F.col("pos")))
    listed = rows(s, d).withColumns({"a": F.col("q") % 5, "b": F.col("q") % 5 + 7}).where("pos <= 3")  # further lines are no lists
    return P.cpu_list(listed.select("batch", kind.alias("source"), "pos", text("0-{a},{b}").alias("value"))).select("batch", F.col("source").alias("kind"), "n")


def devices(s, d):
    """Counters of disks that run up from sample to sample."""
    of = {"reads": "user_", "sectors_read": "system_", "ms_read": "idle_", "writes": "iowait_", "sectors_written": "irq_", "ms_written": "user_"}
    return V.counters(s, d).select((F.col("core") % 4).alias("host"), F.col("core").alias("device"), "seq", *[F.col(c).alias(f) for f, c in of.items()])


def linked(s, d):
    return inventory(s, d, "state of a port", "Speed: {q} Mb/s", "link: UP: {u}", "LINK: DOWN")


def sensors(s, d):
    texts = [f"{n} | {{q}}.5 degrees C | ok" for n in SENSORS]
    texts[3] = "CPU1 Temp | {q} | degrees C | nc"
    texts[6] = "no table here"
    got = P.sensors(lines(s, d, of_pos(*texts)))
    return got.withColumn("kind", P.sensor_kind(F.col("name"))).drop("source")


def pressure(s, d):
    return P.pressure(lines(s, d, of_pos("some avg10={q}.5 avg60=0.25 avg300={u}.123456 total={p}", "full avg10=0.00 avg60={q} avg300=1 total=0", *["noise"] * 5)))


def net(s, d):
    """Counters of three interfaces that run over the batches."""
    each = F.when(F.col("pos") == 3, "   lo: 1 2 3 4 0 0 0 0 5 6 7 8").otherwise(text("  eth{i}: {p} {k} {u} 1 0 0 0 0 {q} {p} {k} {u} 0"))
    return P.net_counters(rows(s, d).withColumn("i", F.col("pos") % 3).select("batch", F.lit("probe").alias("source"), "pos", each.alias("value")))


def modules(s, d):
    texts = ["Handle 0x1", "\tSize: {q} GB", "\tLocator: DIMM{u}", "Handle 0x2", "\tSize: No Module Installed", "\tLocator: DIMM_B", "\tType: DDR4"]
    return P.memory_modules(inventory(s, d, *texts).withColumn("source", F.col("batch").cast("string")))  # each order is a file; by a constant nothing could be dealt


def labelled(df, *keys):
    """Points in columns that SQL has too: labels as sorted k=v."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return df.select(*keys, "component", "name", F.round("value", 6).alias("value"), pairs.alias("labels"))


def identity(s, d):
    texts = ["Model Family: F{q}", "Device Model: D{u}", "User Capacity: 1 bytes [{q} TB]", "SMART overall-health self-assessment test result: PASSED", "Rotation Rate: {p} rpm", "Serial Number: S{u}", "Firmware Version: V{u}"]
    return P.disk_identity(inventory(s, d, *texts)).drop("source")


def layout(s, d):
    texts = ["Architecture: x86_64", "CPU(s): {u}", "Thread(s) per core: 2", "Core(s) per socket: {q}", "Socket(s): {u}", "NUMA node(s): many", "Model name: M: {p}", "Model name: other"]
    return P.processor_layout(inventory(s, d, *texts)).drop("source")


def group_texts(s, d):
    """Each supplier's groups as the JSON of a rank: the suppliers of its nation."""
    mates = V.table(s, d, "supplier").groupBy("s_nationkey").agg(F.collect_list(F.col("s_suppkey").cast("int")).alias("mates"))
    group = F.struct(F.lit("tp").alias("group_name"), F.col("mates").alias("global_ranks"))
    of_nation = mates.select("s_nationkey", F.to_json(F.create_map(F.concat(F.lit("g"), F.col("s_nationkey").cast("string")), group)).alias("value"))
    return V.table(s, d, "supplier").join(of_nation, "s_nationkey").select(F.col("s_suppkey").cast("int").alias("rank"), "value")


def device_rows(s, d):
    return rows(s, d).select("batch", F.col("pos").alias("card"), (F.col("q") % 5).alias("health"), (F.col("u") % 3).alias("link"))


QUERIES = {
    "s6_context_switches": lambda s, d: P.context_switches(lines(s, d, of_pos("ctxt {k}", *["intr {p} 1 2"] * 6))).drop("source"),
    "s7_load_average": lambda s, d: P.load_average(lines(s, d, "{q}.25 {u}.5 0.75 {pos}/{p} 99", 0)).drop("source"),
    "s8_memory_info": lambda s, d: P.memory_info(lines(s, d, of_pos(*[f"{k}:   {{p}} kB" for k in KEYS[:6]], "None: x"))).drop("source"),
    "s9_fdev_disk_counters": lambda s, d: P.disk_counters(lines(s, d, F.concat_ws(" ", F.lit(" 8"), "pos", of_pos(*DEVICES), text("{q} 0 {p} {k} {u} 0 {q} {k} 0 0 0")))).drop("source"),
    "s10_net_counters": lambda s, d: net(s, d).drop("source"),
    "s11_counters": lambda s, d: P.key_values(lines(s, d, F.when(F.col("pos") % 2 == 1, text("counter{pos} {p}")).otherwise(text("text {p} x")))).drop("source"),
    "s12_cpu_info": lambda s, d: P.cpu_info(inventory(s, d, "model name\t: M{q}: x", "cpu cores\t: {u}", "cache size\t: 1 KB", "model name\t: other", "cache size\t: {p} KB", "flags\t: a b")).drop("source"),
    "s13_a22_buddy_orders": lambda s, d: P.buddy_orders(lines(s, d, "Node {pos}, zone   Normal {q} {u} 0 {k} 0 0")).select("batch", "node", "zone", F.round("fragmentation", 6).alias("fragmentation"), "top_order"),
    "s14_mounts": lambda s, d: P.mounts(lines(s, d, F.concat(text("/dev/sd{q} /m{pos} "), of_pos(*FILESYSTEMS), F.lit(" rw 0 0")))).drop("source"),
    "s15_a23_tcp_states": lambda s, d: P.tcp_states(lines(s, d, F.concat(text("{pos}: 0100007F:{q} 0:0 "), of_pos(*CODES), F.lit(" 0")))),
    "s17_cpu_lists": lambda s, d: P.cpu_list(rows(s, d).withColumns({"a": F.col("q") % 5, "b": F.col("q") % 5 + 7}).select("batch", F.lit("list").alias("source"), "pos", text("0-{a},{b}").alias("value"))).select("batch", F.array_join(F.col("cpus").cast("array<string>"), ",").alias("cpus"), "n"),
    "s17_system_values": lambda s, d: P.system_values(rows(s, d).select("batch", F.explode(F.array(of_pos("/sys/devices/system/cpu/cpu{q}/cpufreq/scaling_cur_freq", "/sys/devices/system/cpu/cpu0/cache/index{q}/size", "/sys/class/net/eth{q}/operstate", "/sys/block/sd{q}/size", "/sys/block/loop{q}/size", "/sys/class/thermal/thermal_zone{q}/temp", "/sys/other"))).alias("source"), F.lit(0).alias("pos"), of_pos("{p}", "{p}K", "up", "{p}", "{p}", "{p} ", "{p}").alias("value"))).drop("source"),
    "s28_disk_specs": lambda s, d: labelled(G.disk_specs(rows(s, d).select("batch", text("sd{pos}").alias("device"), (F.col("p") * 1_000_000).alias("bytes"), F.when(F.col("q") % 2 == 0, text("M{q}")).alias("model")), ["batch"]), "batch"),
    "s28_network_specs": lambda s, d: labelled(G.network_specs(rows(s, d).select("batch", of_pos("lo", *[f"eth{k}" for k in range(6)]).alias("interface"), text("m{q}").alias("mac"), F.col("k").alias("mtu"), F.lit(-1).alias("speed"), F.lit(None).cast("string").alias("driver")), ["batch"]), "batch"),
    "s28_device_specs": lambda s, d: labelled(G.device_specs(rows(s, d).select("batch", F.col("pos").alias("id"), text("N{q}").alias("name"), F.lit("0:1").alias("bus")), ["batch"], "npu"), "batch"),
    "s28_system_specs": lambda s, d: labelled(G.system_specs(V.table(s, d, "orders").select(F.col("o_orderkey").alias("batch"), F.when(F.col("o_custkey") % 2 == 0, F.lit("Maker")).alias("manufacturer"), F.when(F.col("o_custkey") % 3 == 0, F.lit("Box")).alias("product_name"), F.when(F.col("o_custkey") % 5 == 0, F.lit("Linux 1")).alias("pretty_name")), ["batch"]), "batch"),
    "s5_rank_figures": lambda s, d: R.settled_steps(R.figures_of(inventory(s, d, "stepindex,took, wait", "1,{q},x", "2,{u},{p}", "3,{p},-").withColumn("source", F.col("batch").cast("string")), F.col("source").try_cast("int"))),
    "s5_rank_groups": lambda s, d: R.groups_of(group_texts(s, d)).select("domain", "name", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks")),
    "s5_rank_hosts": lambda s, d: R.hosts_of(V.table(s, d, "supplier").select(F.col("s_suppkey").alias("rank"), F.when(F.col("s_nationkey") % 3 == 0, "{}").otherwise(F.to_json(F.struct(F.concat(F.lit("h"), F.col("s_nationkey").cast("string")).alias("hostUid")))).alias("value"))),
    "k10_result_entries": lambda s, d: reports.result_entries(profiler_queries.QUERIES["dp8_findings"](s, d)),
    "x12_ranks_of_keys": lambda s, d: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", X.ranks_of_key(F.concat_ws(", ", "l_suppkey", F.lit("x"), "l_linenumber")).alias("r")).select("l_orderkey", "l_linenumber", "l_suppkey", F.array_join(F.col("r").cast("array<string>"), ";").alias("ranks")),
    "s28_release": lambda s, d: P.release(inventory(s, d, "NAME=\"Linux {q}\"", "# comment=1", "ID=x{u}", "no pair")).drop("source"),
    "k6_global_snapshots": lambda s, d: files.global_snapshot(H.component_scores(V.points(s, d)), H.health(V.points(s, d)), "node", {"cpu": 3.0}).select("node", "health.score", "health.grade", F.array_join(F.transform("collectors", lambda c: F.concat(c["component"], F.lit(":"), c["max"].cast("int").cast("string"))), ",").alias("parts"), F.col("intervals_ms")["cpu"].alias("cpu_ms")),
    "k5_component_snapshots": lambda s, d: files.snapshots(metric_queries.chart_points(s, d), None, metric_queries.chart_points(s, d).where("name = 'power'")).select("component", "batch", F.size("metrics").alias("n"), F.round(F.aggregate("metrics", F.lit(0.0), lambda a, m: a + m["value"]), 3).alias("total"), F.size(F.coalesce("specs", F.array())).alias("specs")),
    "k5_snapshot_points": lambda s, d: files.snapshots(metric_queries.chart_points(s, d)).select("component", F.posexplode("metrics").alias("place", "m")).select("component", "place", F.col("m.name").alias("name"), F.round("m.value", 3).alias("value"), F.col("m.unit").alias("unit")),
    "m11_sample_fields": lambda s, d: files.samples_of(V.kpi(s, d).groupBy("ts_s", "card", "metric").agg(F.max("value").alias("value"))).select("ts", F.explode("vals").alias("card", "fields")).select("ts", "card", F.explode("fields").alias("metric", "v")).select("ts", "card", "metric", F.round("v", 6).alias("value")),
    "m11_kpi_samples": lambda s, d: files.samples_of(V.kpi(s, d).groupBy("ts_s", "card", "metric").agg(F.max("value").alias("value"))).select("ts", F.size("vals").alias("cards"), F.aggregate(F.map_values("vals"), F.lit(0), lambda a, m: a + F.size(m)).alias("fields")),
    "s16_pressure": lambda s, d: pressure(s, d).drop("source"),
    "s18_fsensor_sensors": sensors,
    "s20_gpu_rows": lambda s, d: P.gpu_rows(lines(s, d, F.when(F.col("pos") == 5, "too, short").otherwise(text("{pos}, {q}, {p}, {k}, {u}, 75.5, [N/A], 3, 1500")))).drop("source"),
    "s21_labelled_numbers": lambda s, d: P.labelled_numbers(lines(s, d, of_pos("Usage(%)  : {q}", "\tTemp (C) : -{u}.5", "Name : none", "no colon {p}", "Speed: {k} MHz 7", "a: b: {p}", ": {q}"))).drop("source"),
    "s22_a23_machine_checks": lambda s, d: P.machine_checks(rows(s, d).withColumn("c", F.col("u") % 2).select("batch", F.lit("log").alias("source"), "pos", of_pos("CPU {c}: Machine Check: corrected", "Machine Check uncorrected CPU 1", "nothing", "Machine Check: corrected", "Machine Check: FATAL CPU 7", "corrected", "Machine Check").alias("value"))),
    "s23_memory_modules": lambda s, d: modules(s, d).select("batch", "locator", "size_mb"),
    "s19_disk_identity": identity,
    "s24_processor_layout": layout,
    "m1_model_info": lambda s, d: labelled(G.model(P.cpu_info(inventory(s, d, "model name\t: M{q}: x", "cpu cores\t: {u}", "cache size\t: {p} KB", "flags\t: a b")), ["batch"]), "batch"),
    "m2_core_states": lambda s, d: labelled(G.core_states(core_lists(s, d), ["batch"]), "batch"),
    "m2_frequency_range": lambda s, d: labelled(G.frequency_range(V.table(s, d, "orders").select(F.col("o_orderkey").alias("batch"), F.floor("o_totalprice").alias("min_khz"), F.when(F.col("o_custkey") % 9 != 0, F.floor("o_totalprice") + F.col("o_custkey") * 1000).alias("max_khz")), ["batch"]), "batch"),
    "m2_caches": lambda s, d: labelled(G.caches(rows(s, d).select("batch", F.col("q").alias("kb"), F.element_at(F.array(*map(F.lit, CACHE_LEVELS)), F.col("pos")).alias("level"), F.element_at(F.array(*map(F.lit, CACHE_TYPES)), F.col("pos")).alias("type")), ["batch"]), "batch"),
    "m4_disk_rates": lambda s, d: labelled(G.disk_rates(devices(s, d), ["host"], "seq", seconds=5.0), "host", "seq"),
    "m7_device_points": lambda s, d: labelled(G.device_points(rows(s, d).select("batch", F.col("pos").alias("card"), F.col("q").alias("temperature"), F.when(F.col("u") % 2 == 0, F.col("u")).alias("voltage"), F.col("p").alias("hbm_total_memory"), F.when(F.col("pos") < 5, F.col("q")).alias("hbm_used_memory"), F.col("k").alias("net_tx_bandwidth"), F.lit("x").alias("other")), ["batch"], "card"), "batch"),
    "m7_device_counters": lambda s, d: labelled(G.device_counters(P.statistics(lines(s, d, of_pos("packet statistics:", "mac_rx_total_oct_num:{p}", " mac_tx_mac_pause_num: {q} ", "roce_new_pkt_rty:{u}", "half:{q}.5", "negative:-{q}", "a:b:{p}"))).withColumn("card", F.col("batch") % 8), ["batch"], "card"), "batch"),
    "m7_device_count": lambda s, d: labelled(G.device_count(rows(s, d).withColumn("card", F.col("q") % 3), ["batch"], "card"), "batch"),
    "s21_bandwidths": lambda s, d: P.bandwidths(inventory(s, d, "Bandwidth of a device:", "NET TX: {q} MB/s", "Net rx : {u}.5", "pcie TX none", "PCIE RX {q} {u}", "net tx 5 {q}"), P.NET_BANDWIDTHS).drop("source"),
    "s21_link_bandwidths": lambda s, d: P.bandwidths(inventory(s, d, "TX 1e2 {q}", "rx: -{u}.25 7", "other {p}"), P.LINK_BANDWIDTHS).drop("source"),
    "s21_link_and_speed": lambda s, d: P.labelled_text(linked(s, d), "Link:").withColumnRenamed("text", "link").join(P.labelled_text(linked(s, d), "speed:").withColumnRenamed("text", "speed"), ["batch", "source"]).drop("source"),
    "s21_topology": lambda s, d: labelled(G.device_texts(P.whole_text(inventory(s, d, "", "  card0 {q}", "card1 {u} ", " ")), ["batch"], "comm_topo", "topo"), "batch"),
    "x19_conversions": lambda s, d: V.table(s, d, "orders").select("o_orderkey", F.round(X.seconds_of_jiffies(F.col("o_custkey")), 6).alias("s"), F.round(X.mb_of_sectors(F.floor("o_totalprice")), 6).alias("mb"), *[F.round(X.in_unit(F.floor("o_totalprice"), u), 9).alias(u) for u in ("ns", "us", "ms")]),
    "m1_load_points": lambda s, d: labelled(G.load(P.load_average(lines(s, d, "{q}.25 {u}.5 0.75 {pos}/{p} 99", 0)), ["batch"]), "batch"),
    "m3_pressure_points": lambda s, d: labelled(G.memory_pressure(pressure(s, d), ["batch"]), "batch"),
    "m3_page_counters": lambda s, d: labelled(G.page_counters(P.key_values(lines(s, d, F.concat(of_pos(*COUNTERS), text(" {p}")))), ["batch"]), "batch"),
    "m3_memory_errors": lambda s, d: labelled(G.memory_errors(rows(s, d).select("batch", F.concat(F.lit("mc"), F.col("pos").cast("string")).alias("mc"), F.col("q").alias("ce_count"), F.when(F.col("u") % 2 == 0, F.col("u")).alias("ue_count")), ["batch"]), "batch"),
    "m3_module_points": lambda s, d: labelled(G.memory_modules(rows(s, d).select("batch", text("DIMM{pos}").alias("locator"), (F.col("q") % 3 * 1024).alias("size_mb"), F.lit("DDR4").alias("type"), text("{k} MT/s").alias("speed"), F.lit(None).cast("string").alias("manufacturer")), ["batch"]), "batch"),
    "m4_smart_points": lambda s, d: labelled(G.disk_health(rows(s, d).select("batch", text("sd{pos}").alias("device"), F.when(F.col("pos") < 6, F.col("q") % 2 == 0).alias("passed"), F.when(F.col("pos") > 2, F.col("u")).alias("temperature")), ["batch"]), "batch"),
    "m5_network_points": lambda s, d: labelled(G.network(net(s, d).groupBy("batch", "interface").agg(*[F.max(c).alias(c) for c in P.NET_FIELDS]), ["batch"], [], "batch"), "batch"),
    "m5_connections": lambda s, d: labelled(G.connections(P.tcp_states(lines(s, d, F.concat(text("{pos}: 0100007F:{q} 0:0 "), of_pos(*CODES), F.lit(" 0")))), ["batch"]), "batch"),
    "m5_interface_status": lambda s, d: labelled(G.interface_status(rows(s, d).select("batch", of_pos("lo", *[f"eth{k}" for k in range(6)]).alias("interface"), F.when(F.col("q") % 2 == 0, "up").otherwise("down").alias("state")), ["batch"]), "batch"),
    "m6_chassis_points": lambda s, d: labelled(G.chassis(sensors(s, d), ["batch"]), "batch"),
    "m7_x11_device_states": lambda s, d: labelled(G.device_states(device_rows(s, d), ["batch"], "card"), "batch"),
    "m7_device_values": lambda s, d: labelled(G.device_values(rows(s, d).select("batch", F.col("pos").alias("card"), F.col("q").alias("hbm_temp"), F.when(F.col("u") % 2 == 0, F.col("u")).alias("voltage"), F.col("k").alias("mac_rx_total_oct_num")), ["batch"], "npu", "card", "npu_id", {"hbm_temp": "C", "voltage": "V", "mac_rx_total_oct_num": "", "absent": ""}), "batch"),
    "m15_derived_shares": lambda s, d: labelled(G.derived_shares(W.cpu_shares(cpu_rows(s, d), ["core"], ["batch"], P.CPU_FIELDS[:8]), ["core", "batch"]), "core", "batch"),
    "a27_capacity": lambda s, d: G.capacity(rows(s, d).select(F.col("u").alias("host"), (F.col("p") / 1000).alias("gb")), ["host"]).select("host", "n", F.round("gb", 6).alias("gb"), "text"),
    "fnav_preferred": lambda s, d: G.preferred(metric_queries.chart_points(s, d), ["batch"], {"throughput": {"direction": "write"}, "usage_detail": {"field": "free"}, "load_average": {"interval": "none"}}).select("batch", "name", "value", F.array_join(F.array_sort(F.map_values("labels")), ",").alias("label")),
    "fnav_order": lambda s, d: G.navigation(metric_queries.chart_points(s, d).select("component").union(s.createDataFrame([("system",), ("zeta",)], "component string"))),
    "feff_all_specs": lambda s, d: S.efficiency(eff_points(s, d), S.efficiency_specs(s)).select("batch", "component", "name", "ord"),
}


def cpu_rows(s, d):
    """Running counters of eight processors: sums of line items by line number."""
    w = W.Window.partitionBy("pos").orderBy("batch").rowsBetween(W.Window.unboundedPreceding, 0)
    q = {f: F.sum((F.col("q") * (k + 1) + F.col("u")) % (7 + k)).over(w).alias(f) for k, f in enumerate(P.CPU_FIELDS[:8])}
    return rows(s, d).select(F.col("pos").alias("core"), "batch", *q.values())


def eff_points(s, d):
    """Charted points, and processor times of all cores and of single ones."""
    times = rows(s, d).select(F.col("batch"), F.lit("cpu").alias("component"), F.concat(F.element_at(F.array(*[F.lit(f) for f in P.CPU_FIELDS[:8]]), F.col("pos")), F.lit("_time")).alias("name"), F.create_map(F.lit("core"), F.when(F.col("q") % 2 == 0, "total").otherwise(F.col("q").cast("string"))).alias("labels"), F.col("k").alias("ord"))
    return metric_queries.chart_points(s, d).select("batch", "component", "name", "labels", "ord").unionByName(times)


_L = "l as (select l_orderkey as batch, cast(l_linenumber as int) as pos, max(cast(floor(l_quantity) as bigint)) as q, max(cast(floor(l_extendedprice) as bigint)) as p, max(l_partkey) as k, max(l_suppkey) as u from lineitem group by 1, 2)"
_O = "with o as (select o_orderkey as batch, cast(floor(o_totalprice) as bigint) as p, o_custkey % 97 + 1 as q, o_custkey as u from orders)"
_Q1 = "cast(trunc((q + 0.5) * 10 + 0.5) as bigint) / 10.0"


def _with(tail: str, *parts: str) -> str:
    return "with " + ",\n".join((_L, *parts)) + "\n" + tail


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _points(component: str, base: str, *each: tuple[str, str, str], keys: str = "batch") -> str:
    """(name, value, labels) as SQL for each point of base; null values give none."""
    return " union all ".join(f"select {keys}, '{component}' as component, '{n}' as name, round(({v})::double, 6) as value, {lab} as labels from {base} where ({v}) is not null" for n, v, lab in each)


#: Points of disk rates: name, counter, what it is multiplied with, places as a power of ten, labels.
_DISK_POINTS = [
    ("iops", "user_", "1", 1, "'device=' || core || ',direction=read'"), ("iops", "iowait_", "1", 1, "'device=' || core || ',direction=write'"),
    ("throughput", "system_", "(512 / 1048576)", 100, "'device=' || core || ',direction=read'"), ("throughput", "irq_", "(512 / 1048576)", 100, "'device=' || core || ',direction=write'"),
    ("read_latency", "idle_", "1", 100, "'device=' || core"), ("write_latency", "user_", "1", 100, "'device=' || core"),
]
_NET = "net as (select batch, 'eth' || (pos % 3) as interface, p as rx_bytes, k as rx_packets, u as rx_errs, 1::bigint as rx_drop, q as tx_bytes, p as tx_packets, k as tx_errs, u as tx_drop from l where pos > 3 or pos = 2)"
_STATES = f"tcp as (select batch, case upper({_list(CODES)}[pos]) when '01' then 'ESTABLISHED' when '0A' then 'LISTEN' when '06' then 'TIME_WAIT' when '08' then 'CLOSE_WAIT' end as state from l)"
_SENSORS = f"""sensed as (select batch, pos, replace({_list(SENSORS)}[pos], '{{u}}', u::varchar) as name, case when pos = 4 then q::double else q + 0.5::double end as value, case when pos = 4 then 'degrees C' else 'degrees C' end as unit,
    case when pos = 4 then 'nc' else 'ok' end as status, ['inlet_temp', 'fan_speed', 'power', 'cpu_temp', 'fan_power', 'outlet_temp'][pos] as kind, u, q from l where pos < 7)"""
_RATE = "case when lag({0}) over w is not null then cast(trunc(greatest(0, {0} - lag({0}) over w) / 3.0 + 0.5) as bigint) end"
_CPU = ", ".join(f"sum((q * {k + 1} + u) % {7 + k}) over w as {f}" for k, f in enumerate(P.CPU_FIELDS[:8]))
_DELTA = ", ".join(f"greatest(0, {f} - lag({f}) over w) as {f}" for f in P.CPU_FIELDS[:8])
_SUM = " + ".join(P.CPU_FIELDS[:8])
_SHARE = {
    "idle_util": "idle",
    "non_idle_util": "user_ + nice + system + iowait + irq + softirq + steal",
    "user_util": "user_ + nice",
    "system_util": "system",
    "iowait_util": "iowait",
    "irq_util": "irq + softirq",
    "steal_util": "steal",
}

SQL = {
    "s6_context_switches": _with("select batch, k as switches from l where pos = 1"),
    "s7_load_average": _with("select batch, (q + 0.25)::double as load_1m, (u + 0.5)::double as load_5m, 0.75::double as load_15m, pos::bigint as running, p as total from l where pos = 1"),
    "s8_memory_info": _with(f"select batch, {_list(KEYS)}[pos] as key, p as kb from l where pos < 7"),
    "s9_fdev_disk_counters": _with(f"select batch, {_list(DEVICES)}[pos] as device, q as reads, p as sectors_read, k as ms_read, u as writes, q as sectors_written, k as ms_written from l where pos in (1, 3, 5, 7)"),
    "s10_net_counters": _with("select * from net", _NET),
    "s11_counters": _with("select batch, 'counter' || pos as key, p as n from l where pos % 2 = 1"),
    "s12_cpu_info": _O + " select batch, 'M' || q || ': x' as model, u::int as cores, p || ' KB' as cache from o",
    "s13_a22_buddy_orders": _with("select batch, pos as node, 'Normal' as zone, round(100.0 * q / (q + 2 * u + 8 * k), 6) as fragmentation, case when k > 0 then 3 when u > 0 then 1 when q > 0 then 0 else -1 end as top_order from l"),
    "s14_mounts": _with(f"select batch, '/dev/sd' || q as device, '/m' || pos as mount, {_list(FILESYSTEMS)}[pos] as fstype from l where pos in (1, 3, 6, 7)"),
    "s15_a23_tcp_states": _with("select batch, state, count(*) as n from tcp where state is not null group by 1, 2", _STATES),
    "s17_cpu_lists": _with("select batch, array_to_string(list_concat(range(q % 5 + 1), [q % 5 + 7]), ',') as cpus, cast(q % 5 + 2 as int) as n from l"),
    "s17_system_values": _with("select batch, ['cur_khz', 'cache_kb', 'operstate', 'bytes', '', 'celsius'][pos] as kind, case pos when 1 then 'cpu' || q when 2 then 'cpu0/cache/index' || q when 3 then 'eth' || q when 4 then 'sd' || q else 'thermal_zone' || q end as device, case pos when 2 then p || 'K' when 3 then 'up' else p::varchar end as text, case pos when 3 then null when 4 then p * 512.0 when 6 then p / 1000.0 else p end::double as number from l where pos in (1, 2, 3, 4, 6)"),
    "s28_disk_specs": _with(_points("disk", "l", ("disk_info", "cast(trunc(p / 1000.0 * 10 + 0.5) as bigint) / 10.0", "'device=sd' || pos || ',model=' || case when q % 2 = 0 then 'M' || q else '' end"))),
    "s28_network_specs": _with(_points("network", "(select *, row_number() over (partition by batch order by pos) - 1 as place from l where pos > 1) as t", ("net_info", "place", "'driver=,interface=eth' || (pos - 2) || ',mac=m' || q || ',mtu=' || k || ',speed=-1'"))),
    "s28_device_specs": _with(_points("npu", "l", ("npu_info", "0", "'bus_id=0:1,name=N' || q || ',npu_id=' || pos"))),
    "s28_system_specs": _O + " " + _points("system", "o", ("device_model", "case when u % 2 = 0 or u % 3 = 0 then 0 end", "'manufacturer=' || case when u % 2 = 0 then 'Maker' else '' end || ',product_name=' || case when u % 3 = 0 then 'Box' else '' end"), ("os_info", "case when u % 5 = 0 then 0 end", "'pretty_name=Linux 1'")),
    "s5_rank_figures": _O + " select cast(batch as int) as rank, 'took' as metric, u::double as value from o union all select cast(batch as int), 'wait', p::double from o",
    "s5_rank_groups": "select 'tp' as domain, 'g' || s_nationkey as name, string_agg(s_suppkey::varchar, ',' order by s_suppkey) as ranks from supplier group by s_nationkey having count(*) > 1",
    "s5_rank_hosts": "select s_suppkey as rank, 'h' || s_nationkey as host from supplier where s_nationkey % 3 <> 0",
    "k10_result_entries": "select category, cast(row_number() over (partition by category order by case when category = 'bubble' then score else -score end, key) as int) as place, case when category = 'comm' then domain || '[' || replace(key, ',', ', ') || ']' else key end as display, score as value from (" + profiler_queries.SQL["dp8_findings"] + ")",
    "x12_ranks_of_keys": "select l_orderkey, l_linenumber, l_suppkey, l_suppkey || ';' || l_linenumber as ranks from lineitem",
    "s28_release": _O + " select batch, 'NAME' as key, 'Linux ' || q as text from o union all select batch, 'ID', 'x' || u from o",
    "k6_global_snapshots": fleet_queries._with(*fleet_queries._health_sql(), tail="select node, cast(sum(score) as int) as score, case when sum(score) >= 90 then 'Excellent' when sum(score) >= 75 then 'Good' when sum(score) >= 60 then 'Warning' else 'Critical' end as grade, string_agg(component || ':' || max::int, ',' order by component) as parts, 3000 as cpu_ms from scores group by node"),
    "k5_component_snapshots": "with " + metric_queries._POINTS + " select component, max(batch) as batch, cast(count(*) as int) as n, round(sum(value), 3) as total, cast(count(*) filter (name = 'power') as int) as specs from cpoints group by component",
    "k5_snapshot_points": "with " + metric_queries._POINTS + " select component, cast(row_number() over (partition by component order by ord) - 1 as int) as place, name, round(value, 3) as value, unit from cpoints",
    "m11_sample_fields": f"with {V.KPI_SQL} select ts_s as ts, card::varchar as card, metric, round(max(value), 6) as value from kpi group by 1, 2, 3",
    "m11_kpi_samples": f"with {V.KPI_SQL} select ts_s as ts, cast(count(distinct card) as int) as cards, cast(count(distinct (card, metric)) as int) as fields from kpi group by 1",
    "s16_pressure": _with("select batch, 'some' as kind, unnest(['avg10', 'avg60', 'avg300', 'total']) as field, unnest([q + 0.5, 0.25, u + 0.123456, p]::double[]) as value from l where pos = 1 union all select batch, 'full', unnest(['avg10', 'avg60', 'avg300', 'total']), unnest([0, q, 1, 0]::double[]) from l where pos = 2"),
    "s18_fsensor_sensors": _with("select batch, name, value, unit, status, kind from sensed", _SENSORS),
    "s20_gpu_rows": _with("select batch, pos::varchar as gpu, q::double as utilization, p::double as mem_used, k::double as mem_total, u::double as temperature, 75.5::double as power, 0.0::double as fan_speed, 3.0::double as ecc_errors, 1500.0::double as clock from l where pos <> 5"),
    "s21_labelled_numbers": _with("select batch, ['Usage(%)', 'Temp (C)', null, null, 'Speed', 'a', ''][pos] as key, case pos when 1 then q when 2 then -u - 0.5 when 5 then k when 6 then p when 7 then q end::double as value from l where pos not in (3, 4)"),
    "s22_a23_machine_checks": _with("select batch, socket, kind, count(*) as n from (select batch, case pos when 1 then u % 2 when 2 then 1 when 5 then 7 else 0 end::int as socket, case when pos in (2, 5) then 'uce' else 'ce' end as kind from l where pos in (1, 2, 4, 5)) group by 1, 2, 3"),
    "s23_memory_modules": _O + " select batch, 'DIMM' || u as locator, q * 1024 as size_mb from o",
    "s19_disk_identity": _O + " select batch, 'D' || u as model, 'S' || u as serial, 'V' || u as firmware, q || ' TB' as capacity, p || ' rpm' as rotation, true as passed from o",
    "s24_processor_layout": _O + " select batch, 'x86_64' as architecture, 'M: ' || p as model, u::int as cpus, 2 as threads_per_core, q::int as cores_per_socket, u::int as sockets, null::int as numa_nodes from o",
    "m1_model_info": _O + " " + _points("cpu", "o", ("model_info", "u", "'cache_size=' || p || ' KB,model_name=M' || q || ': x'")),
    "m2_core_states": _with(_points("cpu", "c", *[(f"{k}_core_num", f"coalesce({k}_n, 0)", "''") for k in ("online", "offline", "isolated")]), "c as (select batch, " + ", ".join(f"max(case when pos = {n + 1} then q % 5 + 2 end) as {k}_n" for n, k in enumerate(("online", "offline", "isolated"))) + " from l where pos <= 3 group by batch)"),
    "m2_frequency_range": _O + " " + _points("cpu", "o", ("min_freq", "case when u % 9 <> 0 then trunc(p / 1000 + 0.5) end", "''"), ("max_freq", "case when u % 9 <> 0 then trunc((p + u * 1000) / 1000 + 0.5) end", "''")),
    "m2_caches": _with(_points("cpu", "l", *[(n, f"case when pos = {k} then q end", "'core=0'") for k, n in ((1, "l1d_cache_size"), (2, "l1i_cache_size"), (3, "l2_cache_size"), (4, "l3_cache_size"))])),
    "m4_disk_rates": "with " + V.COUNTERS_SQL + ", r as (select core % 4 as host, core, seq, " + ", ".join(f"case when lag({c}) over w is not null then greatest(0, {c} - lag({c}) over w) end as d_{c}" for c in ("user_", "system_", "idle_", "iowait_", "irq_")) + " from counters window w as (partition by core order by seq)) " + _points("disk", "r", *[(n, f"case when d_{c} is not null then trunc(d_{c} * {f}::double / 5.0 * {t} + 0.5) / {t} end", lab) for n, c, f, t, lab in _DISK_POINTS], keys="host, seq"),
    "m7_device_points": _with(_points("npu", "l", ("temperature", "q", "'npu_id=' || pos"), ("voltage", "case when u % 2 = 0 then u end", "'npu_id=' || pos"), ("hbm_total_memory", "p", "'npu_id=' || pos"), ("hbm_used_memory", "case when pos < 5 then q end", "'npu_id=' || pos"), ("memory_usage", "case when pos < 5 and p > 0 then trunc(q / p * 100 * 100 + 0.5) / 100 end", "'npu_id=' || pos"), ("net_tx_bandwidth", "k", "'npu_id=' || pos"))),
    "m7_device_counters": _with(_points("npu", "l", ("mac_rx_total_oct_num", "case when pos = 2 then p end", "'npu_id=' || (batch % 8)"), ("mac_tx_mac_pause_num", "case when pos = 3 then q end", "'npu_id=' || (batch % 8)"), ("roce_new_pkt_rty", "case when pos = 4 then u end", "'npu_id=' || (batch % 8)"))),
    "m7_device_count": _with(_points("npu", "n", ("npu_num", "n", "''")), "n as (select batch, count(distinct q % 3) as n from l group by batch)"),
    "s21_bandwidths": _O + " select batch, 5.0::double as net_tx_bandwidth, u + 0.5::double as net_rx_bandwidth, 0.0::double as pcie_tx_bandwidth, q::double as pcie_rx_bandwidth from o",
    "s21_link_bandwidths": _O + " select batch, 100.0::double as hccs_tx_bandwidth, -u - 0.25::double as hccs_rx_bandwidth from o",
    "s21_link_and_speed": _O + " select batch, 'UP: ' || u as link, q || ' Mb/s' as speed from o",
    "s21_topology": _O + " " + _points("npu", "o", ("comm_topo", "0", "'topo=card0 ' || q || chr(10) || 'card1 ' || u")),
    "x19_conversions": "select o_orderkey, round(o_custkey / 100.0::double, 6) as s, round(floor(o_totalprice) * 512 / 1048576, 6) as mb, floor(o_totalprice)::double as ns, round(floor(o_totalprice) / 1e3::double, 9) as us, round(floor(o_totalprice) / 1e6::double, 9) as ms from orders",
    "m1_load_points": _with(_points("cpu", "l where pos = 1) as one", ("load_average", "q + 0.25", "'interval=1m'"), ("load_average", "u + 0.5", "'interval=5m'"), ("load_average", "0.75", "'interval=15m'"), ("process_count", "pos", "'type=running'"), ("process_count", "p", "'type=total'")).replace("from l where", "from (select * from l where")),
    "m3_pressure_points": _with(_points("memory", "(select * from l where pos = 1) as one", ("saturation", "q + 0.5", "'interval=avg10'"), ("saturation", "0.25", "'interval=avg60'"), ("saturation", "u + 0.1235", "'interval=avg300'"))),
    "m3_page_counters": _with(_points("memory", "c", ("isolated_pages", "a + f", "''"), ("isolated_anon_pages", "a", "''"), ("isolated_file_pages", "f", "''"), ("free_pages", "n", "''")), "c as (select batch, coalesce(max(p) filter (pos = 1), 0) as a, coalesce(max(p) filter (pos = 2), 0) as f, coalesce(max(p) filter (pos = 3), 0) as n from l group by batch)"),
    "m3_memory_errors": _with(_points("memory", "l", ("ecc_ce_errors", "q", "'mc=mc' || pos"), ("ecc_uce_errors", "case when u % 2 = 0 then u else 0 end", "'mc=mc' || pos"))),
    "m3_module_points": _with(_points("memory", "l", ("module_size", "case when q % 3 > 0 then q % 3 * 1024 end", "'locator=DIMM' || pos"), ("module_info", "case when q % 3 > 0 then q % 3 * 1024 end", "'locator=DIMM' || pos || ',manufacturer=,speed=' || k || ' MT/s,type=DDR4'")) + " union all " + _points("memory", "(select batch, count(*) filter (q % 3 > 0) as n from l group by batch) as c", ("module_num", "n", "''"))),
    "m4_smart_points": _with(_points("disk", "l", ("smart_status", "case when pos < 6 then (q % 2 = 0)::int end", "'device=sd' || pos || ',status=' || case when q % 2 = 0 then 'PASSED' else 'FAILED' end"), ("smart_temperature", "case when pos > 2 then u end", "'device=sd' || pos"))),
    "m5_network_points": _with(
        _points("network", "rated", *[(n, f"{d}_{c}_rate", f"'direction={d},interface=' || interface") for n, c in (("throughput", "bytes"), ("packet_count", "packets")) for d in ("rx", "tx")], *[("error_count", f"{d}_{c}{'s' if c == 'err' else ''}", f"'interface=' || interface || ',type={d}_{c}'") for d in ("rx", "tx") for c in ("err", "drop")], *[(f"{d}_bytes_total", f"{d}_bytes", "'interface=' || interface") for d in ("rx", "tx")]),
        _NET,
        "one as (select batch, interface, " + ", ".join(f"max({c}) as {c}" for c in P.NET_FIELDS) + " from net group by 1, 2)",
        "rated as (select *, " + ", ".join(f"{_RATE.format(c)} as {c}_rate" for c in ("rx_bytes", "tx_bytes", "rx_packets", "tx_packets")) + " from one window w as (partition by interface order by batch))",
    ),
    "m5_connections": _with(_points("network", "(select batch, state, count(*) as n from tcp where state is not null group by 1, 2) as t", ("connection_count", "n", "'state=' || state")), _STATES),
    "m5_interface_status": _with(_points("network", "(select * from l where pos > 1) as t", ("interface_status", "(q % 2 = 0)::int", "'interface=eth' || (pos - 2) || ',status=' || case when q % 2 = 0 then 'up' else 'down' end"))),
    "m6_chassis_points": _with(_points("chassis", "sensed", ("inlet_temp", "case when kind = 'inlet_temp' then q + 0.5 end", "''"), ("outlet_temp", "case when kind = 'outlet_temp' then q + 0.5 end", "''"), ("fan_power", "case when kind = 'fan_power' then q + 0.5 end", "'fan=2'"), ("power", "case when kind = 'power' then q + 0.5 end", "''"), ("fan_speed", "case when kind = 'fan_speed' then q + 1 end", "'direction=F,fan=' || u")), _SENSORS),
    "m7_x11_device_states": _with(_points("npu", "l", ("health_status", "q % 5 + 1", "'npu_id=' || pos || ',status=' || case q % 5 when 1 then 'Warning' when 2 then 'Alarm' when 3 then 'Critical' else 'OK' end"), ("roce_link_status", "u % 3", "'npu_id=' || pos || ',status=' || case when u % 3 > 0 then 'up' else 'down' end"))),
    "m7_device_values": _with(_points("npu", "l", ("hbm_temp", "q", "'npu_id=' || pos"), ("voltage", "case when u % 2 = 0 then u end", "'npu_id=' || pos"), ("mac_rx_total_oct_num", "k", "'npu_id=' || pos"))),
    "m15_derived_shares": _with(
        _points("cpu", "shown", *[(n, f"100.0 * ({v}) / total", "'core=total'") for n, v in _SHARE.items()], keys="core, batch"),
        f"sums as (select pos as core, batch, {_CPU} from l window w as (partition by pos order by batch rows unbounded preceding))",
        f"deltas as (select core, batch, row_number() over w as n, {_DELTA} from sums window w as (partition by core order by batch))",
        f"grown as (select core, batch, count(*) filter (n > 1 and {_SUM} > 0) over (partition by core order by batch) as part, {', '.join(f'{f} as {f}_' if f == 'user' else f for f in P.CPU_FIELDS[:8])}, {_SUM} as total, n from deltas)",
        "shown as (select g.core, g.batch, f.* exclude (core, batch, part) from grown as g join grown as f on f.core = g.core and f.part = g.part and f.total > 0 and f.n > 1)",
    ),
    "a27_capacity": _with("select host, n, round(gb, 6) as gb, case when gb >= 1024 then printf('%.1f', gb / 1024) || ' TB' when gb >= 10 then printf('%.0f', gb) || ' GB' else printf('%.1f', gb) || ' GB' end as text from (select u as host, count(*) as n, sum(p / 1000.0::double) as gb from l group by u)"),
    "fnav_preferred": "with " + metric_queries._POINTS + """, picked as (select *, row_number() over (partition by batch, name order by case when (name = 'throughput' and direction = 'write') or (name = 'usage_detail' and field = 'free') then 0 else 1 end, ord) as place from cpoints)
select batch, name, value, case when device is not null then case when direction < device then direction || ',' || device else device || ',' || direction end else coalesce(npu_id, interface, field, interval_, cpu) end as label from picked where place = 1""",
    "fnav_order": "select component, cast(place as int) as place from (values ('cpu', 1), ('memory', 2), ('disk', 3), ('npu', 4), ('network', 5), ('chassis', 6), ('zeta', 7)) as t(component, place)",
    "feff_all_specs": "with " + metric_queries._POINTS + ",\n" + _L + f""", specs as (select * from (values {', '.join(f"('{c}', '{n}')" for c, n, lab, _ in S.EFFICIENCY if not lab)}) as t(component, name))
select batch, component, name, ord from cpoints semi join specs using (component, name) union all select batch, component, name, ord from cpoints where (name = 'usage_detail' and field in ('total', 'free')) or (name = 'swap_detail' and field in ('total', 'free'))
union all select batch, 'cpu', {_list(P.CPU_FIELDS[:8])}[pos] || '_time', k from l where q % 2 = 0""",
}
