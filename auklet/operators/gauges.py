"""Parsed probes as metric points: percentages, unit conversions and one row for each value.

Every function gives (keys, component, name, value, unit, labels); values that can't be computed give no point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auklet.functions.scalars import mb_of_sectors, percent, trunc_round
from auklet.session import spread

_NONE = "map<string,string>"


def _labels(**parts: Column | str) -> Column:
    if not parts:
        return F.create_map().cast(_NONE)
    return F.create_map(*[x for k, v in parts.items() for x in (F.lit(k), v.cast("string") if isinstance(v, Column) else F.lit(v))])


def points(rows: DataFrame, keys: list[str], component: str, *each: tuple[str, Column, str, Column]) -> DataFrame:
    """One point for each (name, value, unit, labels) of a row whose value isn't null; rows are read once."""
    made = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(u).alias("unit"), lab.alias("labels")) for n, v, u, lab in each])
    return rows.select(*keys, F.lit(component).alias("component"), F.explode(made).alias("p")).where("p.value is not null").select(*keys, "component", "p.*")


def memory(info: DataFrame, keys: list[str]) -> DataFrame:
    """Usage and swap usage in percent and their fields in MB, from (keys, key, kb); usage needs MemTotal and MemAvailable."""
    fields = {"total": "MemTotal", "available": "MemAvailable", "free": "MemFree", "buffers": "Buffers", "cached": "Cached", "sreclaimable": "SReclaimable", "unevictable": "Unevictable", "swap_total": "SwapTotal", "swap_free": "SwapFree"}
    wide = info.groupBy(*keys).agg(*[F.max(F.when(F.col("key") == k, F.col("kb"))).alias(f"v_{c}") for c, k in fields.items()])
    v = {c: F.col(f"v_{c}") for c in fields}
    known, swap = v["total"].isNotNull() & v["available"].isNotNull(), v["swap_total"].isNotNull() & v["swap_free"].isNotNull()
    used, swapped = v["total"] - v["available"], v["swap_total"] - v["swap_free"]
    own = {"total": v["total"], "used": used, **{c: v[c] for c in list(fields)[1:7]}}
    return points(
        wide, keys, "memory",
        ("usage", F.when(known, trunc_round(percent(used, v["total"]), 2)), "%", _labels()),
        *[("usage_detail", F.when(known, c / 1024), "MB", _labels(field=n)) for n, c in own.items()],
        ("swap_usage", F.when(swap, trunc_round(percent(swapped, v["swap_total"]), 2)), "%", _labels()),
        *[("swap_detail", F.when(swap, c / 1024), "MB", _labels(field=n)) for n, c in {"total": v["swap_total"], "used": swapped, "free": v["swap_free"]}.items()],
    )


def disk_space(mounts: DataFrame, keys: list[str]) -> DataFrame:
    """Usage in percent and sizes in MB of mounts (keys, device, mount, fstype, total, used, avail in bytes)."""
    lab = {"device": F.col("device"), "mount_point": F.col("mount"), "fstype": F.col("fstype")}
    usage = trunc_round(percent(F.col("used"), F.col("total")), 2)
    sizes = [("space_detail", F.col(c) / (1 << 20), "MB", _labels(**lab, field=n)) for n, c in (("total", "total"), ("used", "used"), ("available", "avail"))]
    return points(mounts, keys, "disk", ("space_usage", usage, "%", _labels(**lab)), *sizes)


def disk_rates(counters: DataFrame, keys: list[str], order: str, seconds: float | None = None) -> DataFrame:
    """(keys, order and a point's columns): operations and MB a second by direction, and ms of waiting a second, of devices since their sample before.

    counters are (keys, device, order, reads, sectors_read, ms_read, writes, sectors_written, ms_written); order is in seconds, unless a fixed
    interval is given. A device's first sample and one at the same time as the sample before give no points; a counter that fell counts as no increase.
    """
    w = Window.partitionBy(*keys, "device").orderBy(order)
    fields = ("reads", "sectors_read", "ms_read", "writes", "sectors_written", "ms_written")
    gap = F.lit(float(seconds)) if seconds else (F.col(order) - F.lag(order).over(w)).cast("double")
    rows = counters.withColumns({"gap_": F.when(F.lag(order).over(w).isNotNull(), gap), **{f"d_{f}": F.greatest(F.lit(0), F.col(f) - F.lag(f).over(w)) for f in fields}}).where("gap_ > 0")
    each = lambda f, places, of=lambda c: c: trunc_round(of(F.col(f"d_{f}")) / F.col("gap_"), places)
    lab = lambda **more: _labels(device=F.col("device"), **more)
    return points(
        rows, [*keys, order], "disk",
        ("iops", each("reads", 0), "1/s", lab(direction="read")),
        ("iops", each("writes", 0), "1/s", lab(direction="write")),
        ("throughput", each("sectors_read", 2, mb_of_sectors), "MB/s", lab(direction="read")),
        ("throughput", each("sectors_written", 2, mb_of_sectors), "MB/s", lab(direction="write")),
        ("read_latency", each("ms_read", 2), "ms/s", lab()),
        ("write_latency", each("ms_written", 2), "ms/s", lab()),
    )


def core_states(lists: DataFrame, keys: list[str]) -> DataFrame:
    """How many cores are online, offline and isolated, from the lists (keys, kind, n) of each; a list that wasn't read counts as empty."""
    wide = lists.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("online", "offline", "isolated")])
    return points(wide, keys, "cpu", *[(f"{k}_core_num", F.col(k), "", _labels()) for k in ("online", "offline", "isolated")])


def frequency_range(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The least and the greatest MHz of the hardware, from (keys, min_khz, max_khz); both are needed."""
    both = rows.where("min_khz is not null and max_khz is not null")
    return points(both, keys, "cpu", *[(f"{k}_freq", trunc_round(F.col(f"{k}_khz") / 1000.0, 0), "MHz", _labels()) for k in ("min", "max")])


def caches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes in KB of the first core's caches (keys, level, type, kb): the two of level 1, levels 2 and 3; others give no point."""
    level, kind = F.col("level"), F.col("type")
    name = F.when((level == 1) & (kind == "Data"), "l1d").when((level == 1) & (kind == "Instruction"), "l1i").when(level.isin(2, 3), F.concat(F.lit("l"), level.cast("string")))
    made = rows.withColumn("name_", name).where("name_ is not null")
    return points(made, [*keys, "name_"], "cpu", ("", F.col("kb"), "KB", _labels(core="0"))).withColumn("name", F.concat("name_", F.lit("_cache_size"))).drop("name_")


def model(info: DataFrame, keys: list[str]) -> DataFrame:
    """The processor's model and cache as labels of its core count, from (keys, model, cores, cache)."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return points(info, keys, "cpu", ("model_info", F.coalesce("cores", F.lit(0)), "cores", _labels(model_name=empty("model"), cache_size=empty("cache"))))


def gpus(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Nine points of each device (keys, gpu and the fields that the probe parser gives)."""
    two, gpu = lambda c: trunc_round(F.col(c), 2), F.col("gpu")
    return points(
        rows, keys, "gpu",
        ("utilization", two("utilization"), "%", _labels(gpu_id=gpu)),
        ("memory_usage", trunc_round(percent(F.col("mem_used"), F.col("mem_total")), 2), "%", _labels(gpu_id=gpu)),
        ("memory_detail", two("mem_used"), "MB", _labels(gpu_id=gpu, field="used")),
        ("memory_detail", two("mem_total"), "MB", _labels(gpu_id=gpu, field="total")),
        ("temperature", two("temperature"), "C", _labels(gpu_id=gpu)),
        ("power_draw", two("power"), "W", _labels(gpu_id=gpu)),
        ("fan_speed", two("fan_speed"), "%", _labels(gpu_id=gpu)),
        ("ecc_errors", two("ecc_errors"), "", _labels(gpu_id=gpu)),
        ("clock_frequency", two("clock"), "MHz", _labels(gpu_id=gpu)),
    )


def load(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Load averages by interval and counts of running and of all tasks."""
    loads = [("load_average", F.col(f"load_{i}"), "", _labels(interval=i)) for i in ("1m", "5m", "15m")]
    return points(rows, keys, "cpu", *loads, *[("process_count", F.col(c), "", _labels(type=c)) for c in ("running", "total")])


def frequencies(cores: DataFrame, keys: list[str]) -> DataFrame:
    """MHz of each core (keys, core, khz) and of their mean, rounded."""
    each = points(cores, keys, "cpu", ("frequency", trunc_round(F.col("khz") / 1000.0, 0), "MHz", _labels(core=F.col("core"))))
    mean = cores.groupBy(*keys).agg(F.avg("khz").alias("khz"))
    return each.unionByName(points(mean, keys, "cpu", ("avg_freq", trunc_round(F.col("khz") / 1000.0, 0), "MHz", _labels())))


def topology(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of processors, cores and nodes, and cores by die and by node, from (keys, cores, sockets, cores_per_socket, dies, nodes)."""
    dies, nodes = F.greatest(F.coalesce("dies", F.lit(1)), F.lit(1)), F.coalesce("nodes", F.lit(0))
    rows = rows.withColumns({"d_": dies, "n_": nodes})
    totals = points(rows, keys, "cpu", ("numa_node_num", F.col("n_"), "", _labels()), ("core_num", F.col("cores"), "", _labels()), ("cpu_num", F.col("sockets"), "", _labels()))
    by_die = rows.withColumn("k_", F.explode(F.sequence(F.lit(0), F.col("d_") - 1)))
    by_node = rows.where("n_ > 0").withColumn("k_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    die = points(by_die, keys, "cpu", ("die_core_num", F.expr("cores_per_socket div d_"), "", _labels(die=F.col("k_"))))
    return totals.unionByName(die).unionByName(points(by_node, keys, "cpu", ("numa_core_num", F.expr("cores div n_"), "", _labels(node=F.col("k_")))))


def device_values(wide: DataFrame, keys: list[str], component: str, id_: str, label: str, units: dict[str, str]) -> DataFrame:
    """A point for each non-null column of a captured device row that `units` names; counters with `_oct_` in the name are bytes."""
    each = [(n, F.col(n), "bytes" if "_oct_" in n else u, _labels(**{label: F.col(id_)})) for n, u in units.items() if n in wide.columns]
    return points(wide, keys, component, *each)


#: The probes of an accelerator that give one number each, and their units; counters of its network are whatever its tool lists.
DEVICE_PROBES = {
    "utilization": "%", "memory_usage": "%", "hbm_total_memory": "MB", "hbm_used_memory": "MB", "hbm_temp": "C", "temperature": "C", "power_draw": "W", "driver_health": "", "voltage": "V",
    "cluster_temp": "C", "peri_temp": "C", "aicore0_temp": "C", "aicore1_temp": "C", "ntc1_temp": "C", "ntc2_temp": "C", "ntc3_temp": "C", "ntc4_temp": "C", "soc_max_temp": "C", "fp_max_temp": "C",
    "ndie_temp": "C", "hbm_max_temp": "C", "aicore_voltage": "V", "hybrid_voltage": "V", "cpu_voltage": "V", "ddr_voltage": "V", "acg_count": "", "fan_speed": "%", "aicpu_freq": "MHz",
    "aicore_rated_freq": "MHz", "ctrlcpu_freq": "MHz", "vector_core_freq": "MHz", "hbm_freq": "MHz", "ddr_freq": "MHz", "aicore_freq": "MHz", "aicpu_util": "%", "ctrlcpu_util": "%",
    "vector_core_util": "%", "hbm_bandwidth_util": "%", "ddr_util": "%", "ddr_bandwidth_util": "%", "vdec_util": "%", "vpc_util": "%", "venc_util": "%", "jpege_util": "%", "jpegd_util": "%",
    "npu_util": "%", "process_total": "", "llc_write_hit_rate": "%", "llc_read_hit_rate": "%", "llc_throughput": "MB/s", "net_tx_bandwidth": "MB/s", "net_rx_bandwidth": "MB/s",
    "pcie_tx_bandwidth": "MB/s", "pcie_rx_bandwidth": "MB/s", "hccs_tx_bandwidth": "MB/s", "hccs_rx_bandwidth": "MB/s",
}


def device_points(wide: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """A point for every probe of DEVICE_PROBES that a captured device row (keys, id, a column for each probe) has; memory_usage comes from its two sizes where it wasn't read."""
    used = F.when(F.col("hbm_total_memory") > 0, trunc_round(percent(F.col("hbm_used_memory"), F.col("hbm_total_memory")), 2)) if {"hbm_total_memory", "hbm_used_memory"} <= set(wide.columns) else F.lit(None)
    wide = wide.withColumn("memory_usage", F.coalesce("memory_usage", used) if "memory_usage" in wide.columns else used)
    return device_values(wide, keys, "npu", id_, "npu_id", DEVICE_PROBES)


def device_counters(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """A point for each counter (keys, id, key, n) of a device's network; those of octets are bytes."""
    made = points(rows.withColumn("key_", F.col("key")), [*keys, "key_"], "npu", ("", F.col("n"), "", _labels(npu_id=F.col(id_))))
    return made.withColumns({"name": F.col("key_"), "unit": F.when(F.col("key_").contains("_oct_"), "bytes").otherwise("")}).drop("key_")


def device_count(devices: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """How many devices there are."""
    return points(devices.groupBy(*keys).agg(F.countDistinct(id_).alias("n_")), keys, "npu", ("npu_num", F.col("n_"), "", _labels()))


def device_texts(rows: DataFrame, keys: list[str], name: str, label: str, id_: str | None = None) -> DataFrame:
    """A point of value 0 that carries a text (keys, id, text) as its label: topology, driver version, chip type, link and speed; none for empty texts."""
    return points(rows.where("text <> ''"), keys, "npu", (name, F.lit(0), "", _labels(**({"npu_id": F.col(id_)} if id_ else {}), **{label: F.col("text")})))


def trend_text(metric: Column, slope: Column) -> Column:
    """A trend by day, hour or minute, the first of which it moves a tenth in; slope is by second."""
    day, hour = slope * 86400, slope * 3600
    value = F.when(F.abs(day) >= 0.1, day).when(F.abs(hour) >= 0.1, hour).otherwise(slope * 60)
    unit = F.when(F.abs(day) >= 0.1, "day").when(F.abs(hour) >= 0.1, "hour").otherwise("minute")
    size = F.abs(value)
    number = F.when(size < 0.01, "~0").when(size < 1, F.format_string("%.3f", size)).when(size < 100, F.format_string("%.2f", size)).otherwise(F.format_string("%.1f", size))
    return F.concat(metric, F.when(value < 0, " falls by ").otherwise(" rises by "), number, F.lit(" per "), unit)


def rolling_view(history: DataFrame, newest: DataFrame, key: str) -> DataFrame:
    """Histories of the series that the newest batch still has."""
    return history.join(newest.select(key).distinct(), key, "left_semi")


def parameter_faults(commands: DataFrame, rules: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(id, faults) of commands (id, instruction, params: map of text) against rules by instruction: parameter -> (Spark type, required)."""
    found = []
    for name, params in rules.items():
        own = F.col("instruction") == name
        for p, (kind, required) in params.items():
            v = F.element_at("params", F.lit(p))
            bad = (v.isNull() & F.lit(required)) | (v.isNotNull() & v.try_cast(kind).isNull())
            found.append(F.when(own & bad, F.lit(p)))
        found.append(F.when(own, F.array_join(F.array_except(F.map_keys("params"), F.array(*[F.lit(p) for p in params])), ",")))
    found.append(F.when(~F.col("instruction").isin(list(rules)), F.lit("instruction")))
    return commands.select("id", F.array_sort(F.filter(F.array_compact(F.array(*found)), lambda x: x != "")).alias("faults"))


def memory_pressure(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Averages of the `some` line of pressure rows (keys, kind, field, value) in percent, by interval."""
    some = rows.where((F.col("kind") == "some") & F.col("field").isin("avg10", "avg60", "avg300"))
    return points(some, keys, "memory", ("saturation", trunc_round(F.col("value"), 4), "%", _labels(interval=F.col("field"))))


def page_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Isolated and free pages from counters (keys, key, n); a counter that is missing counts as 0."""
    n = lambda k: F.coalesce(F.max(F.when(F.col("key") == k, F.col("n"))), F.lit(0)).alias(k)
    wide = rows.groupBy(*keys).agg(*[n(k) for k in ("nr_isolated_anon", "nr_isolated_file", "nr_free_pages")])
    anon, file = F.col("nr_isolated_anon"), F.col("nr_isolated_file")
    each = {"isolated_pages": anon + file, "isolated_anon_pages": anon, "isolated_file_pages": file, "free_pages": F.col("nr_free_pages")}
    return points(wide, keys, "memory", *[(name, v, "", _labels()) for name, v in each.items()])


def memory_errors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts so far of corrected and uncorrected errors of each controller (keys, mc, ce_count, ue_count)."""
    return points(rows, keys, "memory", *[(n, F.coalesce(F.col(c), F.lit(0)), "", _labels(mc=F.col("mc"))) for n, c in (("ecc_ce_errors", "ce_count"), ("ecc_uce_errors", "ue_count"))])


def memory_modules(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Size and identity of each populated slot (keys, locator, size_mb, type, speed, manufacturer), and how many there are."""
    full = rows.where("size_mb > 0")
    identity = _labels(**{c: F.coalesce(F.col(c), F.lit("")) for c in ("locator", "type", "speed", "manufacturer")})
    each = points(full, keys, "memory", ("module_size", F.col("size_mb"), "MB", _labels(locator=F.col("locator"))), ("module_info", F.col("size_mb"), "MB", identity))
    return each.unionByName(points(rows.groupBy(*keys).agg(F.count_if(F.col("size_mb") > 0).alias("n")), keys, "memory", ("module_num", F.col("n"), "", _labels())))


def with_before(rows: DataFrame, series: list[str], order: str, columns: list[str], width: float = 3600.0) -> DataFrame:
    """rows with before_*: the columns' values in the row before of the same series, null in its first; order is a number or a time, and no two rows of a series share it.

    A series is cut into slices of `width` of its order (seconds of a time), and each slice's last row is carried into the next one that has
    rows: so no series is one task, however long it gets.
    """
    cut = rows.withColumn("slice_", F.floor(F.col(order).cast("double") / width))
    ends = cut.groupBy(*series, "slice_").agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in columns])
    carried = ends.withColumn("slice_", F.lead("slice_").over(Window.partitionBy(*series).orderBy("slice_"))).where("slice_ is not null")
    both = cut.withColumn("carried_", F.lit(False)).unionByName(carried.withColumn("carried_", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(*series, "slice_").orderBy(order)
    found = spread(both, *series, "slice_").withColumns({f"before_{c}": F.lag(c).over(w) for c in columns})
    return found.where("not carried_").drop("slice_", "carried_")


def network(counters: DataFrame, keys: list[str], series: list[str], order: str, seconds: float = 3.0) -> DataFrame:
    """Errors, drops and byte totals of each interface at each sample, and from its second sample on rates over the interval.

    A counter that falls gives no negative rate.
    """
    fields = ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets"]
    rate = lambda c: F.when(F.col(f"before_{c}").isNotNull(), trunc_round(F.greatest(F.lit(0), F.col(c) - F.col(f"before_{c}")) / seconds, 0))
    rows = with_before(counters, [*series, "interface"], order, fields).withColumns({f"{c}_rate": rate(c) for c in fields})
    of, each = F.col("interface"), []
    for name, unit, column in (("throughput", "bytes/s", "bytes"), ("packet_count", "/s", "packets")):
        each += [(name, F.col(f"{d}_{column}_rate"), unit, _labels(interface=of, direction=d)) for d in ("rx", "tx")]
    each += [("error_count", F.col(f"{d}_{c}s" if c == "err" else f"{d}_{c}"), "", _labels(interface=of, type=f"{d}_{c}")) for d in ("rx", "tx") for c in ("err", "drop")]
    each += [(f"{d}_bytes_total", F.col(f"{d}_bytes"), "bytes", _labels(interface=of)) for d in ("rx", "tx")]
    return points(rows, keys, "network", *each)


def connections(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sockets by state (keys, state, n)."""
    return points(rows, keys, "network", ("connection_count", F.col("n"), "", _labels(state=F.col("state"))))


def interface_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """1 for interfaces (keys, interface, state) that are up, 0 for others; loopback is left out."""
    return points(rows.where("interface <> 'lo'"), keys, "network", ("interface_status", (F.col("state") == "up").cast("int"), "", _labels(interface=F.col("interface"), status=F.col("state"))))


def chassis(sensors: DataFrame, keys: list[str]) -> DataFrame:
    """Temperatures, power and fans of a chassis from sensor rows (keys, name, value, kind); a fan without a number is 0, without a side F."""
    fan = F.coalesce(F.nullif(F.regexp_extract(F.lower("name"), r"(?:^|\s)fan(\S+)", 1), F.lit("")), F.lit("0"))
    side = F.coalesce(F.nullif(F.regexp_extract("name", r"(?:^|.*\s)([FR])(?=\s|$)", 1), F.lit("")), F.lit("F"))
    one = lambda kind, places: F.when(F.col("kind") == kind, trunc_round(F.col("value"), places))
    return points(
        sensors, keys, "chassis",
        ("inlet_temp", one("inlet_temp", 1), "C", _labels()),
        ("outlet_temp", one("outlet_temp", 1), "C", _labels()),
        ("fan_power", one("fan_power", 2), "W", _labels(fan=fan)),
        ("power", one("power", 2), "W", _labels()),
        ("fan_speed", one("fan_speed", 0), "RPM", _labels(fan=fan, direction=side)),
    )


def disk_health(rows: DataFrame, keys: list[str]) -> DataFrame:
    """1 for disks (keys, device, passed, temperature) that pass their own test, 0 for such that fail, and their temperature."""
    of = F.col("device")
    status = F.when(F.col("passed"), "PASSED").otherwise("FAILED")
    return points(rows, keys, "disk", ("smart_status", F.col("passed").cast("int"), "", _labels(device=of, status=status)), ("smart_temperature", F.col("temperature"), "C", _labels(device=of)))


#: What a device's health code says; any other is OK.
HEALTH = {1: "Warning", 2: "Alarm", 3: "Critical"}


def device_states(rows: DataFrame, keys: list[str], id_: str) -> DataFrame:
    """Health of accelerators (keys, id, health, link): the code plus 1 with its text, and whether the network link is up."""
    of = F.col(id_)
    text = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HEALTH.items() for x in kv]), F.col("health")), F.lit("OK"))
    link = F.when(F.col("link") > 0, "up").otherwise("down")
    return points(rows, keys, "npu", ("health_status", F.col("health") + 1, "", _labels(npu_id=of, status=text)), ("roce_link_status", F.col("link"), "", _labels(npu_id=of, status=link)))


def derived_shares(shares: DataFrame, keys: list[str]) -> DataFrame:
    """Seven utilization points from the shares (user_pct, nice_pct, ...) of all cores together."""
    c = lambda *names: sum((F.col(f"{n}_pct") for n in names[1:]), F.col(f"{names[0]}_pct"))
    each = {
        "idle_util": c("idle"),
        "non_idle_util": c("user", "nice", "system", "iowait", "irq", "softirq", "steal"),
        "user_util": c("user", "nice"),
        "system_util": c("system"),
        "iowait_util": c("iowait"),
        "irq_util": c("irq", "softirq"),
        "steal_util": c("steal"),
    }
    return points(shares, keys, "cpu", *[(n, v, "%", _labels(core="total")) for n, v in each.items()])


def preferred(metrics: DataFrame, keys: list[str], prefer: dict[str, dict[str, str]]) -> DataFrame:
    """(keys, name, value, labels): of each name's points the first that has the preferred labels, or else the first; `ord` is their order."""
    want = F.lit(False)
    for name, labels in prefer.items():
        has = F.lit(True)
        for k, v in labels.items():
            has = has & (F.element_at("labels", F.lit(k)) == v)
        want = want | ((F.col("name") == name) & F.coalesce(has, F.lit(False)))
    return metrics.groupBy(*keys, "name").agg(F.min_by(F.struct("value", "labels"), F.struct((~want).alias("other"), "ord")).alias("p")).select(*keys, "name", "p.*")


def capacity(disks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, gb, text): how many disks (keys, gb) there are and what they hold together."""
    got = disks.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("gb").alias("gb"))
    gb = F.col("gb")
    text = F.when(gb >= 1024, F.concat(F.format_string("%.1f", gb / 1024), F.lit(" TB"))).when(gb >= 10, F.concat(F.format_string("%.0f", gb), F.lit(" GB"))).otherwise(F.concat(F.format_string("%.1f", gb), F.lit(" GB")))
    return got.withColumn("text", text)


#: Components in the order in which they are shown; others follow by name.
NAVIGATION = ("cpu", "memory", "disk", "gpu", "npu", "network")


def navigation(components: DataFrame) -> DataFrame:
    """(component, place): where each component stands; `system` has no page of its own."""
    known = F.array_position(F.array(*[F.lit(c) for c in NAVIGATION]), F.col("component"))
    rows = components.select("component").where("component <> 'system'").distinct()  # as many as there are kinds of probes
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(F.lit(999)), "component")))


def disk_specs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Disks (keys, device, bytes, model) as identity points, in GB of 10^9 bytes."""
    return points(rows, keys, "disk", ("disk_info", trunc_round(F.col("bytes") / 1e9, 1), "GB", _labels(device=F.col("device"), model=F.coalesce("model", F.lit("")))))


def network_specs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Interfaces (keys, interface, mac, mtu, speed, driver) as identity points; the value counts them by name, loopback left out."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("interface")) - 1
    labels = _labels(**{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("interface", "mac", "mtu", "speed", "driver")})
    return points(rows.where("interface <> 'lo'").withColumn("place_", place), keys, "network", ("net_info", F.col("place_"), "", labels))


def device_specs(rows: DataFrame, keys: list[str], component: str) -> DataFrame:
    """Accelerators (keys, id, name, bus) as identity points of gpu or npu."""
    labels = _labels(**{f"{component}_id": F.col("id"), "name": F.coalesce("name", F.lit("")), "bus_id": F.coalesce("bus", F.lit(""))})
    return points(rows, keys, component, (f"{component}_info", F.lit(0), "", labels))


def system_specs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Maker and product of the machine and the system's name (keys, manufacturer, product_name, pretty_name) as identity points."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    model = F.when(F.col("manufacturer").isNotNull() | F.col("product_name").isNotNull(), 0)
    return points(rows, keys, "system", ("device_model", model, "", _labels(manufacturer=text("manufacturer"), product_name=text("product_name"))), ("os_info", F.when(F.col("pretty_name").isNotNull(), 0), "", _labels(pretty_name=text("pretty_name"))))
