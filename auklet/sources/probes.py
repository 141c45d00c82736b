"""Text of system probes as rows: each function takes lines (batch, source, pos, value) and gives typed columns beside batch and source.

Lines are parsed where they lie; only block formats (handles, inventories) are grouped. Lines that don't fit are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auklet.functions.scalars import expand_ranges, size_mb
from auklet.session import spread

KEYS = ["batch", "source"]
# Fields of a processor line, columns of a network device line, codes of socket states
CPU_FIELDS = ["user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal", "guest", "guest_nice"]
NET_FIELDS = {"rx_bytes": 0, "rx_packets": 1, "rx_errs": 2, "rx_drop": 3, "tx_bytes": 8, "tx_packets": 9, "tx_errs": 10, "tx_drop": 11}
DISK_FIELDS = {"reads": 3, "sectors_read": 5, "ms_read": 6, "writes": 7, "sectors_written": 9, "ms_written": 10}
TCP_STATES = {"01": "ESTABLISHED", "02": "SYN_SENT", "03": "SYN_RECV", "04": "FIN_WAIT1", "05": "FIN_WAIT2", "06": "TIME_WAIT", "07": "CLOSE", "08": "CLOSE_WAIT", "09": "LAST_ACK", "0A": "LISTEN", "0B": "CLOSING"}
GPU_FIELDS = ["utilization", "mem_used", "mem_total", "temperature", "power", "fan_speed", "ecc_errors", "clock"]
VIRTUAL_FS = ["proc", "sysfs", "devtmpfs", "tmpfs", "devpts", "overlay", "squashfs", "fusectl", "none", "cgroup", "cgroup2", "mqueue", "hugetlbfs", "rpc_pipefs", "binfmt_misc", "securityfs", "pstore", "bpf", "tracefs", "debugfs", "configfs", "autofs", "fuse", "fuse.gvfsd-fuse"]


def read_lines(spark: SparkSession, path: str, batch: Column | None = None) -> DataFrame:
    """(batch, source, pos, value) of text files; source is the file's path, pos the line's place in it.

    Files of any length are read in blocks: lines are numbered within a block, and each block starts where those before it end.
    """
    meta = {c: F.col(f"_metadata.{m}").alias(c) for c, m in (("source", "file_path"), ("at", "file_modification_time"), ("block_", "file_block_start"))}
    text = spark.read.text(path).select(*meta.values(), "value").withColumn("id_", F.monotonically_increasing_id())
    sizes = text.groupBy("source", "block_").agg(F.count("*").alias("n_"))
    base = F.coalesce(F.sum("n_").over(Window.partitionBy("source").orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("source", "block_").orderBy("id_")) - 1
    lines = text.withColumn("k_", place).join(sizes.select("source", "block_", base.alias("base_")), ["source", "block_"])
    return lines.where("value <> ''").select((F.col("at") if batch is None else batch).alias("batch"), "source", (F.col("base_") + F.col("k_")).cast("int").alias("pos"), "value")


# Files of the system tree that hold one value, as (kind, pattern of the path, whose first group is the device)
SYSTEM_FILES = [
    ("cur_khz", r"/cpu/(cpu\d+)/cpufreq/scaling_cur_freq$"),
    ("min_khz", r"/cpu/(cpu\d+)/cpufreq/cpuinfo_min_freq$"),
    ("max_khz", r"/cpu/(cpu\d+)/cpufreq/cpuinfo_max_freq$"),
    ("cache_kb", r"/cpu/(cpu\d+/cache/index\d+)/size$"),
    ("node_cpus", r"/node/(node\d+)/cpulist$"),
    ("ce_count", r"/edac/mc/(mc\d+)/ce_count$"),
    ("ue_count", r"/edac/mc/(mc\d+)/ue_count$"),
    ("operstate", r"/net/([^/]+)/operstate$"),
    ("speed", r"/net/([^/]+)/speed$"),
    ("mtu", r"/net/([^/]+)/mtu$"),
    ("mac", r"/net/([^/]+)/address$"),
    ("bytes", r"/block/([^/]+)/size$"),
    ("celsius", r"/thermal/(thermal_zone\d+)/temp$"),
]
# Beginnings of block devices' names that aren't disks
NO_DISKS = ["loop", "ram", "sr", "zram", "md"]


def system_values(lines: DataFrame) -> DataFrame:
    """(batch, source, kind, device, text, number) of the system tree's one-value files; the file's path says what a value is.

    Sizes of block devices are in sectors of 512 bytes, of caches in K, temperatures in thousandths. Loops, memory disks and
    arrays give no row.
    """
    found = [F.when(F.col("source").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("source", p, 1).alias("device"))) for k, p in SYSTEM_FILES]
    rows = lines.where("pos = 0").select(*KEYS, F.coalesce(*found).alias("of"), _strip("value").alias("text")).where("of is not null").select(*KEYS, "of.*", "text")
    rows = rows.where((F.col("kind") != "bytes") | ~F.col("device").rlike("^(" + "|".join(NO_DISKS) + ")"))
    n = F.regexp_replace("text", "K$", "").try_cast("double")
    return rows.withColumn("number", F.when(F.col("kind") == "bytes", n * 512).when(F.col("kind") == "celsius", n / 1000).otherwise(n))


def release(lines: DataFrame) -> DataFrame:
    """(batch, source, key, text) of NAME="value" lines; quotes at both ends go."""
    parts = F.split("value", "=", 2)
    rows = lines.where(F.col("value").contains("=") & ~F.col("value").startswith("#"))
    return rows.select(*KEYS, _strip(parts[0]).alias("key"), F.regexp_replace(_strip(F.get(parts, F.lit(1))), r"^[\"']|[\"']$", "").alias("text"))


def _strip(text: Column | str) -> Column:
    """Text without white space at its ends, tabs included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _words() -> Column:
    return F.split(_strip("value"), r"\s+")


def _long(words: Column, k: int) -> Column:
    return F.coalesce(F.get(words, F.lit(k)).try_cast("bigint"), F.lit(0))


def cpu_times(lines: DataFrame) -> DataFrame:
    """A row for each `cpu` line: core (`total` for all) and the fields, 0 where the line is short."""
    w = _words()
    core = F.when(F.get(w, F.lit(0)) == "cpu", "total").otherwise(F.regexp_extract(F.get(w, F.lit(0)), r"^cpu(\d+)$", 1))
    return lines.where(_strip("value").rlike(r"^cpu\d*\s")).select(*KEYS, core.alias("core"), *[_long(w, k + 1).alias(f) for k, f in enumerate(CPU_FIELDS)])


def context_switches(lines: DataFrame) -> DataFrame:
    return lines.where("value like 'ctxt %'").select(*KEYS, _long(_words(), 1).alias("switches"))


def load_average(lines: DataFrame) -> DataFrame:
    w = _words()
    tasks = F.split(F.get(w, F.lit(3)), "/")
    loads = [F.get(w, F.lit(k)).try_cast("double").alias(c) for k, c in enumerate(("load_1m", "load_5m", "load_15m"))]
    return lines.where("pos = 0").select(*KEYS, *loads, F.get(tasks, F.lit(0)).try_cast("bigint").alias("running"), F.get(tasks, F.lit(1)).try_cast("bigint").alias("total"))


def memory_info(lines: DataFrame) -> DataFrame:
    """(key, kb) of `Key: n kB` lines."""
    return lines.select(*KEYS, F.regexp_extract("value", r"^(\S+):\s+(\d+)", 1).alias("key"), F.regexp_extract("value", r"^(\S+):\s+(\d+)", 2).try_cast("bigint").alias("kb")).where("key <> ''")


def disk_counters(lines: DataFrame, physical: bool = True) -> DataFrame:
    """Counters of block devices; `physical` leaves out partitions, loops and memory devices."""
    w = _words()
    rows = lines.where(F.size(w) >= 11).select(*KEYS, F.get(w, F.lit(2)).alias("device"), *[_long(w, k).alias(f) for f, k in DISK_FIELDS.items()])
    return rows.where(F.col("device").rlike(r"^(sd[a-z]+|nvme\d+n\d+|vd[a-z]+|xvd[a-z]+)$")) if physical else rows


def net_counters(lines: DataFrame, loopback: bool = False) -> DataFrame:
    parts = F.split("value", ":", 2)
    w = F.split(_strip(F.get(parts, F.lit(1))), r"\s+")
    rows = lines.where(F.col("value").contains(":") & (F.col("pos") >= 2)).select(*KEYS, _strip(F.get(parts, F.lit(0))).alias("interface"), *[_long(w, k).alias(f) for f, k in NET_FIELDS.items()])
    return rows if loopback else rows.where("interface <> 'lo'")


def key_values(lines: DataFrame, sep: str = r"\s+") -> DataFrame:
    """(key, n) of lines with a name and a whole number."""
    parts = F.split(_strip("value"), sep, 2)
    return lines.select(*KEYS, _strip(F.get(parts, F.lit(0))).alias("key"), _strip(F.get(parts, F.lit(1))).try_cast("bigint").alias("n")).where("n is not null")


def cpu_info(lines: DataFrame) -> DataFrame:
    """First model name and core count, last cache size."""
    key, val = _strip(F.split("value", ":", 2)[0]), _strip(F.get(F.split("value", ":", 2), F.lit(1)))
    first = lambda n: F.min_by(val, F.when(key == n, F.col("pos")))
    return lines.groupBy(*KEYS).agg(first("model name").alias("model"), first("cpu cores").try_cast("int").alias("cores"), F.max_by(val, F.when(key == "cache size", F.col("pos"))).alias("cache"))


def buddy_orders(lines: DataFrame) -> DataFrame:
    """Free blocks by order, share of memory that lies in single pages (percent) and the highest order with a free block."""
    head = r"^Node\s+(\d+),\s+zone\s+(\S+)\s+(.*)$"
    pick = lambda k: F.regexp_extract("value", f"(?i){head}", k)
    orders = F.transform(F.split(_strip(pick(3)), r"\s+"), lambda x: x.try_cast("bigint"))
    rows = lines.where(F.col("value").rlike(f"(?i){head}")).select(*KEYS, pick(1).cast("int").alias("node"), pick(2).alias("zone"), orders.alias("orders"))
    pages = F.aggregate(F.transform("orders", lambda x, k: (x * F.pow(F.lit(2.0), k)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    top = F.array_max(F.transform("orders", lambda x, k: F.when(x > 0, k).otherwise(-1)))
    return rows.withColumns({"fragmentation": F.coalesce(F.try_divide(100.0 * F.get("orders", F.lit(0)), pages), F.lit(0.0)), "top_order": top})


def mounts(lines: DataFrame, virtual: bool = False) -> DataFrame:
    w = _words()
    rows = lines.where(F.size(w) >= 3).select(*KEYS, *[F.get(w, F.lit(k)).alias(c) for k, c in enumerate(("device", "mount", "fstype"))])
    return rows if virtual else rows.where(~F.col("fstype").isin(VIRTUAL_FS))


def tcp_states(lines: DataFrame) -> DataFrame:
    """Sockets by state over all files of a batch."""
    code = F.upper(F.get(_words(), F.lit(3)))
    name = F.element_at(F.create_map(*[F.lit(x) for kv in TCP_STATES.items() for x in kv]), code)
    return lines.where("pos > 0").select("batch", name.alias("state")).where("state is not null").groupBy("batch", "state").agg(F.count("*").alias("n"))


def pressure(lines: DataFrame) -> DataFrame:
    """(kind, field, value): averages and totals of the `some` and `full` lines."""
    w = F.split(_strip("value"), " ", 2)
    pairs = F.str_to_map(F.get(w, F.lit(1)), F.lit(" "), F.lit("="))
    rows = lines.where(F.get(w, F.lit(0)).isin("some", "full")).select(*KEYS, F.get(w, F.lit(0)).alias("kind"), F.explode(pairs).alias("field", "v"))
    return rows.select(*KEYS, "kind", "field", F.col("v").try_cast("double").alias("value"))


def cpu_list(lines: DataFrame) -> DataFrame:
    """(cpus, n) of lists such as 0-3,5."""
    return lines.select(*KEYS, expand_ranges(_strip("value")).alias("cpus")).withColumn("n", F.size("cpus"))


def sensors(lines: DataFrame) -> DataFrame:
    """(name, value, unit, status) of pipe tables with 3 columns (value and unit together) or more."""
    cells = F.transform(F.split("value", r"\|"), lambda c: _strip(c))
    n, second = F.size(cells), F.get(cells, F.lit(1))
    number = F.regexp_extract(second, r"^(-?[\d.]+)", 1).try_cast("double")
    unit = F.when(n == 3, _strip(F.regexp_replace(second, r"^-?[\d.]+", ""))).otherwise(F.get(cells, F.lit(2)))
    return lines.where(n >= 3).select(*KEYS, F.get(cells, F.lit(0)).alias("name"), number.alias("value"), unit.alias("unit"), F.when(n == 3, F.get(cells, F.lit(2))).otherwise(F.get(cells, F.lit(3))).alias("status"))


def sensor_kind(name: Column) -> Column:
    """What a sensor measures, null for others; a fan's power comes before its speed."""
    n = _strip(F.lower(name))
    return (
        F.when(n == "inlet temp", "inlet_temp")
        .when(n == "outlet temp", "outlet_temp")
        .when(n.contains("fan") & n.contains("power"), "fan_power")
        .when(n == "power", "power")
        .when(n.contains("fan") & n.contains("speed"), "fan_speed")
        .when(n.contains("cpu") & n.contains("temp"), "cpu_temp")
        .when(n.contains("mem") & n.contains("temp"), "memory_temp")
        .when(n.contains("cpu") & n.contains("pwr"), "cpu_power")
    )


def gpu_rows(lines: DataFrame) -> DataFrame:
    """Comma-separated device lines of nine fields; shorter ones are left out, unreadable numbers are 0."""
    cells = F.transform(F.split("value", ","), lambda c: _strip(c))
    return lines.where(F.size(cells) >= 9).select(*KEYS, F.get(cells, F.lit(0)).alias("gpu"), *[F.coalesce(F.get(cells, F.lit(k + 1)).try_cast("double"), F.lit(0.0)).alias(f) for k, f in enumerate(GPU_FIELDS)])


def labelled_numbers(lines: DataFrame) -> DataFrame:
    """(key, value): the first number after the colon of `label: number` lines."""
    key, number = _strip(F.regexp_extract("value", r"^([^:]+):", 1)), F.regexp_extract("value", r":\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return lines.select(*KEYS, key.alias("key"), number.alias("value")).where("value is not null")


def _first_number(text: Column) -> Column:
    """The first of a text's words that is a number; 0 if none is."""
    words = F.filter(F.split(_strip(text), r"\s+"), lambda x: x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"))
    return F.coalesce(F.get(words, F.lit(0)).try_cast("double"), F.lit(0.0))


def bandwidths(lines: DataFrame, of: dict[str, tuple[str, ...]]) -> DataFrame:
    """A column for each name of `of`: the first number of the last line that has all its words, in any case; 0 without such a line.

    A line counts for the first name whose words it has. NET_BANDWIDTHS and LINK_BANDWIDTHS are the tools' names.
    """
    low, name = F.lower("value"), F.lit(None).cast("string")
    for n, words in reversed(of.items()):
        name = F.when(reduce(lambda a, b: a & b, [low.contains(x) for x in words]), n).otherwise(name)
    rows = lines.select(*KEYS, "pos", name.alias("name_"), _first_number(F.col("value")).alias("n_"))
    return rows.groupBy(*KEYS).agg(*[F.coalesce(F.max_by("n_", F.when(F.col("name_") == n, F.col("pos"))), F.lit(0.0)).alias(n) for n in of])


# The lines in which the network's and the links' rates stand
NET_BANDWIDTHS = {"net_tx_bandwidth": ("net", "tx"), "net_rx_bandwidth": ("net", "rx"), "pcie_tx_bandwidth": ("pcie", "tx"), "pcie_rx_bandwidth": ("pcie", "rx")}
LINK_BANDWIDTHS = {"hccs_tx_bandwidth": ("tx",), "hccs_rx_bandwidth": ("rx",)}


def labelled_text(lines: DataFrame, prefix: str) -> DataFrame:
    """(text): what stands after the first colon of the first line that has the prefix, in any case; '' without one."""
    own = F.when(F.lower("value").contains(prefix.lower()) & F.col("value").contains(":"), F.col("pos"))
    return lines.groupBy(*KEYS).agg(F.coalesce(F.min_by(_strip(F.get(F.split("value", ":", 2), F.lit(1))), own), F.lit("")).alias("text"))


def whole_text(lines: DataFrame) -> DataFrame:
    """(text): a probe's lines as one text without outer white space; a topology is as large as the machine."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return lines.groupBy(*KEYS).agg(_strip(F.array_join(F.transform(listed, lambda x: x["value"]), "\n")).alias("text"))


def statistics(lines: DataFrame) -> DataFrame:
    """(key, n) of `name:count` lines; the header and counts that are no whole numbers give no row."""
    rows = key_values(lines.where(~F.col("value").contains("statistics:") & F.col("value").contains(":")), ":")
    return rows.where("n >= 0")


def machine_checks(lines: DataFrame) -> DataFrame:
    """Machine check lines by socket and kind; `uncorrected` is tested first, because it contains `corrected`."""
    low = F.lower("value")
    kind = F.when(low.contains("uncorrect") | low.contains("fatal"), "uce").when(low.contains("corrected"), "ce")
    rows = lines.where(F.col("value").contains("Machine Check")).select("batch", F.coalesce(F.regexp_extract("value", r"CPU (\d+)", 1).try_cast("int"), F.lit(0)).alias("socket"), kind.alias("kind"))
    return rows.where("kind is not null").groupBy("batch", "socket", "kind").agg(F.count("*").alias("n"))


def log_counts(lines: DataFrame, patterns: dict[str, str], keys: list[str]) -> DataFrame:
    """Lines that match each pattern, by keys; a line counts once for a pattern."""
    return lines.groupBy(*keys).agg(*[F.count_if(F.lower("value").rlike(p)).alias(n) for n, p in patterns.items()])


# What memory and disk faults look like in a kernel log
LOG_PATTERNS = {"oom": "out of memory|killed process", "io_errors": "i/o error|blk_update_request"}


def blocks(lines: DataFrame, opens: str = "Handle", keys: list[str] | None = None) -> DataFrame:
    """(block, key, text) of inventories in blocks that open with a word, of some keys or all; the lines before the first block are left out.

    Lines are parsed before they are sorted, so only those that open a block or have a key move.
    """
    w = Window.partitionBy(*KEYS).orderBy("pos")
    parts = F.split(_strip("value"), ":", 2)
    pair = F.size(parts) == 2
    rows = lines.select(*KEYS, "pos", F.col("value").startswith(opens).alias("opens"), F.when(pair, _strip(parts[0])).alias("key"), F.when(pair, _strip(F.get(parts, F.lit(1)))).alias("text"))
    if keys is not None:
        wanted = F.col("key").isin(keys)
        rows = rows.withColumns({c: F.when(wanted, F.col(c)) for c in ("text", "key")})
    rows = spread(rows.where("opens or key is not null"), *KEYS).withColumn("block", F.sum(F.col("opens").cast("int")).over(w))
    return rows.where("block > 0 and key is not null").select(*KEYS, "block", "key", "text")


def memory_modules(lines: DataFrame) -> DataFrame:
    """Populated slots: locator, size in MB, type, speed, manufacturer, serial and part number."""
    names = {"Locator": "locator", "Size": "size", "Type": "type", "Speed": "speed", "Manufacturer": "manufacturer", "Serial Number": "serial", "Part Number": "part"}
    got = blocks(lines, keys=list(names)).groupBy(*KEYS, "block").agg(*[F.max(F.when(F.col("key") == k, F.col("text"))).alias(c) for k, c in names.items()])
    return got.withColumn("size_mb", size_mb(F.col("size"))).where("size_mb > 0").drop("block", "size")


def inventory(lines: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row by source with the first text of each `Key: text` (key to column)."""
    parts = F.split("value", ":", 2)
    rows = lines.withColumns({"k_": _strip(parts[0]), "t_": _strip(F.get(parts, F.lit(1)))})
    return rows.groupBy(*KEYS).agg(*[F.min_by("t_", F.when(F.col("k_") == k, F.col("pos"))).alias(c) for k, c in names.items()])


# Keys of disk and processor inventories
DISK_KEYS = {"Model Family": "family", "Device Model": "device_model", "Model Number": "model_number", "Serial Number": "serial", "Firmware Version": "firmware", "User Capacity": "capacity", "Rotation Rate": "rotation", "SMART overall-health self-assessment test result": "health"}
CPU_KEYS = {"Architecture": "architecture", "CPU(s)": "cpus", "Thread(s) per core": "threads_per_core", "Core(s) per socket": "cores_per_socket", "Socket(s)": "sockets", "NUMA node(s)": "numa_nodes", "Model name": "model"}


def disk_identity(lines: DataFrame) -> DataFrame:
    """Identity of disks; the specific model counts before the family, the capacity is the text in brackets."""
    got = inventory(lines, DISK_KEYS)
    return got.select(*KEYS, F.coalesce("device_model", "model_number", "family").alias("model"), "serial", "firmware", F.regexp_extract("capacity", r"\[([^\]]+)\]", 1).alias("capacity"), "rotation", (F.col("health") == "PASSED").alias("passed"))


def processor_layout(lines: DataFrame) -> DataFrame:
    got = inventory(lines, CPU_KEYS)
    ints = [F.col(c).try_cast("int").alias(c) for c in ("cpus", "threads_per_core", "cores_per_socket", "sockets", "numa_nodes")]
    return got.select(*KEYS, "architecture", "model", *ints)


def metric_points(rows: DataFrame, component: str, values: list[str], labels: dict[str, str], unit: str = "") -> DataFrame:
    """(batch, component, name, value, unit, labels) of wide rows; null values give no point."""
    one = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values]))
    lab = F.create_map(*[x for k, c in labels.items() for x in (F.lit(k), F.col(c).cast("string"))]) if labels else F.create_map().cast("map<string,string>")
    flat = rows.select("batch", lab.alias("labels"), one.alias("m"))
    return flat.where("m.value is not null").select("batch", F.lit(component).alias("component"), "m.name", "m.value", F.lit(unit).alias("unit"), "labels")
