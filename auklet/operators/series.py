"""Charts and expositions of metric points: stable series names, grouped charts, and the text format that scrapers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auklet.functions.scalars import natural_key

# Labels that name an instance, in order of preference
INSTANCE = ("npu_id", "interface", "device", "fan")
# Charts as (id, component, names, label that must be there, its value, mode)
CHARTS = [
    ("npu_aicore_freq", "npu", ["aicore_freq"], "npu_id", "", ""),
    ("npu_hbm_freq", "npu", ["hbm_freq"], "npu_id", "", ""),
    ("npu_power_draw", "npu", ["power_draw"], "npu_id", "", ""),
    ("npu_voltage", "npu", ["voltage"], "npu_id", "", ""),
    ("npu_npu_util", "npu", ["npu_util"], "npu_id", "", ""),
    ("npu_utilization", "npu", ["utilization"], "npu_id", "", ""),
    ("npu_vector_core_util", "npu", ["vector_core_util"], "npu_id", "", ""),
    ("npu_hbm_bandwidth_util", "npu", ["hbm_bandwidth_util"], "npu_id", "", ""),
    ("npu_memory_usage", "npu", ["memory_usage"], "npu_id", "", ""),
    ("cpu_utilization", "cpu", ["idle_util", "non_idle_util", "user_util", "system_util", "iowait_util", "irq_util", "steal_util"], "", "", ""),
    ("cpu_load", "cpu", ["load_average"], "", "", ""),
    ("cpu_power", "cpu", ["power"], "", "", ""),
    ("memory_pool", "memory", ["usage_detail"], "", "", ""),
    ("memory_swap", "memory", ["swap_detail"], "", "", ""),
    ("disk_throughput_read", "disk", ["throughput"], "direction", "read", ""),
    ("disk_throughput_write", "disk", ["throughput"], "direction", "write", ""),
    ("disk_iops_read", "disk", ["iops"], "direction", "read", ""),
    ("disk_iops_write", "disk", ["iops"], "direction", "write", ""),
    ("disk_read_latency", "disk", ["read_latency"], "device", "", ""),
    ("disk_write_latency", "disk", ["write_latency"], "device", "", ""),
    ("network_rx", "network", ["rx_bytes_total"], "interface", "", ""),
    ("network_tx", "network", ["tx_bytes_total"], "interface", "", ""),
    ("chassis_power", "chassis", ["power", "fan_power"], "", "", ""),
    ("chassis_temp", "chassis", ["inlet_temp", "outlet_temp"], "", "", ""),
    ("chassis_fan", "chassis", ["fan_speed"], "", "", "avg"),
]
# Efficiency metrics by component, whatever their labels
EFFICIENCY_NAMES = {
    "npu": [
        "aicpu_freq", "aicore_rated_freq", "aicore_freq", "ctrlcpu_freq", "vector_core_freq", "hbm_freq", "ddr_freq",
        "utilization", "memory_usage", "npu_util", "aicpu_util", "ctrlcpu_util", "vector_core_util", "hbm_bandwidth_util", "ddr_util", "ddr_bandwidth_util", "vdec_util", "vpc_util", "venc_util", "jpege_util", "jpegd_util",
        "temperature", "hbm_temp", "cluster_temp", "peri_temp", "aicore0_temp", "aicore1_temp", "ntc1_temp", "ntc2_temp", "ntc3_temp", "ntc4_temp", "soc_max_temp", "fp_max_temp", "ndie_temp", "hbm_max_temp",
        "power_draw", "voltage", "aicore_voltage", "hybrid_voltage", "cpu_voltage", "ddr_voltage", "acg_count", "fan_speed", "llc_write_hit_rate", "llc_read_hit_rate", "llc_throughput",
    ],
    "cpu": ["load_average", "power"],
    "disk": ["throughput", "read_latency", "write_latency", "iops"],
    "network": ["rx_bytes_total", "tx_bytes_total"],
    "chassis": ["power", "inlet_temp", "outlet_temp", "fan_speed", "fan_power"],
}
# Efficiency metrics as (component, name, label, values that the label must have)
EFFICIENCY = [
    *[(c, n, "", []) for c, names in EFFICIENCY_NAMES.items() for n in names],
    *[("cpu", f"{n}_time", "core", ["total"]) for n in ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")],
    ("memory", "usage_detail", "field", ["total", "free", "buffers", "cached", "sreclaimable"]),
    ("memory", "swap_detail", "field", ["total", "free"]),
]


def _instance() -> Column:
    return F.coalesce(*[F.col("labels")[k] for k in INSTANCE])


def series_id(labels: str = "labels") -> Column:
    """A name for the series that stays the same between batches: instance first, else field, interval or core; direction last."""
    one = lambda k: F.col(labels)[k]
    base = F.coalesce(
        F.concat(_instance(), F.lit(":"), F.col("name")),
        F.concat(F.col("name"), F.lit(":"), one("field")),
        F.concat(F.col("name"), F.lit(":"), one("interval")),
        F.concat(F.col("name"), F.lit(":cpu"), one("cpu")),
        F.col("name"),
    )
    return F.concat(base, F.coalesce(F.concat(F.lit(":"), one("direction")), F.lit("")))


def series_label(display: Column, short: Column) -> Column:
    """What a reader sees: the instance alone in charts that are about a label (`short`), else the display name with its labels."""
    one = lambda k: F.col("labels")[k]
    name = F.concat(display, F.coalesce(F.concat(F.lit(" "), one("direction")), F.lit("")))
    alone = F.coalesce(F.concat(F.lit("NPU "), one("npu_id")), _instance(), one("field"))
    tagged = F.coalesce(
        *[F.concat(name, F.lit(f" [{'NPU' if k == 'npu_id' else k} "), one(k), F.lit("]")) for k in INSTANCE],
        F.concat(display, F.lit(" ("), one("field"), F.lit(")")),
        F.concat(display, F.lit(" "), one("interval")),
        F.concat(name, F.lit(" [CPU "), one("cpu"), F.lit("]")),
        name,
    )
    return F.when(short & alone.isNotNull(), alone).otherwise(tagged)


def efficiency_specs(spark: SparkSession) -> DataFrame:
    """EFFICIENCY as specs."""
    return spark.createDataFrame(EFFICIENCY, "component string, name string, label string, allowed array<string>")


def efficiency(points: DataFrame, specs: DataFrame) -> DataFrame:
    """Points of the specs (component, name, label, allowed): an empty label takes any, otherwise the label's value must be allowed."""
    rows = points.join(F.broadcast(specs), ["component", "name"])
    ok = (F.coalesce("label", F.lit("")) == "") | F.array_contains("allowed", F.element_at("labels", F.col("label")))
    return rows.where(F.coalesce(ok, F.lit(False))).select(*[points[c] for c in points.columns])


def chart_series(points: DataFrame, batch: list[str], charts: list[tuple] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """(batch, chart, id, label, value, unit, place) of each series in each chart; place sorts digits by value.

    points are (batch, component, name, value, unit, labels, ord). A chart in mode `avg` has one series, the mean.
    """
    spark = points.sparkSession
    charts = charts or CHARTS
    flat = [(c, comp, n, key, val, mode) for c, comp, ns, key, val, mode in charts for n in ns]
    table = F.broadcast(spark.createDataFrame(flat, "chart string, component string, name string, key string, wanted string, mode string"))
    rows = points.join(table, ["component", "name"])
    rows = rows.where((F.col("key") == "") | (F.col("wanted") == "") | (F.element_at("labels", F.col("key")) == F.col("wanted")))
    display = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.concat_ws(":", "component", "name")), F.col("name")) if names else F.col("name")
    each = rows.where("mode <> 'avg'").select(*batch, "chart", series_id().alias("id"), series_label(display, F.col("key") != "").alias("label"), "value", "unit", natural_key(series_id()).alias("place"))
    mean = rows.where("mode = 'avg'").groupBy(*batch, "chart").agg(F.avg("value").alias("value"), F.max_by("unit", "ord").alias("unit"))
    name = F.concat(F.col("chart"), F.lit("_avg"))
    return each.unionByName(mean.select(*batch, "chart", name.alias("id"), F.lit("average").alias("label"), "value", "unit", name.alias("place")))


def charts(series: DataFrame, batch: list[str]) -> DataFrame:
    """(batch, chart, unit, series): the unit if all series share it, else empty; series in natural order. One batch's series of a chart are few."""
    got = series.groupBy(*batch, "chart").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi"), F.sort_array(F.collect_list(F.struct("place", "id", "label", "value", "unit"))).alias("s"))
    items = F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["value"].alias("value"), x["unit"].alias("unit")))
    return got.select(*batch, "chart", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("unit"), items.alias("series"))


def exposition_name(prefix: str = "node") -> Column:
    return F.translate(F.concat_ws("_", F.lit(prefix), "component", "name"), "-/.", "___")


def plain_number(v: Column) -> Column:
    """The shortest decimal that reads back as the same double, without an exponent."""
    text = F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf")
    whole = F.when((v == F.floor(v)) & (F.abs(v) < 1e15), v.cast("bigint").cast("string"))
    digits = v.cast("string")
    mantissa, power = F.regexp_extract(digits, r"^-?([\d.]+)E?", 1), F.regexp_extract(digits, r"E(-?\d+)$", 1).try_cast("int")
    figures = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"\.", "")
    small = F.concat(F.when(v < 0, "-").otherwise(""), F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
    rest = figures.substr(power + 2, F.length(figures))
    large = F.concat(F.when(v < 0, "-").otherwise(""), F.rpad(figures, power + 1, "0"), F.when(F.length(rest) > 0, F.concat(F.lit("."), rest)).otherwise(""))
    return F.coalesce(text, whole, F.when(power.isNull(), digits).when(power < 0, small).otherwise(large))


def label_text() -> Column:
    """{a="x",b="y"} with sorted names and quoted values; empty without labels."""
    quoted = lambda v: F.concat(F.lit('"'), F.regexp_replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), "\n", r"\\n"), F.lit('"'))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"])))
    return F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")


def exposition(points: DataFrame, prefix: str = "node") -> DataFrame:
    """(series, kind, rank, line): HELP and TYPE once for each name, then its samples in order; names that end in _time or _total are counters.

    Sorted by (first, rank, ord) the lines are a scrape; `first` is the name's first ord.
    """
    series = exposition_name(prefix)
    rows = points.withColumn("series", series)
    heads = rows.groupBy("series").agg(F.min("ord").alias("first"), F.min_by("component", "ord").alias("component"), F.min_by("name", "ord").alias("name"))
    counter = F.col("name").endswith("_time") | F.col("name").endswith("_total")
    lines = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit("# HELP "), "series", F.lit(" "), "component", F.lit("/"), "name").alias("line")),
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit("# TYPE "), "series", F.lit(" "), F.when(counter, "counter").otherwise("gauge")).alias("line")),
    )
    head = heads.select("series", "first", F.explode(lines).alias("l")).select("series", "first", "l.rank", F.col("first").alias("ord"), "l.line")
    body = rows.join(heads.select("series", "first"), "series").select("series", "first", F.lit(2).alias("rank"), "ord", F.concat("series", label_text(), F.lit(" "), plain_number(F.col("value"))).alias("line"))
    return head.unionByName(body)
