"""The domain's relations as views of the generic tables, in DataFrame form and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What stands for which metric in the event table.
EVENT_METRICS = {"view": "aicore_util", "click": "temp", "purchase": "power", "signup": "hbm_util", "error": "roce_tx_err_pkt"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def seconds(ts):
    return F.unix_seconds(ts)


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts_s, card, metric, value, ord): gauges as they are, errors as a counter that runs up by card."""
    e = table(spark, sf_dir, "events")
    metric = F.element_at(F.create_map(*[F.lit(x) for kv in EVENT_METRICS.items() for x in kv]), F.col("event_type"))
    e = e.select(seconds("ts").alias("ts_s"), (F.col("user_id") % 8).cast("int").alias("card"), metric.alias("metric"), "value", F.col("event_id").alias("ord"))
    run = F.sum(F.floor(F.col("value") * 100).cast("bigint")).over(Window.partitionBy("card", "metric").orderBy("ts_s", "ord"))
    return e.withColumn("value", F.when(F.col("metric") == "roce_tx_err_pkt", run.cast("double")).otherwise(F.col("value")))


KPI_SQL = """
kpi0 as (select cast(floor(epoch(ts)) as bigint) as ts_s, cast(user_id % 8 as int) as card, case event_type when 'view' then 'aicore_util'
    when 'click' then 'temp' when 'purchase' then 'power' when 'signup' then 'hbm_util' else 'roce_tx_err_pkt' end as metric, value, event_id as ord from events),
kpi as (select ts_s, card, metric, ord, case when metric = 'roce_tx_err_pkt' then cast(sum(cast(floor(value * 100) as bigint))
    over (partition by card, metric order by ts_s, ord rows unbounded preceding) as double) else value end as value from kpi0)"""


#: What goes wrong with a card in the last days, by its number modulo the length: from nothing to what each rule of root causes looks for.
PROFILES = [
    (), ("temp", "aicore_freq"), ("temp", "power"), ("aicore_freq",), ("power", "aicore_util", "hbm_util"), ("aicore_util",), ("hbm_util",), ("temp",), ("power",), ("aicore_util", "hbm_util"),
    ("roce_tx_err_pkt",), ("rx_pfc_pkt",), ("roce_out_of_order", "roce_new_pkt_rty"), ("tx_bandwidth",), ("roce_out_of_order",), ("temp", "rx_pfc_pkt"),
]
ALL_METRICS = ["temp", "power", "aicore_freq", "aicore_util", "hbm_util", "tx_bandwidth", "rx_pfc_pkt", "roce_tx_err_pkt", "roce_out_of_order", "roce_new_pkt_rty"]
_AILING = [(p, m) for p, metrics in enumerate(PROFILES) for m in metrics]


def kpi_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts_s, card, metric, value, ord): samples of all ten metrics of 48 cards over 30 days, each line item one; in the last eight days cards ail as PROFILES says."""
    metrics = F.array(*[F.lit(m) for m in ALL_METRICS])
    e = table(spark, sf_dir, "lineitem").withColumn("ord", F.col("l_orderkey") * 7 + F.col("l_linenumber")).withColumn("cell", F.col("ord") * 7919 % 14_400)
    e = e.withColumns({"metric": F.element_at(metrics, (F.col("cell") % 10 + 1).cast("int")), "card": (F.floor(F.col("cell") / 10) % 48).cast("int"), "day": F.floor(F.col("cell") / 480), "second": F.col("ord") * 37 % 86_400})
    ailing = spark.createDataFrame(_AILING, "profile int, metric string").withColumn("ails_", F.lit(True))  # a fixed list
    e = e.withColumn("profile", F.col("card") % len(PROFILES)).join(F.broadcast(ailing), ["profile", "metric"], "left").withColumn("ails", F.coalesce("ails_", F.lit(False)) & (F.col("day") >= 22))
    gauge = 50 + F.col("l_quantity") / 25 + F.when(F.col("ails"), F.when(F.col("metric") == "aicore_freq", -30.0).otherwise(40.0)).otherwise(0.0)
    count = F.lit(1000.0) + F.when(F.col("ails"), F.col("second").cast("double")).otherwise(0.0)
    value = F.when(F.col("cell") % 10 >= 6, count).otherwise(gauge)
    return e.select((F.col("day") * 86_400 + F.col("second")).alias("ts_s"), "card", "metric", value.alias("value"), "ord")


KPI_ALL_SQL = f"""
cells as (select l_orderkey * 7 + l_linenumber as ord, (l_orderkey * 7 + l_linenumber) * 7919 % 14400 as cell, l_quantity from lineitem),
samples as (select ord, l_quantity, cell % 10 as k, {ALL_METRICS!r}[cell % 10 + 1] as metric, cast(cell // 10 % 48 as int) as card, cell // 480 as day, ord * 37 % 86400 as second from cells),
ailing as (select * from (values {", ".join(f"({p}, '{m}')" for p, m in _AILING)}) as t(profile, metric)),
judged as (select samples.*, ailing.metric is not null and day >= 22 as ails from samples left join ailing on ailing.profile = card % {len(PROFILES)} and ailing.metric = samples.metric),
kpi as (select day * 86400 + second as ts_s, card, metric, ord, case when k >= 6 then 1000.0 + case when ails then second else 0 end
    else 50 + l_quantity / 25 + case when not ails then 0.0 when metric = 'aicore_freq' then -30.0 else 40.0 end end::double as value from judged)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(npu, batch, active): each user's events in order; an error is an active fault."""
    e = table(spark, sf_dir, "events")
    batch = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("npu"), batch.alias("batch"), (F.col("event_type") == "error").alias("active"), seconds("ts").alias("ts_s"), "event_type", "event_id", "value")


STATES_SQL = """
states as (select user_id as npu, cast(row_number() over (partition by user_id order by ts, event_id) as int) as batch, event_type = 'error' as active,
    cast(floor(epoch(ts)) as bigint) as ts_s, event_type, event_id, value from events)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, start, stop, id): an interval for each event, as long as its value."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 16).cast("int").alias("rank"), seconds("ts").alias("start"), (seconds("ts") + F.floor(F.col("value") * 100).cast("bigint")).alias("stop"), F.col("event_id").alias("id"))


SPANS_SQL = """
spans as (select cast(user_id % 16 as int) as rank, cast(floor(epoch(ts)) as bigint) as start,
    cast(floor(epoch(ts)) as bigint) + cast(floor(value * 100) as bigint) as stop, event_id as id from events)"""


def rank_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, group_id, host, value): suppliers as ranks, eights of them as groups, nations as hosts, mean quantity as the metric."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_quantity"), 6).alias("value"))
    s = table(spark, sf_dir, "supplier").join(line, "s_suppkey")
    return s.select(F.col("s_suppkey").alias("rank"), F.floor((F.col("s_suppkey") - 1) / 8).cast("int").alias("group_id"), F.col("s_nationkey").alias("host"), "value")


RANKS_SQL = """
ranks as (select s_suppkey as rank, cast((s_suppkey - 1) // 8 as int) as group_id, s_nationkey as host, value from supplier
    join (select l_suppkey, round(avg(l_quantity), 6) as value from lineitem group by 1) on l_suppkey = s_suppkey)"""

#: Counters of a core: which event type runs up which.
FIELDS = {"user_": "view", "system_": "click", "idle_": "purchase", "iowait_": "signup", "irq_": "error"}


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(core, seq, ts_s, FIELDS): each user is a core, each event a sample of running sums by type."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.floor(F.col("value") * 100).cast("bigint")
    run = {f: F.sum(F.when(F.col("event_type") == t, step).otherwise(0)).over(w) for f, t in FIELDS.items()}
    return e.select(F.col("user_id").alias("core"), F.row_number().over(w).alias("seq"), seconds("ts").alias("ts_s"), *[c.alias(f) for f, c in run.items()])


COUNTERS_SQL = (
    "counters as (select user_id as core, cast(row_number() over w as int) as seq, cast(floor(epoch(ts)) as bigint) as ts_s, "
    + ", ".join(f"cast(sum(case when event_type = '{t}' then cast(floor(value * 100) as bigint) else 0 end) over w as bigint) as {f}" for f, t in FIELDS.items())
    + " from events window w as (partition by user_id order by ts, event_id rows unbounded preceding))"
)

#: Points of a node: component, name, label, its value, and what the event's value is taken modulo of.
POINTS = [
    ("cpu", "usage", "core", "total", 110), ("cpu", "usage", "core", "0", 110), ("cpu", "temperature", "sensor", "a", 100), ("cpu", "load_average", "interval", "1m", 20),
    ("cpu", "core_num", "", "", 9), ("cpu", "cpu_ce_errors", "socket", "0", 2), ("cpu", "cpu_uce_errors", "socket", "0", 2), ("memory", "usage", "", "", 110),
    ("memory", "swap_usage", "", "", 100), ("memory", "ecc_ce_errors", "mc", "0", 3), ("memory", "ecc_uce_errors", "mc", "0", 2), ("memory", "saturation", "interval", "avg10", 110),
    ("memory", "saturation", "interval", "avg60", 110), ("memory", "fragmentation", "zone", "n", 110), ("disk", "space_usage", "mount", "/", 105), ("disk", "io_wait", "", "", 40),
    ("disk", "smart_status", "device", "sda", 2), ("gpu", "temperature", "gpu", "0", 105), ("gpu", "memory_usage", "gpu", "0", 101), ("gpu", "utilization", "gpu", "0", 101),
    ("gpu", "ecc_errors", "gpu", "0", 2), ("npu", "temperature", "npu_id", "0", 95), ("npu", "hbm_temp", "npu_id", "1", 95), ("npu", "memory_usage", "npu_id", "0", 101),
    ("npu", "health_status", "npu_id", "0", 5), ("npu", "utilization", "npu_id", "0", 101), ("npu", "npu_util", "npu_id", "0", 101), ("npu", "hbm_double_ecc", "npu_id", "0", 2),
    ("npu", "ddr_double_ecc", "npu_id", "0", 2), ("npu", "hbm_single_ecc", "npu_id", "0", 2), ("npu", "ddr_single_ecc", "npu_id", "0", 2), ("npu", "error_code", "npu_id", "0", 2),
]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, component, name, value, labels, ord): metric points of nodes, some of which have no accelerators."""
    e = table(spark, sf_dir, "events")
    kinds = spark.createDataFrame([(k, *p) for k, p in enumerate(POINTS)], "k long, component string, name string, label string, label_value string, m int")
    rows = e.withColumn("k", F.col("event_id") % len(POINTS)).join(F.broadcast(kinds), "k")
    rows = rows.where("not (user_id % 3 = 0 and component in ('gpu', 'npu')) and not (user_id % 3 = 1 and component = 'gpu')")
    labels = F.when(F.col("label") != "", F.create_map("label", "label_value")).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select(F.col("user_id").alias("node"), "component", "name", (F.floor("value") % F.col("m")).cast("double").alias("value"), labels.alias("labels"), F.col("event_id").alias("ord"), seconds("ts").alias("ts_s"))


POINTS_SQL = (
    "kinds as (select * from (values "
    + ", ".join(f"({k}, '{c}', '{n}', '{a}', '{v}', {m})" for k, (c, n, a, v, m) in enumerate(POINTS))
    + f""") as t(k, component, name, label, label_value, m)),
points as (select user_id as node, component, name, cast(cast(floor(value) as bigint) % m as double) as value, label, label_value, event_id as ord, cast(floor(epoch(ts)) as bigint) as ts_s
    from events join kinds on k = event_id % {len(POINTS)} where not (user_id % 3 = 0 and component in ('gpu', 'npu')) and not (user_id % 3 = 1 and component = 'gpu'))"""
)

#: Probes of a device: name, label and the texts that it takes in turn.
PROBES = [("card_drop", "", ["-"]), ("health_status", "status", ["OK", "Warning", "Alarm", "Critical"]), ("error_code", "error_codes", ["", "0x1, 0x40F84E00", "0x2"]), ("hbm_double_ecc", "", ["-"]),
          ("ddr_double_ecc", "", ["-"]), ("roce_link_status", "status", ["up", "down", "up"]), ("roce_link_health", "roce_link", ["Up", "Down", "up", "up"]), ("driver_health", "", ["-"])]


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, npu, batch, name, value, labels, ord): device probes by day."""
    e = table(spark, sf_dir, "events")
    kinds = spark.createDataFrame([(k, *p) for k, p in enumerate(PROBES)], "k long, name string, label string, texts array<string>")
    rows = e.withColumn("k", F.col("event_id") % len(PROBES)).join(F.broadcast(kinds), "k")
    text = F.get("texts", (F.floor("value") % F.size("texts")).cast("int"))
    labels = F.when(F.col("label") != "", F.create_map("label", text)).otherwise(F.create_map().cast("map<string,string>"))
    value = F.when(F.col("name") == "card_drop", (F.floor("value") % 10 == 0).cast("double")).otherwise((F.floor("value") % 2).cast("double"))
    return rows.select((F.col("user_id") % 4).cast("int").alias("host"), (F.col("user_id") % 16).cast("int").alias("npu"), F.floor(seconds("ts") / 86400).cast("bigint").alias("batch"), "name", value.alias("value"), labels.alias("labels"), F.col("event_id").alias("ord"))


_TEXTS = "case k " + " ".join(f"when {k} then ({list(texts)!r})[1 + cast(floor(value) as bigint) % {len(texts)}]" for k, (_, _, texts) in enumerate(PROBES)) + " end"
PROBES_SQL = (
    "probe_kinds as (select * from (values " + ", ".join(f"({k}, '{n}', '{lab}')" for k, (n, lab, _) in enumerate(PROBES)) + f""") as t(k, name, label)),
probes as (select cast(user_id % 4 as int) as host, cast(user_id % 16 as int) as npu, cast(floor(epoch(ts)) as bigint) // 86400 as batch, name, label, {_TEXTS} as text,
    case when name = 'card_drop' then (cast(floor(value) as bigint) % 10 = 0)::int::double else (cast(floor(value) as bigint) % 2)::double end as value, event_id as ord
    from events join probe_kinds on k = event_id % {len(PROBES)})"""
)
