"""Queries of the parsers, reports and remaining scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auklet.functions import scalars as X
from auklet.operators import catalog as C
from auklet.operators import gauges as G
from auklet.operators import windows as W
from auklet.plans import views as V
from auklet.plans.kpi_queries import rounded
from auklet.sinks import push, reports
from auklet.sources import kpi_files as K
from auklet.sources import probes

WORDS = {"errors": "error|fail", "warnings": "warn"}


def lines(s, d):
    """Each document's lines as a probe's text."""
    docs = V.table(s, d, "documents").where("text is not null")
    return docs.select(F.col("source").alias("batch"), F.col("doc_id").alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "value"))


def stat_lines(s, d):
    """Processor lines made of line items."""
    rows = V.table(s, d, "lineitem")
    cells = [F.floor(c).cast("bigint").cast("string") for c in ("l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")]
    text = F.concat_ws(" ", F.concat(F.lit("cpu"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber").cast("string")).otherwise("")), *cells)
    return rows.select(F.col("l_orderkey").alias("batch"), F.lit("stat").alias("source"), F.col("l_linenumber").alias("pos"), text.alias("value"))


def figures(s, d):
    """Mean price of suppliers as a metric of ranks."""
    rows = V.table(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("rank")).agg(F.floor(F.sum("l_extendedprice")).cast("bigint").alias("value"))
    return rows.select("rank", F.lit("took").alias("metric"), "value")


MEMORY = ["MemTotal", "MemAvailable", "MemFree", "Cached", "SwapTotal", "SwapFree", "Buffers"]
COMMANDS = {"scale_down": {"ranks": ("int", True), "timeout": ("double", False)}, "retry": {"timeout": ("double", True)}}


def memory_info(s, d):
    """Memory keys of orders; some lack one that usage needs."""
    key = F.element_at(F.array(*[F.lit(k) for k in MEMORY]), F.col("l_linenumber"))
    return V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("batch"), key.alias("key"), (F.floor("l_extendedprice").cast("bigint") * F.when(F.col("l_linenumber").isin(1, 5), 10).otherwise(1)).alias("kb"))


def labelled(df, *keys):
    return df.select(*keys, "name", F.round("value", 6).alias("value"), F.array_join(F.array_sort(F.map_values("labels")), ",").alias("label"))


def commands(s, d):
    e = V.table(s, d, "events")
    params = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("ranks"), F.lit("4"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("ranks"), F.lit("x"), F.lit("timeout"), F.lit("1.5"))).otherwise(F.create_map(F.lit("timeout"), F.lit("2")))
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "scale_down").otherwise(F.when(F.col("event_id") % 5 == 0, "jump").otherwise("retry")).alias("instruction"), params.alias("params"))


def kpi_text(s, d):
    """A line of a KPI file for each event, with its props as a card's fields; every 11th is cut off, every 13th has another type, every 17th is blank."""
    e, k = V.table(s, d, "events"), F.col("event_id")
    whole = F.concat(F.lit('{"ts": '), V.seconds(F.col("ts")).cast("string"), F.lit(', "vals": {"'), (F.col("user_id") % 8).cast("string"), F.lit('": '), F.col("props"), F.lit(', "x": {"k": 1}}, "more": [1]}'))
    value = F.when(k % 17 == 0, "  ").when(k % 11 == 0, F.substring(whole, 1, 30)).when(k % 13 == 0, F.lit('{"ts": "late", "vals": 7}')).otherwise(whole)
    return K.parsed_lines(e.select(F.concat(F.lit("day"), (k % 5).cast("string")).alias("file"), value.alias("value")))


def watchers(s, d):
    """A subscription of each customer, and later changes of some."""
    c = V.table(s, d, "customer")
    text = F.col("c_custkey").cast("string")
    part = F.when(F.col("c_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("gpu"), F.lit("cpu")))
    base = c.select(text.alias("id"), part.alias("components"), F.when(F.col("c_nationkey") % 4 == 0, "").when(F.col("c_nationkey") % 4 == 1, F.lit(None)).otherwise("critical").alias("min_severity"), F.when(F.col("c_nationkey") % 5 != 0, F.col("c_nationkey").cast("long")).alias("debounce_s"))
    o = V.table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    changes = o.where("n > 11").select(F.col("o_custkey").cast("string").alias("id"), F.array(F.lit("npu"), F.lit("disk")).alias("components"), F.lit("info").alias("min_severity"), F.col("n").alias("debounce_s"), (F.col("n") % 2 == 0).alias("removed"))
    return C.subscription_defaults(C.upserted(base, changes, "id"), debounce_s=30, min_severity="warning")


QUERIES = {
    "s1_parsed_samples": lambda s, d: K.long_kpi(kpi_text(s, d).where("bad is null").withColumn("ts", F.col("ts"))).groupBy("ts_s", "card", "metric", "value").agg(F.count("*").alias("n")),
    "s1_malformed_lines": lambda s, d: kpi_text(s, d).groupBy("file").agg(F.count_if(F.col("bad").isNotNull()).alias("malformed"), F.count_if(F.col("bad").isNull()).alias("samples")),
    "m10_subscription_table": lambda s, d: watchers(s, d).select("id", F.array_join("components", ",").alias("components"), "min_severity", "debounce_s"),
    "x18_ids_of_events": lambda s, d: push.with_event_ids(V.table(s, d, "events").select("user_id", "event_type", F.col("event_id").alias("seq")), ["user_id", "event_type"]).select("seq", "event_id"),
    "w19_stages_of_hosts": lambda s, d: V.table(s, d, "supplier").select(F.col("s_suppkey").alias("rank"), "s_nationkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).alias("k"), F.count("*").over(Window.partitionBy("s_nationkey")).alias("n")).select("rank", W.chunks(F.col("k"), F.col("n"), 4).alias("stage")),
    "x15_memory_points": lambda s, d: labelled(G.memory(memory_info(s, d), ["batch"]), "batch"),
    "m4_disk_space": lambda s, d: labelled(G.disk_space(V.table(s, d, "orders").select(F.col("o_orderkey").alias("batch"), F.lit("sda").alias("device"), F.lit("/").alias("mount"), F.lit("ext4").alias("fstype"), F.floor("o_totalprice").cast("bigint").alias("total"), (F.floor("o_totalprice") * (F.col("o_custkey") % 10) / 10).cast("bigint").alias("used"), F.col("o_custkey").alias("avail")), ["batch"]), "batch"),
    "m6_gpu_points": lambda s, d: labelled(G.gpus(V.table(s, d, "part").select(F.col("p_partkey").alias("batch"), (F.col("p_partkey") % 8).cast("string").alias("gpu"), (F.col("p_retailprice") / 7).alias("mem_used"), F.col("p_retailprice").alias("mem_total"), *[F.col("p_size").cast("double").alias(c) for c in ("utilization", "temperature", "power", "fan_speed", "ecc_errors", "clock")]), ["batch"]), "batch"),
    "a22_frequencies": lambda s, d: labelled(G.frequencies(V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("core"), F.floor("l_extendedprice").cast("bigint").alias("khz")), ["batch"]), "batch"),
    "x16_topology": lambda s, d: labelled(G.topology(V.table(s, d, "part").select(F.col("p_partkey").alias("batch"), (F.col("p_size") * 4).alias("cores"), F.lit(2).alias("sockets"), (F.col("p_size") * 2).alias("cores_per_socket"), (F.col("p_partkey") % 3).cast("int").alias("dies"), (F.col("p_partkey") % 4).cast("int").alias("nodes")), ["batch"]), "batch"),
    "x6_trend_text": lambda s, d: V.table(s, d, "events").select("event_id", G.trend_text(F.col("event_type"), (F.col("value") - 50) / F.pow(F.lit(10.0), F.col("event_id") % 8)).alias("text")),
    "e12_parameter_faults": lambda s, d: G.parameter_faults(commands(s, d), COMMANDS).select("id", F.array_join("faults", ";").alias("faults")),
    "w21_rolling_view": lambda s, d: G.rolling_view(W.history(V.states(s, d), ["npu"], ["batch"]), V.states(s, d).where("batch % 5 = 0 and event_type = 'error'"), "npu").select("npu", F.size("history").alias("n")),
    "a23_log_counts": lambda s, d: probes.log_counts(lines(s, d), WORDS, ["batch"]),
    "s6_cpu_times": lambda s, d: probes.cpu_times(stat_lines(s, d)).drop("source"),
    "s1_json_values": lambda s, d: V.table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].try_cast("double").alias("k")),
    "w19_stage_buckets": lambda s, d: V.table(s, d, "supplier").select(F.col("s_suppkey").alias("rank"), W.chunks(F.col("s_suppkey") + 1, F.lit(100), F.lit(7)).alias("stage")),
    "x7_duration_text": lambda s, d: V.table(s, d, "orders").select("o_orderkey", X.duration_text(F.pow(F.lit(10.0), F.col("o_orderkey") % 11).cast("bigint")).alias("text")),
    "x14_sizes": lambda s, d: V.table(s, d, "part").select("p_partkey", X.size_mb(F.concat(F.col("p_size").cast("string"), F.element_at(F.array(F.lit(" GB"), F.lit(" TB"), F.lit(" MB"), F.lit(" x")), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("mb")),
    "x16_core_ranges": lambda s, d: V.table(s, d, "nation").select("n_nationkey", F.array_join(X.expand_ranges(F.concat(F.lit("0-"), F.col("n_nationkey").cast("string"), F.lit(",99"))).cast("array<string>"), ",").alias("cpus")),
    "x18_event_ids": lambda s, d: push.with_event_ids(V.table(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"]).groupBy("event_id").agg(F.count("*").alias("n")),
    "k10_k11_metric_report": lambda s, d: reports.metric_report(figures(s, d), "took").select("place", "rank", "value", "text", F.length("bar").alias("bar")),
    "k11_spread": lambda s, d: rounded(reports.spread(figures(s, d))),
}

_LOW = "lower(value)"
_TEXT = "case when v >= 1000000000 then printf('%.2fs', v / 1e9) when v >= 1000000 then printf('%.2fms', v / 1e6) when v >= 1000 then printf('%.2fus', v / 1e3) else printf('%.2fns', v::double) end"
_USED = "(total - available)"
_KB = "(cast(floor(l_extendedprice) as bigint) * case when l_linenumber in (1, 5) then 10 else 1 end)"
_MEM = (
    "with m as (select l_orderkey as batch, "
    + ", ".join(f"max({_KB}) filter (l_linenumber = {k + 1}) as {c}" for k, c in enumerate(("total", "available", "free", "cached", "stotal", "sfree", "buffers")))
    + " from lineitem group by 1), u as (select *, total - available as used, stotal - sfree as sused from m) "
)
_PCT = "cast(trunc(case when {1} > 0 then 100.0 * {0} / {1} else 0.0 end * 100 + 0.5) as bigint) / 100.0"


def _union(base: str, rows: list[tuple[str, str, str]], where: str = "true") -> str:
    return " union all ".join(f"select batch, '{n}' as name, round(({v})::double, 6) as value, {lab} as label from {base} where {where} and ({v}) is not null" for n, v, lab in rows)


_GPU = [("memory_usage", _PCT.format("(p_retailprice / 7)", "p_retailprice"), "g"), ("memory_detail", "cast(trunc(p_retailprice / 7 * 100 + 0.5) as bigint) / 100.0", "g || ',used'"), ("memory_detail", "cast(trunc(p_retailprice * 100 + 0.5) as bigint) / 100.0", "g || ',total'")]
_GPU += [(n, "p_size", "g") for n in ("utilization", "temperature", "power_draw", "fan_speed", "ecc_errors", "clock_frequency")]
_KPI_TEXT = """e as (select *, event_id % 17 = 0 as blank, event_id % 11 = 0 or event_id % 13 = 0 as bad from events),
good as (select cast(floor(epoch(ts)) as bigint) as ts_s, cast(user_id % 8 as int) as card, cast(json_extract(props, '$.k') as double) as value from e where not blank and not bad)"""
SQL = {
    "s1_parsed_samples": f"with {_KPI_TEXT} select ts_s, card, 'k' as metric, value, count(*) as n from good group by all",
    "s1_malformed_lines": f"with {_KPI_TEXT} select 'day' || (event_id % 5) as file, count(*) filter (bad) as malformed, count(*) filter (not bad) as samples from e where not blank group by 1",
    "m10_subscription_table": """with o as (select o_custkey, count(*) as n from orders group by 1 having count(*) > 11)
select c_custkey::varchar as id, case when c_nationkey % 3 = 0 then 'npu' else 'gpu,cpu' end as components, case when c_nationkey % 4 < 2 then 'warning' else 'critical' end as min_severity, case when c_nationkey % 5 <> 0 then c_nationkey else 30 end::bigint as debounce_s
    from customer where c_custkey not in (select o_custkey from o)
union all select o_custkey::varchar, 'npu,disk', 'info', n from o where n % 2 <> 0""",
    "x18_ids_of_events": "select event_id as seq, substr(sha256(user_id || '|' || event_type), 1, 32) as event_id from events",
    "w19_stages_of_hosts": """with s as (select s_suppkey as rank, row_number() over (partition by s_nationkey order by s_suppkey) as k, count(*) over (partition by s_nationkey) as n from supplier)
select rank, cast((k - 1) // greatest(1, n // 4) as int) as stage from s""",
    "x15_memory_points": _MEM
    + _union("u", [("usage", _PCT.format("used", "total"), "''"), *[("usage_detail", f"{c} / 1024", f"'{c}'") for c in ("total", "used", "available", "free", "buffers", "cached")]], "total is not null and available is not null")
    + " union all "
    + _union("u", [("swap_usage", _PCT.format("sused", "stotal"), "''"), *[("swap_detail", f"{c} / 1024", f"'{n}'") for n, c in (("total", "stotal"), ("used", "sused"), ("free", "sfree"))]], "stotal is not null and sfree is not null"),
    "m4_disk_space": "with u as (select o_orderkey as batch, cast(floor(o_totalprice) as bigint) as total, cast(trunc(floor(o_totalprice) * (o_custkey % 10) / 10) as bigint) as used, o_custkey as avail from orders) "
    + _union("u", [("space_usage", _PCT.format("used", "total"), "'/,ext4,sda'"), *[("space_detail", f"{c} / 1048576", f"'/,{'available,' if c == 'avail' else ''}ext4,sda{'' if c == 'avail' else ',' + c}'") for c in ("total", "used", "avail")]]),
    "m6_gpu_points": "with u as (select p_partkey as batch, (p_partkey % 8)::varchar as g, p_retailprice, p_size from part) " + _union("u", _GPU),
    "a22_frequencies": "select l_orderkey as batch, 'frequency' as name, trunc(cast(floor(l_extendedprice) as bigint) / 1000.0 + 0.5)::double as value, l_linenumber::varchar as label from lineitem union all select l_orderkey, 'avg_freq', trunc(avg(cast(floor(l_extendedprice) as bigint)) / 1000.0 + 0.5)::double, '' from lineitem group by 1",
    "x16_topology": "with u as (select p_partkey as batch, p_size * 4 as cores, p_size * 2 as per, greatest(1, p_partkey % 3) as d, p_partkey % 4 as n from part) "
    + _union("u", [("numa_node_num", "n", "''"), ("core_num", "cores", "''"), ("cpu_num", "2", "''")])
    + " union all select batch, 'die_core_num', (per // d)::double, k::varchar from u, range(3) as t(k) where k < d union all select batch, 'numa_core_num', (cores // n)::double, k::varchar from u, range(4) as t(k) where k < n",
    "x6_trend_text": """with s as (select event_id, event_type, (value - 50) / pow(10, event_id % 8) as slope from events),
v as (select *, case when abs(slope * 86400) >= 0.1 then slope * 86400 when abs(slope * 3600) >= 0.1 then slope * 3600 else slope * 60 end as v, case when abs(slope * 86400) >= 0.1 then 'day' when abs(slope * 3600) >= 0.1 then 'hour' else 'minute' end as unit from s)
select event_id, event_type || case when v < 0 then ' falls by ' else ' rises by ' end || case when abs(v) < 0.01 then '~0' when abs(v) < 1 then printf('%.3f', abs(v)) when abs(v) < 100 then printf('%.2f', abs(v)) else printf('%.1f', abs(v)) end || ' per ' || unit as text from v""",
    "e12_parameter_faults": """select event_id as id, case when event_id % 2 = 0 then case event_id % 3 when 0 then '' else 'ranks' end when event_id % 5 = 0 then 'instruction'
    else case event_id % 3 when 0 then 'ranks;timeout' when 1 then 'ranks' else '' end end as faults from events""",
    "w21_rolling_view": f"with {V.STATES_SQL} select npu, cast(least(60, count(*)) as int) as n from states semi join (select npu from states where batch % 5 = 0 and event_type = 'error') as x using (npu) group by npu",
    "a23_log_counts": f"with l as (select source as batch, unnest(string_split(text, chr(10))) as value from documents where text is not null) select batch, count(*) filter (regexp_matches({_LOW}, 'error|fail')) as errors, count(*) filter (regexp_matches({_LOW}, 'warn')) as warnings from l group by 1",
    "s6_cpu_times": "select l_orderkey as batch, case when l_linenumber > 1 then l_linenumber::varchar else 'total' end as core, cast(floor(l_quantity) as bigint) as user, cast(floor(l_extendedprice) as bigint) as nice, l_partkey as system, l_suppkey as idle, 0::bigint as iowait, 0::bigint as irq, 0::bigint as softirq, 0::bigint as steal, 0::bigint as guest, 0::bigint as guest_nice from lineitem",
    "s1_json_values": "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events",
    "w19_stage_buckets": "select s_suppkey as rank, cast(s_suppkey // 14 as int) as stage from supplier",
    "x7_duration_text": f"select o_orderkey, {_TEXT} as text from (select o_orderkey, cast(pow(10, o_orderkey % 11) as bigint) as v from orders)",
    "x14_sizes": "select p_partkey, case p_partkey % 4 when 0 then p_size::bigint * 1024 when 1 then p_size::bigint * 1048576 when 2 then p_size::bigint end as mb from part",
    "x16_core_ranges": "select n_nationkey, array_to_string(list_concat(range(n_nationkey + 1), [99]), ',') as cpus from nation",
    "x18_event_ids": "select substr(sha256(user_id || '|' || event_type), 1, 32) as event_id, count(*) as n from events group by 1",
    "k10_k11_metric_report": f"""with m as (select l_suppkey as rank, cast(floor(sum(l_extendedprice)) as bigint) as v from lineitem group by 1),
p as (select *, row_number() over (order by v desc, rank) as hi, row_number() over (order by v, rank) as lo, max(v) over () as most from m)
select cast(row_number() over (order by v desc, rank) as int) as place, rank, v as value, {_TEXT} as text, cast(round(v / most * 40) as int) as bar from p where hi <= 30 or lo <= 5""",
    "k11_spread": "with m as (select l_suppkey, cast(floor(sum(l_extendedprice)) as bigint) as v from lineitem group by 1) select 'took' as metric, count(*) as n, min(v) as least, round(avg(v), 6) as mean, quantile_cont(v, 0.5)::double as median, max(v) as most from m",
}
