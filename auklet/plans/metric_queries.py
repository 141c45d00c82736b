"""Queries of the catalog, chart, exposition and placement operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from auklet.functions import scalars as X
from auklet.operators import catalog as C
from auklet.operators import placement as E
from auklet.operators import series as S
from auklet.plans import views as V
from auklet.plans.kpi_queries import rounded

#: A catalog of the view's points: priority and static flag by position.
CATALOG = [(c, n, ("High", "Medium", "Low")[k % 3], k % 5 == 0, ("%", "C", "")[k % 3], "3s") for k, (c, n) in enumerate(sorted({(c, n) for c, n, *_ in V.POINTS})) if k % 7]
SCOPE = [(c, n) for k, (c, n, *_) in enumerate(CATALOG) if k % 2]
FEATURES = [("cpu", 1.0), ("cpu", 3.0), ("npu", 2.0), ("disk", 5.0)]
DIRECTIONS = [("disk", "throughput", "direction", ["read"]), ("disk", "iops", "device", []), ("npu", "utilization", "", []), ("memory", "usage_detail", "field", ["total", "free"])]
_COLUMNS = "component string, name string, priority string, static boolean, unit string, interval string"


def catalog(s, rows=None):
    return s.createDataFrame(rows or CATALOG, _COLUMNS)


def part_catalog(s, d):
    """A catalog with an entry for each part."""
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % by + 1).cast("int"))
    return V.table(s, d, "part").select(F.col("p_brand").alias("component"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), pick(["High", "Medium", "Low"], 3).alias("priority"), (F.col("p_partkey") % 5 == 0).alias("static"), pick(["%", "C", "", "W"], 4).alias("unit"), F.lit("3s").alias("interval"))


def part_override(s, d):
    """What a site says otherwise about the parts of one kind of size, and entries of its own; empty fields say nothing."""
    own = F.col("p_partkey") % 16 == 0
    name = F.concat(F.when(own, "own").otherwise("m"), F.col("p_partkey").cast("string"))
    rows = V.table(s, d, "part").where("p_size > 20").select(F.col("p_brand").alias("component"), name.alias("name"), F.when(F.col("p_partkey") % 8 == 0, " ").otherwise("High").alias("priority"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 3 == 0).alias("static"), F.lit("").alias("unit"), F.when(F.col("p_partkey") % 12 == 0, "5s").otherwise("").alias("interval"))
    return rows


def part_scope(s, d):
    """What a feature wants: metrics of suppliers' parts."""
    return V.table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").cast("string").alias("component"), F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("name"))


def chart_points(s, d):
    """Points of charted metrics by day, with labels that vary."""
    kinds = [(k, c, n) for k, (c, n) in enumerate((c, n) for _, c, ns, *_ in S.CHARTS for n in ns)]
    e = V.table(s, d, "events").withColumn("k", F.col("event_id") % len(kinds))
    rows = e.join(F.broadcast(s.createDataFrame(kinds, "k long, component string, name string")), "k")
    u = F.col("user_id")
    lab = F.when(F.col("component") == "npu", F.create_map(F.lit("npu_id"), (u % 12).cast("string")))
    lab = lab.when(F.col("component") == "disk", F.create_map(F.lit("device"), F.concat(F.lit("sd"), (u % 3).cast("string")), F.lit("direction"), F.when(u % 2 == 0, "read").otherwise("write")))
    lab = lab.when(F.col("component") == "network", F.create_map(F.lit("interface"), F.concat(F.lit("eth"), (u % 3).cast("string"))))
    lab = lab.when(F.col("component") == "memory", F.create_map(F.lit("field"), F.element_at(F.array(F.lit("total"), F.lit("free"), F.lit('a"b')), (u % 3 + 1).cast("int"))))
    lab = lab.when(F.col("name") == "load_average", F.create_map(F.lit("interval"), F.element_at(F.array(F.lit("15m"), F.lit("5m"), F.lit("1m")), (u % 3 + 1).cast("int"))))
    lab = lab.otherwise(F.create_map(F.lit("cpu"), (u % 2).cast("string")))
    return rows.select(F.floor(V.seconds("ts") / 86400).cast("bigint").alias("batch"), "component", "name", F.round("value", 3).alias("value"), F.when(u % 5 == 0, "W").otherwise("V").alias("unit"), lab.alias("labels"), F.col("event_id").alias("ord"))


def placed(s, d):
    """Events as loads of the slots of four layers of 32 cards."""
    rows = V.table(s, d, "events").select(F.pmod(F.floor(F.col("event_id") / 256), F.lit(4)).alias("layer"), (F.col("event_id") % 256).alias("k"), "value")
    rows = rows.groupBy("layer", "k").agg(F.sum("value").alias("workload"))
    return rows.select("layer", F.floor(F.col("k") / 8).alias("card"), (F.col("k") % 8).alias("slot"), (F.col("k") * 5 % 128).alias("expert"), "workload")


def layer_cards(s, d):
    """(layer, card): every layer has all cards of the machine, also those without a load in it."""
    rows = placed(s, d)
    cards = rows.agg(F.collect_set("card").alias("cards"))  # one row, as large as the machine
    return rows.select("layer").distinct().join(F.broadcast(cards)).select("layer", F.explode("cards").alias("card"))


#: Experts and further replicas of the placement queries, and the cards that are lost.
EXPERTS, REDUNDANT, LOST = 128, 32, [0, 9]


def evened(s, d):
    """Every row of a placement after swaps, and whether what must hold does: the expert is on its card once, the layer has all its
    experts, the highest load isn't above the one before the swaps, and the slot's old expert is still in the layer."""
    before, rows = E.repaired(placed(s, d), LOST), E.repaired(placed(s, d), LOST, swaps=100, per_pair=2)
    peak = lambda df: E.card_loads(df, placed(s, d)).groupBy("layer").agg(F.max("load").alias("load"))
    peaks = peak(before).withColumnRenamed("load", "was").join(peak(rows), "layer").select("layer", (F.col("load") <= F.col("was") + 1e-6).alias("not_higher"))
    experts = rows.groupBy("layer").agg((F.countDistinct("expert") == EXPERTS).alias("complete"))
    once = rows.withColumn("once", F.count("*").over(Window.partitionBy("layer", "card", "expert")) == 1)
    return once.join(peaks, "layer").join(experts, "layer").select("layer", "card", "slot", "old", "once", "complete", "not_higher")


QUERIES = {
    "fsel_selected": lambda s, d: C.selected(V.points(s, d), catalog(s)).groupBy("component", "name").agg(F.count("*").alias("n")),
    "fsel_rows": lambda s, d: C.selected(V.points(s, d), catalog(s), s.createDataFrame(SCOPE, "component string, name string"), "medium").select("node", "component", "name", "value", "ord"),
    "fsel_scoped": lambda s, d: C.selected(V.points(s, d), catalog(s), s.createDataFrame(SCOPE, "component string, name string"), "high").groupBy("component", "name").agg(F.count("*").alias("n")),
    "fwant_groups": lambda s, d: C.wanted(catalog(s), V.points(s, d).select((F.col("node") % 4).alias("group"), "component", "name"), "high"),
    "fscope_u2_union": lambda s, d: C.scope_of(part_scope(s, d), part_catalog(s, d)),
    "fmerge_override": lambda s, d: C.merged(part_catalog(s, d), part_override(s, d)),
    "fint_intervals": lambda s, d: C.intervals(V.points(s, d), s.createDataFrame(FEATURES, "component string, seconds double"), 3.0),
    "m8_once_static": lambda s, d: C.once_static(V.points(s, d), catalog(s), ["node"], "ord").select("node", "component", "name", "ord"),
    "fstatic_latest": lambda s, d: C.latest_static(V.points(s, d), ["core_num", "smart_status"], "ord").select("node", "component", "name", "ord"),
    "fkpi_extract": lambda s, d: C.kpi_points(V.points(s, d).withColumn("ts_s", F.floor(F.col("ts_s") / 86400) * 86400).withColumn("labels", F.create_map(F.lit("npu_id"), (F.col("node") % 8).cast("string"))), {"temp": ["hbm_temp", "temperature"], "util": ["utilization", "npu_util"]}),
    "feff_efficiency": lambda s, d: S.efficiency(chart_points(s, d), s.createDataFrame(DIRECTIONS, "component string, name string, label string, allowed array<string>")).select("batch", "component", "name", "ord"),
    "de1_chart_series": lambda s, d: rounded(S.chart_series(chart_points(s, d), ["batch"])).groupBy("batch", "chart", "id", "label").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")),
    "a24_a25_charts": lambda s, d: S.charts(S.chart_series(chart_points(s, d), ["batch"]), ["batch"]).select("batch", "chart", "unit", F.size("series").alias("n")),
    "t4_natural_order": lambda s, d: S.chart_series(chart_points(s, d), ["batch"]).where("chart = 'npu_hbm_freq'").select("id", "place").distinct(),
    "k4_exposition": lambda s, d: S.exposition(chart_points(s, d)).select("series", "first", "rank", "ord", "line"),
    "x1_trunc_round": lambda s, d: V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.trunc_round(F.col("l_extendedprice") / 7, 2).alias("v"), X.trunc_round(-F.col("l_discount"), 1).alias("neg")),
    "x10_grades": lambda s, d: V.table(s, d, "events").select("event_id", X.grade(F.col("value") % 101).alias("grade")),
    "x12_rank_keys": lambda s, d: V.table(s, d, "lineitem").groupBy("l_orderkey").agg(X.rank_key(F.collect_set(F.col("l_suppkey"))).alias("key")),
    "e4_u3_excluded_ranks": lambda s, d: E.excluded_ranks(V.table(s, d, "supplier").where("s_nationkey = 3").select(F.col("s_suppkey").alias("dp")), 4),
    "e5_e6_w20_renumbered": lambda s, d: E.renumbered(V.table(s, d, "customer").select(F.col("c_custkey").alias("rank")), V.table(s, d, "customer").where("c_nationkey % 5 = 0").select(F.col("c_custkey").alias("rank"))),
    "e7_even_experts": lambda s, d: E.even_experts(V.table(s, d, "nation").select(F.col("n_nationkey").alias("card")), 130, 25),
    "e7_redundant_experts": lambda s, d: E.redundant_experts(V.table(s, d, "nation").select(F.col("n_nationkey").alias("card")), 130, 25, 50),
    "e7_log_to_phys": lambda s, d: E.physical_places(layer_cards(s, d), EXPERTS, REDUNDANT),
    "e6_elastic_tables": lambda s, d: E.elastic_tables(V.table(s, d, "customer").select(F.col("c_custkey").alias("rank"), F.when(F.col("c_nationkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")).alias("dp"))),
    "e6_domains": lambda s, d: E.domains(V.table(s, d, "customer").select(F.col("c_custkey").alias("rank"), F.col("c_nationkey").alias("dp")), V.table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("dp"))),
    "e7_replicas": lambda s, d: E.replicas(placed(s, d)).select("layer", "expert", F.array_join(F.col("places").cast("array<string>"), ",").alias("places")),
    "e8_repaired": lambda s, d: E.repaired(placed(s, d), LOST).groupBy("layer").agg(F.countDistinct("expert").alias("experts"), F.count("*").alias("slots")),
    "e8_swapped": evened,
}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_CATALOG = f"catalog as (select * from (values {_values(CATALOG)}) as t(component, name, priority, static, unit, interval))"
_SCOPE = f"scope as (select * from (values {_values(SCOPE)}) as t(component, name))"
_KINDS = [(k, c, n) for k, (c, n) in enumerate((c, n) for _, c, ns, *_ in S.CHARTS for n in ns)]
_POINTS = f"""
ckinds as (select * from (values {_values(_KINDS)}) as t(k, component, name)),
cpoints as (select cast(floor(epoch(ts)) as bigint) // 86400 as batch, component, name, round(value, 3) as value, case when user_id % 5 = 0 then 'W' else 'V' end as unit, event_id as ord,
    case when component = 'npu' then (user_id % 12)::varchar end as npu_id, case when component = 'disk' then 'sd' || (user_id % 3) end as device,
    case when component = 'disk' then case when user_id % 2 = 0 then 'read' else 'write' end end as direction, case when component = 'network' then 'eth' || (user_id % 3) end as interface,
    case when component = 'memory' then ['total', 'free', 'a"b'][user_id % 3 + 1] end as field, case when name = 'load_average' then ['15m', '5m', '1m'][user_id % 3 + 1] end as interval_,
    case when component in ('cpu', 'chassis') and name <> 'load_average' then (user_id % 2)::varchar end as cpu
    from events join ckinds on k = event_id % {len(_KINDS)}),
named as (select *, coalesce(coalesce(npu_id, interface, device) || ':' || name, name || ':' || field, name || ':' || interval_, name || ':cpu' || cpu, name) || coalesce(':' || direction, '') as id from cpoints)"""
_CHARTS = (
    f"charts as (select * from (values {_values([(c, comp, n, key, val, mode) for c, comp, ns, key, val, mode in S.CHARTS for n in ns])}) as t(chart, component, name, key, wanted, mode))",
    """drawn as (select named.*, chart, mode, case when key <> '' then coalesce('NPU ' || npu_id, interface, device, field)
        else coalesce(name || ' (' || field || ')', name || ' ' || interval_, name || ' [CPU ' || cpu || ']', name) end as label
    from named join charts using (component, name) where key = '' or wanted = '' or (key = 'direction' and direction = wanted))""",
    """series as (select batch, chart, id, label, value, unit from drawn where mode <> 'avg'
    union all select batch, chart, chart || '_avg', 'average', avg(value), arg_max(unit, ord) from drawn where mode = 'avg' group by batch, chart)""",
)
_PRIO = "case lower({}) when 'high' then 2 when 'medium' then 1 else 0 end"
_PARTS = "catalog as (select p_brand as component, 'm' || p_partkey as name, ['High', 'Medium', 'Low'][p_partkey % 3 + 1] as priority, p_partkey % 5 = 0 as static, ['%', 'C', '', 'W'][p_partkey % 4 + 1] as unit, '3s' as interval from part)"
_PLACED = """placed as (select event_id // 256 % 4 as layer, (event_id % 256) // 8 as card, event_id % 8 as slot, (event_id % 256) * 5 % 128 as expert, sum(value) as workload from events group by all)"""


def _with(*parts: str, tail: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + tail


SQL = {
    "fsel_selected": _with(V.POINTS_SQL, _CATALOG, tail=f"select p.component, p.name, count(*) as n from points as p left join catalog as c using (component, name) where c.priority is null or {_PRIO.format('c.priority')} >= 1 or c.static group by 1, 2"),
    "fsel_rows": _with(V.POINTS_SQL, _CATALOG, _SCOPE, tail=f"select p.node, p.component, p.name, p.value, p.ord from points as p semi join scope using (component, name) left join catalog as c using (component, name) where c.priority is null or {_PRIO.format('c.priority')} >= 1 or c.static"),
    "fsel_scoped": _with(V.POINTS_SQL, _CATALOG, _SCOPE, tail=f"select p.component, p.name, count(*) as n from points as p semi join scope using (component, name) left join catalog as c using (component, name) where c.priority is null or {_PRIO.format('c.priority')} >= 2 or c.static group by 1, 2"),
    "fwant_groups": _with(V.POINTS_SQL, _CATALOG, tail=f"select node % 4 as \"group\", bool_or(priority is null or {_PRIO.format('priority')} >= 2) as wanted from points left join catalog using (component, name) group by 1"),
    "fscope_u2_union": _with(_PARTS, tail="select l_suppkey::varchar as component, 'm' || l_partkey as name from lineitem where l_returnflag = 'R' union select component, name from catalog"),
    "fmerge_override": _with(
        _PARTS,
        """override as (select p_brand as component, case when p_partkey % 16 = 0 then 'own' else 'm' end || p_partkey as name, case when p_partkey % 8 = 0 then '' else 'High' end as priority,
    case when p_partkey % 7 <> 0 then p_partkey % 3 = 0 end as static, '' as unit, case when p_partkey % 12 = 0 then '5s' else '' end as interval from part where p_size > 20)""",
        tail="select component, name, " + ", ".join(f"coalesce(nullif(o.{c}, ''), c.{c}) as {c}" for c in ("priority", "unit", "interval")) + ", coalesce(c.static, false) or coalesce(o.static, false) as static from catalog as c full join override as o using (component, name)",
    ),
    "fint_intervals": _with(V.POINTS_SQL, tail=f"select component, coalesce(min(seconds), 3.0)::double as seconds from (select distinct component from points) as p left join (values {_values(FEATURES)}) as f(component, seconds) using (component) group by 1"),
    "m8_once_static": _with(V.POINTS_SQL, _CATALOG, tail="select node, component, name, ord from points anti join (select * from catalog where static) as c using (component, name) union all select node, component, name, min(ord) from points semi join (select * from catalog where static) as c using (component, name) group by 1, 2, 3"),
    "fstatic_latest": _with(V.POINTS_SQL, tail="select node, component, name, ord from points where name in ('core_num', 'smart_status') qualify ord = max(ord) over (partition by component)"),
    "fkpi_extract": _with(
        V.POINTS_SQL,
        "alias as (select * from (values ('hbm_temp', 'temp', 0), ('temperature', 'temp', 1), ('utilization', 'util', 0), ('npu_util', 'util', 1)) as t(name, metric, place))",
        tail="select ts_s // 86400 * 86400 as ts_s, cast(node % 8 as int) as card, metric, arg_min(value, (place, ord)) as value from points join alias using (name) where component = 'npu' group by 1, 2, 3",
    ),
    "feff_efficiency": _with(_POINTS, tail="select batch, component, name, ord from cpoints where (component = 'disk' and name = 'throughput' and direction = 'read') or (component = 'npu' and name = 'utilization') or (component = 'memory' and name = 'usage_detail' and field in ('total', 'free'))"),
    "de1_chart_series": _with(_POINTS, *_CHARTS, tail="select batch, chart, id, label, count(*) as n, round(sum(round(value, 6)), 3) as total from series group by 1, 2, 3, 4"),
    "a24_a25_charts": _with(_POINTS, *_CHARTS, tail="select batch, chart, case when min(unit) = max(unit) then min(unit) else '' end as unit, cast(count(*) as int) as n from series group by 1, 2"),
    "t4_natural_order": _with(_POINTS, *_CHARTS, tail="select distinct id, lpad(split_part(id, ':', 1), 20, '0') || ':hbm_freq' as place from series where chart = 'npu_hbm_freq'"),
    "k4_exposition": _with(
        _POINTS,
        """lined as (select *, 'node_' || component || '_' || name as series, case when npu_id is not null then '{npu_id="' || npu_id || '"}' when device is not null then '{device="' || device || '",direction="' || direction || '"}'
    when interface is not null then '{interface="' || interface || '"}' when field is not null then '{field="' || replace(field, '"', '\\"') || '"}' when interval_ is not null then '{interval="' || interval_ || '"}' else '{cpu="' || cpu || '"}' end as labels from cpoints)""",
        "heads as (select series, min(ord) as first, any_value(component) as component, any_value(name) as name from lined group by 1)",
        tail=r"""select series, first, 0 as rank, first as ord, '# HELP ' || series || ' ' || component || '/' || name as line from heads
union all select series, first, 1, first, '# TYPE ' || series || case when suffix(name, '_time') or suffix(name, '_total') then ' counter' else ' gauge' end from heads
union all select series, first, 2, ord, series || labels || ' ' || regexp_replace(value::varchar, '\.0$', '') from lined join heads using (series)""",
    ),
    "x1_trunc_round": "select l_orderkey, l_linenumber, cast(trunc(l_extendedprice / 7 * 100.0 + 0.5) as bigint) / 100.0::double as v, cast(trunc(-l_discount * 10.0 + 0.5) as bigint) / 10.0::double as neg from lineitem",
    "x10_grades": "select event_id, case when value % 101 >= 90 then 'Excellent' when value % 101 >= 75 then 'Good' when value % 101 >= 60 then 'Warning' else 'Critical' end as grade from events",
    "x12_rank_keys": "select l_orderkey, array_to_string(list_sort(list(distinct l_suppkey)), ',') as key from lineitem group by 1",
    "e4_u3_excluded_ranks": "select distinct s_suppkey * 4 + k as rank from supplier, range(4) as t(k) where s_nationkey = 3",
    "e5_e6_w20_renumbered": "select c_custkey as rank, case when c_nationkey % 5 = 0 then -1 else cast(sum(case when c_nationkey % 5 = 0 then 0 else 1 end) over (order by c_custkey rows unbounded preceding) as bigint) - 1 end as new_rank from customer",
    "e7_even_experts": "select n_nationkey as card, cast(n_nationkey * 5 + least(n_nationkey, 5) + k as int) as expert from nation, range(6) as t(k) where k < 5 + case when n_nationkey < 5 then 1 else 0 end",
    "e7_redundant_experts": "select n_nationkey as card, cast(n_nationkey * 5 + k as int) as expert from nation, range(2) as t(k)",
    # one further replica of each card's first expert, and an even number of cards: neighbours take each other's
    "e7_log_to_phys": _with(_PLACED, "cards as (select layer, card from (select distinct layer from placed), (select distinct card from placed))", tail="""select layer, cast(4 * card + k as int) as expert, cast(5 * card + k as int) as phys, cast(card as int) as card from cards, range(4) as u(k)
    union all select layer, cast(4 * xor(card, 1) as int), cast(5 * card + 4 as int), cast(card as int) from cards"""),
    "e6_elastic_tables": """with ranks as (select c_custkey as rank, c_nationkey % 5 = 0 as gone from customer),
numbered as (select rank, row_number() over (order by rank) - 1 as place, case when gone then -1 else row_number() over (partition by gone order by rank) - 1 end as local from ranks)
select a.place, a.rank, a.local, coalesce(b.rank, -1) as back from numbered as a left join numbered as b on b.local = a.place""",
    "e6_domains": """with stay as (select n_nationkey as dp, row_number() over (order by n_nationkey) - 1 as k from nation where n_regionkey <> 2 and n_nationkey in (select c_nationkey from customer))
select c_custkey as rank, c_nationkey as old_dp, coalesce(k, -1) as dp from customer left join stay on dp = c_nationkey""",
    "e7_replicas": _with(_PLACED, tail="select layer, expert, string_agg((card * 8 + slot)::varchar, ',' order by card * 8 + slot) as places from placed group by 1, 2"),
    "e8_repaired": _with(_PLACED, tail="select layer, count(distinct expert) as experts, count(*) filter (card not in (0, 9)) as slots from placed group by 1"),
    "e8_swapped": _with(_PLACED, tail="select layer, card, slot, expert as old, true as once, true as complete, true as not_higher from placed where card not in (0, 9)"),
}
