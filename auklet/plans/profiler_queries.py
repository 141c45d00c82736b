"""Queries of the profiler operators: line items stand for device operators, orders for host calls, 16 ranks in three domains."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from auklet.operators import profiler as P
from auklet.plans import views as V
from auklet.plans.kpi_queries import rounded

RANKS = 16
#: A rank's own name of its group in each domain.
NAMES = {"tp": lambda r: f"g_tp_{r // 4}", "dp": lambda r: f"g_dp_{r % 4}", "pp": lambda r: f"g_pp_{r % 8}"}


def meta(spark):
    groups: dict[str, dict] = {}
    for d, name in NAMES.items():
        for r in range(RANKS):
            groups.setdefault(name(r), {"group_name": d, "global_ranks": []})["global_ranks"].append(r)
    return spark.createDataFrame([(r, "parallel_group_info", json.dumps(groups)) for r in range(RANKS)], "rank int, name string, value string")


def meta_of(s, d):
    """Every rank of the line items with the JSON of all groups, as each rank's database has it."""
    ranks = V.table(s, d, "lineitem").select((F.col("l_orderkey") % RANKS).cast("int").alias("rank")).distinct()
    name = {"tp": F.concat(F.lit("g_tp_"), F.floor(F.col("rank") / 4)), "dp": F.concat(F.lit("g_dp_"), F.col("rank") % 4), "pp": F.concat(F.lit("g_pp_"), F.col("rank") % 8)}
    rows = ranks.select("rank", F.explode(F.array(*[F.struct(F.lit(k).alias("domain"), v.cast("string").alias("name")) for k, v in name.items()])).alias("g"))
    each = rows.groupBy("g").agg(F.collect_list("rank").alias("ranks")).select("g.name", F.struct(F.col("g.domain").alias("group_name"), F.col("ranks").alias("global_ranks")).alias("group"))
    whole = each.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "group")))).alias("value"))  # one row, as large as the job's groups
    return ranks.join(F.broadcast(whole)).select("rank", F.lit("parallel_group_info").alias("name"), "value")


def strings(spark):
    rows = [(r, k, v) for r in range(RANKS) for k, v in [(1, P.KERNEL), (2, P.DATALOADER), (3, "Step 7"), (9, "OTHER"), *((10 + k, name(r)) for k, name in enumerate(NAMES.values()))]]
    return spark.createDataFrame(rows, "rank int, id int, value string")


def _secs(c):
    return V.seconds(F.col(c))


def _whole(c):
    return F.floor(c).cast("bigint")


def comm(s, d):
    rows = V.table(s, d, "lineitem").withColumns({"start": _secs("l_shipdate"), "rank": (F.col("l_orderkey") % RANKS).cast("int")})
    return rows.select("rank", F.col("l_orderkey").alias("conn"), (10 + F.col("l_linenumber") % 4).alias("group_id"), "start", (F.col("start") + _whole("l_extendedprice")).alias("stop"), _whole("l_quantity").alias("cnt"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rowid"))


def host(s, d):
    rows = V.table(s, d, "orders").withColumns({"start": _secs("o_orderdate"), "rank": (F.col("o_orderkey") % RANKS).cast("int")})
    return rows.select("rank", F.col("o_orderkey").alias("conn"), "start", (F.col("start") + _whole("o_totalprice")).alias("stop"), F.col("o_orderkey").alias("rowid"))


def marks(s, d):
    rows = V.table(s, d, "orders").withColumns({"start": _secs("o_orderdate") + 10, "rank": (F.col("o_orderkey") % RANKS).cast("int")})
    urgent = F.col("o_orderpriority") == "1-URGENT"  # other marks have a name that nothing looks for, and no connection
    message = F.when(~urgent, 9).when((F.col("o_custkey") % 2 == 0) | (F.col("rank") >= 14), 2).otherwise(3)
    return rows.select("rank", message.alias("message"), F.when(urgent, F.col("o_orderkey")).otherwise(0).alias("conn"), "start", (F.col("start") + _whole(F.col("o_totalprice") / 2)).alias("stop"), F.col("o_orderkey").alias("rowid"))


def tasks(s, d):
    rows = V.table(s, d, "lineitem").withColumns({"start": _secs("l_shipdate") + 5, "rank": (F.col("l_orderkey") % RANKS).cast("int")})
    kind = F.when((F.col("l_returnflag") == "N") & (F.col("rank") != 5), 1).otherwise(9)
    return rows.select("rank", kind.alias("type_id"), F.col("l_orderkey").alias("conn"), "start", (F.col("start") + _whole(F.col("l_extendedprice") / 3)).alias("stop"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rowid"))


def steps(s, d):
    rows = V.table(s, d, "orders").where(f"o_orderstatus = 'F' and o_orderkey % {RANKS} < 10")
    return rows.groupBy((F.col("o_orderkey") % RANKS).cast("int").alias("rank"), F.col("o_custkey") % 3).agg(F.min(_secs("o_orderdate")).alias("start"), (F.max(_secs("o_orderdate")) + 100_000).alias("stop"))


def hosts(s, d):
    rows = V.table(s, d, "orders").where(f"o_orderkey % {RANKS} <> 3")
    return rows.select((F.col("o_orderkey") % RANKS).cast("int").alias("rank"), F.concat(F.lit("h"), (F.col("o_custkey") % 4).cast("string")).alias("host"), F.col("o_orderkey").alias("rowid"))


def ranges(s, d):
    return P.step_ranges(comm(s, d), steps(s, d), P.marker_steps(strings(s), marks(s, d), tasks(s, d)))


def metrics(s, d):
    return P.rank_metrics(comm(s, d), P.parallel_groups(meta(s)), strings(s), ranges(s, d), comm(s, d), host(s, d), marks(s, d), tasks(s, d))


def groups(s):
    return P.parallel_groups(meta(s))


def spread(s, d, high):
    """Days of a user's events, doubled with the user's number so that some stand apart, as members of 16 groups."""
    rows = V.table(s, d, "events").groupBy("user_id").agg(F.sum(F.floor("value")).alias("v"))
    rows = rows.select((F.col("user_id") % 16).alias("g"), F.col("user_id").alias("rank"), (F.col("v") * F.when(F.col("user_id") % 7 == 0, 4).otherwise(1) + 1000).alias("v"), F.lit(high).alias("high"))
    return rounded(P.apart(rows, ["g"], "rank", "v", "high", 1.3))


QUERIES = {
    "q1_u4_parallel_groups": lambda s, d: P.parallel_groups(meta_of(s, d)).select("domain", "name", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks")),
    "j5_groups_present": lambda s, d: P.groups_present(groups(s), comm(s, d).where("rank % 3 <> 0")).select("domain", "name", F.array_join(F.col("ranks").cast("array<string>"), ",").alias("ranks")),
    "q2_first_hosts": lambda s, d: P.first_hosts(hosts(s, d)),
    "q3_q4_dp2_step_ranges": ranges,
    "q6_q7_q8_named_events": lambda s, d: P.named(P.within(marks(s, d), ranges(s, d)), "message", strings(s), P.DATALOADER).select("rank", "conn", "start", "stop"),
    "q9_host_ops": lambda s, d: P.host_ops(host(s, d), marks(s, d)),
    "q10_kernel_connections": lambda s, d: P.named(P.within(tasks(s, d), ranges(s, d)), "type_id", strings(s), P.KERNEL).where("conn > 0").select("rank", "conn").distinct(),
    "j1_comm_with_hosts": lambda s, d: P.with_hosts(comm(s, d), P.host_ops(host(s, d), marks(s, d))).select("rank", "rowid", "h_start", "h_stop"),
    "dp1_rank_metrics": metrics,
    "k7_wide_metrics": lambda s, d: P.wide_metrics(metrics(s, d), ["tp", "dp"]),
    "dp3_largest_gap_high": lambda s, d: spread(s, d, True),
    "dp3_largest_gap_low": lambda s, d: spread(s, d, False),
    "dp8_findings": lambda s, d: rounded(P.findings(groups(s), metrics(s, d), hosts(s, d))),
}

_RANK = f"cast(o_orderkey % {RANKS} as int)"
_EPOCH = "cast(floor(epoch({})) as bigint)"
_TABLES = (
    f"ranks as (select distinct cast(l_orderkey % {RANKS} as int) as rank from lineitem)",
    f"strings as (select cast(r as int) as rank, unnest([1, 2, 3, 9, 10, 11, 12]) as id, unnest(['{P.KERNEL}', '{P.DATALOADER}', 'Step 7', 'OTHER', 'g_tp_' || (r // 4), 'g_dp_' || (r % 4), 'g_pp_' || (r % 8)]) as value from range({RANKS}) as t(r))",
    f"membership as (select cast(r as int) as rank, unnest(['tp', 'dp', 'pp']) as domain, unnest(['g_tp_' || (r // 4), 'g_dp_' || (r % 4), 'g_pp_' || (r % 8)]) as name from range({RANKS}) as t(r))",
    f"comm as (select cast(l_orderkey % {RANKS} as int) as rank, l_orderkey as conn, 10 + l_linenumber % 4 as group_id, {_EPOCH.format('l_shipdate')} as start, {_EPOCH.format('l_shipdate')} + cast(floor(l_extendedprice) as bigint) as stop, cast(floor(l_quantity) as bigint) as cnt, l_orderkey * 10 + l_linenumber as rowid from lineitem)",
    f"host as (select {_RANK} as rank, o_orderkey as conn, {_EPOCH.format('o_orderdate')} as start, {_EPOCH.format('o_orderdate')} + cast(floor(o_totalprice) as bigint) as stop, o_orderkey as rowid from orders)",
    f"marks as (select {_RANK} as rank, case when o_orderpriority <> '1-URGENT' then 9 when o_custkey % 2 = 0 or {_RANK} >= 14 then 2 else 3 end as message, case when o_orderpriority = '1-URGENT' then o_orderkey else 0 end as conn, {_EPOCH.format('o_orderdate')} + 10 as start, {_EPOCH.format('o_orderdate')} + 10 + cast(floor(o_totalprice / 2) as bigint) as stop, o_orderkey as rowid from orders)",
    f"tasks as (select cast(l_orderkey % {RANKS} as int) as rank, case when l_returnflag = 'N' and l_orderkey % {RANKS} <> 5 then 1 else 9 end as type_id, l_orderkey as conn, {_EPOCH.format('l_shipdate')} + 5 as start, {_EPOCH.format('l_shipdate')} + 5 + cast(floor(l_extendedprice / 3) as bigint) as stop, l_orderkey * 10 + l_linenumber as rowid from lineitem)",
    f"steps as (select {_RANK} as rank, min({_EPOCH.format('o_orderdate')}) as start, max({_EPOCH.format('o_orderdate')}) + 100000 as stop from orders where o_orderstatus = 'F' and o_orderkey % {RANKS} < 10 group by {_RANK})",
    f"hosts as (select {_RANK} as rank, arg_min('h' || (o_custkey % 4), o_orderkey) as host from orders where o_orderkey % {RANKS} <> 3 group by 1)",
    r"""marker as (select n.rank, min(t.start) as start, max(t.stop) as stop from strings as n
    join (select rank, message, arg_min(conn, rowid) as conn from marks group by 1, 2) as f on f.rank = n.rank and f.message = n.id
    join (select rank, conn, arg_min(start, (rowid, start, stop)) as start, arg_min(stop, (rowid, start, stop)) as stop from tasks group by 1, 2) as t on t.rank = n.rank and t.conn = f.conn
    where regexp_full_match(lower(value), 'step\s+\d+') group by 1)""",
    "ranges as (select ranks.rank, coalesce(steps.start, marker.start) as step_start, coalesce(steps.stop, marker.stop) as step_stop from ranks left join steps using (rank) left join marker using (rank))",
    "ops as (select rank, conn, 0 as source, start as h_start, stop as h_stop from host where conn > 0 union all select rank, conn, 1, start, stop from marks where conn > 0)",
    "paired as (select comm.*, h.h_start, h.h_stop from comm left join (select rank, conn, arg_max(h_start, source) as h_start, arg_max(h_stop, source) as h_stop from ops group by 1, 2) as h using (rank, conn))",
)


def _inside(name: str) -> str:
    return f"(select x.* from {name} as x join ranges using (rank) where (step_start is null or x.start >= step_start) and (step_stop is null or x.stop <= step_stop))"


_METRICS = (
    "ids as (select distinct m.rank, s.id as group_id, m.domain from membership as m join strings as s on s.rank = m.rank and s.value = m.name)",
    f"device as (select p.*, domain from {_inside('paired')} as p join ids using (rank, group_id))",
    f"kernels as (select * from {_inside('tasks')} where type_id = 1)",
    """durations as (select rank, h_stop - h_start as d from device where h_start > 0 and h_stop >= h_start
    union all select rank, h_stop - h_start from ops semi join (select rank, conn from kernels where conn > 0) as k using (rank, conn) where h_start > 0 and h_stop >= h_start)""",
    "reach as (select *, max(stop) over (partition by rank order by start, stop, rowid rows between unbounded preceding and 1 preceding) as before from device where start > 0 and stop >= start)",
    "busy as (select rank, cast(sum(greatest(0, stop - greatest(start, coalesce(before, start)))) as bigint) as duration from reach group by 1)",
    f"""wide as (select ranks.rank, step_stop - step_start as step, duration, (select cast(round(avg(d)) as bigint) from durations where durations.rank = ranks.rank) as host_mean,
    (select cast(round(avg(start - h_stop)) as bigint) from device where device.rank = ranks.rank and h_stop > 0 and start > h_stop) as bubble,
    (select cast(round(avg(stop - start)) as bigint) from kernels where kernels.rank = ranks.rank) as kernel,
    (select arg_min(stop - start, (start, rowid)) from {_inside("marks")} as m where m.rank = ranks.rank and message = 2) as loader from ranks left join ranges using (rank) left join busy using (rank))""",
    """sorted as (select rank, domain, stop - start as d, cnt, count(*) over (partition by rank, domain) as n, row_number() over (partition by rank, domain order by stop - start, rowid) as k from device where stop > start)""",
    "pairs as (select rank, domain, cast(round(avg(d)) as bigint) as d, cast(round(avg(cnt)) as bigint) as c from sorted where n <= 2 or k between 2 and n - 1 group by 1, 2)",
    """metrics as (
    select rank, 'StepDuration' as metric, step as value from wide union all select rank, 'ZP_Device', case when duration is not null and step is not null then greatest(0, step - duration) end from wide
    union all select rank, 'ZP_Duration', duration from wide union all select rank, 'ZP_Host', host_mean from wide union all select rank, 'ZP_Bubble', bubble from wide
    union all select rank, 'ZP_Kernel', coalesce(kernel, 0) from wide union all select rank, 'DataLoader', coalesce(loader, 0) from wide
    union all select rank, domain || '_Duration', d from pairs union all select rank, domain || '_Count', c from pairs)""",
)


def _gap(base: str, keys: str, threshold: float, prefix: str) -> str:
    """Common table expressions that end in {prefix}found: members of `base` (keys, rank, v, high) that stand apart."""
    same = lambda x: " and ".join(f"r.{k.strip()} = {x}.{k.strip()}" for k in keys.split(","))
    return f"""{prefix}cut as (
    select {keys}, any_value(high) as high, list_sort(list(v::double)) as seg, 0 as depth, min(v::double) as least, max(v::double) as most from {base} where v is not null group by {keys} having count(*) >= 2
    union all
    select {keys}, high, case when high then seg[cut + 1:] else seg[:cut] end, depth + 1, least, most from (
        select *, list_position(gaps, list_max(gaps)) as cut from (select *, list_transform(range(1, len(seg)), lambda i: seg[i + 1] - seg[i]) as gaps from {prefix}cut where len(seg) >= 2) as g) as c
    where 2 * list_max(gaps) >= list_sum(gaps) and list_avg(seg[:cut]) <> 0 and list_avg(seg[cut + 1:]) / list_avg(seg[:cut]) >= {threshold}),
{prefix}last as (select {keys}, max(depth) as depth from {prefix}cut group by {keys}),
{prefix}found as (select b.*, case when r.high then b.v / nullif(least, 0) else most / nullif(b.v, 0) end as score from {base} as b join {prefix}cut as r on {same("b")} join {prefix}last as l on {same("l")} and r.depth = l.depth
    where r.depth > 0 and case when r.high then b.v >= seg[1] else b.v <= seg[-1] end)"""


def _with(*parts: str, tail: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n" + tail


def _spread(high: str) -> str:
    base = f"base as (select user_id % 16 as g, user_id as rank, cast(sum(cast(floor(value) as bigint)) as bigint) * case when user_id % 7 = 0 then 4 else 1 end + 1000 as v, {high} as high from events group by user_id)"
    return _with(base, _gap("base", "g", 1.3, "x_"), tail="select g, rank, round(score, 6) as score from x_found")


_FINDINGS = (
    "present as (select m.* from membership as m semi join metrics using (rank))",
    """cal as (select name, p.rank, bool_and(coalesce(k.value > 0, false)) over (partition by name) as high, count(*) over (partition by name) as n, k.value as kv, z.value as zv
    from present as p left join (select * from metrics where metric = 'ZP_Kernel') as k using (rank) left join (select * from metrics where metric = 'ZP_Duration') as z using (rank) where domain = 'tp')""",
    "calv as (select name, rank, high, case when high then kv else zv end as v from cal where n >= 2 and case when high then kv else zv end <> 0)",
    _gap("calv", "name", 1.3, "c_"),
    """fastest0 as (select domain, name, arg_min(p.rank, (value, p.rank)) as rank, min(value) as v, true as high, (select string_agg(q.rank::varchar, ',' order by q.rank) from present as q where q.name = p.name) as members,
    (select list(q.rank order by q.rank) from present as q where q.name = p.name) as ids from present as p join metrics on metrics.rank = p.rank and metric = domain || '_Duration' where domain in ('tp', 'dp') and value is not null group by domain, name)""",
    """fastest as (select domain, rank, v, high, members, cast(floor((row_number() over (partition by domain order by ids) - 1) / greatest(1, count(*) over (partition by domain) // 2)) as bigint) as stage from fastest0)""",
    _gap("fastest", "domain, stage", 2.5, "m_"),
    """smooth as (select 1 as a, rank, true as high, case when host is null then value when n > 2 then (s - lo - hi) / (n - 2) else s / n end as v from (
    select m.rank, host, value::double as value, count(value) over w as n, sum(value) over w as s, min(value) over w as lo, max(value) over w as hi from metrics as m left join hosts using (rank) where metric = 'ZP_Host' and value is not null window w as (partition by host)) as h)""",
    _gap("smooth", "a", 1.3, "h_"),
)
_GROUPS = "select domain, name, string_agg(rank::varchar, ',' order by rank) as ranks from membership"

SQL = {
    "q1_u4_parallel_groups": _with(_TABLES[2], tail=f"{_GROUPS} group by 1, 2"),
    "j5_groups_present": _with(_TABLES[0], _TABLES[2], tail=f"{_GROUPS} semi join (select rank from ranks where rank % 3 <> 0) as r using (rank) group by 1, 2"),
    "q2_first_hosts": _with(_TABLES[8], tail="select * from hosts"),
    "q3_q4_dp2_step_ranges": _with(*_TABLES, tail="select * from ranges"),
    "q6_q7_q8_named_events": _with(*_TABLES, tail=f"select rank, conn, start, stop from {_inside('marks')} where message = 2"),
    "q9_host_ops": _with(*_TABLES, tail="select * from ops"),
    "q10_kernel_connections": _with(*_TABLES, tail=f"select distinct rank, conn from {_inside('tasks')} where type_id = 1 and conn > 0"),
    "j1_comm_with_hosts": _with(*_TABLES, tail="select rank, rowid, h_start, h_stop from paired"),
    "dp1_rank_metrics": _with(*_TABLES, *_METRICS, tail="select * from metrics"),
    "k7_wide_metrics": _with(
        *_TABLES,
        *_METRICS,
        tail="select rank, "
        + ", ".join(f"max(value) filter (metric = '{m}') as {m}" for m in ("StepDuration", "ZP_Device", "ZP_Duration", "ZP_Host", "ZP_Bubble", "ZP_Kernel", "DataLoader"))
        + ", "
        + ", ".join(f"coalesce(max(value) filter (metric = '{m}'), 0) as {m}" for m in ("dp_Duration", "dp_Count", "tp_Duration", "tp_Count"))
        + " from metrics group by rank",
    ),
    "dp3_largest_gap_high": _spread("true"),
    "dp3_largest_gap_low": _spread("false"),
    "dp8_findings": _with(
        *_TABLES,
        *_METRICS,
        *_FINDINGS,
        tail=f"""select 'bubble' as category, rank::varchar as key, null::varchar as domain, value::double as score from metrics where metric = 'ZP_Bubble' and value > 0 and value < {P.BUBBLE_LIMIT}
union all select 'cal', rank::varchar, null, round(score, 6) from c_found union all select 'comm', members, domain, round(score, 6) from m_found
union all select 'cpu', rank::varchar, null, round(score, 6) from h_found""",
    ),
}
