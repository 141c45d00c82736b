"""Queries of the window, fault and health operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from auklet.operators import faults as X
from auklet.operators import health as H
from auklet.operators import windows as W
from auklet.plans import views as V
from auklet.plans.kpi_queries import rounded

FIELDS = list(V.FIELDS)
SUBSCRIPTIONS = [
    ("sub-0001", [], [], [], "", 0),
    ("sub-0002", ["card_drop", "hbm_uce"], ["npu"], [], "critical", 3 * 86400),
    ("sub-0003", [], ["npu"], ["1", "2", "3"], "warning", 5 * 86400),
    ("sub-0004", ["npu_health"], ["gpu"], [], "", 0),
]


def fault_events(spark, sf):
    probes = V.probes(spark, sf)
    got = X.transitions(X.active_faults(probes, ["host", "npu", "batch"]), probes.select("host", "batch"), ["host"])
    return got.withColumns({"component": F.lit("npu"), "npu": F.col("npu").cast("string"), "ts": F.col("batch") * 86400})


def subscriptions(spark):
    return spark.createDataFrame(SUBSCRIPTIONS, "id string, types array<string>, components array<string>, npu_ids array<string>, min_severity string, debounce_s long")


def state_events(spark, sf):
    """Raise and recover rows of the event table's devices, with a type that varies."""
    rows = X.edges(V.states(spark, sf), ["npu"], "batch")
    kind = F.when(F.floor("value") % 3 == 0, "card_drop").when(F.floor("value") % 3 == 1, "hbm_uce").otherwise("roce_link_down")
    return rows.select("npu", "batch", kind.alias("type"), (~F.col("active")).alias("recovered"))


def reports(spark, sf):
    """Status reports of engines, which change from event to event."""
    s = F.element_at(F.array(F.lit("healthy"), F.lit("paused"), F.lit("dead"), F.lit("paused"), F.lit("paused")), ((F.col("user_id") + F.floor("value")) % 5 + 1).cast("int"))
    return V.table(spark, sf, "events").select(F.col("user_id").alias("engine"), s.alias("status"), "event_id")


def engines(spark, sf):
    return X.engine_table(reports(spark, sf), "engine", "event_id")


def rare_failures(spark, sf):
    """Reports that are unhealthy for large values only, so that all engines are healthy now and then."""
    status = F.when(F.col("value") > 280, F.element_at(F.array(F.lit("dead"), F.lit("paused")), (F.col("event_id") % 2 + 1).cast("int"))).otherwise("healthy")
    return V.table(spark, sf, "events").select(F.col("user_id").alias("engine"), status.alias("status"), "event_id")


def polls(spark, sf):
    """A poll a day of every host, of the users that have an event then."""
    return V.table(spark, sf, "events").select((F.col("user_id") % 2).cast("int").alias("host"), F.col("user_id").alias("series"), F.floor(V.seconds(F.col("ts")) / 86400).alias("poll"), (F.col("value") - 20).alias("value"))


def excluded(spark, sf):
    return V.table(spark, sf, "events").where("user_id % 5 = 0").select(F.col("user_id").alias("engine")).distinct()


QUERIES = {
    "w1_history_ring": lambda s, d: W.history(V.states(s, d), ["npu"], ["batch"], last=60).select("npu", F.size("history").alias("n"), F.array_join(F.transform("history", lambda v: F.round(v, 2).cast("decimal(12,2)")).cast("array<string>"), ",").alias("history")),
    "w2_w6_cpu_usage": lambda s, d: rounded(W.cpu_usage(V.counters(s, d), ["core"], ["seq"], FIELDS, "idle_")),
    "w3_cpu_shares": lambda s, d: rounded(W.cpu_shares(V.counters(s, d), ["core"], ["seq"], FIELDS)),
    "w4_clamped_delta": lambda s, d: W.clamped_delta(V.states(s, d).withColumn("value", F.floor("value").cast("bigint")), ["npu"], ["batch"]),
    "w5_rates": lambda s, d: rounded(W.rate(V.counters(s, d), ["core"], ["seq"], "ts_s", "user_")),
    "w5_fixed_rates": lambda s, d: rounded(W.rate(V.counters(s, d), ["core"], ["seq"], "ts_s", "user_", seconds=3)),
    "w7_error_delta": lambda s, d: W.error_delta(V.states(s, d).withColumn("value", F.floor("value").cast("bigint") % 4), ["npu"], ["batch"]),
    "w13_transitions": lambda s, d: X.edges(V.states(s, d), ["npu"], "batch").select("npu", "batch", "active"),
    "w14_debounce": lambda s, d: X.debounced(V.states(s, d).where("active").select("npu", "ts_s", "event_id", F.lit(2 * 86400).cast("long").alias("gap")), ["npu"], "ts_s", "gap", "event_id").select("npu", "event_id"),
    "w15_latest_active": lambda s, d: X.latest_active(state_events(s, d), "npu", "batch"),
    "w16_event_ring": lambda s, d: X.newest(V.table(s, d, "events").select("event_id", "event_type"), "event_id"),
    "w17_consumer_dedup": lambda s, d: X.not_repeated(state_events(s, d), "npu", "batch"),
    "w18_second_to_last": lambda s, d: W.second_to_last(V.states(s, d), ["npu"], ["batch"]).select("npu", "batch", "event_id"),
    "w22_axis_a26_stats": lambda s, d: rounded(W.axis(V.states(s, d), ["npu"])),
    "t3_top_and_bottom": lambda s, d: W.top_and_bottom(V.table(s, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie")), ["l_suppkey"], "l_extendedprice", "tie").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("place").cast("int").alias("place")),
    "k3_latest_batch": lambda s, d: W.latest(V.probes(s, d), ["host"], ["batch"]).select("host", "batch", "npu", "name", "value", "ord"),
    "df1_active_faults": lambda s, d: X.active_faults(V.probes(s, d), ["host", "npu", "batch"]),
    "df1_fault_events": lambda s, d: fault_events(s, d).drop("component"),
    "fsub_j9_subscriptions": lambda s, d: X.matched(fault_events(s, d), subscriptions(s)).select("npu", "type", "severity", "batch", "recovered", "subscription"),
    "fevt_event_query": lambda s, d: fault_events(s, d).where((F.col("batch") > 19730) & (F.col("type") == "npu_health") & F.col("npu").isin("1", "2")).select("npu", "severity", "batch", "recovered"),
    "e1_j10_actions": lambda s, d: X.actions(state_events(s, d), V.table(s, d, "supplier").select(F.col("s_suppkey").alias("npu"), F.col("s_nationkey").alias("dp_rank"))).select("npu", "batch", "dp_rank", "action"),
    "e9_engine_table": engines,
    "e9_pauses": lambda s, d: X.pauses(rare_failures(s, d), "engine", "event_id", 1000),
    "w21_unbroken_histories": lambda s, d: W.unbroken(polls(s, d), "host", "series", "poll", last=5).select("host", "series", F.array_join(F.transform("history", lambda v: F.round(v, 2).cast("decimal(12,2)")).cast("array<string>"), ",").alias("history")),
    "e2_e10_verdicts": lambda s, d: X.verdicts(engines(s, d), excluded(s, d), "engine"),
    "e3_not_yet_scaled": lambda s, d: engines(s, d).where("status = 'dead'").join(V.table(s, d, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("engine")), "engine", "left_anti").select("engine"),
    "e11_result_fold": lambda s, d: engines(s, d).agg(F.bool_and(F.col("status") != "dead").alias("success"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == "dead", F.concat_ws(":", F.col("engine").cast("string"), "status")))), ";").alias("reason")),
    "h1_h6_component_scores": lambda s, d: rounded(H.component_scores(V.points(s, d)).select("node", "component", "score", "max", F.size("deductions").alias("n"), F.array_join(F.array_sort(F.transform("deductions", lambda x: x["rule"])), ",").alias("rules"), F.aggregate("deductions", F.lit(0.0), lambda a, x: a + x["penalty"]).alias("penalty"))),
    "h7_health": lambda s, d: H.health(V.points(s, d)),
}


def _with(*parts: str, tail: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + ",".join(parts) + "\n" + tail


_TOTAL = " + ".join(FIELDS)
_KIND = "case cast(floor(value) as bigint) % 3 when 0 then 'card_drop' when 1 then 'hbm_uce' else 'roce_link_down' end"
_EDGES = f"""
edged as (select *, coalesce(lag(active) over (partition by npu order by batch), false) as was from states),
state_events as (select npu, batch, {_KIND} as type, not active as recovered from edged where active <> was)"""
_ACTIVE = """
state as (select host, npu, batch,
    arg_max(value, ord) filter (name = 'card_drop') as drop_, arg_max(value, ord) filter (name = 'error_code') as code, arg_max(value, ord) filter (name = 'hbm_double_ecc') as hbm,
    arg_max(value, ord) filter (name = 'ddr_double_ecc') as ddr, arg_max(value, ord) filter (name = 'roce_link_status') as link, arg_max(value, ord) filter (name = 'driver_health') as driver,
    arg_max(text, ord) filter (name = 'error_code') as codes, arg_max(text, ord) filter (name = 'health_status') as health,
    arg_max(text, ord) filter (name = 'roce_link_status') as link_text, arg_max(text, ord) filter (name = 'roce_link_health') as roce from probes group by 1, 2, 3),
active as (
    select host, npu, batch, 'card_drop' as type, 'critical' as severity from state where drop_ >= 1 or list_contains(list_transform(string_split(coalesce(codes, ''), ','), lambda c: lower(trim(c))), '0x40f84e00')
    union all select host, npu, batch, 'npu_health', case when health = 'Critical' then 'critical' else 'warning' end from state where health in ('Alarm', 'Critical')
    union all select host, npu, batch, 'error_code', 'warning' from state where code > 0
    union all select host, npu, batch, 'hbm_uce', 'critical' from state where hbm > 0
    union all select host, npu, batch, 'ddr_uce', 'critical' from state where ddr > 0
    union all select host, npu, batch, 'roce_link_down', 'warning' from state where link = 0 or link_text = 'down' or roce in ('down', 'Down')
    union all select host, npu, batch, 'driver_health', 'warning' from state where driver <> 0)"""
_EVENTS = """
steps as (select host, batch, lead(batch) over (partition by host order by batch) as nxt, lag(batch) over (partition by host order by batch) as prv from (select distinct host, batch from probes) as b),
seen as (select active.*, nxt, prv, lag(active.batch) over w as before, lead(active.batch) over w as after from active join steps using (host, batch) window w as (partition by host, npu, type order by active.batch)),
fault_events as (
    select host, npu::varchar as npu, type, severity, batch, false as recovered, batch * 86400 as ts from seen where prv is null or before is distinct from prv
    union all select host, npu::varchar, type, severity, nxt, true, nxt * 86400 from seen where nxt is not null and after is distinct from nxt)"""
_FAULTS = (V.PROBES_SQL, _ACTIVE, _EVENTS)
_ENGINES = "engines as (select user_id as engine, arg_max(['healthy', 'paused', 'dead', 'paused', 'paused'][(user_id + cast(floor(value) as bigint)) % 5 + 1], event_id) as status from events group by user_id)"
_PAUSES = """
reports as (select user_id as engine, event_id, case when value > 280 then 1 else 0 end as bad from events),
steps as (select engine, event_id, bad - coalesce(lag(bad) over (partition by engine order by event_id), 0) as step from reports),
counted as (select *, sum(step) over (order by event_id, engine rows unbounded preceding) as unhealthy from steps where step <> 0)"""
_POLLS = """
polls as (select cast(user_id % 2 as int) as host, user_id as series, cast(floor(epoch(ts)) as bigint) // 86400 as poll, max(value - 20) as value from events group by all),
numbered as (select host, poll, row_number() over (partition by host order by poll desc) as back from (select distinct host, poll from polls)),
runs as (select host, series, value, back, row_number() over (partition by host, series order by back) as k from polls join numbered using (host, poll)),
unbroken as (select *, row_number() over (partition by host, series order by back) as place from runs where k = back and value >= 0),
held as (select host, series, string_agg(round(value, 2)::decimal(12, 2)::varchar, ',' order by back desc) as history from unbroken where place <= 5 group by all)"""
_RANK = "case {} when 'critical' then 2 when 'warning' then 1 else 0 end"
_SUBS = (
    "subs as (select * from (values " + ", ".join(f"('{i}', {t!r}::varchar[], {c!r}::varchar[], {n!r}::varchar[], '{m}')" for i, t, c, n, m, _ in SUBSCRIPTIONS) + ") as t(id, types, components, npu_ids, min_severity))"
)


def _pick(component: str, name: str, label: str = "", of: str = "first") -> str:
    where = f"component = '{component}' and name = '{name}'" + (f" and label_value = '{label}'" if label else "")
    return {"first": f"arg_min(value, ord) filter ({where})", "worst": f"max(value) filter ({where})", "sum": f"coalesce(sum(value) filter ({where} and value > 0), 0)", "least": f"min(value) filter ({where})"}[of]


_FACTS = {
    "cpu_usage": _pick("cpu", "usage", "total"), "cpu_temp": _pick("cpu", "temperature", of="worst"), "cores": _pick("cpu", "core_num"), "load": _pick("cpu", "load_average", "1m"),
    "cpu_ce": _pick("cpu", "cpu_ce_errors", of="sum"), "cpu_uce": _pick("cpu", "cpu_uce_errors", of="sum"), "mem_usage": _pick("memory", "usage"), "swap": _pick("memory", "swap_usage"),
    "mem_ce": _pick("memory", "ecc_ce_errors", of="sum"), "mem_uce": _pick("memory", "ecc_uce_errors", of="sum"), "psi": _pick("memory", "saturation", "avg10"), "frag": _pick("memory", "fragmentation", of="worst"),
    "space": _pick("disk", "space_usage", of="worst"), "io_wait": _pick("disk", "io_wait"), "smart": _pick("disk", "smart_status", of="least"),
    **{f"gpu_{k}": _pick("gpu", n, of="worst") for k, n in (("temp", "temperature"), ("mem", "memory_usage"), ("util", "utilization"), ("ecc", "ecc_errors"))},
    "npu_temp": "max(value) filter (component = 'npu' and name in ('temperature', 'hbm_temp'))", "npu_util": "max(value) filter (component = 'npu' and name in ('utilization', 'npu_util'))",
    "npu_mem": _pick("npu", "memory_usage", of="worst"), "npu_health": _pick("npu", "health_status", of="worst"),
    **{f"npu_{n}": _pick("npu", n, of="worst") for n in ("hbm_double_ecc", "ddr_double_ecc", "hbm_single_ecc", "ddr_single_ecc", "error_code")},
}


def _health_sql() -> tuple[str, ...]:
    facts = "facts as (select node, " + ", ".join(f"{c} as {n}" for n, c in _FACTS.items()) + ", bool_or(component in ('gpu', 'npu')) as fast, " + ", ".join(f"bool_or(component = '{c}') as has_{c}" for c in H.PLAIN) + " from points group by node)"
    parts = []
    for c in H.PLAIN:
        most = f"(case when fast then {H.ACCELERATED[c]} else {H.PLAIN[c]} end)"
        for tiers in H.RULES[c]:
            cases = " ".join(f"when {cond} then {{}}" for cond, _, _ in tiers)
            rule, penalty = "case " + cases.format(*[f"'{r}'" for _, r, _ in tiers]) + " end", "case " + cases.format(*[f"{most} * {s}::double" for _, _, s in tiers]) + " end"
            parts.append(f"select node, '{c}' as component, {most} as max, {rule} as rule, ({penalty})::double as penalty from facts where has_{c}")
        for n, r, each in H.PER_ERROR.get(c, []):
            parts.append(f"select node, '{c}', {most}, case when {n} > 0 then '{r}' end, case when {n} > 0 then ({n} * {each})::double end from facts where has_{c}")
    taken = "taken as (" + " union all ".join(parts) + ")"
    scores = """scores as (select node, component, cast(trunc(greatest(0.0, max - coalesce(sum(penalty), 0.0))) as int) as score, max::int as max, cast(count(rule) as int) as n,
    coalesce(string_agg(rule, ',' order by rule), '') as rules, round(coalesce(sum(penalty), 0.0), 6) as penalty from taken group by node, component, max)"""
    return V.POINTS_SQL, facts, taken, scores


SQL = {
    "w1_history_ring": _with(
        V.STATES_SQL,
        "k as (select *, row_number() over (partition by npu order by batch desc) as k from states where value >= 0)",
        tail="select npu, cast(count(*) as int) as n, string_agg(cast(round(value, 2)::decimal(12,2) as varchar), ',' order by batch) as history from k where k <= 60 group by npu",
    ),
    "w2_w6_cpu_usage": _with(
        V.COUNTERS_SQL,
        f"d as (select core, seq, {_TOTAL} - lag({_TOTAL}) over w as total, " + ", ".join(f"{f} - lag({f}) over w as d_{f}" for f in FIELDS) + " from counters window w as (partition by core order by seq))",
        tail="select core, seq, round(coalesce(case when total > 0 then 100.0 * (total - d_idle_)::double / total else 0.0 end, 0.0)::double, 6) as usage, "
        + ", ".join(f"round(case when total is null then null when total > 0 then 100.0 * d_{f}::double / total else 0.0 end, 6)::double as {f}_pct" for f in FIELDS)
        + " from d",
    ),
    "w3_cpu_shares": _with(
        V.COUNTERS_SQL,
        "d as (select core, seq, " + ", ".join(f"case when lag({f}) over w is not null then greatest(0, {f} - lag({f}) over w) end as d_{f}" for f in FIELDS) + " from counters window w as (partition by core order by seq))",
        "t as (select *, " + " + ".join(f"d_{f}" for f in FIELDS) + " as total from d)",
        "s as (select core, seq, " + ", ".join(f"case when total > 0 then 100.0 * d_{f}::double / total end as {f}_pct" for f in FIELDS) + " from t)",
        tail="select core, seq, " + ", ".join(f"round(last_value({f}_pct ignore nulls) over (partition by core order by seq rows unbounded preceding), 6) as {f}_pct" for f in FIELDS) + " from s",
    ),
    "w4_clamped_delta": _with(V.STATES_SQL, "v as (select npu, batch, cast(floor(value) as bigint) as v from states)", tail="select npu, batch, case when v >= lag(v) over w then v - lag(v) over w else 0 end as delta from v window w as (partition by npu order by batch)"),
    **{
        name: _with(
            V.COUNTERS_SQL,
            f"r as (select core, seq, user_ - lag(user_) over w as d, {gap} as gap from counters window w as (partition by core order by seq))",
            tail="select core, seq, round(greatest(0, d)::double / gap, 6) as rate from r where d is not null and gap > 0",
        )
        for name, gap in (("w5_rates", "(ts_s - lag(ts_s) over w)::double"), ("w5_fixed_rates", "3.0::double"))
    },
    "w7_error_delta": _with(V.STATES_SQL, "v as (select npu, batch, cast(floor(value) as bigint) % 4 as v from states)", tail="select npu, batch, case when lag(v) over w > 0 then v - lag(v) over w else 0 end as delta from v window w as (partition by npu order by batch)"),
    "w13_transitions": _with(V.STATES_SQL, _EDGES, tail="select npu, batch, active from edged where active <> was"),
    "w14_debounce": _with(
        V.STATES_SQL,
        "a as (select npu, ts_s, event_id, row_number() over (partition by npu order by ts_s, event_id) as k from states where active)",
        "kept as (select npu, ts_s, event_id, k from a where k = 1 union all select n.npu, n.ts_s, n.event_id, n.k from kept join lateral (select * from a where a.npu = kept.npu and a.k > kept.k and a.ts_s - kept.ts_s >= 172800 order by a.k limit 1) as n on true)",
        tail="select npu, event_id from kept",
        recursive=True,
    ),
    "w15_latest_active": _with(V.STATES_SQL, _EDGES, tail="select npu, batch, type from state_events qualify row_number() over (partition by npu order by batch desc) = 1 and not recovered"),
    "w16_event_ring": "select event_id, event_type from events order by event_id desc limit 1024",
    "w17_consumer_dedup": _with(
        V.STATES_SQL, _EDGES, "l as (select *, lag(type) over w as t, lag(recovered) over w as r from state_events window w as (partition by npu order by batch))", tail="select npu, batch, type, recovered from l where not coalesce(t = type and not r and not recovered, false)"
    ),
    "w18_second_to_last": _with(V.STATES_SQL, tail="select npu, batch, event_id from states qualify row_number() over (partition by npu order by batch desc) = least(2, count(*) over (partition by npu))"),
    "w22_axis_a26_stats": _with(
        V.STATES_SQL,
        "g as (select npu, min(value) as lo, max(value) as hi, avg(value) as mean from states group by npu)",
        tail="select npu, round(case when hi - lo < 0.01 * hi and lo > 0 then 0.0 else lo end, 6) as lo, round(case when hi = lo then hi + 1 else hi end, 6) as hi, round(mean, 6) as mean from g",
    ),
    "t3_top_and_bottom": """with r as (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey * 10 + l_linenumber) as place, count(*) over (partition by l_suppkey) as n from lineitem)
select l_suppkey, l_orderkey, l_linenumber, cast(place as int) as place from r where place <= 30 or place > n - 5""",
    "k3_latest_batch": _with(V.PROBES_SQL, tail="select host, batch, npu, name, value, ord from probes qualify batch = max(batch) over (partition by host)"),
    "df1_active_faults": _with(V.PROBES_SQL, _ACTIVE, tail="select host, npu, batch, type, severity from active"),
    "df1_fault_events": _with(*_FAULTS, tail="select * from fault_events"),
    "fsub_j9_subscriptions": _with(
        *_FAULTS,
        _SUBS,
        tail=f"""select npu, type, severity, batch, recovered, id as subscription from fault_events join subs on (len(types) = 0 or list_contains(types, type)) and (len(components) = 0 or list_contains(components, 'npu'))
    and (len(npu_ids) = 0 or list_contains(npu_ids, npu)) and (min_severity = '' or {_RANK.format("severity")} >= {_RANK.format("min_severity")})""",
    ),
    "fevt_event_query": _with(*_FAULTS, tail="select npu, severity, batch, recovered from fault_events where batch > 19730 and type = 'npu_health' and npu in ('1', '2')"),
    "e1_j10_actions": _with(
        V.STATES_SQL, _EDGES, tail="select npu, batch, s_nationkey as dp_rank, case when recovered then 'retry' when type in ('card_drop', 'npu_health', 'hbm_uce', 'ddr_uce') then 'scale_down' else 'pause' end as action from state_events join supplier on s_suppkey = npu"
    ),
    "e9_pauses": _with(_PAUSES, tail="select event_id, engine, unhealthy::bigint as unhealthy from counted where step = 1 and unhealthy = 1"),
    "w21_unbroken_histories": _with(_POLLS, tail="select host, series, coalesce(history, '') as history from (select host, series from runs where back = 1 and k = 1) left join held using (host, series)"),
    "e9_engine_table": _with(_ENGINES, tail="select engine, status from engines"),
    "e2_e10_verdicts": _with(
        _ENGINES,
        tail="select bool_and(engine % 5 = 0 or status in ('paused', 'dead')) as all_paused, true as pause_ok, not bool_or(status = 'healthy') as retry_ok, not bool_or(status = 'healthy' and engine % 5 <> 0) as scale_down_ok from engines",
    ),
    "e3_not_yet_scaled": _with(_ENGINES, tail="select engine from engines where status = 'dead' and engine not in (select s_suppkey from supplier where s_nationkey < 12)"),
    "e11_result_fold": _with(_ENGINES, tail="select bool_and(status <> 'dead') as success, coalesce(string_agg(engine::varchar || ':' || status, ';' order by engine::varchar || ':' || status) filter (status = 'dead'), '') as reason from engines"),
    "h1_h6_component_scores": _with(*_health_sql(), tail="select node, component, score, max, n, rules, penalty from scores"),
    "h7_health": _with(
        *_health_sql(),
        "t as (select node, cast(sum(score) as int) as score, bool_or(component in ('gpu', 'npu')) as fast from scores group by node)",
        tail="select node, score, case when score >= 90 then 'Excellent' when score >= 75 then 'Good' when score >= 60 then 'Warning' else 'Critical' end as grade, case when fast then 'accelerated' else 'cpu_only' end as server_type from t",
    ),
}
