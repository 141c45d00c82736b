"""Queries of the card-KPI operators on the event table's views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.operators import aggregates as A
from auklet.operators import kpi as K
from auklet.plans.views import KPI_ALL_SQL, KPI_SQL, RANKS_SQL, SPANS_SQL, kpi, kpi_all, rank_metric, spans, table

DAY = 86_400
SETTINGS = K.Settings(bucket_s=DAY, detect_s=7 * DAY, trend_r2=0.05)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def minute(spark, sf):
    return K.minute_table(kpi(spark, sf), SETTINGS)


def split(spark, sf):
    return K.windows(minute(spark, sf), SETTINGS)


def detail(spark, sf):
    return K.details(split(spark, sf), spark, SETTINGS)


def summary(spark, sf):
    return K.summaries(detail(spark, sf))


def flagship(spark, sf):
    return rounded(K.ranked(summary(spark, sf)))


def split_all(spark, sf):
    return K.windows(K.minute_table(kpi_all(spark, sf), SETTINGS), SETTINGS)


QUERIES = {
    "a1_daily_trimmed_mean": lambda s, d: rounded(minute(s, d)),
    "a2_midmean": lambda s, d: rounded(A.midmean(kpi(s, d), ["card", "metric"])),
    "a3_counter_delta": lambda s, d: A.counter_delta(kpi(s, d).where("metric = 'roce_tx_err_pkt'"), ["card"], ["ts_s", "ord"]),
    "a4_a5_a6_a7_baselines": lambda s, d: rounded(A.baselines(split(s, d).where("not detect"), ["card", "metric"])),
    "a8_trend": lambda s, d: rounded(A.trend(split(s, d), ["card", "metric"], "bucket", "value").withColumn("slope", F.col("slope") * DAY), 4),
    "a9_against_peers": lambda s, d: rounded(A.against_peers(split(s, d).where("detect"), "metric", "card"), 9),
    "a10_mean_of_valid": lambda s, d: kpi(s, d).groupBy("card").agg(A.mean_of_valid(F.col("value") - 20).alias("mean")),
    "a11_trimmed_pair": lambda s, d: A.trimmed_pair(table(s, d, "lineitem").withColumns({"duration": F.col("l_extendedprice"), "cnt": F.col("l_quantity"), "ord": F.col("l_orderkey") * 10 + F.col("l_linenumber")}), ["l_suppkey"], "duration", "cnt", "ord"),
    "a12_interval_union": lambda s, d: A.union_length(spans(s, d), ["rank"]),
    "a13_step_merge": lambda s, d: spans(s, d).groupBy("rank").agg(F.min("start").alias("start"), F.max("stop").alias("stop")),
    "a14_host_smoothing": lambda s, d: rounded(A.smoothed(rank_metric(s, d)).select("rank", "host", "smooth")),
    "a16_space_scores": lambda s, d: rounded(K.space_scores(K.space_points(split(s, d).where("detect"), s, SETTINGS), SETTINGS)),
    "w8_w10_w11_space_points": lambda s, d: rounded(K.space_points(split(s, d).where("detect"), s, SETTINGS).drop("method")),
    "w9_iqr_points": lambda s, d: rounded(K.iqr_points(minute(s, d))),
    "w12_window_split": lambda s, d: split(s, d).groupBy("detect", "metric").agg(F.count("*").alias("n"), F.min("bucket").alias("first"), F.max("bucket").alias("last")),
    "x5_time_scores": lambda s, d: rounded(K.time_scores(split(s, d), SETTINGS)),
    "dk2_details": lambda s, d: rounded(detail(s, d).drop("ord")),
    "dk3_trend_findings": lambda s, d: rounded(K.trends(split(s, d), SETTINGS).withColumn("slope", F.col("slope") * DAY), 4),
    "dk1_card_summaries": flagship,
    "a19_summary_counts": lambda s, d: K.counts(summary(s, d)),
    "w10_all_space_points": lambda s, d: rounded(K.space_points(split_all(s, d).where("detect"), s, SETTINGS)),
    "dk4_dk5_all_causes": lambda s, d: rounded(K.summaries(K.details(split_all(s, d), s, SETTINGS))),
    "dk7_correlation": lambda s, d: K.correlation(summary(s, d)),
    "dk8_gate": lambda s, d: K.gate(summary(s, d)),
    "k12_straggler_events": lambda s, d: K.events(summary(s, d)),
}

_COUNTERS = "('" + "', '".join(K.COUNTERS) + "')"
_MINUTE = f"""
mm as (select ts_s // 86400 * 86400 as bucket, card, metric, value, ts_s, ord, row_number() over (partition by ts_s // 86400, card, metric order by value) as k,
    count(*) over (partition by ts_s // 86400, card, metric) as n from kpi),
minute as (
    select bucket, card, metric, avg(value) filter (n < 4 or k between greatest(1, floor(n * 0.25)) + 1 and n - greatest(1, floor(n * 0.25))) as value
    from mm where not metric in {_COUNTERS} group by 1, 2, 3
    union all
    select bucket, card, metric, case when count(*) < 2 then 0.0 else arg_max(value, (ts_s, ord)) - arg_min(value, (ts_s, ord)) end
    from mm where metric in {_COUNTERS} group by 1, 2, 3),
split as (select *, bucket >= (select max(bucket) from minute) - 7 * 86400 as detect from minute)"""
_SPACE = f"""
points0 as (select bucket, card, metric, value, case when metric in {_COUNTERS} then 'absolute' when metric = 'aicore_freq' then 'direct' else 'zscore' end as method,
    count(*) over w as n, avg(value) over w as m, stddev_samp(value) over w as sd, min(value) over (w rows between unbounded preceding and unbounded following exclude current row) as others
    from split where detect window w as (partition by bucket, metric)),
points as (select bucket, card, metric, method, value, case method when 'absolute' then case when value > 0 then 999.0 else 0.0 end when 'direct' then case when value < others then 999.0 else 0.0 end
    else case when n >= 2 and sd > 0 then abs(value - m) / sd else 0.0 end end as score from points0),
space as (select card, metric, case when method = 'zscore' then avg(score) else avg(case when score >= 999 then 1.0 else 0.0 end) end as space_score,
    case when method = 'zscore' then avg(score) > 1.3 else avg(case when score >= 999 then 1.0 else 0.0 end) > 0.5 end as space_abnormal
    from points group by card, metric, method)"""
_TIME = """
base as (select card, metric, count(value) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std from split where not detect group by 1, 2),
now as (select card, metric, avg(value) as current from split where detect group by 1, 2),
time0 as (select card, metric, current, case when coalesce(n, 0) < 2 then 0.0 when std > 0 then abs(current - mean) / std when abs(current - mean) > 0.01 then 999.0 else 0.0 end as time_score
    from now left join base using (card, metric)),
time_ as (select *, time_score > 1.24 as time_abnormal from time0)"""
_METRICS = "metrics as (select * from (values " + ", ".join(f"('{m}', '{c}', {k})" for k, (m, c, *_) in enumerate(K.METRICS)) + ") as t(metric, category, o))"
_DETAIL = (
    _METRICS
    + """,
cards as (select distinct card from split where metric in ('power', 'temp')),
detail0 as (select card, metric, category, o, coalesce(space_score, 0.0) as space_score, coalesce(time_score, 0.0) as time_score,
    coalesce(space_abnormal, false) as space_abnormal, coalesce(time_abnormal, false) as time_abnormal
    from cards cross join metrics left join space using (card, metric) left join time_ using (card, metric)),
detail as (select *, 0.6 * time_score + 0.4 * space_score as fusion_score,
    case when space_abnormal and time_abnormal then 'confirmed_anomaly' when space_abnormal then 'individual_variance' when time_abnormal then 'early_degradation' else 'normal' end as quadrant from detail0)"""
)
_CAUSES = "causes as (select * from (values " + ", ".join("('" + "', '".join(x.replace("'", "''") for x in row) + "')" for row in K.CAUSES) + ") as t(rule, cause, confidence, suggestion))"
_SUMMARY = (
    _CAUSES
    + """,
flagged as (select *, space_abnormal or time_abnormal as bad, bool_or((space_abnormal or time_abnormal) and category = 'compute') over (partition by card) as comp from detail),
summed as (
    select card, bool_or(comp) as comp, bool_or(bad) as anybad,
        coalesce(string_agg(metric, ',' order by o) filter (bad and (category = 'compute' or not comp)), '') as abnormal,
        coalesce(string_agg(metric || ':' || quadrant, ',' order by o) filter (bad and (category = 'compute' or not comp)), '') as evidence,
        count(*) filter (bad and (category = 'compute' or not comp)) as n_abnormal,
        coalesce(string_agg(metric, ',' order by o) filter (bad and comp and category = 'communication'), '') as secondary,
        coalesce(min(case quadrant when 'confirmed_anomaly' then 0 when 'early_degradation' then 1 when 'individual_variance' then 2 else 3 end) filter (bad and (category = 'compute' or not comp)), 3) as qo,
        coalesce(avg(fusion_score) filter (bad and (category = 'compute' or not comp)), 0.0) as composite,
        bool_or(bad and metric = 'temp') as t, bool_or(bad and metric = 'power') as p, bool_or(bad and metric = 'aicore_freq') as f,
        bool_or(bad and metric = 'aicore_util') as u, bool_or(bad and metric = 'hbm_util') as h, bool_or(bad and metric = 'roce_tx_err_pkt') as e,
        bool_or(bad and metric = 'rx_pfc_pkt') as pfc, bool_or(bad and metric = 'roce_out_of_order') as ooo, bool_or(bad and metric = 'roce_new_pkt_rty') as rty, bool_or(bad and metric = 'tx_bandwidth') as tx
    from flagged group by card),
ruled as (
    select *, case when qo = 3 then null when comp then case when t and f then 'hot and slow' when t and p then 'hot and drawing' when f then 'slow'
            when p and u and h then 'idle' when u and not h then 'less used' when h and not u then 'memory' when t and not p then 'hot alone'
            when p and not t and not f and not u and not h then 'power alone' else 'compute' end
        else case when e then 'errors' when pfc then 'pauses' when ooo and rty then 'disorder' when tx and not u then 'bandwidth' else 'communication' end end as rule from summed),
summary as (
    select card, case when comp then 'compute' when anybad then 'communication' else 'none' end as category,
        case qo when 0 then 'confirmed_anomaly' when 1 then 'early_degradation' when 2 then 'individual_variance' else 'normal' end as quadrant, composite,
        case when qo = 0 and composite >= 5 then 'critical' when qo = 0 then 'warning' else 'info' end as severity, abnormal, secondary,
        cause, confidence, replace(suggestion, '{n}', n_abnormal::varchar) as suggestion, case when qo < 3 then evidence end as evidence
    from ruled left join causes using (rule))"""
)


def _with(*parts: str, tail: str) -> str:
    return "with " + ",".join(parts) + "\n" + tail


_BASE = (KPI_SQL, _MINUTE)
_ALL = (*_BASE, _SPACE, _TIME, _DETAIL, _SUMMARY)
_TREND = "select card, metric, count(*) as n, coalesce(round(regr_slope(value, bucket::double) * 86400, 4), 0.0) as slope, round(greatest(0.0, coalesce(regr_r2(value, bucket::double), 1.0)), 4) as r2 from split group by 1, 2"

SQL = {
    "a1_daily_trimmed_mean": _with(*_BASE, tail="select bucket, card, metric, round(value, 6) as value from minute"),
    "a2_midmean": _with(
        KPI_SQL,
        "r as (select card, metric, value, row_number() over w as k, count(*) over (partition by card, metric) as n from kpi window w as (partition by card, metric order by value))",
        tail="select card, metric, round(avg(value) filter (n < 4 or k between greatest(1, floor(n * 0.25)) + 1 and n - greatest(1, floor(n * 0.25))), 6) as value from r group by 1, 2",
    ),
    "a3_counter_delta": _with(KPI_SQL, tail="select card, case when count(*) < 2 then 0.0 else arg_max(value, (ts_s, ord)) - arg_min(value, (ts_s, ord)) end as value from kpi where metric = 'roce_tx_err_pkt' group by 1"),
    "a4_a5_a6_a7_baselines": _with(
        *_BASE,
        tail="""select card, metric, count(value) as n, round(avg(value), 6) as mean, round(coalesce(stddev_samp(value), 0), 6) as std, round(min(value), 6) as lowest, round(max(value), 6) as highest,
    round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from split where not detect group by 1, 2""",
    ),
    "a8_trend": _with(*_BASE, tail=_TREND),
    "a9_against_peers": _with(
        *_BASE,
        "o as (select metric, card, sum(value) as s, count(value) as n from split where detect group by 1, 2)",
        tail="select metric, card, round(s / n, 9) as own_mean, round((sum(s) over w - s) / nullif(sum(n) over w - n, 0), 9) as peer_mean from o window w as (partition by metric)",
    ),
    "a10_mean_of_valid": _with(KPI_SQL, tail="select card, cast(round(avg(value - 20) filter (value - 20 >= 0)) as bigint) as mean from kpi group by 1"),
    "a11_trimmed_pair": """with r as (select l_suppkey, l_extendedprice as duration, l_quantity as cnt, count(*) over (partition by l_suppkey) as n,
    row_number() over (partition by l_suppkey order by l_extendedprice, l_orderkey * 10 + l_linenumber) as k from lineitem)
select l_suppkey, cast(round(avg(duration)) as bigint) as duration, cast(round(avg(cnt)) as bigint) as cnt from r where n <= 2 or k between 2 and n - 1 group by 1""",
    "a12_interval_union": _with(
        SPANS_SQL,
        "r as (select *, max(stop) over (partition by rank order by start, stop rows between unbounded preceding and 1 preceding) as reach from spans)",
        tail="select rank, cast(sum(greatest(0, stop - greatest(start, coalesce(reach, start)))) as bigint) as covered from r group by 1",
    ),
    "a13_step_merge": _with(SPANS_SQL, tail="select rank, min(start) as start, max(stop) as stop from spans group by 1"),
    "a14_host_smoothing": _with(
        RANKS_SQL,
        tail="select rank, host, round(case when count(*) over w > 2 then (sum(value) over w - min(value) over w - max(value) over w) / (count(*) over w - 2) else avg(value) over w end, 6) as smooth from ranks window w as (partition by host)",
    ),
    "a16_space_scores": _with(*_BASE, _SPACE, tail="select card, metric, round(space_score, 6) as space_score, space_abnormal from space"),
    "w8_w10_w11_space_points": _with(*_BASE, _SPACE, tail="select bucket, card, metric, round(value, 6) as value, round(score, 6) as score from points"),
    "w9_iqr_points": _with(
        *_BASE,
        "q as (select bucket, metric, quantile_cont(value, 0.25) as lo, quantile_cont(value, 0.75) as hi from minute group by 1, 2)",
        tail="select bucket, card, metric, round(value, 6) as value, case when value < lo - 1.5 * (hi - lo) or value > hi + 1.5 * (hi - lo) then 999.0 else 0.0 end::double as score from minute join q using (bucket, metric)",
    ),
    "w12_window_split": _with(*_BASE, tail="select detect, metric, count(*) as n, min(bucket) as first, max(bucket) as last from split group by 1, 2"),
    "x5_time_scores": _with(*_BASE, _TIME, tail="select card, metric, round(current, 6) as current, round(time_score, 6) as time_score, time_abnormal from time_"),
    "dk2_details": _with(*_BASE, _SPACE, _TIME, _DETAIL, tail="select card, metric, category, round(space_score, 6) as space_score, round(time_score, 6) as time_score, space_abnormal, time_abnormal, round(fusion_score, 6) as fusion_score, quadrant from detail"),
    "dk3_trend_findings": _with(*_BASE, tail=f"select * from ({_TREND}) where n >= 10 and r2 >= 0.05 and slope <> 0"),
    "dk1_card_summaries": _with(*_ALL, tail="select card, category, quadrant, round(composite, 6) as composite, severity, abnormal, secondary, cause, confidence, suggestion, evidence from summary"),
    "a19_summary_counts": _with(*_ALL, tail="select count(*) as cards, " + ", ".join(f"count(*) filter (quadrant = '{q}') as {q}" for q in ("confirmed_anomaly", "early_degradation", "individual_variance", "normal")) + " from summary"),
    "w10_all_space_points": _with(KPI_ALL_SQL, _MINUTE, _SPACE, tail="select bucket, card, metric, method, round(value, 6) as value, round(score, 6) as score from points"),
    "dk4_dk5_all_causes": _with(KPI_ALL_SQL, *_ALL[1:], tail="select card, category, quadrant, round(composite, 6) as composite, severity, abnormal, secondary, cause, confidence, suggestion, evidence from summary"),
    "dk7_correlation": _with(
        *_ALL,
        "c as (select count(*) filter (quadrant = 'confirmed_anomaly') as n, count(*) as total, coalesce(string_agg(card::varchar, ',' order by card) filter (quadrant = 'confirmed_anomaly'), '') as cards from summary)",
        tail="select case when n = total and total > 1 then 'job_level' else 'card_level' end as type, case when (n = total and total > 1) or n > 1 then 'medium' else 'high' end as confidence, n, total, cards from c where n > 0",
    ),
    "dk8_gate": _with(*_ALL, tail="select coalesce(bool_or(quadrant = 'confirmed_anomaly'), false) as confirmed from summary"),
    "k12_straggler_events": _with(
        *_ALL,
        tail="""select substr(sha256('straggler_detected/' || card || '/' || quadrant), 1, 16) as event_id, 'straggler_detected' as type, card::varchar as npu_id,
    case quadrant when 'confirmed_anomaly' then 'critical' when 'individual_variance' then 'info' else 'warning' end as severity, quadrant, cause from summary where quadrant <> 'normal'""",
    ),
}
