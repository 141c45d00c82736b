"""Slow ranks from profiler tables: metrics by rank, then clusters by the largest gap inside parallel groups.

Tables are long, one row for each event, with a `rank` column; times are integer nanoseconds:
strings (rank, id, value), steps (rank, start, stop), comm (rank, conn, group_id, start, stop, cnt, rowid),
host (rank, conn, start, stop, rowid), marks (rank, message, conn, start, stop, rowid), tasks (rank, type_id, conn, start, stop, rowid).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auklet.operators.aggregates import smoothed
from auklet.session import settled

# Names in the string tables; domains by priority and by exclusion
KERNEL, DATALOADER = "KERNEL_AICORE", "dataloader"
#: Which domain's groups are compared for slow compute, the first that is there.
DOMAIN_PRIORITY = ("tp", "exp", "ep", "tp_exp", "cp", "cp2", "cp_ulysses", "cp_ring", "dp", "dp_cp", "dp_modulo_exp_cp")
#: Domains whose groups aren't compared for slow communication.
NO_COMM = ("pp", "embd")
#: Bubbles above this many nanoseconds aren't reported.
BUBBLE_LIMIT = 5000
#: Operators of a rank whose times are ordered together.
SLICE = 100_000
_GROUP = "map<string,struct<group_name:string,global_ranks:array<int>>>"


def parallel_groups(meta: DataFrame) -> DataFrame:
    """(domain, name, ranks): distinct groups from the JSON under `parallel_group_info`; ranks sorted."""
    parsed = meta.where("name = 'parallel_group_info'").select(F.explode(F.from_json("value", _GROUP)).alias("name", "g"))
    return parsed.select(F.col("g.group_name").alias("domain"), "name", F.array_sort("g.global_ranks").alias("ranks")).distinct()


def groups_present(groups: DataFrame, ranks: DataFrame) -> DataFrame:
    """Groups with the ranks that have data; groups without any go."""
    rows = groups.select("domain", "name", F.explode("ranks").alias("rank")).join(ranks.select("rank").distinct(), "rank", "left_semi")
    return rows.groupBy("domain", "name").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))


def first_hosts(hosts: DataFrame) -> DataFrame:
    """(rank, host): the first host row of each rank."""
    return hosts.groupBy("rank").agg(F.min_by("host", "rowid").alias("host"))


def marker_steps(strings: DataFrame, marks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(rank, start, stop) of the tasks behind markers named `step N`; each lookup takes its first row."""
    names = strings.where(F.lower("value").rlike(r"^step\s+\d+$")).select("rank", F.col("id").alias("message"))
    first = marks.groupBy("rank", "message").agg(F.min_by("conn", "rowid").alias("conn"))
    at = tasks.groupBy("rank", "conn").agg(F.min_by(F.struct("start", "stop"), F.struct("rowid", "start", "stop")).alias("t"))
    return names.join(first, ["rank", "message"]).join(at, ["rank", "conn"]).select("rank", "t.start", "t.stop")


def step_ranges(ranks: DataFrame, steps: DataFrame, markers: DataFrame) -> DataFrame:
    """(rank, step_start, step_stop): all steps as one range; from markers without steps; null (unbounded) without either."""
    one = lambda df, p: df.groupBy("rank").agg(F.min("start").alias(f"{p}0"), F.max("stop").alias(f"{p}1"))
    rows = ranks.select("rank").distinct().join(one(steps, "s"), "rank", "left").join(one(markers, "m"), "rank", "left")
    return rows.select("rank", F.coalesce("s0", "m0").alias("step_start"), F.coalesce("s1", "m1").alias("step_stop"))


def within(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Events inside their rank's step range."""
    rows = events.join(ranges, "rank")
    lo, hi = F.col("start") >= F.col("step_start"), F.col("stop") <= F.col("step_stop")
    return rows.where(F.coalesce(lo, F.lit(True)) & F.coalesce(hi, F.lit(True))).drop("step_start", "step_stop")


def named(events: DataFrame, key: str, strings: DataFrame, *names: str) -> DataFrame:
    """Events whose `key` stands for one of these strings in their rank's table."""
    ids = strings.where(F.col("value").isin(*names)).select("rank", F.col("id").alias(key)).distinct()
    return events.join(ids, ["rank", key], "left_semi")


def host_ops(host: DataFrame, marks: DataFrame) -> DataFrame:
    """(rank, conn, source, h_start, h_stop): the last row of each table's connection."""
    both = host.select("rank", "conn", F.lit(0).alias("source"), "start", "stop", "rowid").unionByName(marks.select("rank", "conn", F.lit(1).alias("source"), "start", "stop", "rowid"))
    last = both.where("conn > 0").groupBy("rank", "conn", "source").agg(F.max_by(F.struct("start", "stop"), "rowid").alias("t"))
    return last.select("rank", "conn", "source", F.col("t.start").alias("h_start"), F.col("t.stop").alias("h_stop"))


def with_hosts(comm: DataFrame, ops: DataFrame) -> DataFrame:
    """Device operators with their host times: of both tables, the markers' come first; operators without host times stay."""
    best = ops.groupBy("rank", "conn").agg(F.max_by(F.struct("h_start", "h_stop"), "source").alias("h"))
    return comm.join(best, ["rank", "conn"], "left").select(comm["*"], "h.h_start", "h.h_stop")


def rank_metrics(ranks: DataFrame, groups: DataFrame, strings: DataFrame, ranges: DataFrame, comm: DataFrame, host: DataFrame, marks: DataFrame, tasks: DataFrame) -> DataFrame:
    """(rank, metric, value): device and communication time, host and bubble means, kernel mean, first data loading, and each
    domain's trimmed duration and count. A metric that can't be computed is null; a rank without a known communication group
    has no host mean either.
    """
    ids = groups.select("domain", F.col("name").alias("value"), F.explode("ranks").alias("rank")).join(strings, ["rank", "value"]).select("rank", F.col("id").alias("group_id"), "domain").distinct()
    ranges = settled(ranges)  # a row for each rank, read for operators, kernels and markers
    ops = host_ops(host, marks)
    device = settled(with_hosts(within(comm, ranges).join(ids, ["rank", "group_id"]), ops))
    kernels = named(within(tasks, ranges), "type_id", strings, KERNEL)
    by_domain = _device_figures(device)
    under = ops.join(kernels.where("conn > 0").select("rank", "conn").distinct(), ["rank", "conn"], "left_semi").where("h_start > 0 and h_stop >= h_start")
    under = under.groupBy("rank").agg(F.sum(F.col("h_stop") - F.col("h_start")).alias("under_s"), F.count("*").alias("under_n"))
    kernel = kernels.groupBy("rank").agg(F.round(F.avg(F.col("stop") - F.col("start"))).cast("bigint").alias("kernel"))
    loads = named(within(marks, ranges), "message", strings, DATALOADER).groupBy("rank").agg(F.min_by(F.col("stop") - F.col("start"), F.struct("start", "rowid")).alias("loader"))
    sums = by_domain.groupBy("rank").agg(*[F.sum(c).alias(c) for c in ("host_s", "host_n", "bubble_s", "bubble_n", "duration")])
    rows = ranks.select("rank").distinct().join(ranges, "rank", "left")
    for part in (sums, under, kernel, loads, ids.select("rank", F.lit(True).alias("grouped")).distinct()):
        rows = rows.join(part, "rank", "left")
    zero, step = F.lit(0), F.col("step_stop") - F.col("step_start")
    mean = lambda total, n: F.round(F.try_divide(total, n)).cast("bigint")
    host_mean = mean(F.coalesce("host_s", zero) + F.coalesce("under_s", zero), F.coalesce("host_n", zero) + F.coalesce("under_n", zero))
    values = {
        "StepDuration": step,
        "ZP_Device": F.when(F.col("duration").isNotNull() & step.isNotNull(), F.greatest(zero, step - F.col("duration"))),
        "ZP_Duration": F.col("duration"),
        "ZP_Host": F.when(F.col("grouped"), host_mean),
        "ZP_Bubble": mean(F.col("bubble_s"), F.col("bubble_n")),
        "ZP_Kernel": F.coalesce("kernel", zero),
        "DataLoader": F.coalesce("loader", zero),
    }
    wide = rows.select("rank", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("bigint").alias("value")) for n, v in values.items()])).alias("m")).select("rank", "m.*")
    each = F.array(F.struct(F.concat("domain", F.lit("_Duration")).alias("metric"), F.col("mid").alias("value")), F.struct(F.concat("domain", F.lit("_Count")).alias("metric"), F.col("mid_cnt").alias("value")))
    return wide.unionByName(by_domain.where("mid is not null").select("rank", F.explode(each).alias("m")).select("rank", "m.*"))


def _device_figures(device: DataFrame) -> DataFrame:
    """By rank and domain: sums and counts of host times and bubbles, the time that this domain's operators add to the union of
    all, and means of duration and count without the shortest and longest where there are over two.

    All but the union are aggregates that combine before the shuffle. The union needs the latest end among a rank's earlier
    operators; a rank's time is cut into slices of about SLICE operators, whose ends are handed on, so a rank's log isn't one task.
    """
    took, valid = F.col("stop") - F.col("start"), (F.col("start") > 0) & (F.col("stop") >= F.col("start"))
    hosted = (F.col("h_start") > 0) & (F.col("h_stop") >= F.col("h_start"))
    waited = (F.col("h_stop") > 0) & (F.col("start") > F.col("h_stop"))
    one = F.when(took > 0, F.struct(took.alias("took"), "rowid", "cnt"))
    sums = device.groupBy("rank", "domain").agg(
        F.sum(F.when(hosted, F.col("h_stop") - F.col("h_start"))).alias("host_s"),
        F.count_if(hosted).alias("host_n"),
        F.sum(F.when(waited, F.col("start") - F.col("h_stop"))).alias("bubble_s"),
        F.count_if(waited).alias("bubble_n"),
        F.count(one).alias("n_"),
        F.sum(one["took"]).alias("took_"),
        F.sum(one["cnt"]).alias("cnt_"),
        F.count(one["cnt"]).alias("cnt_n_"),
        F.min(one).alias("short_"),
        F.max(one).alias("long_"),
    )
    many = F.col("n_") > 2
    less = lambda total, f: F.col(total) - F.when(many, f("short_") + f("long_")).otherwise(0)
    mid = F.try_divide(less("took_", lambda c: F.col(c)["took"]), less("n_", lambda c: F.lit(1)))
    mid_cnt = F.try_divide(less("cnt_", lambda c: F.coalesce(F.col(c)["cnt"], F.lit(0))), less("cnt_n_", lambda c: F.col(c)["cnt"].isNotNull().cast("int")))

    rows = device.where(valid)
    spans = rows.groupBy("rank").agg(F.min("start").alias("lo_"), (F.ceil((F.max("start") - F.min("start") + 1) / F.ceil(F.count("*") / SLICE))).alias("width_"))
    rows = rows.join(spans, "rank").withColumn("slice_", F.floor((F.col("start") - F.col("lo_")) / F.col("width_")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("rank", "slice_").agg(F.max("stop").alias("end_"))
    ends = ends.select("rank", "slice_", F.max("end_").over(before(Window.partitionBy("rank").orderBy("slice_"))).alias("earlier_"))
    inside = F.max("stop").over(before(Window.partitionBy("rank", "slice_").orderBy("start", "stop", "rowid")))
    rows = rows.withColumn("inside_", inside).join(ends, ["rank", "slice_"])
    reach = F.coalesce(F.greatest("inside_", "earlier_"), F.col("start"))
    busy = rows.groupBy("rank", "domain").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), reach))).alias("duration"))
    whole = lambda v: F.round(v).cast("bigint")
    return sums.join(busy, ["rank", "domain"], "left").select("rank", "domain", "host_s", "host_n", "bubble_s", "bubble_n", "duration", whole(mid).alias("mid"), whole(mid_cnt).alias("mid_cnt"))


def _outlying(values: np.ndarray, high: bool, threshold: float) -> np.ndarray:
    """Which of the values stand apart: the far side of the widest gap, again and again while the gap is half of the range
    or more and the sides' means differ by the threshold's factor."""
    order = np.argsort(values, kind="stable")
    v, lo, hi = values[order], 0, len(values)
    while hi - lo >= 2:
        gaps = np.diff(v[lo:hi])
        cut = lo + int(np.argmax(gaps)) + 1
        small = v[lo:cut].mean()
        if 2 * gaps[cut - lo - 1] < gaps.sum() or small == 0 or v[cut:hi].mean() / small < threshold:
            break
        lo, hi = (cut, hi) if high else (lo, cut)
    apart = np.zeros(len(values), bool)
    if hi - lo < len(values):
        apart[order[lo:hi]] = True
    return apart


def apart(df: DataFrame, keys: list[str], member: str, value: str, high: str, threshold: float) -> DataFrame:
    """(keys, member, score) of members that stand apart in their group: on the high side where the boolean column `high` says so.

    The score is the value over the group's least (or the greatest over the value). A group holds one value for each rank of
    a parallel group, not events, so its size is bounded by the machine's; equal values are ordered by member.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col(member).alias("m")))).alias("all_"), F.first(high).alias("high_")).where(F.size("all_") >= 2)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(out_=[_outlying(np.asarray(v, float), bool(h), threshold).tolist() for v, h in zip(f["v_"], f["high_"], strict=True)])

    small = rows.select(*keys, "high_", F.transform("all_", lambda x: x["v"]).alias("v_"), F.transform("all_", lambda x: x["m"]).alias("m_"))
    judged = small.mapInPandas(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields) + ", out_ array<boolean>")
    least, most = F.array_min("v_"), F.array_max("v_")
    each = judged.select(*keys, "high_", least.alias("least_"), most.alias("most_"), F.explode(F.arrays_zip("m_", "v_", "out_")).alias("z")).where("z.out_")
    score = F.when(F.col("high_"), F.try_divide(F.col("z.v_"), F.col("least_"))).otherwise(F.try_divide(F.col("most_"), F.col("z.v_")))
    return each.select(*keys, F.col("z.m_").alias(member), score.alias("score"))


def primary_domain(groups: DataFrame) -> DataFrame:
    """Groups of the first domain in DOMAIN_PRIORITY that has any."""
    place = F.array_position(F.array(*[F.lit(d) for d in DOMAIN_PRIORITY]), F.col("domain"))
    best = groups.where(place > 0).agg(F.min_by("domain", place).alias("domain"))
    return groups.join(F.broadcast(best), "domain")


def _values(metrics: DataFrame, name: str | Column, alias: str) -> DataFrame:
    return metrics.where((F.col("metric") == name) & F.col("value").isNotNull()).select("rank", F.col("value").alias(alias))


def slow_compute(groups: DataFrame, metrics: DataFrame, threshold: float = 1.3) -> DataFrame:
    """(rank, score): long kernels where all of a group have kernels, otherwise short communication (others wait for the slow)."""
    rows = primary_domain(groups).select("name", F.size("ranks").alias("n"), F.explode("ranks").alias("rank"))
    rows = rows.where("n >= 2").join(_values(metrics, "ZP_Kernel", "kernel"), "rank", "left").join(_values(metrics, "ZP_Duration", "busy"), "rank", "left")
    all_have = F.bool_and(F.coalesce(F.col("kernel") > 0, F.lit(False))).over(Window.partitionBy("name"))
    rows = rows.withColumn("high", all_have).withColumn("v", F.when(F.col("high"), F.col("kernel")).otherwise(F.col("busy")))
    return apart(rows.where("v <> 0"), ["name"], "rank", "v", "high", threshold).groupBy("rank").agg(F.max("score").alias("score"))


def bubbles(metrics: DataFrame) -> DataFrame:
    """(rank, score): positive mean bubbles below the limit."""
    return _values(metrics, "ZP_Bubble", "score").where(f"score > 0 and score < {BUBBLE_LIMIT}").withColumn("score", F.col("score").cast("double"))


def slow_cpu(metrics: DataFrame, hosts: DataFrame, threshold: float = 1.3) -> DataFrame:
    """(rank, score): ranks whose host's smoothed host time stands apart from all others."""
    rows = _values(metrics, "ZP_Host", "value").join(first_hosts(hosts), "rank", "left")
    return apart(smoothed(rows).select(F.lit(1).alias("all"), "rank", "smooth", F.lit(True).alias("high")), ["all"], "rank", "smooth", "high", threshold).select("rank", "score")


def slow_communication(groups: DataFrame, metrics: DataFrame, threshold: float = 2.5) -> DataFrame:
    """(domain, ranks, score): groups whose fastest rank is slow among the groups of its pipeline stage."""
    depth = groups.where("domain = 'pp'").agg(F.coalesce(F.min_by(F.size("ranks"), "ranks"), F.lit(1)).alias("depth"))
    comparable = groups.where(~F.col("domain").isin(*NO_COMM)).groupBy("domain").agg(F.min(F.size("ranks")).alias("least"), F.max(F.size("ranks")).alias("most")).where("least = most and least > 1")
    rows = groups.join(F.broadcast(comparable), "domain").select("domain", "ranks", F.explode("ranks").alias("rank"))
    took = metrics.where("metric like '%\\\\_Duration' and value is not null").select("rank", F.regexp_replace("metric", "_Duration$", "").alias("domain"), F.col("value").alias("v"))
    fastest = rows.join(took, ["rank", "domain"]).groupBy("domain", "ranks").agg(F.min_by("rank", F.struct("v", "rank")).alias("rank"), F.min("v").alias("v"))
    w = Window.partitionBy("domain")
    placed = fastest.join(F.broadcast(depth)).withColumns({"at": F.row_number().over(w.orderBy("ranks")) - 1, "n": F.count("*").over(w)})
    stage = F.floor(F.col("at") / F.greatest(F.lit(1), F.floor(F.col("n") / F.col("depth")))).alias("stage")
    found = apart(placed.select("domain", stage, "rank", "v", F.lit(True).alias("high")), ["domain", "stage"], "rank", "v", "high", threshold)
    return found.join(fastest.select("domain", "rank", "ranks"), ["domain", "rank"]).groupBy("domain", "ranks").agg(F.max("score").alias("score"))


def findings(groups: DataFrame, metrics: DataFrame, hosts: DataFrame) -> DataFrame:
    """(category, key, domain, score) of everything found; key is the rank, or a group's ranks joined by commas."""
    metrics = settled(metrics)  # a few figures for each rank, read by every detector
    present = groups_present(groups, metrics)
    single = lambda df, c: df.select(F.lit(c).alias("category"), F.col("rank").cast("string").alias("key"), F.lit(None).cast("string").alias("domain"), "score")
    comm = slow_communication(present, metrics).select(F.lit("comm").alias("category"), F.concat_ws(",", F.col("ranks").cast("array<string>")).alias("key"), "domain", "score")
    return single(bubbles(metrics), "bubble").unionByName(single(slow_compute(present, metrics), "cal")).unionByName(comm).unionByName(single(slow_cpu(metrics, hosts), "cpu"))


def wide_metrics(metrics: DataFrame, domains: list[str]) -> DataFrame:
    """One row for each rank: fixed metrics, then each domain's two columns by name; missing domain figures are 0."""
    columns = ["StepDuration", "ZP_Device", "ZP_Duration", "ZP_Host", "ZP_Bubble", "ZP_Kernel", "DataLoader"]
    extra = [f"{d}_{k}" for d in sorted(domains) for k in ("Duration", "Count")]
    wide = metrics.groupBy("rank").pivot("metric", columns + extra).agg(F.first("value"))
    return wide.select("rank", *columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in extra])
