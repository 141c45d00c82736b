"""Health scores from 0 to 100: deductions by rule, one conditional aggregate over a node's points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auklet.functions.scalars import grade

# Most points of each component, without and with accelerators
PLAIN = {"cpu": 30, "memory": 40, "disk": 30, "gpu": 0, "npu": 0}
ACCELERATED = {"cpu": 10, "memory": 20, "disk": 10, "gpu": 60, "npu": 60}
NPU_TEMPERATURES = ["temperature", "hbm_temp", "cluster_temp", "peri_temp", "aicore0_temp", "aicore1_temp", "soc_max_temp", "fp_max_temp", "ndie_temp", "hbm_max_temp"]


def _of(component: str, *names: str) -> Column:
    return (F.col("component") == component) & F.col("name").isin(*names)


def _first(component: str, name: str, key: str | None = None, label: str | None = None) -> Column:
    at = _of(component, name) if key is None else _of(component, name) & (F.col("labels")[key] == label)
    return F.min_by("value", F.when(at, F.col("ord")))


def _worst(component: str, *names: str) -> Column:
    return F.max(F.when(_of(component, *names), F.col("value")))


def _sum(component: str, name: str) -> Column:
    return F.coalesce(F.sum(F.when(_of(component, name) & (F.col("value") > 0), F.col("value"))), F.lit(0.0))


def facts() -> dict[str, Column]:
    """What the rules look at, as aggregates of a node's points."""
    return {
        "cpu_usage": _first("cpu", "usage", "core", "total"),
        "cpu_temp": _worst("cpu", "temperature"),
        "cores": _first("cpu", "core_num"),
        "load": _first("cpu", "load_average", "interval", "1m"),
        "cpu_ce": _sum("cpu", "cpu_ce_errors"),
        "cpu_uce": _sum("cpu", "cpu_uce_errors"),
        "mem_usage": _first("memory", "usage"),
        "swap": _first("memory", "swap_usage"),
        "mem_ce": _sum("memory", "ecc_ce_errors"),
        "mem_uce": _sum("memory", "ecc_uce_errors"),
        "psi": _first("memory", "saturation", "interval", "avg10"),
        "frag": _worst("memory", "fragmentation"),
        "space": _worst("disk", "space_usage"),
        "io_wait": _first("disk", "io_wait"),
        "smart": F.min(F.when(_of("disk", "smart_status"), F.col("value"))),
        "gpu_temp": _worst("gpu", "temperature"),
        "gpu_mem": _worst("gpu", "memory_usage"),
        "gpu_util": _worst("gpu", "utilization"),
        "gpu_ecc": _worst("gpu", "ecc_errors"),
        "npu_temp": _worst("npu", *NPU_TEMPERATURES),
        "npu_mem": _worst("npu", "memory_usage"),
        "npu_health": _worst("npu", "health_status"),
        "npu_util": _worst("npu", "utilization", "npu_util"),
        **{f"npu_{n}": _worst("npu", n) for n in ("hbm_double_ecc", "ddr_double_ecc", "hbm_single_ecc", "ddr_single_ecc", "error_code")},
    }


# By component, tiers of (condition, rule, share of the component's points); of a tuple only the first tier that holds counts
RULES: dict[str, list[list[tuple[str, str, float]]]] = {
    "cpu": [
        [("cpu_usage > 90", "usage>90%", 0.20), ("cpu_usage > 80", "usage>80%", 0.10)],
        [("cpu_temp > 85", "temp>85C", 0.30), ("cpu_temp > 75", "temp>75C", 0.15)],
        [("load > case when cores > 0 then cores * 2 else 8 end", "load>cores*2", 0.10)],
    ],
    "memory": [
        [("mem_usage > 90", "usage>90%", 0.30), ("mem_usage > 80", "usage>80%", 0.15)],
        [("swap > 50", "swap>50%", 0.10)],
        [("psi > 80", "saturation>80%", 0.15)],
        [("frag > 80", "fragmentation>80%", 0.10)],
    ],
    "disk": [[("space > 90", "space>90%", 0.40), ("space > 80", "space>80%", 0.20)], [("io_wait > 20", "io_wait>20%", 0.10)], [("smart < 1", "smart_failed", 0.30)]],
    "gpu": [
        [("gpu_temp > 90", "temp>90C", 0.30), ("gpu_temp > 80", "temp>80C", 0.15)],
        [("gpu_mem > 95", "mem>95%", 0.10)],
        [("gpu_util > 95", "util>95%", 0.10)],
        [("gpu_ecc > 0", "ecc_error", 0.20)],
    ],
    "npu": [
        [("npu_temp > 90", "temp>90C", 0.30), ("npu_temp > 80", "temp>80C", 0.15)],
        [("npu_mem > 95", "mem>95%", 0.10)],
        [("npu_health >= 3", "health_alarm", 0.30), ("npu_health = 2", "health_warning", 0.15)],
        [("npu_util > 95", "util>95%", 0.10)],
        *[[(f"npu_{n} > 0", n, share)] for n, share in (("hbm_double_ecc", 0.20), ("ddr_double_ecc", 0.20), ("hbm_single_ecc", 0.10), ("ddr_single_ecc", 0.10), ("error_code", 0.10))],
    ],
}
#: Points for each counted error.
PER_ERROR = {"cpu": [("cpu_ce", "cpu_ce_error", 2.0), ("cpu_uce", "cpu_uce_error", 10.0)], "memory": [("mem_ce", "ce_error", 2.0), ("mem_uce", "uce_error", 10.0)]}


def component_scores(points: DataFrame, node: str = "node") -> DataFrame:
    """(node, component, score, max, deductions) of every component that a node has points of.

    points are (node, component, name, value, labels, ord). An accelerator's points select the accelerated scheme.
    """
    has = {c: F.bool_or(F.col("component") == c).alias(f"has_{c}") for c in PLAIN}
    seen = points.groupBy(node).agg(*[c.alias(n) for n, c in facts().items()], *has.values())
    fast = F.col("has_gpu") | F.col("has_npu")
    parts = []
    for c in PLAIN:
        most = F.when(fast, ACCELERATED[c]).otherwise(PLAIN[c])
        taken = []
        for tiers in RULES[c]:
            pick = None
            for cond, rule, share in tiers:
                d = F.struct(F.lit(rule).alias("rule"), (most * F.lit(share)).cast("double").alias("penalty"))
                pick = F.when(F.expr(cond), d) if pick is None else pick.when(F.expr(cond), d)
            taken.append(pick)
        taken += [F.when(F.col(n) > 0, F.struct(F.lit(rule).alias("rule"), (F.col(n) * each).cast("double").alias("penalty"))) for n, rule, each in PER_ERROR.get(c, [])]
        deductions = F.array_compact(F.array(*taken))
        left = most - F.aggregate(deductions, F.lit(0.0), lambda s, d: s + d["penalty"])
        parts.append(F.when(F.col(f"has_{c}"), F.struct(F.lit(c).alias("component"), F.greatest(F.lit(0.0), left).cast("int").alias("score"), most.alias("max"), deductions.alias("deductions"))))
    return seen.select(node, F.explode(F.array_compact(F.array(*parts))).alias("c")).select(node, "c.*")


def health(points: DataFrame, node: str = "node") -> DataFrame:
    """(node, score, grade, server_type): components' scores together."""
    got = component_scores(points, node).groupBy(node).agg(F.sum("score").cast("int").alias("score"), F.bool_or(F.col("component").isin("gpu", "npu")).alias("fast"))
    return got.select(node, "score", grade(F.col("score")).alias("grade"), F.when(F.col("fast"), "accelerated").otherwise("cpu_only").alias("server_type"))
