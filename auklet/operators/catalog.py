"""Which metrics are wanted: priorities, scopes, overrides and collection intervals, as joins with small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auklet.functions.scalars import priority_rank

ON = ["component", "name"]


def selected(points: DataFrame, catalog: DataFrame, scope: DataFrame | None = None, threshold: str = "medium") -> DataFrame:
    """Points that are kept: without a scope those of high or medium priority, static ones and ones the catalog doesn't have;
    with one (component, name) those in it that reach the threshold or are static. An empty scope is none.
    """
    known = F.broadcast(catalog.select(*ON, F.col("priority").alias("p_"), F.coalesce("static", F.lit(False)).alias("s_"), F.lit(True).alias("k_")))
    rows = points.join(known, ON, "left")
    plain = F.col("k_").isNull() | (priority_rank(F.col("p_")) >= 1) | F.col("s_")
    if scope is None or scope.isEmpty():
        kept = rows.where(plain)
    else:
        least = priority_rank(F.lit(threshold))
        within = rows.join(F.broadcast(scope.select(*ON).distinct()), ON, "left_semi")
        kept = within.where(F.col("k_").isNull() | (priority_rank(F.col("p_")) >= least) | F.col("s_"))
    return kept.select(*[F.col(c) for c in points.columns])


def wanted(catalog: DataFrame, groups: DataFrame, threshold: str = "medium") -> DataFrame:
    """(group, wanted): whether a collector's group (group, component, name) has a metric that reaches the threshold; unknown ones do."""
    rows = groups.join(F.broadcast(catalog.select(*ON, "priority")), ON, "left")
    return rows.groupBy("group").agg(F.bool_or(F.col("priority").isNull() | (priority_rank(F.col("priority")) >= priority_rank(F.lit(threshold)))).alias("wanted"))


def scope_of(*lists: DataFrame) -> DataFrame:
    """The union of features' (component, name) lists."""
    out = lists[0].select(*ON)
    for more in lists[1:]:
        out = out.union(more.select(*ON))
    return out.distinct()


def merged(base: DataFrame, override: DataFrame) -> DataFrame:
    """Catalog rows with an override's non-empty fields; `static` is on if either says so; the override's own rows are added."""
    fields = [c for c in base.columns if c not in (*ON, "static")]
    b, o = base.alias("b"), override.alias("o")
    rows = b.join(o, ON, "full")
    picks = [F.coalesce(F.nullif(F.trim(F.col(f"o.{c}")), F.lit("")), F.col(f"b.{c}")).alias(c) for c in fields]
    return rows.select(*ON, *picks, (F.coalesce("b.static", F.lit(False)) | F.coalesce("o.static", F.lit(False))).alias("static"))


def intervals(components: DataFrame, features: DataFrame, default_s: float) -> DataFrame:
    """(component, seconds): the shortest interval that a feature asks for, or the default."""
    least = features.groupBy("component").agg(F.min("seconds").alias("s_"))
    return components.select("component").distinct().join(F.broadcast(least), "component", "left").select("component", F.coalesce("s_", F.lit(float(default_s))).alias("seconds"))


def once_static(points: DataFrame, catalog: DataFrame, series: list[str], order: str) -> DataFrame:
    """Points in which a static metric's series appears once, at its first sample."""
    known = F.broadcast(catalog.where("static").select(*ON).distinct())
    static = points.join(known, ON, "left_semi")
    first = static.groupBy(*ON, *series).agg(F.min(order).alias(order))
    rest = points.join(known, ON, "left_anti")
    return rest.unionByName(static.join(first, [*ON, *series, order]).select(*points.columns))


def latest_static(points: DataFrame, names: list[str], order: str) -> DataFrame:
    """The rows of each component's last batch that has any of the static names."""
    rows = points.where(F.col("name").isin(names))
    last = rows.groupBy("component").agg(F.max(order).alias(order))
    return rows.join(F.broadcast(last), ["component", order])


# KPI fields and the metric names that feed them, first present first
KPI_ALIASES = {
    "temp": ["temperature"],
    "power": ["power_draw"],
    "aicore_freq": ["aicore_freq"],
    "aicore_util": ["utilization"],
    "hbm_util": ["memory_usage"],
    "tx_bandwidth": ["tx_bandwidth"],
    "rx_pfc_pkt": ["mac_rx_pfc_pkt_num"],
    "roce_tx_err_pkt": ["roce_tx_err_pkt_num"],
    "roce_out_of_order": ["roce_out_of_order_num"],
    "roce_new_pkt_rty": ["roce_new_pkt_rty_num", "roce_retry_num", "new_pkt_rty_num"],
    "nic_rx_all_pkg": ["nic_rx_all_pkg_num"],
}


def kpi_points(points: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """(ts_s, card, metric, value) of device points; of several names for a field in one batch the first in the list counts."""
    aliases = aliases or KPI_ALIASES
    table = points.sparkSession.createDataFrame([(n, f, k) for f, names in aliases.items() for k, n in enumerate(names)], "name string, metric string, place int")
    rows = points.where("component = 'npu'").withColumn("card", F.col("labels")["npu_id"].try_cast("int")).where("card is not null").join(F.broadcast(table), "name")
    return rows.groupBy("ts_s", "card", "metric").agg(F.min_by("value", F.struct("place", "ord")).alias("value"))


def subscription_defaults(subscriptions: DataFrame, debounce_s: int = 60, min_severity: str = "warning", component: str = "npu") -> DataFrame:
    """Subscriptions with the configured values where their own are missing."""
    parts = F.when(F.size("components") > 0, F.col("components")).otherwise(F.array(F.lit(component)))
    return subscriptions.withColumns({"components": parts, "min_severity": F.coalesce(F.nullif("min_severity", F.lit("")), F.lit(min_severity)), "debounce_s": F.coalesce("debounce_s", F.lit(debounce_s).cast("long"))})


def upserted(table: DataFrame, changes: DataFrame, key: str, gone: str = "removed") -> DataFrame:
    """The table after changes (its columns and `removed`): changed rows replace those of the same key, removed ones go."""
    kept = table.join(changes.select(key).distinct(), key, "left_anti")
    return kept.unionByName(changes.where(~F.col(gone)).select(*table.columns))
