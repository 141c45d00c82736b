"""Faults of devices: rules, raise and recover events, subscriptions, debounce, and what consumers do."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auklet.functions.scalars import severity_rank

#: Fixed value: the error code of a card that dropped out.
CARD_DROP_CODE = "0x40f84e00"
#: Subscriptions that are broadcast at most.
FEW = 1000
ALL_RULES = ("card_drop", "npu_health", "error_code", "hbm_uce", "ddr_uce", "roce_link_down", "driver_health")


def point_faults(rules: tuple[str, ...] = ALL_RULES) -> Column:
    """(type, severity) of the rules that hold for a point (name, value, labels); the last point of a name counts for its device and batch."""
    name, value = F.col("name"), F.col("value")
    text = lambda key: F.col("labels")[key]
    of = lambda n, cond: (name == n) & F.coalesce(cond, F.lit(False))
    dropped = of("card_drop", value >= 1) | of("error_code", F.exists(F.split(F.coalesce(text("error_codes"), F.lit("")), ","), lambda c: F.lower(F.trim(c)) == CARD_DROP_CODE))
    down = of("roce_link_status", value == 0) | of("roce_link_status", text("status") == "down") | of("roce_link_health", text("roce_link").isin("down", "Down"))
    rule = {
        "card_drop": (dropped, F.lit("critical")),
        "npu_health": (of("health_status", text("status").isin("Alarm", "Critical")), F.when(text("status") == "Critical", "critical").otherwise("warning")),
        "error_code": (of("error_code", value > 0), F.lit("warning")),
        "hbm_uce": (of("hbm_double_ecc", value > 0), F.lit("critical")),
        "ddr_uce": (of("ddr_double_ecc", value > 0), F.lit("critical")),
        "roce_link_down": (down, F.lit("warning")),
        "driver_health": (of("driver_health", value != 0), F.lit("warning")),
    }
    return F.array_compact(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), s.alias("severity"))) for t, (c, s) in rule.items() if t in rules]))


def active_faults(points: DataFrame, keys: list[str], ord_: str = "ord", rules: tuple[str, ...] = ALL_RULES) -> DataFrame:
    """keys, type and severity of every rule that holds; points are (keys, name, value, labels), the last of a name counts."""
    last = points.groupBy(*keys, "name").agg(F.max_by(point_faults(rules), ord_).alias("f_"))
    return last.select(*keys, F.explode("f_").alias("f")).select(*keys, "f.type", "f.severity").distinct()


def transitions(active: DataFrame, batches: DataFrame, scope: list[str], device: str = "npu", batch: str = "batch") -> DataFrame:
    """Raise and recover events of faults (scope, device, type, severity, batch) over the scope's batches.

    A fault that lasts says nothing; it recovers at the first later batch of its scope in which it isn't active, whether or
    not the device is in it. batches are those that hold device rows at all: others say nothing about faults.
    """
    w = Window.partitionBy(*scope).orderBy(batch)
    steps = batches.select(*scope, batch).distinct().withColumns({"next_": F.lead(batch).over(w), "prev_": F.lag(batch).over(w)})
    rows = active.join(steps, [*scope, batch])
    one = Window.partitionBy(*scope, device, "type").orderBy(batch)
    raised = ~F.lag(batch).over(one).eqNullSafe(F.col("prev_")) | F.col("prev_").isNull()
    over = F.col("next_").isNotNull() & ~F.lead(batch).over(one).eqNullSafe(F.col("next_"))
    rows = rows.withColumns({"raised_": raised, "over_": over})
    out = F.array(
        F.when(F.col("raised_"), F.struct(F.col(batch).alias("at"), F.lit(False).alias("recovered"))),
        F.when(F.col("over_"), F.struct(F.col("next_").alias("at"), F.lit(True).alias("recovered"))),
    )
    rows = rows.withColumn("e_", F.explode(F.array_compact(out)))
    return rows.select(*scope, device, "type", "severity", F.col("e_.at").alias(batch), F.col("e_.recovered").alias("recovered"))


def edges(states: DataFrame, keys: list[str], order: str, active: str = "active") -> DataFrame:
    """Rows at which a flag changes, starting from off."""
    before = F.coalesce(F.lag(active).over(Window.partitionBy(*keys).orderBy(order)), F.lit(False))
    return states.withColumn("was_", before).where(F.col(active) != F.col("was_")).drop("was_")


def latest_active(events: DataFrame, key: str, seq: str) -> DataFrame:
    """The last event of each device, if it isn't a recovery."""
    return events.groupBy(key).agg(F.max_by(F.struct("type", "recovered"), seq).alias("e_"), F.max(seq).alias(seq)).where("not e_.recovered").select(key, seq, "e_.type")


def newest(events: DataFrame, seq: str, n: int = 1024) -> DataFrame:
    """The newest n events."""
    return events.orderBy(F.desc(seq)).limit(n)


def not_repeated(events: DataFrame, key: str, seq: str) -> DataFrame:
    """Events without those of the type that the device's stored fault already has; a recovery clears the store."""
    w = Window.partitionBy(key).orderBy(seq)
    same = (F.lag("type").over(w) == F.col("type")) & ~F.lag("recovered").over(w) & ~F.col("recovered")
    return events.withColumn("same_", F.coalesce(same, F.lit(False))).where("not same_").drop("same_")


def matched(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Event and subscription pairs: empty lists take any, the severity is at least the subscription's.

    Up to FEW subscriptions are broadcast, and events don't move. Of more, an event meets those of its type and those of any type by an
    equi-join, so neither side need be small.
    """
    takes = lambda names, v: (F.size(f"s.{names}") == 0) | F.array_contains(f"s.{names}", F.col(f"e.{v}"))
    enough = (F.coalesce("s.min_severity", F.lit("")) == "") | (severity_rank(F.col("e.severity")) >= severity_rank(F.col("s.min_severity")))
    rest = takes("components", "component") & takes("npu_ids", "npu") & enough
    out = [*[F.col(f"e.{c}") for c in events.columns], F.col("s.id").alias("subscription"), "s.debounce_s"]
    if subscriptions.count() <= FEW:
        return events.alias("e").join(F.broadcast(subscriptions.alias("s")), takes("types", "type") & rest).select(*out)
    kinds = F.when(F.size("types") > 0, F.array_distinct(F.array_compact("types"))).otherwise(F.array(F.lit(None).cast("string")))
    s = subscriptions.withColumn("kind_", F.explode(kinds)).alias("s")
    e = events.withColumn("kind_", F.explode(F.array_distinct(F.array(F.col("type"), F.lit(None).cast("string"))))).alias("e")
    return e.join(s, F.col("e.kind_").eqNullSafe(F.col("s.kind_")) & rest).select(*out)


def debounced(pairs: DataFrame, keys: list[str], ts: str, gap: str, tie: str) -> DataFrame:
    """Pairs that are at least `gap` after the last one kept of their keys. A task streams over sorted rows and holds one time a key."""
    rows = pairs.repartition(*keys).sortWithinPartitions(*keys, ts, tie)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = None, None
        for df in frames:
            take = []
            for *key, t, g in df[[*keys, ts, gap]].itertuples(index=False, name=None):
                ok = key != now or t - kept >= g
                if ok:
                    now, kept = key, t
                take.append(ok)
            yield df[take]

    return rows.mapInPandas(fold, rows.schema)


def actions(events: DataFrame, device_to_rank: DataFrame) -> DataFrame:
    """What a consumer does: recovered devices retry, lost cards and uncorrectable memory scale down, all else pauses; devices without a rank are left out."""
    lost = F.col("type").isin("card_drop", "npu_health", "hbm_uce", "ddr_uce")
    act = F.when(F.col("recovered"), "retry").when(lost, "scale_down").otherwise("pause")
    return events.join(device_to_rank, "npu").withColumn("action", act)


def engine_table(status: DataFrame, key: str, seq: str) -> DataFrame:
    """Last status of each engine."""
    return status.groupBy(key).agg(F.max_by("status", seq).alias("status"))


def pauses(status: DataFrame, key: str, seq: str, width: int) -> DataFrame:
    """(seq, key, unhealthy): the status reports at which a pause is ordered: an engine fails while all others are healthy.

    Further engines that fail before all are healthy again order none. status is (key, seq, status), every engine healthy before its first report. How many engines
    are unhealthy is a sum over all reports before; it is counted within ranges of `width` numbers and the ranges' sums are added, so no
    task orders all reports. Of several reports of one number the smallest key comes first.
    """
    bad = (F.col("status") != "healthy").cast("int")
    own = Window.partitionBy(key).orderBy(seq)
    steps = status.withColumn("step_", bad - F.coalesce(F.lag(bad).over(own), F.lit(0))).where("step_ <> 0").select(key, seq, "step_", F.floor(F.col(seq) / width).alias("range_"))
    sums = steps.groupBy("range_").agg(F.sum("step_").alias("sum_"))
    before = sums.select("range_", F.coalesce(F.sum("sum_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))  # a row for each range
    within = F.sum("step_").over(Window.partitionBy("range_").orderBy(seq, key).rowsBetween(Window.unboundedPreceding, 0))
    rows = steps.withColumn("within_", within).join(before, "range_").withColumn("unhealthy", F.col("before_") + F.col("within_"))
    return rows.where("step_ = 1 and unhealthy = 1").select(seq, key, "unhealthy")


def verdicts(engines: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Whether all engines rest, and which commands are allowed: pause always, retry and scale-down if no (retained) engine is healthy."""
    e = engines.join(excluded.select(key, F.lit(True).alias("x_")), key, "left").withColumn("x_", F.coalesce("x_", F.lit(False)))
    healthy = F.col("status") == "healthy"
    return e.agg(
        F.bool_and(F.col("x_") | F.col("status").isin("paused", "dead")).alias("all_paused"), F.lit(True).alias("pause_ok"), (~F.bool_or(healthy)).alias("retry_ok"), (~F.bool_or(healthy & ~F.col("x_"))).alias("scale_down_ok")
    )
