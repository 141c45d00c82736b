"""Scalar rules of the telemetry domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_round(v: Column, places: int) -> Column:
    """Half-up by adding a half and cutting towards zero: -0.5 becomes 0, and 1.005 keeps its binary value's side."""
    scale = float(10**places)
    return (v * scale + 0.5).cast("bigint") / F.lit(scale)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 where whole isn't positive."""
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


def quadrant(space: Column, time: Column) -> Column:
    return F.when(space & time, "confirmed_anomaly").when(space, "individual_variance").when(time, "early_degradation").otherwise("normal")


def quadrant_order(q: Column) -> Column:
    return F.when(q == "confirmed_anomaly", 0).when(q == "early_degradation", 1).when(q == "individual_variance", 2).otherwise(3)


def severity(q: Column, score: Column) -> Column:
    return F.when((q == "confirmed_anomaly") & (score >= 5), "critical").when(q == "confirmed_anomaly", "warning").otherwise("info")


def severity_rank(s: Column) -> Column:
    return F.when(F.lower(s) == "critical", 2).when(F.lower(s) == "warning", 1).otherwise(0)


def priority_rank(p: Column) -> Column:
    return F.when(F.lower(p) == "high", 2).when(F.lower(p) == "medium", 1).otherwise(0)


def time_score(delta: Column, std: Column) -> Column:
    """|delta| over std; 999 where std is 0 and the value moved by more than 0.01."""
    return F.when(std > 0, F.abs(delta) / F.nullif(std, F.lit(0.0))).when(F.abs(delta) > 0.01, 999.0).otherwise(0.0)


def grade(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Good").when(score >= 60, "Warning").otherwise("Critical")


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value: each is padded to 20 digits."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def duration_text(ns: Column) -> Column:
    """Nanoseconds in the largest unit of which there is at least one, with two decimals."""
    return (
        F.when(ns >= 1_000_000_000, F.format_string("%.2fs", ns / 1e9))
        .when(ns >= 1_000_000, F.format_string("%.2fms", ns / 1e6))
        .when(ns >= 1_000, F.format_string("%.2fus", ns / 1e3))
        .otherwise(F.format_string("%.2fns", ns.cast("double")))
    )


def seconds_of_jiffies(jiffies: Column, per_second: int = 100) -> Column:
    return jiffies / per_second


def mb_of_sectors(sectors: Column) -> Column:
    """Sectors of 512 bytes in MB."""
    return sectors * 512 / (1 << 20)


def in_unit(ns: Column, unit: str) -> Column:
    """Nanoseconds in ns, us, ms or s."""
    return ns / {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}[unit]


def bar(value: Column, most: Column, width: int = 40) -> Column:
    return F.when(most > 0, F.expr("repeat('#', 0)")).otherwise("") if width < 1 else F.when(most > 0, F.repeat(F.lit("#"), F.round(value / most * width).cast("int"))).otherwise("")


def rank_key(ranks: Column) -> Column:
    """Sorted ranks as comma-separated text."""
    return F.array_join(F.array_sort(ranks).cast("array<string>"), ",")


def ranks_of_key(key: Column) -> Column:
    """The ranks of a rank_key(); what isn't a number is left out."""
    return F.array_compact(F.transform(F.split(key, ","), lambda p: F.trim(p).try_cast("int")))


def expand_ranges(text: Column) -> Column:
    """'0-3,5' as [0, 1, 2, 3, 5]; pieces that are no numbers are left out."""
    bounds = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), "-"))
    spans = F.transform(bounds, lambda b: F.sequence(F.expr("1").cast("int") * F.get(b, F.lit(0)).try_cast("int"), F.coalesce(F.get(b, F.lit(1)), F.get(b, F.lit(0))).try_cast("int")))
    return F.flatten(F.filter(spans, lambda s: s.isNotNull()))


def size_mb(text: Column) -> Column:
    """'16 GB', '1 TB' or '512 MB' in MB; null for anything else."""
    number, unit = F.regexp_extract(text, r"^\s*(\d+)\s*([KMGT]B)", 1).try_cast("bigint"), F.upper(F.regexp_extract(text, r"^\s*(\d+)\s*([KMGT]B)", 2))
    return F.when(unit == "TB", number * 1024 * 1024).when(unit == "GB", number * 1024).when(unit == "MB", number)
