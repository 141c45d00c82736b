"""Text reports of the two slow-card lines: sections and bars as rows, so that a large fleet's report is written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auklet.functions.scalars import bar, duration_text, quadrant_order


def card_report(summaries: DataFrame) -> DataFrame:
    """(section, place, line): cards by worst quadrant, then by falling score."""
    order = quadrant_order(F.col("quadrant"))
    place = F.row_number().over(Window.partitionBy("quadrant").orderBy(F.desc("composite"), "card"))
    line = F.format_string("card %d  %s  score %.2f  cause %s  abnormal %s", "card", "severity", "composite", F.coalesce("cause", F.lit("-")), "abnormal")
    return summaries.select(order.alias("section"), place.alias("place"), line.alias("line"))


def metric_report(metrics: DataFrame, metric: str, top: int = 30, bottom: int = 5) -> DataFrame:
    """(place, rank, value, text, bar): the greatest and least ranks of one metric, with bars against the greatest."""
    rows = metrics.where((F.col("metric") == metric) & F.col("value").isNotNull())
    most = F.broadcast(rows.agg(F.max("value").alias("most"), F.count("*").alias("n")))
    high = rows.orderBy(F.desc("value"), "rank").limit(top)
    low = rows.orderBy("value", "rank").limit(bottom)
    both = high.union(low).distinct().join(most)
    w = Window.orderBy(F.desc("value"), "rank")  # over top + bottom rows
    return both.select(F.row_number().over(w).alias("place"), "rank", "value", duration_text(F.col("value")).alias("text"), bar(F.col("value"), F.col("most")).alias("bar"))


def spread(metrics: DataFrame) -> DataFrame:
    """(metric, n, least, mean, median, most) over ranks."""
    return metrics.where("value is not null").groupBy("metric").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.max("value").alias("most"))


def result_entries(findings: DataFrame) -> DataFrame:
    """(category, place, display, value) of findings (category, key, domain, score): bubbles from the least, all else from the greatest.

    Groups are shown as their domain with the ranks in brackets, ranks as they are.
    """
    value = F.when(F.col("category") == "bubble", F.col("score")).otherwise(-F.col("score"))
    shown = F.when(F.col("category") == "comm", F.concat(F.coalesce("domain", F.lit("")), F.lit("["), F.replace("key", F.lit(","), F.lit(", ")), F.lit("]"))).otherwise(F.col("key"))
    place = F.row_number().over(Window.partitionBy("category").orderBy(value, "key"))  # findings of one job
    return findings.select("category", place.alias("place"), shown.alias("display"), F.col("score").alias("value"))
