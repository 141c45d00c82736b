"""Registered queries of the telemetry operators and the SQL that each must equal."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

MODULES = [importlib.import_module(f"auklet.plans.{m}") for m in ("kpi_queries", "fleet_queries", "profiler_queries", "metric_queries", "report_queries", "probe_queries")]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["dk1_card_summaries"](spark, sf_dir)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
