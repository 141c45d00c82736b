"""KPI samples from JSON lines and CSV files as the long relation (ts_s, card, metric, value, ord)."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts bigint, vals map<string,map<string,double>>, cpu_avg map<string,string>"
# CSV columns and the metrics in them
CSV_METRICS = {
    "NPU_CARD_POWER": "power", "NPU_CARD_TEMP": "temp", "NPU_CARD_AICORE_FREQ": "aicore_freq", "NPU_CARD_AICORE_UTIL": "aicore_util", "NPU_CARD_HBM_UTIL": "hbm_util", "NPU_TX_BANDWIDTH": "tx_bandwidth",
    "NPU_RX_PFC_PKT": "rx_pfc_pkt", "NPU_ROCE_TX_ERR_PKT": "roce_tx_err_pkt", "NPU_ROCE_OUT_OF_ORDER": "roce_out_of_order", "NPU_ROCE_NEW_PKT_RTY": "roce_new_pkt_rty", "NPU_NIC_RX_ALL_PKG": "nic_rx_all_pkg",
}


def day_files(folder: str, since: date, until: date, name: str = "straggler_kpi_{}.jsonl") -> list[str]:
    """One path for each day, both ends included."""
    return [f"{folder}/{name.format(since + timedelta(days=k))}" for k in range((until - since).days + 1)]


def kpi_samples(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(ts, vals, cpu_avg): malformed lines are dropped, unknown fields ignored, missing files skipped; files below the paths count, as micro-batches write them."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("ignoreMissingFiles", True).option("recursiveFileLookup", True).json(paths)


def local_days(since: datetime, until: datetime, zone: str) -> tuple[date, date]:
    """The first and the last day of a range of times, in a time zone; a range that runs backwards is turned round."""
    first, last = sorted(t.astimezone(ZoneInfo(zone)).date() for t in (since, until))
    return first, last


def parsed_lines(lines: DataFrame) -> DataFrame:
    """(file, ts, vals, cpu_avg, bad) of text lines (file, value): `bad` is the line if it isn't a sample, and then the rest is null.

    A line is malformed if it is no JSON object or a field has another type; unknown and missing fields are fine, and so are blank lines, which give no row.
    """
    parsed = F.from_json("value", f"{SCHEMA}, bad_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_"}).alias("s")
    rows = lines.where(F.length(F.trim("value")) > 0).select("file", "value", parsed)
    bad = F.col("s").isNull() | F.col("s.bad_").isNotNull()
    good = lambda c: F.when(~bad, F.col(f"s.{c}")).alias(c)
    return rows.select("file", good("ts"), good("vals"), good("cpu_avg"), F.when(bad, F.col("value")).alias("bad"))


def kpi_lines(spark: SparkSession, folder: str, since: datetime, until: datetime, zone: str = "UTC", name: str = "straggler_kpi_{}.jsonl") -> DataFrame:
    """parsed_lines of the files of the days from since to until, by the days of a time zone; days without a file are fine."""
    paths = day_files(folder, *local_days(since, until, zone), name)
    there = spark.read.option("ignoreMissingFiles", True)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    known = [p for p in paths if hadoop(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop(p))]
    if not known:
        return parsed_lines(spark.createDataFrame([], "file string, value string"))
    return parsed_lines(there.text(known).select(F.col("_metadata.file_name").alias("file"), "value"))


def scan_kpi_days(spark: SparkSession, folder: str, since: datetime, until: datetime, zone: str = "UTC", name: str = "straggler_kpi_{}.jsonl") -> tuple[DataFrame, DataFrame]:
    """(samples, malformed): the samples (ts, vals, cpu_avg) of a range of days, and how many lines of each file (file, n) were left out.

    A range without any sample is an error that names the folder and the days.
    """
    rows = kpi_lines(spark, folder, since, until, zone, name)
    samples = rows.where("bad is null").select("ts", "vals", "cpu_avg")
    if samples.isEmpty():
        first, last = local_days(since, until, zone)
        raise ValueError(f"no KPI samples in {folder} from {first} to {last}")
    return samples, rows.where("bad is not null").groupBy("file").agg(F.count("*").alias("n"))


def long_kpi(samples: DataFrame) -> DataFrame:
    """(ts_s, card, metric, value, ord): cards that are no whole numbers are dropped."""
    rows = samples.select(F.col("ts").alias("ts_s"), F.explode("vals").alias("card", "fields")).select("ts_s", F.col("card").try_cast("int").alias("card"), F.explode("fields").alias("metric", "value"))
    return rows.where("card is not null and value is not null").withColumn("ord", F.col("ts_s"))


def read_kpi_json(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return long_kpi(kpi_samples(spark, paths))


def read_kpi_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Cells are JSON objects of card to number (or text of one); columns are found by name, absent ones give no rows."""
    raw = spark.read.option("header", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(paths)
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.from_json(F.col(c), "map<string,string>").alias("cards")) for c, m in CSV_METRICS.items() if c in raw.columns])
    ts = F.coalesce(F.col("timestamp").try_cast("bigint"), F.unix_seconds(F.try_to_timestamp("timestamp")))
    rows = raw.select(ts.alias("ts_s"), F.explode(cells).alias("c")).select("ts_s", "c.metric", F.explode("c.cards").alias("card", "v"))
    rows = rows.select("ts_s", F.col("card").try_cast("int").alias("card"), "metric", F.col("v").try_cast("double").alias("value"), F.col("ts_s").alias("ord"))
    return rows.where("ts_s is not null and card is not null and value is not null")


def known_cards(kpi: DataFrame) -> DataFrame:
    """Cards that have a power or temperature value."""
    return kpi.where(F.col("metric").isin("power", "temp")).select("card").distinct()
