"""Cards that are abnormal against their own past and against their peers: scores, quadrants, causes and correlation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auklet.functions.scalars import quadrant, quadrant_order, severity, time_score
from auklet.operators.aggregates import baselines, bucket, counter_delta, midmean, trend
from auklet.session import settled

# Fixed values: (metric, category, how cards are compared, counter)
METRICS = [
    ("temp", "compute", "zscore", False),
    ("power", "compute", "zscore", False),
    ("aicore_freq", "compute", "direct", False),
    ("aicore_util", "compute", "zscore", False),
    ("hbm_util", "compute", "zscore", False),
    ("tx_bandwidth", "communication", "zscore", False),
    ("rx_pfc_pkt", "communication", "absolute", True),
    ("roce_tx_err_pkt", "communication", "absolute", True),
    ("roce_out_of_order", "communication", "absolute", True),
    ("roce_new_pkt_rty", "communication", "absolute", True),
]
# Rules, causes and confidences. Suggestions are this library's own; {n} is the number of abnormal metrics
CAUSES = [
    ("hot and slow", "thermal_throttle", "high", "The card slows down because it is hot: see to its fans, the air path and the room."),
    ("hot and drawing", "cooling_insufficient", "high", "Heat isn't carried off: look at the heat sink, its paste and the fans."),
    ("slow", "forced_downclock", "medium", "The clock is held down though the card is cool: compare driver and firmware settings with other cards."),
    ("idle", "straggler", "high", "The card waits for data or for its peers: profile the job to see which."),
    ("less used", "load_imbalance", "medium", "The card gets a share of work unlike the others': look at how data and model are split."),
    ("memory", "mem_bottleneck", "low", "Only its memory is used unlike the others': look at access patterns and cache misses."),
    ("hot alone", "temp_sensor_fault", "medium", "Hot without drawing more power: the sensor may be off, so compare it with another one."),
    ("power alone", "unknown", "low", "More power without heat or work: the meter may be off."),
    ("compute", "unknown", "medium", "{n} metrics of the card's work are abnormal, but no rule fits them: look at them together."),
    ("errors", "network_link_issue", "high", "Packets are damaged on the way: check module, fibre and the switch port's error counts."),
    ("pauses", "network_congestion", "high", "The network holds the card's traffic up: check flow control, queues and marking on the switch."),
    ("disorder", "network_packet_loss", "high", "Packets are lost and come out of order: check congestion settings along the path."),
    ("bandwidth", "bandwidth_limited", "medium", "The card sends at another rate than its peers: check link speed, the bus and the module."),
    ("communication", "unknown", "low", "Its traffic is abnormal, but no rule fits: look at the counters together."),
]
COUNTERS = [m for m, _, _, counter in METRICS if counter]


@dataclass(frozen=True)
class Settings:
    """bucket and detection window in seconds; thresholds; share of the time score in the fused one."""

    bucket_s: int = 60
    detect_s: int = 3600
    time_threshold: float = 1.24
    space_threshold: float = 1.30
    time_weight: float = 0.6
    trend_points: int = 10
    trend_r2: float = 0.6
    absent_is_zero: bool = False  # score a card that is absent at a time as 0, as if it were measured


def registry(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(m, c, how, k) for k, (m, c, how, _) in enumerate(METRICS)], "metric string, category string, method string, ord int"))


def minute_table(samples: DataFrame, s: Settings) -> DataFrame:
    """(bucket, card, metric, value): trimmed means of gauges and increments of counters."""
    rows = samples.withColumn("bucket", bucket(F.col("ts_s"), s.bucket_s))
    keys, counter = ["bucket", "card", "metric"], F.col("metric").isin(COUNTERS)
    return midmean(rows.where(~counter), keys).unionByName(counter_delta(rows.where(counter), keys, ["ts_s", "ord"]))


def windows(minute: DataFrame, s: Settings) -> DataFrame:
    """Adds `detect`: whether the bucket is within the detection window that ends at the newest bucket; all before is baseline."""
    minute = settled(minute)  # read for the newest bucket, and by what follows for the cards and both scores
    newest = minute.agg(F.max("bucket").alias("newest_"))  # one row
    return minute.join(F.broadcast(newest)).withColumn("detect", F.col("bucket") >= F.col("newest_") - s.detect_s).drop("newest_")


def space_points(detected: DataFrame, spark: SparkSession, s: Settings) -> DataFrame:
    """A score for each card, metric and time against the other cards at that time; 999 stands for plainly abnormal."""
    rows = detected
    if s.absent_is_zero:
        every = detected.select("card").distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m, *_ in METRICS])))
        grid = detected.select("bucket", "metric").distinct().join(every, "metric")
        rows = grid.join(detected, ["bucket", "metric", "card"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    rows = rows.join(registry(spark), "metric")
    w = Window.partitionBy("bucket", "metric")
    n, mean, std = F.count("value").over(w), F.avg("value").over(w), F.stddev_samp("value").over(w)
    rows = rows.withColumns({"n_": n, "mean_": mean, "std_": std, "least_": F.min("value").over(w), "k_": F.row_number().over(w.orderBy("value", "card"))})
    rows = rows.withColumn("second_", F.min(F.when(F.col("k_") > 1, F.col("value"))).over(w))
    others = F.when(F.col("k_") == 1, F.col("second_")).otherwise(F.col("least_"))
    z = F.when((F.col("n_") >= 2) & (F.col("std_") > 0), F.abs(F.col("value") - F.col("mean_")) / F.nullif(F.col("std_"), F.lit(0.0))).otherwise(0.0)
    direct = F.when(F.col("value") < others, 999.0).otherwise(0.0)
    absolute = F.when(F.col("value") > 0, 999.0).otherwise(0.0)
    score = F.when(F.col("method") == "zscore", z).when(F.col("method") == "direct", direct).otherwise(absolute)
    return rows.select("bucket", "card", "metric", "method", "value", score.alias("score"))


def iqr_points(detected: DataFrame) -> DataFrame:
    """999 for values outside the quartiles by more than one and a half interquartile ranges, by time and metric."""
    q = detected.groupBy("bucket", "metric").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q_"))
    rows = detected.join(q, ["bucket", "metric"])
    lo, hi = F.col("q_")[0], F.col("q_")[1]
    out = (F.col("value") < lo - 1.5 * (hi - lo)) | (F.col("value") > hi + 1.5 * (hi - lo))
    return rows.select("bucket", "card", "metric", "value", F.when(out, 999.0).otherwise(0.0).alias("score"))


def space_scores(points: DataFrame, s: Settings) -> DataFrame:
    """By card and metric: the mean score of z-scored metrics, the share of plainly abnormal times of the others."""
    got = points.groupBy("card", "metric", "method").agg(F.avg("score").alias("mean_"), F.avg((F.col("score") >= 999).cast("double")).alias("share_"))
    z = F.col("method") == "zscore"
    return got.select("card", "metric", F.when(z, F.col("mean_")).otherwise(F.col("share_")).alias("space_score"), F.when(z, F.col("mean_") > s.space_threshold).otherwise(F.col("share_") > 0.5).alias("space_abnormal"))


def time_scores(split: DataFrame, s: Settings) -> DataFrame:
    """By card and metric: how far the detection window's mean is from the card's own baseline; 0 without two baseline points."""
    base = baselines(split.where(~F.col("detect")), ["card", "metric"]).select("card", "metric", "n", "mean", "std")
    now = split.where("detect").groupBy("card", "metric").agg(F.avg("value").alias("current"))
    rows = now.join(base, ["card", "metric"], "left")
    score = F.when(F.coalesce("n", F.lit(0)) >= 2, time_score(F.col("current") - F.col("mean"), F.col("std"))).otherwise(0.0)
    return rows.select("card", "metric", "current", score.alias("time_score"), (score > s.time_threshold).alias("time_abnormal"))


def trends(split: DataFrame, s: Settings) -> DataFrame:
    """Lines through all buckets that are long, clear and not level; slope per second."""
    got = trend(split, ["card", "metric"], "bucket", "value")
    return got.where((F.col("n") >= s.trend_points) & (F.col("r2") >= s.trend_r2) & (F.col("slope") != 0))


def details(split: DataFrame, spark: SparkSession, s: Settings) -> DataFrame:
    """Every known card (one that has power or temperature) with every metric: both scores, the fused one and the quadrant."""
    cards = split.where(F.col("metric").isin("power", "temp")).select("card").distinct()
    grid = cards.join(registry(spark))
    space = space_scores(space_points(split.where("detect"), spark, s), s)
    rows = grid.join(space, ["card", "metric"], "left").join(time_scores(split, s), ["card", "metric"], "left")
    zero, no = F.lit(0.0), F.lit(False)
    rows = rows.select("card", "metric", "category", "ord", *[F.coalesce(c, zero).alias(c) for c in ("space_score", "time_score")], *[F.coalesce(c, no).alias(c) for c in ("space_abnormal", "time_abnormal")])
    fused = s.time_weight * F.col("time_score") + (1 - s.time_weight) * F.col("space_score")
    return rows.withColumns({"fusion_score": fused, "quadrant": quadrant(F.col("space_abnormal"), F.col("time_abnormal"))})


def summaries(detail: DataFrame) -> DataFrame:
    """By card: category, what is abnormal, worst quadrant, composite score, severity and root cause.

    An abnormal compute metric makes the card's category compute; its communication metrics are then secondary.
    """
    bad = F.col("space_abnormal") | F.col("time_abnormal")
    flags = detail.withColumn("bad_", bad).withColumn("compute_", F.bool_or(bad & (F.col("category") == "compute")).over(Window.partitionBy("card")))
    main = F.col("bad_") & ((F.col("category") == "compute") | ~F.col("compute_"))
    has = {m: F.bool_or(F.col("bad_") & (F.col("metric") == m)).alias(f"b_{m}") for m, *_ in METRICS}
    listed = lambda cond, *c: F.sort_array(F.collect_list(F.when(cond, F.struct("ord", "metric", *c))))
    names = lambda cond: F.transform(listed(cond), lambda x: x["metric"])
    evidence = F.transform(listed(main, F.col("quadrant").alias("of")), lambda x: F.concat(x["metric"], F.lit(":"), x["of"]))
    got = flags.groupBy("card").agg(
        F.bool_or("compute_").alias("compute"),
        F.bool_or(bad).alias("any_"),
        names(main).alias("abnormal"),
        evidence.alias("evidence"),
        names(F.col("bad_") & F.col("compute_") & (F.col("category") == "communication")).alias("secondary"),
        F.coalesce(F.min(F.when(main, quadrant_order(F.col("quadrant")))), F.lit(3)).alias("order_"),
        F.coalesce(F.avg(F.when(main, F.col("fusion_score"))), F.lit(0.0)).alias("composite"),
        *has.values(),
    )
    got = got.withColumn("quadrant", F.when(F.col("order_") == 0, "confirmed_anomaly").when(F.col("order_") == 1, "early_degradation").when(F.col("order_") == 2, "individual_variance").otherwise("normal"))
    got = got.withColumn("category", F.when(F.col("compute"), "compute").when(F.col("any_"), "communication").otherwise("none"))
    cause = root_cause()
    text = lambda c: F.array_join(c, ",").alias(c)
    got = got.withColumns({"severity": severity(F.col("quadrant"), F.col("composite")), "cause_": F.when(F.col("quadrant") != "normal", cause)})
    suggestion = F.replace(F.col("cause_.suggestion"), F.lit("{n}"), F.size("abnormal").cast("string"))
    return got.select("card", "category", "quadrant", "composite", "severity", text("abnormal"), text("secondary"), "cause_.cause", "cause_.confidence", suggestion.alias("suggestion"), F.when(F.col("quadrant") != "normal", text("evidence")).alias("evidence"))


def root_cause():
    """(cause, confidence, suggestion) of the first rule that fits the card's abnormal metrics."""
    t, p, f, u, h = (F.col(f"b_{m}") for m in ("temp", "power", "aicore_freq", "aicore_util", "hbm_util"))
    e, pfc, ooo, rty, tx = (F.col(f"b_{m}") for m in ("roce_tx_err_pkt", "rx_pfc_pkt", "roce_out_of_order", "roce_new_pkt_rty", "tx_bandwidth"))
    of = {rule: F.struct(F.lit(cause).alias("cause"), F.lit(sure).alias("confidence"), F.lit(advice).alias("suggestion")) for rule, cause, sure, advice in CAUSES}
    compute = F.when(t & f, of["hot and slow"]).when(t & p, of["hot and drawing"]).when(f, of["slow"]).when(p & u & h, of["idle"]).when(u & ~h, of["less used"]).when(h & ~u, of["memory"])
    compute = compute.when(t & ~p, of["hot alone"]).when(p & ~u, of["power alone"]).otherwise(of["compute"])  # u and h go together from here on
    link = F.when(e, of["errors"]).when(pfc, of["pauses"]).when(ooo & rty, of["disorder"]).when(tx & ~u, of["bandwidth"]).otherwise(of["communication"])
    return F.when(F.col("compute"), compute).otherwise(link)


def ranked(summary: DataFrame) -> DataFrame:
    """Worst quadrant first, then by composite score."""
    return summary.orderBy(quadrant_order(F.col("quadrant")), F.desc("composite"), "card")


def counts(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("cards"), *[F.count_if(F.col("quadrant") == q).alias(q) for q in ("confirmed_anomaly", "early_degradation", "individual_variance", "normal")])


def correlation(summary: DataFrame) -> DataFrame:
    """One row where cards are confirmed abnormal: whether that is the whole job or single cards."""
    bad = F.col("quadrant") == "confirmed_anomaly"
    got = summary.agg(F.count_if(bad).alias("n"), F.count("*").alias("total"), F.array_join(F.sort_array(F.collect_list(F.when(bad, F.col("card")))).cast("array<string>"), ",").alias("cards"))
    job = (F.col("n") == F.col("total")) & (F.col("total") > 1)
    kind, sure = F.when(job, "job_level").otherwise("card_level"), F.when(job | (F.col("n") > 1), "medium").otherwise("high")
    return got.where("n > 0").select(kind.alias("type"), sure.alias("confidence"), "n", "total", "cards")


def gate(summary: DataFrame) -> DataFrame:
    """(confirmed): whether any card is confirmed abnormal, so that ranks are worth looking into."""
    return summary.agg(F.coalesce(F.bool_or(F.col("quadrant") == "confirmed_anomaly"), F.lit(False)).alias("confirmed"))


def events(summary: DataFrame) -> DataFrame:
    """The event that each card which isn't normal gives rise to."""
    level = F.when(F.col("quadrant") == "confirmed_anomaly", "critical").when(F.col("quadrant") == "individual_variance", "info").otherwise("warning")
    eid = F.sha2(F.concat_ws("/", F.lit("straggler_detected"), F.col("card").cast("string"), "quadrant"), 256)
    return summary.where("quadrant <> 'normal'").select(F.substring(eid, 1, 16).alias("event_id"), F.lit("straggler_detected").alias("type"), F.col("card").cast("string").alias("npu_id"), level.alias("severity"), "quadrant", "cause")
