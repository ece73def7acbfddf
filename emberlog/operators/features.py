"""Behaviour features: trailing windows, first sights, five-minute window features, beacons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from .trailing import trailing


def rolling(logs: DataFrame, minutes: tuple[int, ...] = (5, 60)) -> DataFrame:
    """Logs, denials and bytes sent over the trailing minutes of each log's source and host, and the logs before it.

    Equal times count up to the log's own id.
    """
    plain = {f"{m}m": m for m in minutes}
    found = trailing(logs, plain)
    before = Window.partitionBy("source_id", "src_ip").orderBy("us", "log_id")
    prior = logs.filter("us is not null").select("log_id", (F.row_number().over(before) - 1).alias("prior_logs"))
    return found.select("log_id", *[F.col(f"{a}_{n}").alias(f"{b}_{n}") for n in plain for a, b in (("logs", "logs"), ("denied", "denied"), ("sent", "bytes"))]).join(prior, "log_id")


def first_sights(logs: DataFrame) -> DataFrame:
    """Whether a host uses a port or an application for the first time, and how often it did before."""
    by = lambda c: Window.partitionBy("source_id", "src_ip", c).orderBy("us", "log_id")
    app = logs.withColumn("app_name", P.lowered("app"))
    return app.select(
        "log_id",
        (F.row_number().over(by("dst_port")) - 1).alias("port_before"),
        (F.row_number().over(by("app_name")) - 1).alias("app_before"),
        (F.row_number().over(by("dst_port")) == 1).cast("int").alias("new_port"),
        (F.row_number().over(by("app_name")) == 1).cast("int").alias("new_app"),
    )


def _share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def window_features(logs: DataFrame, seconds: int = 300) -> DataFrame:
    """Features of each host in each fixed window, maxima over its targets and services included."""
    start = F.col("us") - F.pmod("us", F.lit(seconds * 1_000_000))
    rows = logs.filter("src_ip is not null and us is not null").withColumn("win", start)
    key = ["src_ip", "win"]
    main = rows.groupBy(*key).agg(
        F.count("*").alias("connections"),
        F.countDistinct("dst_ip").alias("targets"),
        F.countDistinct("dst_port").alias("services"),
        _share(F.col("denied")).alias("deny_share"),
        _share(F.coalesce("bytes_received", F.lit(0)) <= 0).alias("no_reply_share"),
        _share(F.coalesce("elapsed_time", F.lit(0)) <= 1).alias("short_share"),
        F.sum("bytes_sent").alias("sent"),
        F.sum("bytes_received").alias("received"),
        (F.sum("bytes_sent") / (F.sum("bytes_received") + 1)).alias("upload_ratio"),
        F.avg("packets").alias("mean_packets"),
    )
    by_host = rows.groupBy(*key, "dst_ip").agg(F.countDistinct("dst_port").alias("p"), F.count("*").alias("n")).groupBy(*key).agg(F.max("p").alias("most_ports_a_target"), F.max("n").alias("top_target"))
    by_port = rows.groupBy(*key, "dst_port").agg(F.countDistinct("dst_ip").alias("h")).groupBy(*key).agg(F.max("h").alias("most_targets_a_port"))
    both = main.join(by_host, key).join(by_port, key)
    return both.withColumn("top_target_share", F.col("top_target") / F.col("connections")).drop("top_target")


def beacons(logs: DataFrame, seconds: int, least: int = 4) -> DataFrame:
    """The steadiest target of each host and window: the lowest deviation of gaps over their mean."""
    start = F.col("us") - F.pmod("us", F.lit(seconds * 1_000_000))
    rows = logs.filter("src_ip is not null and dst_ip is not null").withColumn("win", start)
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy("src_ip", "win", "dst_ip").orderBy("us", "log_id"))) / 1e6
    by = rows.withColumn("gap", gap).groupBy("src_ip", "win", "dst_ip").agg(F.count("*").alias("connections"), F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("spread"))
    steady = by.filter((F.col("connections") >= least) & (F.col("mean_gap") > 0)).withColumn("cv", F.round(F.col("spread") / F.col("mean_gap"), 9))
    best = steady.groupBy("src_ip", "win").agg(F.min_by(F.struct("dst_ip", "connections", "cv"), F.struct("cv", "dst_ip")).alias("b"))
    return best.select("src_ip", "win", "b.*")


def prevalence(logs: DataFrame, seconds: int) -> DataFrame:
    """How many hosts a target has in each window."""
    start = F.col("us") - F.pmod("us", F.lit(seconds * 1_000_000))
    return logs.filter("dst_ip is not null").groupBy(start.alias("win"), "dst_ip").agg(F.countDistinct("src_ip").alias("hosts"))


def scan_score(ports: Column, targets: Column, deny_share: Column) -> Column:
    """How much like a scan a host's last minutes look, up to 100."""
    return F.least(F.lit(100), F.floor(ports * 4 + targets * 2 + deny_share * 30)).cast("int")


def calendar(ts: str) -> tuple[Column, Column]:
    """Hour of the day, and whether it is outside of 7 to 18 o'clock."""
    hour = F.hour(ts)
    return hour, ((hour < 7) | (hour >= 18)).cast("int")


def window_shares(logs: DataFrame, minutes: int = 5) -> DataFrame:
    """Per host and fixed window the features that plain aggregates give; means skip nulls, shares do not."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    step = minutes * 60_000_000
    rows = logs.filter("src_ip is not null and us is not null").withColumn("window", F.col("us") - F.pmod("us", F.lit(step)))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return rows.groupBy("src_ip", "window").agg(
        F.count("*").alias("n_logs"),
        F.countDistinct("dst_ip").alias("n_dst_ips"),
        F.countDistinct("dst_port").alias("n_dst_ports"),
        share(low("action").rlike("^(deny|drop|reset)")).alias("deny_share"),
        share(F.coalesce(F.col("bytes_received"), F.lit(0)) <= 0).alias("zero_reply_share"),
        F.avg("packets").alias("mean_packets"),
        F.max("packets").alias("max_packets"),
        F.sum("bytes_sent").alias("bytes_sent_total"),
        F.max("bytes_sent").alias("bytes_sent_max"),
        F.sum("bytes_received").alias("bytes_received_total"),
        (F.sum("bytes_sent") / (F.coalesce(F.sum("bytes_received"), F.lit(0)) + 1)).alias("upload_ratio"),
        F.avg("elapsed_time").alias("mean_elapsed"),
        share(F.coalesce(F.col("elapsed_time"), F.lit(0)) <= 1).alias("short_session_share"),
        share(low("app").isin(P.UNKNOWN_APPS)).alias("unknown_app_share"),
        F.max("app_risk").alias("max_app_risk"),
        share(F.coalesce(F.col("app_risk"), F.lit(0)) >= 4).alias("high_risk_share"),
        share(F.col("outbound")).alias("outbound_share"),
        share(F.col("inbound")).alias("inbound_share"),
        share(F.col("dst_port").isin(P.LOGIN_PORTS)).alias("auth_port_share"),
        share(F.col("dst_port").isNotNull() & ~F.col("dst_port").isin(P.COMMON_PORTS)).alias("uncommon_port_share"),
        F.count_if(F.upper(F.coalesce("log_type", F.lit(""))) == "THREAT").alias("threat_logs"),
        F.countDistinct("app").alias("n_apps"),
        share(P.is_file_sharing()).alias("p2p_share"),
    ).withColumn("src_is_private", P.is_private("src_ip").cast("double"))


def top_parts(logs: DataFrame, minutes: int = 5) -> DataFrame:
    """Per host and fixed window the share of its busiest target, and the logs of its busiest service."""
    step = minutes * 60_000_000
    rows = logs.filter("src_ip is not null and us is not null").withColumn("window", F.col("us") - F.pmod("us", F.lit(step)))
    by = rows.groupBy("src_ip", "window", "dst_ip", "dst_port").agg(F.count("*").alias("n"))
    hosts = by.groupBy("src_ip", "window", "dst_ip").agg(F.sum("n").alias("n"), F.max("n").alias("service"))
    known = F.when(F.col("dst_ip").isNotNull(), F.col("n"))
    return hosts.groupBy("src_ip", "window").agg((F.max(known) / F.sum("n")).alias("top_dst_share"), F.max("service").alias("top_service_logs"))
