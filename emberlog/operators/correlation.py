"""Correlation of each source's logs over fixed windows on two clock grids, and cadence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..sources.logs import micros


@dataclass(frozen=True)
class Config:
    """Lengths in seconds and thresholds; the defaults are those for firewall logs."""

    window: int = 300
    repeated_source: int = 25
    deny_burst: int = 5
    login_denials: int = 5
    scan_ports: int = 10
    scan_hosts: int = 10
    beacon_events: int = 6
    beacon_low: float = 5.0
    beacon_high: float = 300.0
    beacon_jitter: float = 0.25
    flood: int = 20
    high_volume: int = 100
    large_repeats: int = 3
    byte_threshold: float = 10e6
    packet_threshold: float = 50e3
    min_alert_score: int = 30
    low_evidence: int = 5


#: Columns that rules read and a log table may lack.
OPTIONAL = {"threat_name": "string", "category": "string", "app_category": "string", "app_technology": "string", "app_subcategory": "string", "app_characteristic": "string", "bytes": "long", "packets_received": "long", "session_end_reason": "string", "src_port": "int", "protocol": "string"}


def prepared(logs: DataFrame, cfg: Config = Config(), byte_bar: Column | None = None) -> DataFrame:
    """Logs with the columns that correlation and rules share; ``byte_bar`` replaces the configured byte threshold."""
    facts = {
        "us": micros("generated_time"),
        "weight": P.weight("repeat_count"),
        "denied": P.denied("action", *[c for c in ("subtype", "session_end_reason", "action_source") if c in logs.columns]),
        "inbound": P.inbound(),
        "outbound": P.outbound(),
    }
    out = logs.withColumns({n: F.lit(None).cast(kind) for n, kind in OPTIONAL.items() if n not in logs.columns}).withColumns(facts)
    return out.withColumn("large", F.coalesce((P.outbound_bytes() > (cfg.byte_threshold if byte_bar is None else byte_bar)) & F.col("outbound"), F.lit(False)))


def window_start(us: Column, length: int, offset: int = 0) -> Column:
    """Start, in microseconds, of the fixed window of ``length`` seconds on a grid moved by ``offset``."""
    return us - F.pmod(us - F.lit(offset * 1_000_000), F.lit(length * 1_000_000))


def members(logs: DataFrame, cfg: Config) -> DataFrame:
    """A row for each window a log is in: of both grids, and the window that ends where the log is."""
    half, step = cfg.window // 2, cfg.window * 1_000_000
    starts = [(g, window_start(F.col("us"), cfg.window, o)) for g, o in ((0, 0), (1, half))]
    one = [F.struct(F.lit(g).alias("grid"), s.alias("start")) for g, s in starts]
    edge = [F.when(F.col("us") == s, F.struct(F.lit(g).alias("grid"), (s - step).alias("start"))) for g, s in starts]
    return logs.withColumn("m", F.explode(F.array_compact(F.array(*one, *edge)))).select("*", "m.grid", "m.start").drop("m")


def _total(condition: Column | None = None) -> Column:
    w = F.col("weight") if condition is None else F.when(condition, F.col("weight")).otherwise(0)
    return F.sum(w).cast("long")


def snapshot(logs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Each log with the counts of its fuller window.

    ``logs`` are ``prepared``.  Logs without a source get no window and counts of 0; logs
    without a time are windows of their own.  The scope of every count is the log source.  Four aggregates of the members,
    each reduced before its shuffle, are joined back; a busy source's join is split by
    adaptive execution.
    """
    usable = logs.filter(F.col("src_ip").isNotNull() & (F.col("src_ip") != "") & F.col("us").isNotNull())
    slim = usable.select("log_id", "source_id", "src_ip", "dst_ip", "dst_port", "us", "weight", "denied", "large")
    m = members(slim, cfg)
    key = ["source_id", "src_ip", "grid", "start"]
    login = F.col("dst_port").isin(P.LOGIN_PORTS)
    whole = m.groupBy(*key).agg(
        _total().alias("source_count"),
        _total(F.col("denied")).alias("deny_count"),
        _total(F.col("denied") & login).alias("login_deny_count"),
        F.countDistinct("dst_port").alias("ports"),
        F.countDistinct("dst_ip").alias("hosts"),
    )
    # the fuller window of each log; of equally full ones that of the first grid, then the earlier
    order = F.struct(F.col("source_count"), -F.col("grid"), -F.col("start"))
    joined = m.join(whole, _same(key, m, whole)).select(m["*"], *[whole[c] for c in ("source_count", "deny_count", "login_deny_count", "ports", "hosts")])
    best = joined.groupBy("log_id").agg(F.max_by(F.struct("grid", "start", "source_count", "deny_count", "login_deny_count", "ports", "hosts"), order).alias("b"))
    chosen = slim.join(best, "log_id").select("log_id", "source_id", "src_ip", "dst_ip", "dst_port", "b.*")

    by_service = m.groupBy(*key, "dst_ip", "dst_port").agg(_total(F.col("dst_ip").isNotNull()).alias("dest_repeats"), F.count("dst_ip").alias("dest_events"), _total(F.col("denied") & login).alias("login_target_denials"))
    by_port = m.filter("dst_port is not null").groupBy(*key, "dst_port").agg(F.countDistinct("dst_ip").alias("hosts_for_port"), _total(F.col("denied")).alias("denials_for_port"))
    by_host = m.groupBy(*key, "dst_ip").agg(F.sum(F.col("large").cast("long")).alias("large_to_host"))
    for part, by in ((by_service, [*key, "dst_ip", "dst_port"]), (by_port, [*key, "dst_port"]), (by_host, [*key, "dst_ip"])):
        facts = [c for c in part.columns if c not in by]
        chosen = chosen.join(part, _same(by, chosen, part), "left").select(chosen["*"], *[part[c] for c in facts])
    counts = ["source_count", "deny_count", "login_deny_count", "ports", "hosts", "dest_repeats", "dest_events", "login_target_denials", "hosts_for_port", "denials_for_port", "large_to_host"]
    slim_counts = chosen.select("log_id", F.col("grid").alias("window_grid"), F.col("start").alias("window_start"), *counts)
    out = logs.join(slim_counts, "log_id", "left")
    # a log without a time is alone in its window
    alone = F.col("us").isNull() & F.col("src_ip").isNotNull() & (F.col("src_ip") != "")
    port, host = F.col("dst_port").isNotNull(), F.col("dst_ip").isNotNull()
    own = {"source_count": F.lit(True), "deny_count": F.col("denied"), "login_deny_count": F.col("denied") & login, "dest_repeats": host, "login_target_denials": F.col("denied") & login, "denials_for_port": F.col("denied") & port}
    facts = {c: F.when(cond, F.col("weight")).otherwise(0) for c, cond in own.items()} | {c: cond.cast("long") for c, cond in {"ports": port, "hosts": host, "dest_events": host, "hosts_for_port": host & port, "large_to_host": F.col("large")}.items()}
    return out.withColumns({c: F.coalesce(F.when(alone, facts[c]).otherwise(F.col(c)), F.lit(0)).cast("long") for c in counts})


def _same(columns: list[str], a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def cadence(logs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Regularity of each log's service: over its own, the prior and the next window.

    Returns log_id, beacon_events, beacon_repeats, intervals, mean_seconds and jitter
    (population deviation over mean) for logs with source, target, port and time.
    """
    rows = logs.filter("src_ip is not null and src_ip <> '' and dst_ip is not null and dst_port is not null and us is not null")
    rows = rows.select("log_id", "source_id", "src_ip", "dst_ip", "dst_port", "us", "weight", window_start(F.col("us"), cfg.window).alias("bucket"))
    step = cfg.window * 1_000_000
    key = ["source_id", "src_ip", "dst_ip", "dst_port", "bucket"]
    # equal times are one point of the rhythm
    points = rows.groupBy(*key, "us").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    near = points.withColumn("bucket", F.explode(F.array(*[F.col("bucket") + d * step for d in (-1, 0, 1)])))
    gap = (F.col("us") - F.lag("us").over(Window.partitionBy(*key).orderBy("us"))) / 1e6
    spans = near.withColumn("gap", gap).groupBy(*key).agg(
        F.sum("n").alias("beacon_events"), F.sum("w").alias("beacon_repeats"), F.count("gap").alias("intervals"), F.avg("gap").alias("mean_seconds"), F.stddev_pop("gap").alias("spread")
    )
    on = _same(key, rows, spans)
    jitter = F.when(F.col("mean_seconds") > 0, F.col("spread") / F.col("mean_seconds"))
    return rows.join(spans, on).select("log_id", "beacon_events", "beacon_repeats", "intervals", "mean_seconds", jitter.alias("jitter"))
