"""Reports over logs and alerts: lists, top values, quality, rollups, cases, exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import addresses as AD
from ..functions import predicates as P
from ..sources.logs import micros


def search(logs: DataFrame, text: str | None = None, country: str | None = None, **equal) -> DataFrame:
    """Logs with ``text`` in one of their names or addresses, and columns equal to given values."""
    out = logs
    if text:
        hit = F.lit(False)
        for c in ("src_ip", "dst_ip", "app", "action", "src_zone", "dst_zone", "log_type", "subtype"):
            if c in logs.columns:
                hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        out = out.filter(hit)
    if country:
        out = out.filter((F.col("src_country") == country) | (F.col("dst_country") == country))
    for name, value in equal.items():
        out = out.filter(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return out


def page(df: DataFrame, by: str, descending: bool, tie: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of a list: ascending has nulls first, descending last; ties by ``tie`` in the same direction."""
    order = [F.desc_nulls_last(by), F.desc(tie)] if descending else [F.asc_nulls_first(by), F.asc(tie)]
    return df.orderBy(*order).offset(offset).limit(limit)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, null left out, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and for each column the rows in which it is missing or empty, in one pass."""
    return df.agg(F.count("*").alias("logs"), *[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"missing_{c}") for c in columns])


def traffic_profile(logs: DataFrame) -> DataFrame:
    deny = F.lower("action").isin("deny", "drop")
    calm = (F.lower("action") == "allow") & (F.coalesce("app_risk", F.lit(0)) <= 3) & ~P.lowered("app").isin([*P.UNRESOLVED_APPS, ""])
    return logs.agg(
        F.count("*").alias("logs"),
        F.count_if(F.lower("action") == "allow").alias("allowed"),
        F.count_if(deny).alias("denied"),
        F.count_if(F.col("app_risk") >= 4).alias("risky"),
        F.count_if(P.lowered("app").isin(P.UNRESOLVED_APPS)).alias("unresolved_app"),
        F.count_if(F.col("log_type") == "THREAT").alias("threats"),
        F.count_if(calm).alias("baseline_candidates"),
        F.countDistinct("src_ip").alias("sources"),
        F.min("generated_time").alias("first_seen"),
        F.max("generated_time").alias("last_seen"),
    )


def hourly(logs: DataFrame) -> DataFrame:
    """One row an hour, log source and host: connections, denials, bytes, distinct targets and ports."""
    return logs.filter(F.col("src_ip").isNotNull()).groupBy(F.date_trunc("hour", "generated_time").cast("timestamp_ntz").alias("hour_start"), "source_id", "src_ip").agg(
        F.count("*").alias("connections"),
        F.count_if(P.denied("action")).alias("denied"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"),
        F.coalesce(F.sum("bytes_received"), F.lit(0)).alias("bytes_received"),
        F.countDistinct("dst_ip").alias("destinations"),
        F.countDistinct("dst_port").alias("destination_ports"),
        F.min("generated_time").alias("first_seen"),
        F.max("generated_time").alias("last_seen"),
    )


def windows_available(logs: DataFrame, minutes: int = 5) -> DataFrame:
    return logs.groupBy(F.window("generated_time", f"{minutes} minutes").alias("w")).agg(F.count("*").alias("logs")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "logs")


def daily(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.date_format("generated_time", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("logs"), F.count_if(P.denied("action")).alias("denied"))


def newest(rows: DataFrame, key: str, n: int, span: int = 1 << 20) -> DataFrame:
    """The n rows of largest ``key`` (whole numbers, a key of the rows), without sorting them all.

    Counts by stretches of ``span`` keys find the stretch in which the n-th row lies; only
    that stretch, which has at most ``span`` rows, is put in order.
    """
    part = F.floor(F.col(key) / span)
    down = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") - F.col("n") < n).agg(F.min("part").alias("edge"), F.max_by(F.col("upto") - F.col("n"), F.col("upto")).alias("above"))
    cut = rows.filter(part >= edge.select("edge").scalar())
    last = cut.filter(part == edge.select("edge").scalar()).withColumn("_row", F.row_number().over(Window.orderBy(F.desc(key)))).filter(F.col("_row") <= n - edge.select("above").scalar()).drop("_row")
    return cut.filter(part > edge.select("edge").scalar()).unionByName(last)


def outlier_thresholds(logs: DataFrame, floor_bytes: float = 10e6, floor_packets: float = 50e3, newest_logs: int | None = None) -> DataFrame:
    """Mean plus three population deviations of bytes and packets, no less than the floors; the floors for under ten logs.

    Session starts have no sizes yet and are left out.  ``newest_logs`` bounds the logs
    that count to those of the largest ids.
    """

    def level(c: str, floor: float) -> Column:
        spread = F.sqrt(F.greatest(F.avg(F.col(c) * F.col(c)) - F.avg(c) * F.avg(c), F.lit(0.0)))
        return F.when(F.count(c) >= 10, F.greatest(F.avg(c) + 3 * spread, F.lit(floor))).otherwise(F.lit(floor))

    rows = logs.filter(F.coalesce("subtype", F.lit("")) != "start").select("log_id", F.col("bytes").cast("double").alias("b"), F.col("packets").cast("double").alias("p"))
    rows = newest(rows, "log_id", newest_logs) if newest_logs else rows
    return rows.agg(F.count("*").alias("logs"), level("b", floor_bytes).alias("byte_threshold"), level("p", floor_packets).alias("packet_threshold"))


def indicator_hits(logs: DataFrame, watch: DataFrame, fields: list[str], small: int = 100_000) -> DataFrame:
    """Watched values in any of the fields: log_id, best boost and what was seen.

    ``watch`` has indicator_type, value and boost.  Values with a slash are blocks of
    addresses: each distinct address of the field gets the longest block that holds it,
    and with it all blocks around that one.  The list is broadcast if it has at most
    ``small`` rows, else joined by a shuffle.
    """
    watch = watch.select("indicator_type", P.lowered("value").alias("value"), "boost").withColumn("value", F.trim("value"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("indicator_type"), P.lowered(f).alias("value")) for f in fields]))
    rows = logs.select("log_id", each.alias("e")).select("log_id", "e.*")
    blocks = AD.parsed_blocks(watch.filter(F.col("value").contains("/")), "value")
    if watch.count() <= small:
        watch = F.broadcast(watch)
    direct = rows.join(watch, ["indicator_type", "value"]).select("log_id", "boost", F.concat_ws("=", "indicator_type", "value").alias("hit"))
    if not watch.filter(F.col("value").contains("/")).limit(1).count():
        return direct.groupBy("log_id").agg(*_best())
    held = AD.longest_block(rows.filter(F.col("indicator_type").endswith("_ip")), "value", blocks).filter("block is not null").join(AD.enclosing(blocks), "block").select("value", F.col("outer").alias("listed"))
    within = rows.join(held, "value").join(watch.withColumnRenamed("value", "listed"), ["indicator_type", "listed"]).select("log_id", "boost", F.concat_ws("=", "indicator_type", "listed").alias("hit"))
    return direct.unionByName(within).groupBy("log_id").agg(*_best())


def _best() -> list[Column]:
    return [F.max("boost").alias("boost"), F.array_join(F.array_sort(F.collect_set("hit")), ",").alias("seen")]


#: Connections that are steady by design: ports and applications of name lookups, clocks and probes.
STEADY_PORTS = [53, 123, 853]
STEADY_APPS = ["dns", "dns-base", "dns-over-tls", "ntp", "ping", "icmp", "traceroute", "snmp"]


def is_lasting_candidate() -> Column:
    """An inside host's TCP or UDP connection to a public address, other than steady-by-design traffic."""
    fine = P.lowered("protocol").isin("tcp", "udp") & P.outbound() & P.is_global("dst_ip") & (F.coalesce("src_ip", F.lit("")) != "")
    return fine & ~F.coalesce(F.col("dst_port").isin(STEADY_PORTS), F.lit(False)) & ~P.lowered("app").isin(STEADY_APPS)


def persistent_contacts(batch: DataFrame, stored: DataFrame, batch_connections: int = 12, connections: int = 120, windows: int = 6, users: int = 5, minutes: int = 5, lookback_minutes: int = 60) -> DataFrame:
    """Outside hosts that few hosts talk to and one talks to again and again: dst_ip, src_ip, connections, windows, users.

    ``batch`` are the logs now judged; its busy pairs name the outside hosts that are
    looked at.  ``stored`` are all logs, the batch included, of which the
    ``lookback_minutes`` that end with the batch's last window count; the end is read as a
    scalar, so a time-partitioned store is pruned.  Users are all hosts with session
    records to the target.
    """
    step = minutes * 60_000_000
    us = lambda: micros("generated_time")
    busy = batch.filter(is_lasting_candidate()).groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n")).filter(F.col("n") >= batch_connections).select("dst_ip").distinct()
    end = batch.agg(F.max(us()).alias("e")).select((F.col("e") - F.pmod("e", F.lit(step)) + step).alias("end")).scalar()
    hour = stored.filter((us() >= end - lookback_minutes * 60_000_000) & (us() < end) & (F.col("log_type") == "TRAFFIC") & (F.coalesce("subtype", F.lit("")) != "start")).join(busy, "dst_ip")
    rare = hour.groupBy("dst_ip").agg(F.countDistinct("src_ip").alias("users")).filter(F.col("users") <= users)
    pair = hour.filter(is_lasting_candidate()).groupBy("dst_ip", "src_ip").agg(F.count("*").alias("connections"), F.countDistinct(us() - F.pmod(us(), F.lit(step))).alias("windows"))
    return pair.filter((F.col("connections") >= connections) & (F.col("windows") >= windows)).join(rare, "dst_ip")


#: Alert states by rank, the highest first.
STATE_RANKS = ["open", "needs_more_context", "investigating", "contained", "resolved", "false_positive"]


def cases(alerts: DataFrame, hours: int = 24) -> DataFrame:
    """Alerts of one source, target, attack type and span of hours of a day.

    ``alerts`` have src_ip, dst_ip (null where they have several), attack_type, created_us,
    status, score, evidence, primary, first_us and last_us.  The state is the highest of
    its alerts' by STATE_RANKS; ids are the start of a digest of the key.
    """
    day = F.col("created_us") - F.pmod("created_us", F.lit(86_400_000_000))
    bucket = day + F.floor((F.col("created_us") - day) / (hours * 3_600_000_000)) * (hours * 3_600_000_000)
    src, dst = F.coalesce("src_ip", F.lit("unknown-source")), F.coalesce("dst_ip", F.lit("any-destination"))
    stamp = F.date_format(F.timestamp_micros(bucket), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    rank = P.lookup({s: len(STATE_RANKS) - 1 - i for i, s in enumerate(STATE_RANKS)}, F.col("status"), 0)
    rows = alerts.select("*", src.alias("_src"), dst.alias("_dst"), bucket.alias("_bucket"), rank.alias("_rank"))
    return rows.withColumn("case_id", F.substring(F.sha1(F.concat_ws("|", "_src", "_dst", "attack_type", stamp)), 1, 12)).groupBy("case_id").agg(
        F.first("_src").alias("source"), F.first("_dst").alias("target"), F.first("attack_type").alias("attack_type"), F.first("_bucket").alias("bucket_us"),
        F.count("*").alias("alerts"), F.max("score").alias("score"), F.sum("evidence").alias("evidence"), F.countDistinct("primary").alias("kinds"),
        F.get(F.array(*map(F.lit, STATE_RANKS[::-1])), F.max("_rank")).alias("status"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    )


def top_per_group(df: DataFrame, group: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group, ties by value."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))).filter(F.col("place") <= n)


def due(severity: str = "severity", created: str = "first_us", as_of_us: int = 0) -> tuple[Column, Column]:
    """When an alert is due, in microseconds, and its state at ``as_of_us``."""
    hours = F.when(F.col(severity) == "Critical", 1).when(F.col(severity) == "High", 24).when(F.col(severity) == "Medium", 72).otherwise(168).cast("long")
    at = F.col(created) + hours * 3_600_000_000
    left = at - F.lit(as_of_us)
    return at, F.when(left < 0, "overdue").when(left <= hours * 900_000_000, "due_soon").otherwise("on_track")


def first_rows(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_row = 1").drop("_row")


def feed_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What a new feed does to the stored one: added, reactivated, disabled or unchanged."""
    o, n = old.select(key, F.col("active").alias("was")), new.select(key).distinct().withColumn("now", F.lit(True))
    both = o.join(n, key, "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNotNull() & ~F.col("was"), "reactivated").when(F.col("now").isNull() & F.col("was"), "disabled").otherwise("unchanged")
    return both.select(key, state.alias("change"))
