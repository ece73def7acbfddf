"""Detection rules as columns, and what follows from their matches on a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .alerts import MOST_SPECIFIC, attack_type
from .correlation import Config, cadence, prepared, snapshot

# Rule codes, priorities and kinds of evidence.
PRIORITIES = {
    "paloalto_malware_threat": 101,
    "possible_port_scan": 100,
    "possible_horizontal_scan": 99,
    "connection_flood_suspicion": 98,
    "brute_force_like_attempts": 97,
    "beaconing_like_outbound": 96,
    "multiple_denied_connections": 95,
    "paloalto_threat_log": 90,
    "watchlist_match": 88,
    "deny_drop_action": 80,
    "app_risk_5": 75,
    "app_risk_4": 70,
    "suspicious_app_characteristic": 65,
    "repeated_source_ip": 60,
    "unusual_destination_port": 55,
    "unknown_or_incomplete_app": 50,
    "outside_to_inside": 40,
    "high_outbound_bytes": 38,
    "repeated_large_outbound": 37,
    "high_bytes_outlier": 35,
    "high_packets_outlier": 35,
    "paloalto_threat_informational": 5,
}
SUPPORTING_ONLY = ["app_risk_4", "paloalto_threat_informational", "suspicious_app_characteristic", "repeated_source_ip", "outside_to_inside", "high_bytes_outlier", "high_packets_outlier"]
CONTEXT_ONLY = ["outside_to_inside", "unusual_destination_port", "unknown_or_incomplete_app"]
APP_RISK_RULES = ["app_risk_4", "app_risk_5", "suspicious_app_characteristic"]
MALICIOUS_EVIDENCE = ["paloalto_threat_log", "paloalto_malware_threat", "brute_force_like_attempts", "watchlist_match"]
TO_HOST = ["beaconing_like_outbound", "connection_flood_suspicion"]
BY_PORT = ["deny_drop_action", "unusual_destination_port", "brute_force_like_attempts", "possible_horizontal_scan", *TO_HOST]
#: Rules about several logs of a window: their groups go by the window that correlation chose.
BY_WINDOW = ["possible_port_scan", "possible_horizontal_scan", *TO_HOST]
BY_APP = ["paloalto_threat_log", "paloalto_malware_threat", *APP_RISK_RULES, "beaconing_like_outbound"]
#: Place of a watchlist match: after all rules of ``conditions``.
WATCHLIST_PLACE = 21
#: Limits of what the internet sends to every network all day.
PROBE_HOSTS, PROBE_PORTS, PROBE_CONNECTIONS = 9, 4, 20
THREAT_SCORES = {"informational": 10, "info": 10, "low": 20, "medium": 30, "high": 40, "critical": 45}
BLOCKED_CAPS = {"informational": 30, "info": 30, "low": 30, "medium": 60, "high": 80, "critical": 80}


def conditions(cfg: Config, byte_bar: Column | None = None, packet_bar: Column | None = None) -> list[tuple[str, Column, Column]]:
    """(code, condition, score) in order of evaluation, over ``snapshot`` and ``cadence`` columns.

    The bars of outliers are those of the configuration unless they are given.
    """
    c = F.col
    byte_bar = F.lit(cfg.byte_threshold) if byte_bar is None else byte_bar
    packet_bar = F.lit(cfg.packet_threshold) if packet_bar is None else packet_bar
    threat = F.coalesce(F.upper("log_type") == "THREAT", F.lit(False))
    malware, informational = P.is_malware(), P.is_informational()
    rated = P.lookup(THREAT_SCORES, P.lowered("threat_severity"), 30)
    unresolved = P.lowered("app").isin(P.UNRESOLVED_APPS)
    odd_port = c("dst_port").isNotNull() & ~c("dst_port").isin(P.COMMON_PORTS)
    own_session = P.is_ftp_data()
    scan_context = c("inbound") | unresolved
    vendor_scan, vendor_flood = threat & (P.lowered("subtype") == "scan"), threat & P.lowered("subtype").isin("flood", "packet")
    large = F.coalesce((P.outbound_bytes() > byte_bar) & c("outbound"), F.lit(False))
    regular = (c("beacon_events") >= cfg.beacon_events) & (c("intervals") >= cfg.beacon_events - 1) & c("mean_seconds").between(cfg.beacon_low, cfg.beacon_high) & (c("jitter") <= cfg.beacon_jitter)
    high_signal = (c("app_risk") >= 5) & (F.size(P.risky_traits(P.HIGH_SIGNAL_TRAITS)) > 0)
    very_high = (c("dest_repeats") >= cfg.high_volume) & (c("inbound") | P.unanswered(c("denied")))
    points = lambda n: F.lit(n)
    return [
        ("deny_drop_action", c("denied"), points(25)),
        ("paloalto_malware_threat", threat & malware, rated + 10),
        ("paloalto_threat_informational", informational, rated),
        ("paloalto_threat_log", threat & ~malware & ~informational, rated),
        ("app_risk_4", c("app_risk") == 4, points(15)),
        ("app_risk_5", c("app_risk") >= 5, points(25)),
        ("suspicious_app_characteristic", F.size(P.risky_traits(P.SUSPICIOUS_TRAITS)) > 0, points(15)),
        ("outside_to_inside", c("inbound"), points(15)),
        ("repeated_source_ip", c("source_count") >= cfg.repeated_source, points(20)),
        ("multiple_denied_connections", c("deny_count") >= cfg.deny_burst, points(20)),
        ("brute_force_like_attempts", c("login_target_denials") >= cfg.login_denials, points(30)),
        ("possible_port_scan", (c("ports") >= cfg.scan_ports) & ((c("deny_count") >= cfg.deny_burst) | scan_context | vendor_scan) & ~own_session, points(25)),
        ("possible_horizontal_scan", (c("hosts_for_port") >= cfg.scan_hosts) & ((c("denials_for_port") >= cfg.deny_burst) | scan_context | c("dst_port").isin(P.REMOTE_ADMIN_PORTS)) & ~own_session, points(25)),
        ("beaconing_like_outbound", (c("beacon_repeats") >= cfg.beacon_events) & regular & c("outbound") & (odd_port | unresolved | threat | F.coalesce(high_signal, F.lit(False))), points(30)),
        ("connection_flood_suspicion", very_high | ((c("dest_repeats") >= cfg.flood) & (c("denied") | vendor_flood)), points(35)),
        ("unusual_destination_port", odd_port & c("inbound") & ~own_session, points(10)),
        ("high_outbound_bytes", large, points(35)),
        ("repeated_large_outbound", large & (c("large_to_host") >= cfg.large_repeats), points(20)),
        ("unknown_or_incomplete_app", unresolved | (P.lowered("app_category") == "unknown"), points(10)),
        ("high_bytes_outlier", ~large & (c("bytes") > byte_bar), points(20)),
        ("high_packets_outlier", c("packets") > packet_bar, points(20)),
    ]


def evaluate(logs: DataFrame, cfg: Config = Config(), bars: DataFrame | None = None) -> DataFrame:
    """Logs with their counts and ``matches``, an array of (code, score, priority, place).

    ``log_id`` must be a key of the logs: counts are joined back by it.  ``bars`` is the
    one row (byte_threshold, packet_threshold) of ``reports.outlier_thresholds``, read as
    a scalar; without it the configuration's thresholds count.
    """
    byte_bar, packet_bar = (None, None) if bars is None else (bars.select(c).scalar() for c in ("byte_threshold", "packet_threshold"))
    rows = prepared(logs, cfg, byte_bar)
    rows = snapshot(rows, cfg).join(cadence(rows, cfg), "log_id", "left")
    found = [F.when(cond, F.struct(F.lit(code).alias("code"), score.cast("int").alias("score"), F.lit(PRIORITIES.get(code, 0)).alias("priority"), F.lit(i).alias("place"))) for i, (code, cond, score) in enumerate(conditions(cfg, byte_bar, packet_bar))]
    return rows.withColumn("matches", F.array_compact(F.array(*found)))


def with_watchlist(matched: DataFrame, hits: DataFrame) -> DataFrame:
    """Matches with ``watchlist_match`` for logs that hit indicators (log_id, boost): the largest boost counts."""
    best = hits.groupBy("log_id").agg(F.max("boost").cast("int").alias("_boost"))
    found = F.when(F.col("_boost").isNotNull(), F.struct(F.lit("watchlist_match").alias("code"), F.col("_boost").alias("score"), F.lit(PRIORITIES["watchlist_match"]).alias("priority"), F.lit(WATCHLIST_PLACE).alias("place")))
    return matched.join(best, "log_id", "left").withColumn("matches", F.array_compact(F.array_append("matches", found))).drop("_boost")


def without_expected(matched: DataFrame, expected: DataFrame) -> DataFrame:
    """Sweep rules go where the service (address, port, protocol) is meant to be public.

    They stay if another rule that is not merely supporting matches.  ``expected`` has at
    most one row a service and is small, as people list it; it is joined by its key.
    """
    service = expected.select(F.col("address").alias("dst_ip"), F.col("port").cast("int").alias("dst_port"), F.lower("protocol").alias("_protocol"), F.lit(True).alias("_expected")).distinct()
    rows = matched.withColumn("_protocol", P.lowered("protocol")).join(service, ["dst_ip", "dst_port", "_protocol"], "left")
    others = F.filter("matches", lambda m: ~m["code"].isin(CONTEXT_ONLY))
    flags = F.exists(others, lambda m: ~m["code"].isin(SUPPORTING_ONLY))
    return rows.withColumn("matches", F.when(F.coalesce("_expected", F.lit(False)) & ~flags, others).otherwise(F.col("matches"))).drop("_expected", "_protocol").select(*matched.columns)


def policy_only(matched: DataFrame) -> Column:
    """Why a log raises no alert though rules match: ``file_sharing``, ``background_probe`` or null.

    File sharing needs evidence of malice, background probing that or repeated denials.
    """
    triggers = F.filter("matches", lambda m: ~m["code"].isin(SUPPORTING_ONLY))
    malice = F.exists(triggers, lambda m: m["code"].isin(MALICIOUS_EVIDENCE))
    more = malice | F.exists(triggers, lambda m: m["code"] == "multiple_denied_connections")
    small = (F.col("source_count") > 0) & (F.col("hosts") <= PROBE_HOSTS) & (F.col("ports") <= PROBE_PORTS) & (F.col("source_count") <= PROBE_CONNECTIONS)
    probe = P.from_internet() & P.unanswered(F.col("denied")) & small
    return F.when(P.is_file_sharing() & ~malice, "file_sharing").when(probe & ~more, "background_probe")


def candidates(matched: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Logs that may raise an alert: score, severity and primary rule.

    Supporting rules add points but raise nothing alone.  A blocked threat from outside
    that is not malware scores no more than the firewall's own rating allows.
    """
    triggers = F.filter("matches", lambda m: ~m["code"].isin(SUPPORTING_ONLY))
    total = P.clamped(F.aggregate("matches", F.lit(0), lambda s, m: s + m["score"]))
    blocked = (F.upper("log_type") == "THREAT") & F.col("denied") & P.from_internet() & ~P.is_malware()
    cap = F.when(blocked, F.create_map(*[F.lit(x) for p in BLOCKED_CAPS.items() for x in p])[P.lowered("threat_severity")])
    first = F.array_max(F.transform(triggers, lambda m: F.struct(m["priority"], m["score"], (-m["place"]).alias("before"), m["code"])))
    out = matched.withColumn("score", F.least(total, F.coalesce(cap, F.lit(100)))).withColumn("capped", cap.isNotNull()).withColumn("primary", first["code"])
    alerting = (F.size(triggers) > 0) & (F.col("score") >= cfg.min_alert_score) & policy_only(matched).isNull()
    return out.filter(alerting).withColumn("severity", P.severity("score"))


#: What makes a group.  ``bucket`` is a time's floor or, for rules of BY_WINDOW, the start of the chosen window;
#: ``lone`` tells apart logs without a time, which are windows of their own.
GROUP_KEY = ["source_id", "primary", "group_src", "group_dst", "group_port", "group_app", "bucket", "path"]


def keyed(found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Candidates with the columns of GROUP_KEY and ``lone``; a null time gives a null bucket, the unknown time."""
    merged = F.when(F.col("primary").isin(CONTEXT_ONLY) & F.col("inbound"), F.lit("multiple-internet-sources"))
    merged = merged.when(F.col("primary").isin(APP_RISK_RULES) & ~F.col("inbound"), F.lit("multiple-app-risk-sources")).otherwise(F.coalesce("src_ip", F.lit("unknown-source")))
    bucket = F.col("us") - F.pmod("us", F.lit(cfg.window * 1_000_000))
    path = F.concat_ws("->", F.coalesce("src_zone", F.lit("unknown")), F.coalesce("dst_zone", F.lit("unknown")))
    part = lambda codes, c: F.when(F.col("primary").isin(codes), F.col(c))
    alone = F.col("primary").isin(BY_WINDOW) & F.col("us").isNull() & F.col("src_ip").isNotNull() & (F.col("src_ip") != "")
    return found.select(
        "*",
        merged.alias("group_src"),
        F.coalesce(part(TO_HOST, "dst_ip"), F.lit("")).alias("group_dst"),
        part(BY_PORT, "dst_port").alias("group_port"),
        part(BY_APP, "app").alias("group_app"),
        F.coalesce(part(BY_WINDOW, "window_start"), bucket).alias("bucket"),
        F.when(alone, F.col("log_id")).alias("lone"),
        path.alias("path"),
    )


def groups(found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Candidates of one rule, source, target and time that belong together, if they amount to an alert.

    ``src_ip`` and ``dst_ip`` are those of a group that has only one; ``codes`` are all
    rules that matched its logs, in order of evaluation, ``attack_type`` what they name.
    """
    bit = F.aggregate("matches", F.lit(0).cast("long"), lambda bits, m: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), m["place"])))
    named = F.when(F.exists("matches", lambda m: m["code"].isin("paloalto_threat_log", "paloalto_threat_informational")), P.threat_attack_type())
    rank = P.lookup({t: i for i, t in enumerate(MOST_SPECIFIC)}, named, len(MOST_SPECIFIC))
    rows = keyed(found, cfg).withColumn("_bits", bit).withColumn("_threat", F.when(named.isNotNull(), F.struct(rank.alias("r"), named.alias("t"))))
    out = rows.groupBy(*GROUP_KEY, "lone").agg(
        F.count("*").alias("evidence"),
        F.max("score").alias("score"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.countDistinct("src_ip").alias("sources"),
        F.countDistinct("dst_ip").alias("targets"),
        F.countDistinct("dst_port").alias("services"),
        F.max(F.col("capped").cast("int")).alias("capped"),
        F.min("log_id").alias("first_log"),
        F.min("src_ip").alias("src_ip"),
        F.min("dst_ip").alias("dst_ip"),
        F.bit_or("_bits").alias("_bits"),
        F.min("_threat")["t"].alias("_threat"),
    )
    context = F.col("primary").isin(CONTEXT_ONLY)
    enough = F.col("evidence") >= cfg.low_evidence
    # a group of one rule: a watchlist match is its primary rule or not in the group's condition at all
    admitted = F.when(F.col("primary") == "watchlist_match", True).when(context, enough).when(F.col("capped") == 1, True).when(F.col("score") <= 30, enough).otherwise(True)
    names = [code for code, _, _ in conditions(cfg)] + ["watchlist_match"]
    codes = F.array_compact(F.array(*[F.when(F.call_function("shiftrightunsigned", F.col("_bits"), F.lit(i)).bitwiseAND(1) == 1, F.lit(n)) for i, n in enumerate(names)]))
    out = out.filter(admitted).withColumns({"severity": P.severity("score"), "codes": codes, "src_ip": F.when(F.col("sources") <= 1, F.col("src_ip")), "dst_ip": F.when(F.col("targets") <= 1, F.col("dst_ip"))})
    kinds = attack_type(F.transform("codes", lambda c: F.struct(c.alias("code"))), F.coalesce("_threat", F.lit("unknown_anomaly")))
    return out.withColumn("attack_type", kinds).drop("capped", "_bits", "_threat")


def islands(grouped: DataFrame, gap_hours: int = 24) -> DataFrame:
    """Groups of one kind and source merged while no more than ``gap_hours`` lie between them."""
    from pyspark.sql import Window

    key = Window.partitionBy("source_id", "primary", "group_src", "group_dst").orderBy("first_us", "last_us", "path")
    reach = F.max("last_us").over(key.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("first_us") > reach + gap_hours * 3_600_000_000), 1).otherwise(0)
    numbered = grouped.withColumn("new", new).withColumn("island", F.sum("new").over(key))
    return numbered.groupBy("source_id", "primary", "group_src", "group_dst", "island").agg(
        F.count("*").alias("occurrences"), F.sum("evidence").alias("evidence"), F.max("score").alias("score"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    ).withColumn("severity", P.severity("score"))
