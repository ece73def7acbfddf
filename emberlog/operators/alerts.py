"""Alerts after detection: attack types, suppression, service risks, operations and evidence summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P

# Default attack types of rules, their ranks, and attack types from the most specific on.
RULE_ATTACKS = {
    "paloalto_malware_threat": "malware_c2",
    "brute_force_like_attempts": "brute_force",
    "possible_port_scan": "port_scan",
    "possible_horizontal_scan": "port_scan",
    "beaconing_like_outbound": "malware_c2",
    "connection_flood_suspicion": "dos_ddos",
    "high_outbound_bytes": "data_exfiltration_suspicion",
    "repeated_large_outbound": "data_exfiltration_suspicion",
    "deny_drop_action": "policy_violation",
    "app_risk_4": "policy_violation",
    "app_risk_5": "policy_violation",
    "suspicious_app_characteristic": "policy_violation",
    "multiple_denied_connections": "policy_violation",
}
ATTACK_RANKS = {
    "possible_port_scan": 100,
    "possible_horizontal_scan": 99,
    "connection_flood_suspicion": 95,
    "brute_force_like_attempts": 92,
    "beaconing_like_outbound": 90,
    "high_outbound_bytes": 88,
    "repeated_large_outbound": 87,
    "high_bytes_outlier": 80,
    "high_packets_outlier": 78,
    "paloalto_malware_threat": 91,
    "watchlist_match": 89,
    "paloalto_threat_log": 75,
    "paloalto_threat_informational": 10,
    "suspicious_app_characteristic": 70,
    "ml_anomaly_detected": 5,
    "unknown_or_incomplete_app": 40,
    "multiple_denied_connections": 35,
    "deny_drop_action": 30,
    "app_risk_5": 26,
    "app_risk_4": 25,
    "unusual_destination_port": 20,
}
IDENTIFIED = ["paloalto_malware_threat", "paloalto_threat_log", "watchlist_match"]
SUPPORTING = ["app_risk_4", "paloalto_threat_informational", "suspicious_app_characteristic", "repeated_source_ip", "outside_to_inside", "high_bytes_outlier", "high_packets_outlier"]
MOST_SPECIFIC = ["malware_c2", "exploit_attempt", "data_exfiltration_suspicion", "brute_force", "dos_ddos", "port_scan", "policy_violation", "unknown_anomaly"]
# Services that should seldom be public, in order: name, severity, applications, ports.
RISKY_SERVICES = [
    ("remote desktop", "High", ["ms-rdp"], [3389]),
    ("remote screen", "High", ["vnc"], [5900, 5901, 5902, 5903]),
    ("telnet", "High", ["telnet"], [23]),
    ("windows management", "High", ["ms-winrm", "winrm"], [5985, 5986]),
    ("windows file sharing", "High", ["ms-ds-smb", "smb", "netbios-ss", "netbios-ns", "netbios-dg", "msrpc"], [135, 137, 138, 139, 445]),
    ("browser debugging", "High", [], [9222]),
    ("containers", "High", ["docker"], [2375, 2376, 10250]),
    ("database", "High", ["mysql", "postgres", "mssql-db", "ms-sql", "oracle", "redis", "mongodb", "elasticsearch", "memcache", "cassandra", "couchdb"], [1433, 1521, 3306, 5432, 5984, 6379, 9042, 9200, 9300, 11211, 27017]),
    ("network file sharing", "High", ["nfs", "portmapper"], [111, 2049]),
    ("ssh", "Medium", ["ssh"], [22]),
    ("ftp", "Medium", ["ftp"], [21]),
    ("directory or device management", "Medium", ["ldap", "snmp"], [161, 389]),
]
OPEN_STATES = ["new", "open", "investigating", "escalated"]


def attack_type(matches: str = "matches", threat: Column | None = None) -> Column:
    """The attack type that an array of matches (code) names.

    Identified evidence goes before behaviour, that before support, then the rule's rank
    counts, then the earlier match.  ``threat`` is the type that a threat record names.
    """
    named = F.transform(
        matches,
        lambda m, i: F.struct(
            F.when(m["code"].isin("paloalto_threat_log", "paloalto_threat_informational"), threat if threat is not None else F.lit("unknown_anomaly")).otherwise(P.lookup(RULE_ATTACKS, m["code"], "unknown_anomaly")).alias("type"),
            m["code"].alias("code"),
            i.alias("i"),
        ),
    )
    ranked = F.transform(
        named,
        lambda m: F.struct(
            ((m["type"] != "unknown_anomaly") & m["code"].isin(IDENTIFIED)).alias("identified"),
            ((m["type"] != "unknown_anomaly") & ~m["code"].isin(SUPPORTING)).alias("behaviour"),
            P.lookup(ATTACK_RANKS, m["code"], 0).alias("rank"),
            (-m["i"]).alias("before"),
            m["type"].alias("type"),
        ),
    )
    return F.coalesce(F.array_max(ranked)["type"], F.lit("unknown_anomaly"))


def more_specific(types: Column) -> Column:
    """The most specific of an array of attack types; null of none."""
    rank = F.transform(types, lambda t: F.struct(P.lookup({t_: i for i, t_ in enumerate(MOST_SPECIFIC)}, t, len(MOST_SPECIFIC)).alias("r"), t.alias("t")))
    return F.array_min(F.filter(rank, lambda x: x["t"].isNotNull()))["t"]


def suppressed(groups: DataFrame, logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Groups (group_id, alert_type) with the first active rule that suppresses them, or null.

    ``logs`` are the groups' logs (group_id, src_ip, dst_ip, app).  A rule's set fields
    must match: its target all logs of the group, its source and application one log.
    ``rules`` (rule_id, alert_type, src_ip, dst_ip, app, active) are few and people write
    them; they are joined by a type where they have one.
    """
    active = rules.filter("active")
    typed = groups.join(active.withColumnRenamed("alert_type", "_type"), F.col("_type").isNull() | (F.col("_type") == F.col("alert_type")))
    pairs = typed.select("group_id", "rule_id", F.col("src_ip").alias("_src"), F.col("dst_ip").alias("_dst"), F.lower("app").alias("_app"))
    met = pairs.join(logs, "group_id").groupBy("group_id", "rule_id").agg(
        F.min((F.col("_dst").isNull() | F.coalesce(F.col("dst_ip") == F.col("_dst"), F.lit(False))).cast("int")).alias("target"),
        F.max(((F.col("_src").isNull() | F.coalesce(F.col("src_ip") == F.col("_src"), F.lit(False))) & (F.col("_app").isNull() | (F.lower(F.coalesce("app", F.lit(""))) == F.col("_app")))).cast("int")).alias("one"),
    )
    first = met.filter("target = 1 and one = 1").groupBy("group_id").agg(F.min("rule_id").alias("suppressed_by"))
    return groups.join(first, "group_id", "left")


def _begins(text: str):
    return lambda a: a.startswith(text)


def service_risk(services: DataFrame) -> DataFrame:
    """Services (apps, port) with the kind of risky service they are: by named application, else by port."""
    named = F.filter(F.transform("apps", lambda a: P.lowered(a)), lambda a: ~a.startswith("unknown") & ~a.isin("", "incomplete", "not-applicable", "insufficient-data"))
    by_app, by_port = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, _, apps, ports in reversed(RISKY_SERVICES):
        is_app = F.lit(False)
        for x in apps:
            is_app = is_app | F.array_contains("_named", x) | F.exists("_named", _begins(x + "-"))
        by_app = F.when(is_app, name).otherwise(by_app)
        by_port = F.when(F.col("port").isin(ports), name).otherwise(by_port)
    risk = F.coalesce(by_app, F.when(F.size("_named") == 0, by_port))
    level = P.lookup({name: level for name, level, _, _ in RISKY_SERVICES}, F.col("risk"))
    return services.withColumn("_named", named).withColumn("risk", risk).withColumn("risk_level", level).drop("_named")


def operations(alerts: DataFrame) -> DataFrame:
    """Counts of alerts as rows (part, value, alerts): severities of open ones, states, types and attack types."""
    is_open = F.col("status").isin(OPEN_STATES)
    parts = [("open_severity", F.when(is_open, F.col("severity"))), ("status", F.col("status")), ("type", F.col("alert_type")), ("attack", F.col("attack_type"))]
    rows = alerts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), v.alias("value")) for n, v in parts])).alias("e")).select("e.*")
    return rows.filter("value is not null").groupBy("part", "value").agg(F.count("*").alias("alerts"))


def pressure(alerts: DataFrame) -> DataFrame:
    """Share and severity of each alert type, with how urgently its rule needs tuning."""
    by = alerts.groupBy(F.coalesce("alert_type", F.lit("unknown")).alias("alert_type")).agg(F.count("*").alias("alerts"), F.count_if(F.col("severity").isin("High", "Critical")).alias("high"))
    share = P.percent(F.col("alerts"), F.sum("alerts").over(Window.partitionBy()))  # one row a type
    urgency = F.when(F.col("share") >= 35, "critical").when((F.col("share") >= 20) | (F.col("alerts") >= 500), "high").when((F.col("share") >= 10) | (F.col("alerts") >= 100), "medium").otherwise("low")
    return by.withColumn("share", share).withColumn("high_rate", P.percent(F.col("high"), F.col("alerts"))).withColumn("urgency", urgency)


def false_positives(alerts: DataFrame, newest: int = 250, samples: int = 5) -> DataFrame:
    """Patterns (type, source, application) of the newest alerts that were false, with their newest ids."""
    recent = alerts.filter("status = 'false_positive'").orderBy(F.desc("us"), F.desc("alert_id")).limit(newest)
    ids = F.slice(F.reverse(F.array_sort(F.collect_list("alert_id"))), 1, samples)
    return recent.groupBy("alert_type", "src_ip", "app").agg(F.count("*").alias("alerts"), F.array_join(ids.cast("array<string>"), ",").alias("samples"))


def evidence_summary(evidence: DataFrame, first: int = 10) -> DataFrame:
    """Per alert (alert_id, log_id, source_id): logs, sources, and its first log ids.

    The ids are cut down by rank before they meet in a list.
    """
    place = F.row_number().over(Window.partitionBy("alert_id").orderBy("log_id"))
    ids = evidence.select("alert_id", "log_id").distinct().withColumn("p", place).filter(F.col("p") <= first).groupBy("alert_id").agg(F.array_join(F.array_sort(F.collect_list("log_id")).cast("array<string>"), ",").alias("first_logs"))
    return evidence.groupBy("alert_id").agg(F.countDistinct("log_id").alias("logs"), F.countDistinct("source_id").alias("sources")).join(ids, "alert_id")


def top_services(evidence: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k most frequent (port, action) of each key's evidence; ties by port, then action."""
    by = evidence.groupBy(key, "dst_port", "action").agg(F.count("*").alias("logs"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("logs"), F.col("dst_port").asc_nulls_first(), F.col("action").asc_nulls_first()))
    return by.withColumn("place", place).filter(F.col("place") <= k)


def scoreboard(logs: DataFrame, labels: DataFrame, alerted: DataFrame) -> DataFrame:
    """Alerts against reviewed labels, in two halves that a hash of the id tells apart.

    ``labels`` (log_id, threat), ``alerted`` (log_id).  Rates of nothing are null.
    """
    told = alerted.select("log_id", F.lit(True).alias("alerted")).distinct()
    rows = logs.select("log_id").join(labels, "log_id").join(told, "log_id", "left").withColumn("alerted", F.coalesce("alerted", F.lit(False)))
    half = F.when(P.hash_part("log_id", "scoreboard") < 3, "test").otherwise("dev")
    by = rows.groupBy(half.alias("half")).agg(*[F.count_if(c).alias(n) for n, c in (("tp", F.expr("threat and alerted")), ("fp", F.expr("not threat and alerted")), ("fn", F.expr("threat and not alerted")), ("tn", F.expr("not threat and not alerted")))])
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return by.select("half", "tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.try_divide(F.col("fp"), F.col("fp") + F.col("tn")), 4).alias("false_alarm_rate"), F.round(F.try_divide(2 * p * r, p + r), 4).alias("f1"))
