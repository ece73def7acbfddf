"""Detection queries over the event table seen as logs, each with its SQL.

The test events are sparse, so windows are a day long and thresholds small here; the
operators' own defaults are those for firewall logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import correlation as C
from ..operators import rules as R
from ..sources.logs import LOGS_SQL, from_events, read

CFG = C.Config(
    window=86_400,
    repeated_source=10,
    deny_burst=5,
    login_denials=3,
    scan_ports=4,
    scan_hosts=3,
    beacon_events=3,
    beacon_low=5.0,
    beacon_high=86_400.0,
    beacon_jitter=0.6,
    flood=3,
    high_volume=5,
    large_repeats=2,
    byte_threshold=8_000.0,
    packet_threshold=18.0,
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(read(spark, sf_dir, "events"))


SNAPSHOT_SQL = """
grids AS (
  SELECT *, 0 AS grid, us - us % 86400000000 AS start FROM logs UNION ALL
  SELECT *, 1, us - (us - 43200000000) % 86400000000 FROM logs),
m AS (SELECT *, bytes_sent > 8000 AND outbound AS large, dst_port IN (21,22,23,25,110,143,389,445,465,587,993,995,1433,3306,3389,5432,5900) AS login FROM (
  SELECT * FROM grids UNION ALL SELECT * REPLACE (start - 86400000000 AS start) FROM grids WHERE us = start)),
a AS (SELECT source_id, src_ip, grid, start, sum(weight)::BIGINT AS source_count, coalesce(sum(weight) FILTER (denied), 0)::BIGINT AS deny_count,
  count(DISTINCT dst_port) AS ports, count(DISTINCT dst_ip) AS hosts FROM m GROUP BY ALL),
b AS (SELECT source_id, src_ip, grid, start, dst_ip, dst_port, sum(weight)::BIGINT AS dest_repeats, count(*) AS dest_events, coalesce(sum(weight) FILTER (denied AND login), 0)::BIGINT AS login_target_denials FROM m GROUP BY ALL),
c AS (SELECT source_id, src_ip, grid, start, dst_port, count(DISTINCT dst_ip) AS hosts_for_port, coalesce(sum(weight) FILTER (denied), 0)::BIGINT AS denials_for_port FROM m GROUP BY ALL),
d AS (SELECT source_id, src_ip, grid, start, dst_ip, count(*) FILTER (large) AS large_to_host FROM m GROUP BY ALL),
best AS (
  SELECT m.log_id, m.grid, m.start FROM m JOIN a USING (source_id, src_ip, grid, start)
  QUALIFY row_number() OVER (PARTITION BY m.log_id ORDER BY source_count DESC, m.grid, m.start) = 1),
snap AS (
  SELECT logs.*, best.grid AS window_grid, best.start AS window_start, a.source_count, a.deny_count, a.ports, a.hosts, b.dest_repeats, b.dest_events, b.login_target_denials, c.hosts_for_port, c.denials_for_port, d.large_to_host
  FROM logs JOIN best USING (log_id) JOIN a ON a.source_id = logs.source_id AND a.src_ip = logs.src_ip AND a.grid = best.grid AND a.start = best.start
  JOIN b ON b.source_id = logs.source_id AND b.src_ip = logs.src_ip AND b.grid = best.grid AND b.start = best.start AND b.dst_ip = logs.dst_ip AND b.dst_port = logs.dst_port
  JOIN c ON c.source_id = logs.source_id AND c.src_ip = logs.src_ip AND c.grid = best.grid AND c.start = best.start AND c.dst_port = logs.dst_port
  JOIN d ON d.source_id = logs.source_id AND d.src_ip = logs.src_ip AND d.grid = best.grid AND d.start = best.start AND d.dst_ip = logs.dst_ip)"""

CADENCE_SQL = """
points AS (SELECT source_id, src_ip, dst_ip, dst_port, us - us % 86400000000 AS bucket, us, count(*) AS n, sum(weight) AS w FROM logs GROUP BY ALL),
near AS (SELECT source_id, src_ip, dst_ip, dst_port, bucket + s.d * 86400000000 AS bucket, us, n, w FROM points, (VALUES (-1), (0), (1)) s(d)),
gaps AS (SELECT *, (us - lag(us) OVER (PARTITION BY source_id, src_ip, dst_ip, dst_port, bucket ORDER BY us)) / 1e6::DOUBLE AS gap FROM near),
spans AS (SELECT source_id, src_ip, dst_ip, dst_port, bucket, sum(n)::BIGINT AS beacon_events, sum(w)::BIGINT AS beacon_repeats, count(gap) AS intervals, avg(gap) AS mean_seconds, stddev_pop(gap) AS spread FROM gaps GROUP BY ALL),
cad AS (SELECT log_id, beacon_events, beacon_repeats, intervals, mean_seconds, CASE WHEN mean_seconds > 0 THEN spread / mean_seconds END AS jitter
  FROM logs JOIN spans s ON s.source_id = logs.source_id AND s.src_ip = logs.src_ip AND s.dst_ip = logs.dst_ip AND s.dst_port = logs.dst_port AND s.bucket = us - us % 86400000000)"""

_rated = "CASE threat_severity WHEN 'informational' THEN 10 WHEN 'low' THEN 20 WHEN 'high' THEN 40 ELSE 30 END"
_malware = "(subtype = 'spyware' OR category = 'command-and-control')"
_informational = f"(log_type = 'THREAT' AND NOT {_malware} AND threat_severity = 'informational')"
_odd = "dst_port >= 20000"
_unresolved = "app IN ('unknown', 'incomplete', 'not-applicable', 'unknown-tcp')"
#: (code, condition, score, priority) in order of evaluation.
RULES_SQL = [
    ("deny_drop_action", "denied", "25", 80),
    ("paloalto_malware_threat", f"log_type = 'THREAT' AND {_malware}", f"{_rated} + 10", 101),
    ("paloalto_threat_informational", _informational, _rated, 5),
    ("paloalto_threat_log", f"log_type = 'THREAT' AND NOT {_malware} AND NOT {_informational}", _rated, 90),
    ("app_risk_4", "app_risk = 4", "15", 70),
    ("app_risk_5", "app_risk >= 5", "25", 75),
    ("suspicious_app_characteristic", "app_characteristic IS NOT NULL", "15", 65),
    ("outside_to_inside", "inbound", "15", 40),
    ("repeated_source_ip", "source_count >= 10", "20", 60),
    ("multiple_denied_connections", "deny_count >= 5", "20", 95),
    ("brute_force_like_attempts", "login_target_denials >= 3", "30", 97),
    ("possible_port_scan", f"ports >= 4 AND (deny_count >= 5 OR inbound OR {_unresolved})", "25", 100),
    ("possible_horizontal_scan", f"hosts_for_port >= 3 AND (denials_for_port >= 5 OR inbound OR {_unresolved} OR dst_port IN (22, 135, 445, 3389, 5985, 5986, 5900))", "25", 99),
    ("beaconing_like_outbound", f"beacon_repeats >= 3 AND beacon_events >= 3 AND intervals >= 2 AND mean_seconds BETWEEN 5 AND 86400 AND jitter <= 0.6 AND outbound AND ({_odd} OR {_unresolved} OR log_type = 'THREAT' OR app_risk >= 5 AND app_characteristic IS NOT NULL)", "30", 96),
    ("connection_flood_suspicion", "dest_repeats >= 5 AND (inbound OR denied OR bytes_received <= 0 OR app IN ('incomplete', 'insufficient-data', 'not-applicable')) OR dest_repeats >= 3 AND denied", "35", 98),
    ("unusual_destination_port", f"{_odd} AND inbound", "10", 55),
    ("high_outbound_bytes", "bytes_sent > 8000 AND outbound", "35", 38),
    ("repeated_large_outbound", "bytes_sent > 8000 AND outbound AND large_to_host >= 2", "20", 37),
    ("unknown_or_incomplete_app", f"{_unresolved} OR app_category = 'unknown'", "10", 50),
    ("high_bytes_outlier", "NOT (bytes_sent > 8000 AND outbound) AND bytes > 8000", "20", 35),
    ("high_packets_outlier", "packets > 18", "20", 35),
]
MATCHES_SQL = (
    "facts AS (SELECT snap.*, beacon_events, beacon_repeats, intervals, mean_seconds, jitter FROM snap JOIN cad USING (log_id)),\nmatches AS ("
    + "\n  UNION ALL ".join(f"SELECT *, '{code}' AS code, {score} AS points, {prio} AS priority, {i} AS place FROM facts WHERE {cond}" for i, (code, cond, score, prio) in enumerate(RULES_SQL))
    + ")"
)
CANDIDATES_SQL = """
scored AS (SELECT log_id, least(sum(points), 100)::INTEGER AS total FROM matches GROUP BY 1),
leads AS (SELECT * FROM matches WHERE code NOT IN ('app_risk_4', 'paloalto_threat_informational', 'suspicious_app_characteristic', 'repeated_source_ip', 'outside_to_inside', 'high_bytes_outlier', 'high_packets_outlier')),
lead AS (SELECT * FROM leads QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY priority DESC, points DESC, place) = 1),
why AS (SELECT log_id, bool_or(code IN ('paloalto_threat_log', 'paloalto_malware_threat', 'brute_force_like_attempts', 'watchlist_match')) AS malice, bool_or(code = 'multiple_denied_connections') AS burst FROM leads GROUP BY 1),
policy AS (SELECT lead.log_id, CASE WHEN app_technology = 'peer-to-peer' AND app_subcategory = 'file-sharing' AND NOT malice THEN 'file_sharing'
    WHEN inbound AND (denied OR bytes_received <= 0 OR app IN ('incomplete', 'insufficient-data', 'not-applicable')) AND hosts <= 9 AND ports <= 4 AND source_count BETWEEN 1 AND 20 AND NOT malice AND NOT burst THEN 'background_probe' END AS policy
  FROM lead JOIN why USING (log_id)),
capped AS (SELECT lead.*, total, policy, CASE WHEN log_type = 'THREAT' AND denied AND inbound AND NOT (subtype = 'spyware' OR category = 'command-and-control') THEN CASE threat_severity WHEN 'high' THEN 80 ELSE 30 END END AS cap
  FROM lead JOIN scored USING (log_id) JOIN policy USING (log_id)),
found AS (SELECT * EXCLUDE (cap), cap IS NOT NULL AS capped, code AS primary_code, least(total, coalesce(cap, 100)) AS score FROM capped WHERE policy IS NULL AND least(total, coalesce(cap, 100)) >= 30)"""
SEVERITY_SQL = "CASE WHEN score <= 30 THEN 'Low' WHEN score <= 60 THEN 'Medium' WHEN score <= 80 THEN 'High' ELSE 'Critical' END"
CONTEXT_SQL = "('outside_to_inside', 'unusual_destination_port', 'unknown_or_incomplete_app')"
GROUPS_SQL = f"""
keyed AS (SELECT *, CASE WHEN primary_code IN {CONTEXT_SQL} AND inbound THEN 'multiple-internet-sources' WHEN primary_code IN ('app_risk_4', 'app_risk_5', 'suspicious_app_characteristic') AND NOT inbound THEN 'multiple-app-risk-sources' ELSE src_ip END AS group_src,
  CASE WHEN primary_code IN ('beaconing_like_outbound', 'connection_flood_suspicion') THEN dst_ip ELSE '' END AS group_dst,
  CASE WHEN primary_code IN ('deny_drop_action', 'unusual_destination_port', 'brute_force_like_attempts', 'possible_horizontal_scan', 'beaconing_like_outbound', 'connection_flood_suspicion') THEN dst_port END AS group_port,
  CASE WHEN primary_code IN ('paloalto_threat_log', 'paloalto_malware_threat', 'app_risk_4', 'app_risk_5', 'suspicious_app_characteristic', 'beaconing_like_outbound') THEN app END AS group_app,
  CASE WHEN primary_code IN ('possible_port_scan', 'possible_horizontal_scan', 'beaconing_like_outbound', 'connection_flood_suspicion') THEN window_start ELSE us - us % 86400000000 END AS bucket, src_zone || '->' || dst_zone AS path FROM found),
grouped AS (SELECT source_id, primary_code, group_src, group_dst, group_port, group_app, bucket, path, count(*) AS evidence, max(score) AS score, min(us) AS first_us, max(us) AS last_us,
  count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS targets, count(DISTINCT dst_port) AS services, bool_or(capped) AS capped FROM keyed GROUP BY ALL),
admitted AS (SELECT *, {SEVERITY_SQL} AS severity FROM grouped WHERE CASE WHEN primary_code IN {CONTEXT_SQL} THEN evidence >= 5 WHEN capped THEN true WHEN score <= 30 THEN evidence >= 5 ELSE true END)"""
ISLANDS_SQL = f"""
stretch AS (SELECT *, max(last_us) OVER (PARTITION BY source_id, primary_code, group_src, group_dst ORDER BY first_us, last_us, path, group_port NULLS FIRST, group_app NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM admitted),
marked AS (SELECT *, sum(CASE WHEN reach IS NULL OR first_us > reach + 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, primary_code, group_src, group_dst ORDER BY first_us, last_us, path, group_port NULLS FIRST, group_app NULLS FIRST ROWS UNBOUNDED PRECEDING) AS island FROM stretch),
isles AS (SELECT source_id, primary_code, group_src, group_dst, island::BIGINT AS island, count(*) AS occurrences, sum(evidence)::BIGINT AS evidence, max(score) AS score, min(first_us) AS first_us, max(last_us) AS last_us FROM marked GROUP BY ALL)"""

SNAP_COLUMNS = ["log_id", "window_grid", "window_start", "source_count", "deny_count", "ports", "hosts", "dest_repeats", "dest_events", "login_target_denials", "hosts_for_port", "denials_for_port", "large_to_host"]


def _with(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)


_facts = (LOGS_SQL, SNAPSHOT_SQL, CADENCE_SQL, MATCHES_SQL)
_to_groups = (*_facts, CANDIDATES_SQL, GROUPS_SQL)


def correlation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.snapshot(C.prepared(logs(spark, sf_dir), CFG), CFG).select(*SNAP_COLUMNS)


def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.cadence(C.prepared(logs(spark, sf_dir), CFG), CFG)
    return found.select("log_id", "beacon_events", "beacon_repeats", "intervals", F.round("mean_seconds", 3).alias("mean_seconds"), F.round("jitter", 3).alias("jitter"))


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.evaluate(logs(spark, sf_dir), CFG).select("log_id", F.explode("matches").alias("m")).select("log_id", "m.code", F.col("m.score").alias("points"))


def rule_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = R.evaluate(logs(spark, sf_dir), CFG).select("src_ip", F.explode("matches").alias("m"))
    return each.groupBy("m.code").agg(F.count("*").alias("logs"), F.max("m.score").alias("max_points"), F.countDistinct("src_ip").alias("sources"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidates(R.evaluate(logs(spark, sf_dir), CFG), CFG).select("log_id", F.col("primary").alias("primary_code"), "score", "severity")


def policy_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = R.evaluate(logs(spark, sf_dir), CFG).filter(F.exists("matches", lambda m: ~m["code"].isin(R.SUPPORTING_ONLY)))
    return matched.select(R.policy_only(matched).alias("policy")).groupBy("policy").agg(F.count("*").alias("logs"))


def expected_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule volume when one inbound service is meant to be public."""
    expected = spark.createDataFrame([("10.20.0.3", 22, "tcp"), ("10.20.0.7", 20007, "tcp")], "address string, port int, protocol string")
    matched = R.without_expected(R.evaluate(logs(spark, sf_dir), CFG), expected)
    return matched.select(F.explode("matches.code").alias("code")).groupBy("code").agg(F.count("*").alias("logs"))


def watchlist_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = R.evaluate(logs(spark, sf_dir), CFG)
    hits = matched.filter("src_ip like '45.33.%5'").select("log_id", F.lit(45).alias("boost"))
    found = R.candidates(R.with_watchlist(matched, hits), CFG)
    return found.groupBy(F.col("primary").alias("primary_code")).agg(F.count("*").alias("logs"), F.sum("score").alias("points"))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.groups(R.candidates(R.evaluate(logs(spark, sf_dir), CFG), CFG), CFG)


GROUP_FACTS = ["evidence", "score", "first_us", "last_us", "sources", "targets", "services", "severity"]


def alert_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select(*R.GROUP_KEY, *GROUP_FACTS).withColumnRenamed("primary", "primary_code")


def alert_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.islands(_groups(spark, sf_dir)).withColumnRenamed("primary", "primary_code")


def top_denied_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Busiest denied sources: the flagship report."""
    rows = C.prepared(logs(spark, sf_dir), CFG)
    by = rows.groupBy("source_id", "src_ip").agg(
        F.count("*").alias("logs"), F.sum("weight").alias("events"), F.sum(F.when(F.col("denied"), F.col("weight")).otherwise(0)).alias("denials"), F.countDistinct("dst_port").alias("ports"), F.max("us").alias("last_us")
    )
    score = P.clamped(F.when(F.col("denials") >= 20, 45).otherwise(0) + F.when(F.col("ports") >= 6, 25).otherwise(0) + F.when(F.col("events") >= 100, 20).otherwise(0)).cast("int")
    return by.filter("denials > 0").withColumn("score", score).withColumn("severity", P.severity("score")).orderBy(F.desc("denials"), "src_ip", "source_id").limit(25)


QUERIES = {f.__name__: f for f in (top_denied_sources, correlation_window, cadence, rule_matches, rule_volume, candidates, policy_skips, expected_services, watchlist_candidates, alert_groups, alert_islands)}

ORACLE = {
    "top_denied_sources": f"""{_with(LOGS_SQL)},
t AS (SELECT source_id, src_ip, count(*) AS logs, sum(weight)::BIGINT AS events, coalesce(sum(weight) FILTER (denied), 0)::BIGINT AS denials, count(DISTINCT dst_port) AS ports, max(us) AS last_us FROM logs GROUP BY ALL),
s AS (SELECT *, CASE WHEN denials >= 20 THEN 45 ELSE 0 END + CASE WHEN ports >= 6 THEN 25 ELSE 0 END + CASE WHEN events >= 100 THEN 20 ELSE 0 END AS score FROM t WHERE denials > 0)
SELECT *, {SEVERITY_SQL} AS severity FROM s ORDER BY denials DESC, src_ip, source_id LIMIT 25""",
    "correlation_window": f"{_with(LOGS_SQL, SNAPSHOT_SQL)} SELECT {', '.join(SNAP_COLUMNS)} FROM snap",
    "cadence": f"{_with(LOGS_SQL, CADENCE_SQL)} SELECT log_id, beacon_events, beacon_repeats, intervals, round(mean_seconds, 3) AS mean_seconds, round(jitter, 3) AS jitter FROM cad",
    "rule_matches": f"{_with(*_facts)} SELECT log_id, code, points::INTEGER AS points FROM matches",
    "rule_volume": f"{_with(*_facts)} SELECT code, count(*) AS logs, max(points)::INTEGER AS max_points, count(DISTINCT src_ip) AS sources FROM matches GROUP BY 1",
    "candidates": f"{_with(*_facts, CANDIDATES_SQL)} SELECT log_id, primary_code, score, {SEVERITY_SQL} AS severity FROM found",
    "policy_skips": f"{_with(*_facts, CANDIDATES_SQL)} SELECT policy, count(*) AS logs FROM policy GROUP BY 1",
    "expected_services": f"""{_with(*_facts)}, e AS (SELECT *, (dst_ip = '10.20.0.3' AND dst_port = 22 OR dst_ip = '10.20.0.7' AND dst_port = 20007) AS expected,
  bool_or(code NOT IN {CONTEXT_SQL} AND code NOT IN ('app_risk_4', 'paloalto_threat_informational', 'suspicious_app_characteristic', 'repeated_source_ip', 'outside_to_inside', 'high_bytes_outlier', 'high_packets_outlier')) OVER (PARTITION BY log_id) AS flags FROM matches)
SELECT code, count(*) AS logs FROM e WHERE NOT (expected AND NOT flags AND code IN {CONTEXT_SQL}) GROUP BY 1""",
    "watchlist_candidates": f"""{_with(*_facts).replace("matches AS (", "matches AS (SELECT *, 'watchlist_match' AS code, 45 AS points, 88 AS priority, 99 AS place FROM facts WHERE src_ip LIKE '45.33.%5' UNION ALL ", 1)},{CANDIDATES_SQL.strip()}
SELECT primary_code, count(*) AS logs, sum(score)::BIGINT AS points FROM found GROUP BY 1""",
    "alert_groups": f"{_with(*_to_groups)} SELECT * EXCLUDE (capped) FROM admitted",
    "alert_islands": f"{_with(*_to_groups, ISLANDS_SQL)} SELECT *, {SEVERITY_SQL} AS severity FROM isles",
}
