"""The log table: its columns, and the view of a plain event table as firewall logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signature names of the view's threat records.
THREAT_NAMES = ["Non-RFC Compliant SSL Traffic", "Nmap Scan Detected", "SSH Login Attempt", "HTTP SQL Injection", "Odd Header", "Sweep of hosts", "Apache Code Execution"]

EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Microseconds of wall-clock time since 1970, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), F.col(ts) if isinstance(ts, str) else ts)


def event_time(df: DataFrame) -> Column:
    """The first of the time columns that a log has."""
    names = [n for n in ("generated_time", "receive_time", "high_res_timestamp", "start_time") if n in df.columns]
    return F.coalesce(*names)


#: First addresses of the view's hosts, inside and outside, as numbers.
INSIDE, OUTSIDE = (10 << 24) + (1 << 16), (45 << 24) + (33 << 16)


def host_address(name: str | Column) -> Column:
    """The address of a host of the view: a part of its name beyond 255 carries into the part before.

    From user 65,536 on the third part of a name is no byte any more, so the name is no
    address, but the number that its parts make is that of one.  Up to 16 million users
    hosts inside stay in their private block.
    """
    parts = F.split(F.col(name) if isinstance(name, str) else name, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long"))
    byte = lambda n, by: F.shiftright(n, by).bitwiseAND(255).cast("string")
    dot = F.lit(".")
    return F.get(F.transform(F.array(number), lambda n: F.concat(byte(n, 24), dot, byte(n, 16), dot, byte(n, 8), dot, byte(n, 0))), F.lit(0))


def host_name(address: str | Column) -> Column:
    """The name in the view of the host (a source, not a target) that has an address."""
    parts = F.split(F.col(address) if isinstance(address, str) else address, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, part: n * 256 + part.cast("long"))

    def named(n: Column) -> Column:
        user = n - F.when(n < OUTSIDE, INSIDE).otherwise(OUTSIDE)
        return F.concat(F.when(n < OUTSIDE, "10.1.").otherwise("45.33."), F.shiftright(user, 8).cast("string"), F.lit("."), user.bitwiseAND(255).cast("string"))

    return F.get(F.transform(F.array(number), named), F.lit(0))


def from_events(events: DataFrame) -> DataFrame:
    """Events (event_id, ts, user_id, event_type, value, props) as logs.

    Users become hosts, one in five of them outside; the number in ``props`` picks target,
    service and the rest.  Null props count as 0.
    """
    k = F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0))
    user, inbound, error = F.col("user_id"), F.col("user_id") % 5 == 0, F.col("event_type") == "error"
    pick = lambda pairs, other: F.coalesce(F.create_map(*[F.lit(x) for p in pairs.items() for x in p])[F.col("event_type")], F.lit(other))
    ports = F.array(*[F.lit(p) for p in (443, 80, 53, 22, 3389, 445, 8443)], F.lit(20000) + k)
    src = F.concat(F.when(inbound, "45.33.").otherwise("10.1."), F.floor(user / 256).cast("string"), F.lit("."), (user % 256).cast("string"))
    dst = F.concat(F.when(inbound, "10.20.0.").otherwise("142.250.0."), (k % 16).cast("string"))
    return events.select(
        F.col("event_id").alias("log_id"),
        (user % 3).cast("int").alias("source_id"),
        F.col("ts").alias("generated_time"),
        F.when(k == 0, "THREAT").otherwise("TRAFFIC").alias("log_type"),
        F.when(k == 0, F.when(error, "spyware").otherwise("vulnerability")).otherwise("end").alias("subtype"),
        F.when(k == 0, F.when(user % 7 == 0, "informational").when(inbound, "low").otherwise("high")).alias("threat_severity"),
        F.when(k == 0, F.get(F.array(*[F.lit(n) for n in THREAT_NAMES]), (user % 7).cast("int"))).alias("threat_name"),
        F.when((k == 0) & (user % 11 == 0), "command-and-control").otherwise("any").alias("category"),
        F.when(k % 9 == 0, "unknown").otherwise("general-internet").alias("app_category"),
        F.when(k % 10 == 3, "peer-to-peer").when(k % 10 == 4, "peer-to-peer").otherwise("browser-based").alias("app_technology"),
        F.when(k % 10 == 3, "file-sharing").when(k % 10 == 4, "internet-conferencing").otherwise("internet-utility").alias("app_subcategory"),
        F.when(k % 6 == 0, "used-by-malware, tunnels-other-application").when(k % 6 == 1, " Evasive-Behavior,able-to-transfer-file").alias("app_characteristic"),
        (k % 3).cast("long").alias("packets_received"),
        F.when(k % 4 == 0, "tcp-rst-from-server").otherwise("aged-out").alias("session_end_reason"),
        src.alias("src_ip"),
        dst.alias("dst_ip"),
        F.get(ports, k % 8).cast("int").alias("dst_port"),
        (F.lit(1024) + k).cast("int").alias("src_port"),
        F.when(inbound, "SG-Outside").otherwise("LAN-Inside").alias("src_zone"),
        F.when(inbound, "LAN-Inside").otherwise("SG-Outside").alias("dst_zone"),
        F.when(error, "deny").otherwise("allow").alias("action"),
        pick({"click": "ssl", "view": "web-browsing", "purchase": "incomplete", "signup": "unknown-tcp", "error": "incomplete"}, "unknown").alias("app"),
        (k % 5 + 1).cast("int").alias("app_risk"),
        (F.floor(F.col("value") * 100 + 0.5) + F.when(error, F.lit(0)).otherwise(F.floor(F.col("value") * 10))).cast("long").alias("bytes"),
        F.floor(F.col("value") * 100 + 0.5).cast("long").alias("bytes_sent"),
        F.when(error, F.lit(0)).otherwise(F.floor(F.col("value") * 10)).cast("long").alias("bytes_received"),
        (k % 20 + 1).cast("long").alias("packets"),
        (k % 3 + 1).cast("int").alias("repeat_count"),
        (k % 7).cast("int").alias("elapsed_time"),
        F.lit("tcp").alias("protocol"),
    )


#: The same view in SQL.
LOGS_SQL = """
raw AS (SELECT *, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events),
logs AS (SELECT event_id AS log_id, CAST(user_id % 3 AS INTEGER) AS source_id, ts AS generated_time,
  CASE WHEN k = 0 THEN 'THREAT' ELSE 'TRAFFIC' END AS log_type,
  CASE WHEN k = 0 THEN CASE WHEN event_type = 'error' THEN 'spyware' ELSE 'vulnerability' END ELSE 'end' END AS subtype,
  CASE WHEN k = 0 THEN CASE WHEN user_id % 7 = 0 THEN 'informational' WHEN user_id % 5 = 0 THEN 'low' ELSE 'high' END END AS threat_severity,
  CASE WHEN k = 0 THEN (['Non-RFC Compliant SSL Traffic', 'Nmap Scan Detected', 'SSH Login Attempt', 'HTTP SQL Injection', 'Odd Header', 'Sweep of hosts', 'Apache Code Execution'])[user_id % 7 + 1] END AS threat_name,
  CASE WHEN k = 0 AND user_id % 11 = 0 THEN 'command-and-control' ELSE 'any' END AS category,
  CASE WHEN k % 9 = 0 THEN 'unknown' ELSE 'general-internet' END AS app_category,
  CASE WHEN k % 10 IN (3, 4) THEN 'peer-to-peer' ELSE 'browser-based' END AS app_technology,
  CASE k % 10 WHEN 3 THEN 'file-sharing' WHEN 4 THEN 'internet-conferencing' ELSE 'internet-utility' END AS app_subcategory,
  CASE k % 6 WHEN 0 THEN 'used-by-malware, tunnels-other-application' WHEN 1 THEN ' Evasive-Behavior,able-to-transfer-file' END AS app_characteristic,
  CAST(k % 3 AS BIGINT) AS packets_received, CASE WHEN k % 4 = 0 THEN 'tcp-rst-from-server' ELSE 'aged-out' END AS session_end_reason,
  CAST(floor(value * 100 + 0.5::DOUBLE) + CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 10) END AS BIGINT) AS bytes,
  (CASE WHEN user_id % 5 = 0 THEN '45.33.' ELSE '10.1.' END) || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
  (CASE WHEN user_id % 5 = 0 THEN '10.20.0.' ELSE '142.250.0.' END) || (k % 16) AS dst_ip,
  CAST(([443, 80, 53, 22, 3389, 445, 8443, 20000 + k])[k % 8 + 1] AS INTEGER) AS dst_port,
  CAST(1024 + k AS INTEGER) AS src_port,
  CASE WHEN user_id % 5 = 0 THEN 'SG-Outside' ELSE 'LAN-Inside' END AS src_zone,
  CASE WHEN user_id % 5 = 0 THEN 'LAN-Inside' ELSE 'SG-Outside' END AS dst_zone,
  CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END AS action,
  CASE event_type WHEN 'click' THEN 'ssl' WHEN 'view' THEN 'web-browsing' WHEN 'purchase' THEN 'incomplete' WHEN 'signup' THEN 'unknown-tcp' WHEN 'error' THEN 'incomplete' ELSE 'unknown' END AS app,
  CAST(k % 5 + 1 AS INTEGER) AS app_risk, CAST(floor(value * 100 + 0.5::DOUBLE) AS BIGINT) AS bytes_sent,
  CAST(CASE WHEN event_type = 'error' THEN 0 ELSE floor(value * 10) END AS BIGINT) AS bytes_received,
  CAST(k % 20 + 1 AS BIGINT) AS packets, CAST(k % 3 + 1 AS INTEGER) AS repeat_count, CAST(k % 7 AS INTEGER) AS elapsed_time, 'tcp' AS protocol,
  epoch_us(ts) AS us, least(greatest(k % 3 + 1, 1), 10000) AS weight,
  event_type = 'error' AS denied, user_id % 5 = 0 AS inbound, user_id % 5 <> 0 AS outbound
  FROM raw)
"""
