"""Predicates and scalar functions on log columns.  Missing and empty count alike; null compares false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .addresses import is_global as is_global
from .addresses import is_private as is_private

# Names of zones, services and applications as firewalls write them.
OUTSIDE_TOKENS = ["outside", "untrust", "internet", "wan"]
INSIDE_TOKENS = ["inside", "trust", "lan", "wlan", "corp"]
COMMON_PORTS = [0, 20, 21, 22, 25, 53, 67, 68, 80, 110, 123, 143, 161, 389, 443, 445, 465, 587, 993, 995, 1194, 1433, 1521, 3306, 3389, 5432, 5900, 8080, 8443]
LOGIN_PORTS = [21, 22, 23, 25, 110, 143, 389, 445, 465, 587, 993, 995, 1433, 3306, 3389, 5432, 5900]
REMOTE_ADMIN_PORTS = [22, 135, 445, 3389, 5985, 5986, 5900]
UNRESOLVED_APPS = ["unknown", "incomplete", "not-applicable", "unknown-tcp"]
UNANSWERED_APPS = ["incomplete", "insufficient-data", "not-applicable"]
SEVERITIES = [(30, "Low"), (60, "Medium"), (80, "High"), (100, "Critical")]

# What names an attack, malware, risky applications and file sharing.
MALWARE_SUBTYPES = ["virus", "wildfire-virus", "spyware"]
MALWARE_CATEGORIES = ["command-and-control", "backdoor", "botnet"]
INFORMATIONAL = ["informational", "info"]
SUSPICIOUS_TRAITS = ["used-by-malware", "evasive-behavior", "prone-to-misuse", "able-to-transfer-file", "consume-big-bandwidth"]
HIGH_SIGNAL_TRAITS = ["used-by-malware", "evasive-behavior"]
SUBTYPE_ATTACKS = {"scan": "port_scan", "flood": "dos_ddos", "data": "data_exfiltration_suspicion", "virus": "malware_c2", "wildfire-virus": "malware_c2", "spyware": "malware_c2"}
ANOMALY_WORDS = ["non-rfc compliant"]
DISCOVERY_WORDS = ["nmap", "port scan", "portmapper", "discovery", "enumeration", "sweep"]
GUESSING_WORDS = ["brute force", "brute-force", "login attempt"]
EXPLOIT_WORDS = ["code execution", "injection", "traversal", "overflow", "exploit", "deserialization", "file inclusion", "scanning attempt", "privilege escalation", "authentication bypass"]
EXPLOIT_SEVERITIES = ["medium", "high", "critical"]
DNS_NTP_PORTS = [53, 123]
UNKNOWN_APPS = ["unknown", "unknown-tcp", "unknown-udp", "incomplete"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lowered(c: str | Column) -> Column:
    """Trimmed and in lower case, null as empty."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s+|\s+$", "")))


def has_token(zone: str | Column, tokens: list[str]) -> Column:
    """Whether one of the zone's tokens (parts between other signs than letters and digits) is listed."""
    return F.arrays_overlap(F.split(lowered(zone), "[^a-z0-9]+"), F.array(*map(F.lit, tokens)))


def inbound(src: str = "src_zone", dst: str = "dst_zone") -> Column:
    return has_token(src, OUTSIDE_TOKENS) & has_token(dst, INSIDE_TOKENS)


def outbound(src: str = "src_zone", dst: str = "dst_zone") -> Column:
    return has_token(src, INSIDE_TOKENS) & has_token(dst, OUTSIDE_TOKENS)


def denied(*columns: str | Column) -> Column:
    """Whether a column says deny or drop anywhere, or begins with reset."""
    tests = F.array(*[lowered(c) for c in columns])
    return F.exists(tests, lambda x: x.contains("deny") | x.contains("drop") | x.startswith("reset"))


def ip_number(ip: str | Column) -> Column:
    """An IPv4 address as a number; null for everything else."""
    c = col(ip)
    parts = F.split(c, r"\.")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("long")
    good = c.rlike(r"^(0|[1-9]\d{0,2})(\.(0|[1-9]\d{0,2})){3}$")
    value = number(0) * (1 << 24) + number(1) * (1 << 16) + number(2) * (1 << 8) + number(3)
    return F.when(good & (F.greatest(*[number(i) for i in range(4)]) <= 255), value)


def weight(repeat_count: str | Column) -> Column:
    """How many events a log stands for, between 1 and 10,000."""
    return F.least(F.greatest(F.coalesce(col(repeat_count), F.lit(1)), F.lit(1)), F.lit(10000)).cast("long")


def unanswered(is_denied: Column, received: str = "bytes_received", app: str = "app") -> Column:
    return is_denied | (F.coalesce(col(received), F.lit(0)) <= 0) | lowered(app).isin(UNANSWERED_APPS)


def severity(score: str | Column) -> Column:
    out = F.when(col(score) <= SEVERITIES[0][0], SEVERITIES[0][1])
    for top, name in SEVERITIES[1:3]:
        out = out.when(col(score) <= top, name)
    return out.otherwise(SEVERITIES[3][1])


def clamped(score: str | Column) -> Column:
    return F.least(F.greatest(col(score), F.lit(0)), F.lit(100))


def percent(part: Column, whole: Column) -> Column:
    """Two decimals, half to even; 0 of nothing."""
    return F.coalesce(F.bround(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def redacted(text: str | Column) -> Column:
    """Addresses replaced: version 4, then version 6."""
    v4 = F.regexp_replace(col(text), r"\b\d{1,3}(\.\d{1,3}){3}\b", "[ip]")
    return F.regexp_replace(v4, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "[ip]")


def hash_part(key: str | Column, salt: str, parts: int = 10) -> Column:
    """A part number from the first byte of a salted digest."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), col(key).cast("string")), 256)
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % parts


def lookup(values: dict, key: Column, default=None) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in values.items() for x in p])[key], F.lit(default))


def is_malware() -> Column:
    return lowered("subtype").isin(MALWARE_SUBTYPES) | lowered("category").isin(MALWARE_CATEGORIES)


def names_one(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of the words."""
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def threat_attack_type(kind: str | Column = "subtype", name: str | Column = "threat_name", rated: str | Column = "threat_severity") -> Column:
    """The activity that a threat record names, by its type, then its signature, then its severity."""
    k, n = lowered(kind), lowered(name)
    exploit = names_one(n, EXPLOIT_WORDS) | lowered(rated).isin(EXPLOIT_SEVERITIES)
    by_name = F.when(names_one(n, ANOMALY_WORDS), "unknown_anomaly").when(names_one(n, DISCOVERY_WORDS), "port_scan").when(names_one(n, GUESSING_WORDS), "brute_force").when(exploit, "exploit_attempt")
    return F.coalesce(lookup(SUBTYPE_ATTACKS, k), F.when(k == "vulnerability", by_name), F.lit("unknown_anomaly"))


def is_informational() -> Column:
    """A threat record rated informational that names no attack and no malware."""
    return (F.upper("log_type") == "THREAT") & ~is_malware() & lowered("threat_severity").isin(INFORMATIONAL) & (threat_attack_type() == "unknown_anomaly")


def traits(characteristic: str | Column = "app_characteristic") -> Column:
    """Application characteristics as a sorted set of trimmed lower-case words."""
    parts = F.transform(F.split(F.coalesce(col(characteristic), F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def risky_traits(listed: list[str]) -> Column:
    return F.array_sort(F.array_intersect(traits(), F.array(*map(F.lit, listed))))


def is_file_sharing() -> Column:
    """Peer-to-peer file sharing, not calls, which are of the same technology."""
    return (lowered("app_technology") == "peer-to-peer") & (lowered("app_subcategory") == "file-sharing")


def is_ftp_data() -> Column:
    """A server's active-mode connection back from port 20 to a high port."""
    return F.coalesce((F.col("src_port") == 20) & lowered("app").startswith("ftp") & (F.col("dst_port") >= 1024), F.lit(False))


def from_internet() -> Column:
    return F.col("inbound") & ~is_private("src_ip")


def answered(packets: str = "packets_received", reason: str = "session_end_reason") -> Column:
    """Something came back, other than one reset."""
    back = F.coalesce(col(packets), F.lit(0))
    return (back > 0) & ~((back == 1) & (F.coalesce(col(reason), F.lit("")) == "tcp-rst-from-server"))


def outbound_bytes() -> Column:
    """Bytes sent, or all bytes where those are not known."""
    return F.coalesce(F.col("bytes_sent"), F.col("bytes"))


def is_notable() -> Column:
    """Worth a second look by the firewall's fields alone."""
    return lowered("action").rlike("^(deny|drop|reset)") | (F.coalesce(F.col("app_risk"), F.lit(0)) >= 4) | F.lower(F.coalesce(F.col("app"), F.lit(""))).isin(UNKNOWN_APPS) | (F.upper(F.coalesce(F.col("log_type"), F.lit(""))) == "THREAT")


def is_risky() -> Column:
    """Taken into reviews: risky or unidentified applications and denials."""
    return F.coalesce(F.col("app_risk") >= 4, F.lit(False)) | F.coalesce(F.col("action").isin("deny", "drop", "reset-both", "reset-client", "reset-server"), F.lit(False)) | F.coalesce(F.col("app").isin(UNKNOWN_APPS), F.lit(False))


def is_baseline() -> Column:
    """Fit for a baseline: allowed, of low or unknown risk, of a known application."""
    return (lowered("action") == "allow") & (F.coalesce(F.col("app_risk"), F.lit(0)) <= 3) & ~lowered("app").isin(*UNRESOLVED_APPS, "unknown-udp", "")


def application_state(log_type: str = "log_type", app: str = "app") -> Column:
    """Whether a record names its application: identified, unresolved, absent or not_applicable."""
    a = lowered(app)
    unresolved = ["incomplete", "insufficient-data", "unknown", "unknown-tcp", "unknown-udp", "unknown-p2p"]
    return F.when(~F.upper(F.trim(F.coalesce(col(log_type), F.lit("")))).isin("TRAFFIC", "THREAT"), "not_applicable").when(a.isin(unresolved), "unresolved").when(a.isin("", "not-applicable"), "absent").otherwise("identified")


def sampling_score() -> Column:
    """Points by which logs are drawn for review."""
    act, risk = F.lower(F.coalesce(F.col("action"), F.lit(""))), F.coalesce(F.col("app_risk"), F.lit(0))
    denial = F.when(act.contains("deny") | act.contains("drop") | act.contains("reset"), 30).otherwise(0)
    unknown = F.when(F.lower(F.coalesce(F.col("app"), F.lit(""))).isin(UNKNOWN_APPS), 15).otherwise(0)
    return F.least(denial + F.when(risk >= 5, 25).when(risk >= 4, 15).otherwise(0) + unknown, F.lit(100))


def hybrid_risk(rule: Column, isolation: Column, supervised: Column, asset: Column) -> Column:
    """Weighted risk of four parts, each between 0 and 100: rules, isolation, a model's probability, the asset."""
    part = lambda x: clamped(F.coalesce(x.cast("double"), F.lit(0.0)))
    return F.bround(part(rule) * 0.55 + part(isolation) * 0.20 + part(supervised * 100.0) * 0.20 + part(asset) * 0.05, 2)
