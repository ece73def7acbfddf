"""Detection on hand-built logs: window edges, thresholds and one below, order and repartitioning."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.operators import correlation as C
from emberlog.operators import rules as R

T0 = datetime(2024, 3, 1, 10, 0, 0)
SCHEMA = "log_id long, source_id int, generated_time timestamp_ntz, log_type string, subtype string, threat_severity string, src_ip string, dst_ip string, dst_port int, src_zone string, dst_zone string, action string, app string, app_risk int, bytes_sent long, bytes_received long, packets long, repeat_count int"


def log(i, seconds=0, **over):
    row = {
        "log_id": i,
        "source_id": 1,
        "generated_time": None if seconds is None else T0 + timedelta(seconds=seconds),
        "log_type": "TRAFFIC",
        "subtype": "end",
        "threat_severity": None,
        "src_ip": "10.1.0.9",
        "dst_ip": "142.250.0.1",
        "dst_port": 443,
        "src_zone": "LAN-Inside",
        "dst_zone": "SG-Outside",
        "action": "allow",
        "app": "ssl",
        "app_risk": 1,
        "bytes_sent": 100,
        "bytes_received": 100,
        "packets": 3,
        "repeat_count": 1,
    } | over
    return tuple(row[c.split()[0]] for c in SCHEMA.split(", "))


def codes(spark, rows):
    out = R.evaluate(spark.createDataFrame(rows, SCHEMA)).select("log_id", F.col("matches.code").alias("c")).collect()
    return {r.log_id: set(r.c) for r in out}


INSIDE = {"src_ip": "45.33.32.156", "dst_ip": "10.20.0.1", "src_zone": "SG-Outside", "dst_zone": "LAN-Inside"}


@pytest.mark.parametrize(
    ("code", "rows"),
    [
        ("possible_port_scan", lambda n: [log(i, i, **INSIDE | {"dst_port": 1000 + i}) for i in range(n)]),
        ("possible_horizontal_scan", lambda n: [log(i, i, **INSIDE | {"dst_ip": f"10.20.0.{i}"}) for i in range(n)]),
    ],
)
def test_scan_thresholds(spark, code, rows):
    assert all(code in c for c in codes(spark, rows(10)).values())
    assert not any(code in c for c in codes(spark, rows(9)).values())


@pytest.mark.parametrize(("code", "need", "over"), [("multiple_denied_connections", 5, {"action": "deny"}), ("brute_force_like_attempts", 5, {"action": "drop", "dst_port": 22}), ("repeated_source_ip", 25, {})])
def test_count_thresholds(spark, code, need, over):
    assert all(code in c for c in codes(spark, [log(i, i, **over) for i in range(need)]).values())
    assert not any(code in c for c in codes(spark, [log(i, i, **over) for i in range(need - 1)]).values())
    # repeats of a log count as events
    assert code in codes(spark, [log(0, **over | {"repeat_count": need})])[0]


def test_second_grid_joins_what_the_first_cuts(spark):
    rows = [log(i, 240 + 20 * i, action="deny") for i in range(6)]  # across 10:05
    assert all("multiple_denied_connections" in c for c in codes(spark, rows).values())


def test_edge_row_counts_in_the_window_that_ends_there(spark):
    rows = [log(i, 10 * i, action="deny") for i in range(4)] + [log(9, 300, action="deny")]
    got = {r.log_id: r.deny_count for r in C.snapshot(C.prepared(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(got.values()) == {5}


def test_rows_without_time_or_source_stand_alone(spark):
    rows = [log(0, None), log(1, 0, src_ip=None), log(2, 0, src_ip="")] + [log(i, 0) for i in range(3, 6)]
    got = {r.log_id: r.source_count for r in C.snapshot(C.prepared(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


@pytest.mark.parametrize(("gaps", "fires"), [([30] * 8, True), ([30, 90, 10, 120, 5, 60, 90, 10], False), ([400] * 8, False)])
def test_beacon_needs_a_steady_rhythm(spark, gaps, fires):
    at, rows = 0, []
    for i, g in enumerate(gaps):
        rows.append(log(i, at, app="unknown-tcp", dst_port=4444))
        at += g
    assert any("beaconing_like_outbound" in c for c in codes(spark, rows).values()) == fires


def test_flood_needs_denials_or_silence(spark):
    assert "connection_flood_suspicion" in codes(spark, [log(0, action="deny", repeat_count=20)])[0]
    assert "connection_flood_suspicion" not in codes(spark, [log(0, action="deny", repeat_count=19)])[0]
    assert "connection_flood_suspicion" not in codes(spark, [log(0, repeat_count=500)])[0]
    assert "connection_flood_suspicion" in codes(spark, [log(0, repeat_count=100, bytes_received=0)])[0]


def test_untrust_is_not_trust(spark):
    df = spark.createDataFrame([("untrust", "trust"), ("trust", "untrust"), ("SG-Outside", "WLAN-Inside"), (None, "")], "src_zone string, dst_zone string")
    got = df.select(P.inbound().cast("int").alias("i"), P.outbound().cast("int").alias("o")).collect()
    assert [(r.i, r.o) for r in got] == [(1, 0), (0, 1), (1, 0), (0, 0)]


def test_addresses(spark):
    ips = {"10.0.0.1": (1, 0), "8.8.8.8": (0, 1), "203.0.113.5": (1, 0), "100.64.0.1": (0, 0), "172.32.0.1": (0, 1), "1.2.3": (0, 0), "01.2.3.4": (0, 0), "256.1.1.1": (0, 0), "99999999999.1.1.1": (0, 0), "224.0.0.1": (0, 1), "fe80::1": (1, 0), "2606:4700::1111": (0, 1)}
    df = spark.createDataFrame([(k,) for k in ips] + [(None,)], "ip string")
    got = {r.ip: (r.p, r.g) for r in df.select("ip", P.is_private("ip").cast("int").alias("p"), F.coalesce(P.is_global("ip"), F.lit(False)).cast("int").alias("g")).collect()}
    assert got == ips | {None: (0, 0)}


def test_results_do_not_depend_on_partitions(spark):
    rows = [log(i, (i * 37) % 900, action="deny" if i % 3 else "allow", dst_port=1000 + i % 13, src_ip=f"10.1.0.{i % 4}") for i in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda d: sorted((r.log_id, tuple(m.code for m in r.matches)) for r in R.evaluate(d).collect())
    assert key(df.repartition(1)) == key(df.repartition(9, "dst_port")) == key(df.orderBy(F.desc("log_id")))


def test_supporting_rules_raise_nothing(spark):
    rows = [log(0, app_risk=4, **INSIDE), log(1, app_risk=5, **INSIDE)]
    found = {r.log_id: r.score for r in R.candidates(R.evaluate(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert found == {1: 40}


def test_islands_break_after_a_day(spark):
    hour = 3_600_000_000
    rows = [(1, "x", "a", "", i, "p", 2, 50, s * hour, e * hour) for i, (s, e) in enumerate([(0, 1), (25, 26), (51, 52), (0, 30)])]
    df = spark.createDataFrame(rows, "source_id int, primary string, group_src string, group_dst string, bucket long, path string, evidence long, score int, first_us long, last_us long")
    got = sorted((r.occurrences, r.evidence, r.first_us // hour, r.last_us // hour) for r in R.islands(df).collect())
    assert got == [(4, 8, 0, 52)]
    rows.pop()
    df = spark.createDataFrame(rows, df.schema)
    assert sorted(r.occurrences for r in R.islands(df).collect()) == [1, 2]


def test_rules_of_threats_and_exceptions(spark):
    """One log for each condition, at the threshold and beside it."""
    base = {"log_id": 0, "source_id": 1, "generated_time": datetime(2024, 3, 1, 10), "log_type": "TRAFFIC", "subtype": "end", "src_ip": "8.8.4.4", "dst_ip": "10.0.0.5", "src_port": 5000, "dst_port": 443, "src_zone": "untrust", "dst_zone": "trust", "action": "allow", "app": "ssl", "app_risk": 1, "bytes": 10, "bytes_sent": 5, "bytes_received": 5, "packets": 3, "repeat_count": 1, "threat_severity": None, "threat_name": None, "category": None, "app_category": "networking", "app_characteristic": None, "protocol": "tcp"}
    cases = [
        ({"log_type": "THREAT", "subtype": "vulnerability", "threat_severity": "informational", "threat_name": "Non-RFC Compliant DNS"}, {"paloalto_threat_informational"}, {"paloalto_threat_log"}),
        ({"log_type": "THREAT", "subtype": "vulnerability", "threat_severity": "informational", "threat_name": "Nmap probe"}, {"paloalto_threat_log"}, {"paloalto_threat_informational"}),
        ({"log_type": "THREAT", "subtype": "url", "category": "Botnet", "threat_severity": "low"}, {"paloalto_malware_threat"}, {"paloalto_threat_log"}),
        ({"app_characteristic": "x, Used-By-Malware "}, {"suspicious_app_characteristic"}, set()),
        ({"app_characteristic": "pervasive-use"}, set(), {"suspicious_app_characteristic"}),
        ({"src_port": 20, "app": "ftp-data", "dst_port": 40000}, {"outside_to_inside"}, {"unusual_destination_port"}),
        ({"src_port": 21, "app": "ftp-data", "dst_port": 40000}, {"unusual_destination_port"}, set()),
        ({"app_category": "unknown"}, {"unknown_or_incomplete_app"}, set()),
        ({"src_zone": "trust", "dst_zone": "untrust", "bytes_sent": None, "bytes": 10_000_001}, {"high_outbound_bytes"}, {"high_bytes_outlier"}),
        ({"bytes_sent": 1, "bytes": 10_000_001}, {"high_bytes_outlier"}, {"high_outbound_bytes"}),
        ({"bytes_sent": 1, "bytes": 10_000_000}, set(), {"high_bytes_outlier"}),
    ]
    fields = "log_id long, source_id int, generated_time timestamp_ntz, log_type string, subtype string, src_ip string, dst_ip string, src_port int, dst_port int, src_zone string, dst_zone string, action string, app string, app_risk int, bytes long, bytes_sent long, bytes_received long, packets long, repeat_count int, threat_severity string, threat_name string, category string, app_category string, app_characteristic string, protocol string"
    rows = [base | {"log_id": i, "src_ip": f"8.8.4.{i}"} | case for i, (case, _, _) in enumerate(cases)]
    logs = spark.createDataFrame([tuple(r[f.split()[0]] for f in fields.split(", ")) for r in rows], fields)
    matched = R.evaluate(logs)
    got = {r.log_id: {m.code for m in r.matches} for r in matched.collect()}
    for i, (_, there, absent) in enumerate(cases):
        assert there <= got[i] and not absent & got[i], (i, got[i])
    expected = spark.createDataFrame([("10.0.0.5", 40000, "TCP")], "address string, port int, protocol string")
    freed = {r.log_id: {m.code for m in r.matches} for r in R.without_expected(matched, expected).collect()}
    assert freed[6] == set() and freed[7] == got[7]
    hits = spark.createDataFrame([(4, 20), (4, 45)], "log_id long, boost int")
    listed = {r.log_id: [(m.code, m.score) for m in r.matches] for r in R.with_watchlist(matched, hits).collect()}
    assert ("watchlist_match", 45) in listed[4] and "watchlist_match" not in {c for c, _ in listed[3]}


def test_suppression_needs_all_targets_and_one_source(spark):
    from emberlog.operators import alerts as A

    groups = spark.createDataFrame([("g", "scan"), ("h", "scan"), ("k", "flood")], "group_id string, alert_type string")
    logs = spark.createDataFrame([("g", "1.1.1.1", "d", "SSL"), ("g", "2.2.2.2", "d", None), ("h", "1.1.1.1", "d", "x"), ("h", "3.3.3.3", "e", "x"), ("k", None, None, None)], "group_id string, src_ip string, dst_ip string, app string")
    rules = spark.createDataFrame([(1, "scan", None, "d", None, True), (2, "scan", "1.1.1.1", None, "ssl", True), (3, None, "3.3.3.3", None, None, True), (0, None, None, None, None, False)], "rule_id int, alert_type string, src_ip string, dst_ip string, app string, active boolean")
    assert {r.group_id: r.suppressed_by for r in A.suppressed(groups, logs, rules).collect()} == {"g": 1, "h": 3, "k": None}


def test_attack_types(spark):
    from emberlog.operators import alerts as A

    rows = spark.createDataFrame([(1, ["app_risk_5", "possible_port_scan"]), (2, ["possible_port_scan", "paloalto_malware_threat"]), (3, ["outside_to_inside"]), (4, ["suspicious_app_characteristic", "deny_drop_action"]), (5, [])], "i int, codes array<string>")
    matches = F.transform("codes", lambda c: F.struct(c.alias("code")))
    got = {r.i: r.t for r in rows.withColumn("matches", matches).select("i", A.attack_type().alias("t")).collect()}
    assert got == {1: "port_scan", 2: "malware_c2", 3: "unknown_anomaly", 4: "policy_violation", 5: "unknown_anomaly"}
    types = spark.range(1).select(A.more_specific(F.array(F.lit("port_scan"), F.lit(None), F.lit("brute_force"))).alias("t"))
    assert types.first().t == "brute_force"


def test_leakage_groups_chain(spark, tmp_path):
    from emberlog.operators import groups as G

    rows = spark.createDataFrame([(5, "a", "x"), (3, "b", "x"), (9, "b", "y"), (7, "c", "y"), (1, "d", None), (2, None, None)], "id long, a string, b string")
    got = {r.key: r.group for r in G.leakage_groups(spark, rows, "id", ["a", "b"], str(tmp_path)).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 3, 1: 1, 2: 2}


def test_ordered_cut_puts_nulls_last(spark):
    from emberlog.operators import evaluation as E

    rows = spark.createDataFrame([(10, 1), (10, 2), (5, 3), (None, 4), (10**15, 5), (None, 6)], "us long, id int")
    assert {r.id: r.part for r in E.ordered_cut(rows, ["us", "id"], 3).collect()} == {3: 0, 1: 0, 2: 1, 5: 1, 4: 2, 6: 2}
    alone = rows.filter("us IS NULL")
    assert {r.id: r.part for r in E.ordered_cut(alone, ["us", "id"], 2).collect()} == {4: 0, 6: 1}
    assert not E.ordered_cut(rows.limit(0), ["us", "id"], 2).collect()
