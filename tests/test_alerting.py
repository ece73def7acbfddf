"""Groups, cases, exposure, contacts and bars on hand-made rows, with the results that the rules' text gives."""

from datetime import datetime, timedelta
from statistics import mean, pstdev

import duckdb
import pytest
from pyspark.sql import functions as F
from test_detection import INSIDE, SCHEMA, log

from emberlog.operators import correlation as C
from emberlog.operators import exposure as EX
from emberlog.operators import reports as R
from emberlog.operators import rules as U
from emberlog.plans import catalog


def evaluated(spark, rows):
    return U.evaluate(spark.createDataFrame(rows, SCHEMA))


def test_a_scan_across_a_bucket_edge_is_one_group(spark):
    """Twelve ports from 10:04 to 10:06: one window of the second grid holds them, two five-minute buckets cut them."""
    rows = [log(i, 240 + 10 * i, **INSIDE | {"dst_port": 1000 + i}) for i in range(12)]
    found = U.groups(U.candidates(evaluated(spark, rows))).collect()
    scans = [g for g in found if g.primary == "possible_port_scan"]
    assert [(g.evidence, g.services) for g in scans] == [(12, 12)]
    assert scans[0].attack_type == "port_scan" and "possible_port_scan" in scans[0].codes and scans[0].src_ip == INSIDE["src_ip"]


def test_other_rules_go_by_the_bucket(spark):
    rows = [log(i, 280 + 40 * i, action="deny", app="unknown-tcp", app_risk=5, dst_port=443) for i in range(2)]
    found = U.groups(U.candidates(evaluated(spark, rows))).collect()
    assert len({g.bucket for g in found}) == 2 and all(g.evidence == 1 for g in found)


def test_logs_without_a_time_are_windows_of_their_own(spark):
    """Their repeats count, for themselves only; as flood alerts each is a group."""
    rows = [log(i, None, action="deny", repeat_count=20) for i in range(2)] + [log(2, None, action="deny"), log(3, None, src_ip=None, action="deny", repeat_count=20)]
    matched = evaluated(spark, rows)
    got = {r.log_id: (r.source_count, r.deny_count, r.ports, r.hosts, r.dest_repeats, r.hosts_for_port) for r in matched.collect()}
    assert got == {0: (20, 20, 1, 1, 20, 1), 1: (20, 20, 1, 1, 20, 1), 2: (1, 1, 1, 1, 1, 1), 3: (0,) * 6}
    floods = [g for g in U.groups(U.candidates(matched)).collect() if g.primary == "connection_flood_suspicion"]
    assert sorted((g.evidence, g.bucket, g.first_us) for g in floods) == [(1, None, None)] * 2


ALERT = "src_ip string, dst_ip string, attack_type string, created_us long, status string, score int, evidence long, primary string, first_us long, last_us long"
H = 3_600_000_000


def test_cases_by_source_target_type_and_span(spark):
    rows = [
        ("a", "x", "port_scan", 1 * H, "resolved", 40, 2, "r1", 1, 5),
        ("a", "x", "port_scan", 11 * H, "needs_more_context", 70, 3, "r2", 0, 4),
        ("a", "x", "port_scan", 13 * H, "false_positive", 50, 1, "r1", 2, 2),
        ("a", None, "port_scan", 1 * H, "closed", 30, 1, "r1", 3, 3),
        ("a", "x", "brute_force", 1 * H, "open", 30, 1, "r1", 3, 3),
        (None, "x", "port_scan", 1 * H, "investigating", 30, 1, "r1", 3, 3),
    ]
    got = {(r.source, r.target, r.attack_type, r.bucket_us // H): r for r in R.cases(spark.createDataFrame(rows, ALERT), 12).collect()}
    assert {k: (r.alerts, r.score, r.evidence, r.kinds, r.status, r.first_us, r.last_us) for k, r in got.items()} == {
        ("a", "x", "port_scan", 0): (2, 70, 5, 2, "needs_more_context", 0, 5),
        ("a", "x", "port_scan", 12): (1, 50, 1, 1, "false_positive", 2, 2),
        ("a", "any-destination", "port_scan", 0): (1, 30, 1, 1, "false_positive", 3, 3),
        ("a", "x", "brute_force", 0): (1, 30, 1, 1, "open", 3, 3),
        ("unknown-source", "x", "port_scan", 0): (1, 30, 1, 1, "investigating", 3, 3),
    }
    import hashlib

    assert got["a", "x", "port_scan", 12].case_id == hashlib.sha1(b"a|x|port_scan|1970-01-01T12:00:00+00:00").hexdigest()[:12]


LOGS = "log_id long, generated_time timestamp_ntz, log_type string, subtype string, src_ip string, dst_ip string, src_port int, dst_port int, src_zone string, dst_zone string, protocol string, app string, packets_received long, session_end_reason string, us long, inbound boolean"


def reached(i, **over):
    row = {"log_id": i, "generated_time": None, "log_type": "TRAFFIC", "subtype": "end", "src_ip": "45.33.32.156", "dst_ip": "10.20.0.1", "src_port": 40000, "dst_port": 3389, "src_zone": "untrust", "dst_zone": "trust", "protocol": "TCP", "app": "ssl", "packets_received": 2, "session_end_reason": "tcp-fin", "us": i, "inbound": True} | over
    return tuple(row.values())


def test_exposure_needs_an_answer(spark):
    rows = [
        reached(0),
        reached(1, packets_received=1, session_end_reason="tcp-rst-from-server"),
        reached(2, packets_received=2, session_end_reason="tcp-rst-from-server"),
        reached(3, packets_received=0),
        reached(4, packets_received=None),
        reached(5, src_port=20, app="ftp-data", dst_port=50000),
        reached(6, src_ip="10.0.0.9"),
        reached(7, protocol="icmp"),
        reached(8, inbound=False),
        reached(9, src_ip="2606:4700::1111", app=None),
    ]
    got = EX.noted(spark.createDataFrame(rows, LOGS)).collect()
    assert [(r.address, r.port, r.protocol, r.connections, r.sources, r.first_us, r.last_us, r.apps, r.names) for r in got] == [("10.20.0.1", 3389, "tcp", 3, 2, 0, 9, {"ssl": 2, "unknown": 1}, ["2606:4700::1111", "45.33.32.156"])]


LIST = "address string, port int, protocol string, connections long, sources long, first_us long, last_us long, apps map<string,long>, sample_sources array<string>, status string"


def test_list_and_findings(spark):
    stored = [
        ("h1", 3389, "tcp", 5, 4, 100, 200, {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}, ["s9"], "unreviewed"),
        ("h2", 3389, "tcp", 5, 4, 100, 200, {"ssl": 1}, [], "expected"),
        ("h3", 8080, "tcp", 5, 4, 100, 200, {"web": 1}, [], "not_expected"),
        ("h4", 22, "tcp", 5, 4, 100, 200, {"ssl": 1}, [], "unreviewed"),
    ]
    now = [("h1", 3389, "tcp", 7, 2, 50, 150, {"f": 9, "a": 4}, ["s1", "s9"]), ("h2", 3389, "tcp", 1, 1, 150, 150, {"ssl": 1}, []), ("h3", 8080, "tcp", 1, 1, 150, 150, {"web": 1}, []), ("h5", 8080, "tcp", 1, 1, 24 * H + 100, 24 * H + 100, {"web": 1}, ["s1"]), ("h6", 22, "tcp", 1, 1, 300, 300, {"unknown": 1}, ["s1"]), ("h7", 81, "tcp", 1, 1, 24 * H + 99, 24 * H + 100, {"web": 1}, ["s1"])]
    listed = EX.upsert(spark.createDataFrame(stored, LIST), spark.createDataFrame(now, "address string, port int, protocol string, connections long, sources long, first_us long, last_us long, apps map<string,long>, names array<string>"))
    rows = {r.address: r for r in listed.collect()}
    assert (rows["h1"].connections, rows["h1"].sources, rows["h1"].first_us, rows["h1"].last_us) == (12, 4, 50, 200)
    assert rows["h1"].apps == {"f": 9, "a": 5, "e": 5, "d": 4, "c": 3} and rows["h1"].sample_sources == ["s9", "s1"]
    assert rows["h5"].status == "unreviewed" and rows["h4"].seen_now == 0
    told = {r.address: (r.reason, r.severity) for r in EX.findings(listed, 100).collect()}
    assert told == {"h3": ("not_expected", "High"), "h5": ("new", "Medium"), "h6": ("risky", "Medium")}
    assert "h5" not in {r.address for r in EX.findings(listed, None).collect()}


def test_lasting_contacts_look_back(spark):
    """A pair busy in the batch and steady over the hour; not a resolver, not a target of many, not what lies before."""
    t0 = datetime(2024, 3, 1, 10)

    def row(i, minute, src="10.0.0.1", dst="8.8.8.8", **over):
        return reached(i, generated_time=t0 + timedelta(minutes=minute, seconds=i % 50), src_ip=src, dst_ip=dst, src_zone="trust", dst_zone="untrust", **over)

    steady = [row(i, i % 60) for i in range(130)]
    rows = steady + [row(200 + i, i % 60, dst="9.9.9.9", dst_port=53) for i in range(130)] + [row(400 + i, i % 60, dst="1.1.1.1") for i in range(130)] + [row(600 + i, 56, src=f"10.0.1.{i}", dst="1.1.1.1") for i in range(5)]
    rows += [row(700 + i, i % 6 - 70, dst="4.4.4.4") for i in range(130)] + [row(900 + i, 55 + i % 5, dst="4.4.4.4") for i in range(20)] + [row(950 + i, i % 60, dst="2.2.2.2", app="ping") for i in range(130)]
    stored = spark.createDataFrame(rows, LOGS)
    batch = stored.filter(F.col("generated_time") >= F.lit(t0 + timedelta(minutes=0)))
    got = R.persistent_contacts(batch, stored).collect()
    assert [(r.src_ip, r.dst_ip, r.connections, r.windows, r.users) for r in got] == [("10.0.0.1", "8.8.8.8", 130, 12, 1)]


def test_bars_come_from_the_newest_logs(spark):
    rows = [(i, "end", 10**9, 10**6) for i in range(50)] + [(100 + i, None, 10, 2) for i in range(9)] + [(200, "start", 10**12, 10**12), (201, "end", None, 4)]
    logs = spark.createDataFrame(rows, "log_id long, subtype string, bytes long, packets long").repartition(7)
    assert sorted(r.log_id for r in R.newest(logs, "log_id", 12, span=8).collect()) == [49, *range(100, 109), 200, 201]
    assert R.newest(logs, "log_id", 1000, span=8).count() == 61
    few = R.outlier_thresholds(logs, 100.0, 3.0, 10).head()
    assert (few.logs, few.byte_threshold) == (10, 100.0)  # nine logs with bytes are too few
    assert few.packet_threshold == pytest.approx(2.2 + 3 * 0.6)
    assert R.outlier_thresholds(logs, 100.0, 3.0).head().byte_threshold > 10**9


def test_the_query_counts_every_log(spark, tmp_path):
    """Large and many-packet logs are the oldest 200 of 2,000; bars over some newest logs would miss them."""
    at = datetime(2024, 1, 1)
    rows = [(i, at + timedelta(seconds=i), i % 50, "click", 500.0 if i < 200 else 1.0, '{"k": 19}' if i < 200 else '{"k": 1}') for i in range(2000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["outlier_threshold"](spark, str(tmp_path)).collect()
    large, packets = [55_000] * 200 + [110] * 1800, [20] * 200 + [2] * 1800
    bars = [round(mean(x) + 3 * pstdev(x), 3) for x in (large, packets)]
    assert [(r.logs, r.byte_threshold, r.packet_threshold) for r in got] == [(2000, *bars)]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert con.sql(catalog.ORACLE["outlier_threshold"]).fetchall() == [(2000, *bars)]


def test_rules_use_the_bars(spark):
    rows = [log(i, i, **INSIDE | {"bytes_sent": 1000 if i else 900_000}) for i in range(40)]
    logs = spark.createDataFrame(rows, SCHEMA).withColumn("bytes", F.col("bytes_sent"))
    hit = F.exists("matches", lambda m: m["code"] == "high_bytes_outlier")
    assert [r.log_id for r in U.evaluate(logs, C.Config(), R.outlier_thresholds(logs, 5000.0, 50.0)).filter(hit).collect()] == [0]
    assert not U.evaluate(logs).filter(hit).count()
