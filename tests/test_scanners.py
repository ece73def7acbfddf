"""Routing of scanners and the hour's list on hand-made rows, merged in any number of checks."""

import random

import pytest
from pyspark.sql import functions as F
from test_detection import INSIDE, SCHEMA, log

from emberlog.operators import rules as U
from emberlog.operators import scanners as SC


def scan(first, src, n=12, **over):
    return [log(first + i, i, **INSIDE | {"src_ip": src, "dst_port": 1000 + i} | over) for i in range(n)]


def test_only_scanning_sources_are_routed(spark):
    """One scans; one scans and guesses passwords; one has an open alert of another kind; one is inside; one has its own alert."""
    rows = scan(0, "45.33.0.1") + scan(100, "45.33.0.2") + [log(200 + i, i, **INSIDE | {"src_ip": "45.33.0.2", "dst_port": 22, "action": "deny"}) for i in range(6)]
    rows += scan(300, "45.33.0.3") + scan(400, "45.33.0.4") + scan(500, "10.9.0.9") + scan(600, "45.33.0.5")
    found = U.candidates(U.evaluate(spark.createDataFrame(rows, SCHEMA)))
    groups = U.groups(found)
    alerts = spark.createDataFrame([("45.33.0.3", "brute_force_like_attempts", "open"), ("45.33.0.4", "possible_port_scan", "open"), ("45.33.0.1", "deny_drop_action", "resolved")], "src_ip string, alert_type string, status string")
    own = groups.filter("group_src = '45.33.0.5'").select(SC.group_id().alias("group_id"))
    got = SC.routed(found, groups, alerts, own).collect()
    assert {r.src_ip for r in got} == {"45.33.0.1", "45.33.0.4"} and len(got) == 24


HOUR = SC.HOUR
LOGS = "log_id long, us long, src_ip string, dst_ip string, dst_port int, protocol string, packets_received long, session_end_reason string, live boolean"


def some(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, *[rng.randrange(2 * HOUR)] * 20]), rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["x", "y", None]), rng.choice([None, *range(12)]), rng.choice(["tcp", "icmp"]), rng.choice([0, 1, 3]), rng.choice(["tcp-rst-from-server", "aged-out"]), rng.random() < 0.8) for i in range(n)]


def plain(checks):
    listed, evidence = {}, set()
    for rows in checks:
        targets, answering = {}, {}
        for i, us, src, dst, port, protocol, back, reason, live in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[0])):
            key = us // HOUR * HOUR, src or "unknown"
            e = listed.setdefault(key, {"connections": 0, "targets": 0, "ports": [], "answered": 0, "ping": 0, "open": [], "answering": 0, "kept": 0})
            e["connections"] += 1
            targets.setdefault(key, set()).update({dst} - {None})
            if port is not None and port not in e["ports"] and len(e["ports"]) < 8:
                e["ports"].append(port)
            if back > 1 or back == 1 and reason != "tcp-rst-from-server":
                e["answered"] += 1
                answering.setdefault(key, set()).update({dst} - {None})
                if protocol == "icmp":
                    e["ping"] += 1
                elif port is not None and port not in e["open"] and len(e["open"]) < 8:
                    e["open"].append(port)
            if not live or e["kept"] < 20:
                e["kept"] += 1
                evidence.add(i)
        for key, seen in targets.items():
            listed[key]["targets"] = max(listed[key]["targets"], len(seen))
        for key, seen in answering.items():
            listed[key]["answering"] = max(listed[key]["answering"], len(seen))
    return {k: tuple(e.values()) for k, e in listed.items()}, evidence


@pytest.mark.parametrize("checks", [1, 3])
def test_list_equals_plain_counting(spark, checks):
    rows = some(checks, 420)
    parts = [rows[k::checks] for k in range(checks)]
    listed, kept = None, set()
    for part in parts:
        now, evidence = SC.hourly(spark.createDataFrame(part, LOGS), listed, F.col("live"))
        kept |= {r.log_id for r in evidence.collect()}
        listed = spark.createDataFrame(now.collect(), SC.LISTED)
    want, evidence = plain(parts)
    got = {(r.hour_us, r.address): (r.connections, r.targets, r.ports, r.answered, r.answered_ping, r.answered_ports, r.answering, r.kept) for r in listed.collect()}
    assert got == want and kept == evidence
    hours = {r.hour_us: (r.scanners, r.connections) for r in SC.hours(listed).collect()}
    assert hours == {h: (sum(k[0] == h for k in want), sum(e[0] for k, e in want.items() if k[0] == h)) for h in {k[0] for k in want}}


def test_busiest_scanners_stay(spark, monkeypatch):
    monkeypatch.setattr(SC, "SCANNERS_KEPT", 2)
    rows = [(i, 5, s, "x", 1, "tcp", 0, None, False) for i, s in enumerate("aabbbcd")]
    now, evidence = SC.hourly(spark.createDataFrame(rows, LOGS))
    assert {r.address for r in now.collect()} == {"a", "b"} and evidence.count() == 7
